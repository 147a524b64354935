"""Byte-pair encoding over a pair occurrence index.

All distinct words of a block of texts are laid out as one array of symbols. An index maps each mergeable pair
(by its rank) to all its positions; active ranks are taken in ascending order from a heap, all positions of the
rank merge at once, and the lists of the pairs that appear to their left and right are extended. A pair of a lower rank that a merge creates goes
back on the heap, so each word sees its merges in exactly the order that a word-by-word encoder applies.

Edge cases: null and empty texts have no tokens; very long texts are split into words and so never change the
result; repeated rows are encoded once each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wirelattice.llm.memory import trim
from wirelattice.sources.staging import deploy

#: Characters of text that are encoded together; words kept between blocks of a task's texts.
BLOCK_CHARS, KEPT_WORDS = 5_000_000, 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]

#: Lower cases of capitals that are newer than this Python's Unicode tables.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

#: Code points that the letters and numbers of ``regex`` have and those of the library (Unicode 16) have not.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F "
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _ranges(runs: str) -> str:
    return "".join("-".join(f"\\U{x:0>8}" for x in run.split("-")) for run in runs.split())


class WordBPE:
    """Encoder and decoder of a tokenizer file with word ends, lower case and white space dropped."""

    def __init__(self, file: str):
        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.width = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.width
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.left, self.right, self.made = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        keys = self.left * self.width + self.right
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) > 0] if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks = keys[order][first], order[first]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split).findall
        # slower, for texts that hold later letters
        exact = split.replace(r"\p{L}", rf"[\p{{L}}--[{_ranges(LATER)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_ranges(LATER_NUMBERS)}]]")
        self.exact = regex.compile(exact, regex.V1).findall
        self.later = re.compile(f"[{_ranges(LATER + LATER_NUMBERS)}]").search
        self.capital = re.compile(f"[{''.join(map(chr, NEWER))}]").search
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols; -1 for pairs that never merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Per word its ids, packed as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - size] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that start at these positions."""
            rank = self.rank(sym[at], sym[after[at]])
            live = rank >= 0
            at, rank = at[live], rank[live]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        add(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            nxt = after[at]
            at = at[(sym[at] == a) & (nxt >= 0) & (sym[nxt] == b)]
            if a == b and len(at) > 1:  # aaa: from the left, every other one of a run
                joined = np.r_[False, after[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            sym[at], sym[gone] = self.made[r], -1
            after[at] = then
            more = then >= 0
            before[then[more]] = at[more]
            left = before[at]
            add(np.unique(np.concatenate([left[left >= 0], at[more]])))
        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        upto = (np.cumsum(alive)[ends - 1] * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *upto], upto, strict=False)]

    def pieces(self, text: str) -> list[str | int]:
        """Words after normalisation, with special tokens as their ids."""
        if "<|" not in text:
            return self.plain(text)
        out: list[str | int] = []
        at = 0
        for m in self.marks.finditer(text):
            out += [*self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        # each character is lowered by itself: no final sigma
        bare = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if bare.isascii():
            return self.words(bare)
        if self.capital(bare):
            bare = bare.translate(NEWER)
        return self.exact(bare) if self.later(bare) else self.words(bare)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its packed ids."""
        split = [self.pieces(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list({w for words in split for w in words})
        plain = [w for w in new if isinstance(w, str)]
        if plain:
            self.known.update(zip(plain, self.encode_words(plain), strict=True))
        self.known.update((w, w.to_bytes(4, "little")) for w in new if isinstance(w, int))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        """The tokens, joined by spaces: the file has no decoder of its own."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about BLOCK_CHARS characters."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= BLOCK_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


_ENCODERS: dict[str, WordBPE] = {}


def encoder(file: str) -> WordBPE:
    """The encoder of a file, built once per Python worker."""
    if file not in _ENCODERS:
        _ENCODERS[file] = WordBPE(file)
    return _ENCODERS[file]


def encode_documents(docs: DataFrame, file: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ``ids`` (packed)."""
    deploy(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file)
        for batch in batches:
            low = 0
            for block in blocks(batch.column(1).to_pylist()):
                n, ids, back, raw = [], [], [], []
                for packed in bpe.encode(block):
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
                    if with_ids:
                        raw.append(packed)
                columns = [batch.column(0).slice(low, len(n)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                low += len(n)
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.known = {}  # the worker may live on for other work
        trim()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_file())
