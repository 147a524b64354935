"""Personal data: base patterns and a character tagger.

The base patterns find e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers with ``+``, all in time linear in the text.
A bidirectional LSTM over character classes with CRF transitions, trained in numpy from labelled spans, adds forms that the patterns miss
(local phone numbers, hosts without a dot, spaced addresses, cards with other separators). It reads every place of a text where such data
can stand: all kinds hold a digit or ``@``, so windows cover each such character with its context; a text without one has no span by definition.
Overlapping windows are decoded one by one and reconciled over the whole text: each character takes its tag from the window in which it
stands nearest the middle. An added span must hold the digits its kind demands and overlap no base span.

Edge cases: null and empty texts have no spans; very long texts are read whole, in windows; repeated rows give equal results; empty tables
give empty results; other columns are ignored (or passed through unchanged when masking).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wirelattice.llm.memory import trim
from wirelattice.sources.staging import deploy

KINDS = ("email", "ip", "card", "phone")
#: Length and stride of windows, context around a digit or @, windows decoded together.
WINDOW, STRIDE, CONTEXT, TOGETHER = 64, 32, 24, 1024
#: Training: hidden units, labelled examples, steps, examples a step, learning rate, seed.
HIDDEN, EXAMPLES, STEPS, BATCH, RATE, SEED = 16, 6000, 600, 64, 0.03, 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[Span]:
    """Each @ is tried once: every start of a match lies in the run of local characters that ends there."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind and start."""
    out = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# --- the tagger ---------------------------------------------------------------------------------------------

_MARKS = "@.-+() _%\n:/=\",[]#|!*$&"
CLASSES = 4 + len(_MARKS)
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def classes_of(points: np.ndarray) -> np.ndarray:
    """Character classes of code points: 0 other, 1 lower case and letters beyond ASCII, 2 upper case, 3 digit, then the marks."""
    table = np.zeros(129, np.int64)
    table[97:123], table[65:91], table[48:58], table[128] = 1, 2, 3, 1
    for i, mark in enumerate(_MARKS):
        table[ord(mark)] = 4 + i
    table[9] = table[13] = table[10]
    return table[np.minimum(points, 128)]


def labelled_examples(n: int, rng: np.random.Generator) -> tuple[list[str], list[list[Span]]]:
    """Windows of invented words with labelled personal data, or with numbers that are none."""
    pick = lambda items: items[int(rng.integers(len(items)))]
    some = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick(["th", "er", "on", "an", "re", "en", "la", "ou", "ti", "ment", "ó", "ü", "st"]) for _ in range(int(rng.integers(1, 4))))
    name = lambda: re.sub("[^a-z]", "x", word())

    def card(sep: str) -> str:
        body = "4" + some(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def ip(dot: str) -> str:
        return dot.join(str(int(rng.integers(1, 256))) for _ in range(4))

    makers = [
        ("email", lambda: f"{name()}.{some(2)}@{name()}.example.com"), ("email", lambda: f"{name()}@{name()}"), ("email", lambda: f"{name()}_{some(1)}@ {name()}.com"),
        ("ip", lambda: ip(".")), ("ip", lambda: ip(" . ")), ("ip", lambda: ip("[.]")),
        ("card", lambda: card("")), ("card", lambda: card(" ")), ("card", lambda: card("-")), ("card", lambda: card(".")), ("card", lambda: card("/")),
        ("phone", lambda: f"+{some(1)} ({some(3)}) {some(3)}-{some(4)}"), ("phone", lambda: f"({some(3)}) {some(3)}-{some(4)}"), ("phone", lambda: f"{some(3)}-{some(3)}-{some(4)}"), ("phone", lambda: f"00{some(2)} {some(3)} {some(3)} {some(3)}"), ("phone", lambda: f"{some(3)}.{some(3)}.{some(4)}"),
    ]
    others = [
        lambda: f'token = "{rng.bytes(12).hex()}"', lambda: f"password={rng.bytes(9).hex()}", lambda: f"{int(rng.integers(1900, 2100))}-{some(2)}-{some(2)}", lambda: some(int(rng.integers(1, 9))),
        lambda: f"{some(2)}:{some(2)}:{some(2)}", lambda: f"{some(1)}.{some(1)}.{some(2)}", lambda: " ".join(some(2) for _ in range(6)), lambda: f"{some(3)},{some(3)},{some(3)}", lambda: f"@{name()}", lambda: "a @ b", lambda: some(int(rng.integers(20, 30))),
        lambda: f"isbn {some(3)}-{some(1)}-{some(4)}-{some(4)}-{some(1)}", lambda: " | ".join(some(4) for _ in range(4)), lambda: "-".join(some(5) for _ in range(5)),
    ]
    texts, spans = [], []
    for i in range(n):
        text, found = "", []
        while len(text) < 2 * WINDOW:
            turn = rng.random()
            if turn < 0.35:
                kind, make = makers[(i + len(found)) % len(makers)]
                put = make()
                found.append((kind, len(text), len(text) + len(put)))
            else:
                put = pick(others)() if turn < 0.5 else " ".join(word() for _ in range(int(rng.integers(1, 6))))
            text += put + pick([" ", " ", " ", ". ", ", ", "\n", ": "])
        low = int(rng.integers(0, WINDOW)) if i % 4 else 0
        high = low + (WINDOW if i % 5 else int(rng.integers(12, WINDOW)))
        texts.append(text[low:high].ljust(WINDOW, "\0"))
        spans.append([(k, max(s, low) - low, min(e, high) - low) for k, s, e in found if s < high and e > low])
    return texts, spans


def tags_of(spans: list[Span]) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * KINDS.index(kind)
        out[start] -= 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """A bidirectional LSTM with CRF transitions; all weights in one dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Tagger:
        w = {}
        for d in "fb":
            w[f"x{d}"], w[f"h{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN)), rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return cls(w | {"o": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "a": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))})

    def lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, unit) of class windows (row, time); keep gets what the gradient needs."""
        wx, wh, c0 = self.w["x" + d], self.w["h" + d], self.w["c" + d]
        h = c = np.zeros((len(x), HIDDEN))
        out = np.empty((x.shape[1], len(x), HIDDEN))
        for t in range(x.shape[1]):
            z = wx[x[:, t]] + h @ wh + c0
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(z[:, 3 * HIDDEN :])
            last_c, last_h = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            out[t] = h = o * tc
            if keep is not None:
                keep.append((i, f, o, u, last_c, last_h, tc))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (time, row, tag)."""
        both = np.concatenate([self.lstm(x, "f"), self.lstm(x[:, ::-1], "b")[::-1]], axis=2)
        return both @ self.w["o"] + self.w["a"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence (row, time) of each window."""
        s, move = self.scores(x), self.w["t"]
        best, back = s[0], []
        for t in range(1, len(s)):
            through = best[:, :, None] + move
            back.append(through.argmax(1))
            best = through.max(1) + s[t]
        tag = best.argmax(1)
        out = [tag]
        for b in reversed(back):
            tag = b[np.arange(len(tag)), tag]
            out.append(tag)
        return np.stack(out[::-1], axis=1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the CRF's mean negative log likelihood, through both LSTMs."""
        n, steps = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        hf, hb = self.lstm(x, "f", kept["f"]), self.lstm(x[:, ::-1], "b", kept["b"])
        both = np.concatenate([hf, hb[::-1]], axis=2)
        s, move = both @ self.w["o"] + self.w["a"], self.w["t"]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha = [s[0]]
        for t in range(1, steps):
            alpha.append(lse(alpha[-1][:, :, None] + move, 1) + s[t])
        beta = [np.zeros((n, TAGS))]
        for t in range(steps - 1, 0, -1):
            beta.append(lse(move + (s[t] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        z = lse(alpha[-1], 1)[:, None]
        rows = np.arange(n)
        ds, dmove = np.empty_like(s), np.zeros_like(move)
        for t in range(steps):
            ds[t] = np.exp(alpha[t] + beta[t] - z)
            ds[t][rows, y[:, t]] -= 1
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + move + (s[t] + beta[t])[:, None, :] - z[:, :, None])
                dmove += pair.sum(0)
                np.add.at(dmove, (y[:, t - 1], y[:, t]), -1)
        ds /= n
        g = {"t": dmove / n, "o": np.einsum("tnh,tnk->hk", both, ds), "a": ds.sum((0, 1))}
        dboth = ds @ self.w["o"].T
        for d, dh_all, xs in (("f", dboth[:, :, :HIDDEN], x), ("b", dboth[::-1, :, HIDDEN:], x[:, ::-1])):
            wh = self.w["h" + d]
            gx, gh, gc = np.zeros_like(self.w["x" + d]), np.zeros_like(wh), np.zeros(4 * HIDDEN)
            dh = dc = np.zeros((n, HIDDEN))
            for t in range(steps - 1, -1, -1):
                i, f, o, u, last_c, last_h, tc = kept[d][t]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * last_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                np.add.at(gx, xs[:, t], dz)
                gh += last_h.T @ dz
                gc += dz.sum(0)
                dh, dc = dz @ wh.T, dc * f
            g |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        return g


_TRAINED: dict[tuple, Tagger] = {}


def trained(examples: int = EXAMPLES, steps: int = STEPS, seed: int = SEED) -> Tagger:
    """The tagger after training with Adam; the same for the same arguments, and trained once per process."""
    at = (examples, steps, seed)
    if at not in _TRAINED:
        rng = np.random.default_rng(seed)
        texts, spans = labelled_examples(examples, rng)
        x = np.stack([classes_of(np.frombuffer(t.encode("utf-32-le"), "<u4")) for t in texts])
        y = np.stack([tags_of(s) for s in spans])
        tagger = Tagger.fresh(rng)
        m1, m2 = ({k: np.zeros_like(v) for k, v in tagger.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = rng.choice(len(x), BATCH, replace=False)
            g = tagger.gradient(x[rows], y[rows])
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5 / (size + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                pace = RATE * (1 - 0.9 * step / steps)
                tagger.w[k] = tagger.w[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        _TRAINED[at] = tagger
    return _TRAINED[at]


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Class windows of a text and their starts: each digit and @ lies in one with CONTEXT characters on both sides."""
    cls = classes_of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    hits = np.flatnonzero((cls == 3) | (cls == 4))
    cuts = np.flatnonzero(np.diff(hits) > 2 * CONTEXT) + 1
    starts = []
    for part in np.split(hits, cuts):
        low, high = max(0, part[0] - CONTEXT), min(len(cls), part[-1] + CONTEXT + 1)
        starts += range(low, max(low + 1, high - WINDOW + STRIDE), STRIDE)
    begin = np.array(starts)
    padded = np.concatenate([cls, np.zeros(WINDOW, np.int64)])
    return padded[begin[:, None] + np.arange(WINDOW)], begin


def reconcile(begin: np.ndarray, tags: np.ndarray, length: int) -> list[Span]:
    """Spans over the whole text: a character takes its tag from the window in which it is nearest the middle."""
    place = begin[:, None] + np.arange(WINDOW)
    edge = np.broadcast_to(np.abs(2 * np.arange(WINDOW) - WINDOW + 1), place.shape)
    order = np.lexsort((edge.ravel(), place.ravel()))
    at, tag = place.ravel()[order], tags.ravel()[order]
    first = np.r_[True, np.diff(at) > 0] & (at < length)
    at, tag = at[first], tag[first]
    hot = np.flatnonzero(tag)
    at, tag = at[hot], tag[hot]
    if not len(at):
        return []
    kind = (tag - 1) // 2
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(kind) != 0) | (tag[1:] % 2 == 1)]
    heads = np.flatnonzero(new)
    return [(KINDS[kind[i]], int(at[i]), int(at[j - 1]) + 1) for i, j in zip(heads, [*heads[1:], len(at)], strict=True)]


def whole(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The span without blanks at its ends, grown over what it cuts: an address to its whole length, a number over digits
    and parentheses (up to WINDOW characters, more than any of its kinds has)."""
    while start < end and text[start] in " \n\t,:;":
        start += 1
    while end > start and text[end - 1] in " \n\t,:;.":
        end -= 1
    if kind == "email":
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        while end < len(text) and text[end] in _HOST:
            end += 1
        while end > start and text[end - 1] in ".-":
            end -= 1
        return start, end
    while start > 0 and end - start < WINDOW and text[start - 1] in _GROWN:
        start -= 1
    while end < len(text) and end - start < WINDOW and text[end] in _DIGITS:
        end += 1
    return start, end


_DIGITS, _GROWN = frozenset("0123456789"), frozenset("0123456789(")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
_LOCAL = _HOST | frozenset("_%+")


def plausible(kind: str, text: str) -> bool:
    """Whether a span holds what its kind demands."""
    digits = digits_of(text)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", text))
    if kind == "ip":
        parts = re.fullmatch(r"([0-9]{1,3})(?: ?\[?\.\]? ?([0-9]{1,3})){3}", text) and _IP_PARTS.findall(text)
        return bool(parts) and all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9]+(?:[ ./-]{1,2}[0-9]+)*", text))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\(?[0-9]+\)?(?:[ .-]{1,2}\(?[0-9]+\)?){2,5}", text))


_IP_PARTS = re.compile(r"[0-9]+")


def find_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Per text the base spans and all spans, both by kind and start."""
    base = [base_spans(t) for t in texts]
    cut = [(i, *windows_of(t)) for i, t in enumerate(texts) if _TRIGGER.search(t)]
    tags: list[np.ndarray] = []
    if cut:
        x = np.concatenate([w for _, w, _ in cut])
        tags = [tagger.decode(x[k : k + TOGETHER]) for k in range(0, len(x), TOGETHER)]
    flat = np.concatenate(tags) if tags else np.zeros((0, WINDOW), np.int64)
    out, at = [(b, b) for b in base], 0
    for i, _, begin in cut:
        mine = flat[at : at + len(begin)]
        at += len(begin)
        taken = sorted((s, e) for _, s, e in base[i])
        starts = np.array([s for s, _ in taken])
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, np.int64)
        added = []
        last = 0
        for kind, s, e in reconcile(begin, mine, len(texts[i])):
            s, e = whole(texts[i], s, e, kind)
            if s < last:
                continue
            before = int(np.searchsorted(starts, e)) if taken else 0
            if (not before or reach[before - 1] <= s) and plausible(kind, texts[i][s:e]):
                added.append((kind, s, e))
                last = e
        if added:
            out[i] = (base[i], sorted(base[i] + added, key=lambda x: (KINDS.index(x[0]), x[1])))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"<{kind.upper()}>"]
        end = max(end, e)
    return "".join(out) + text[end:]


#: Texts that are read together, as characters.
BLOCK_CHARS = 2_000_000


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= BLOCK_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def detect(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base_sha256, spans (all of them), n_added."""
    deploy(docs.sparkSession)
    tagger = trained()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks, spans, added = {k: [] for k in KINDS}, [], [], []
            for block in _blocks(batch.column(1).to_pylist()):
                for base, every in find_spans(block, tagger):
                    for k in KINDS:
                        counts[k].append(sum(x[0] == k for x in base))
                    marks.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(every))
                    added.append(len(every) - len(base))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(marks, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
        trim()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def mask_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns with the spans in ``text`` masked; null texts stay null; ``n_chars``, if there, follows the text."""
    deploy(docs.sparkSession)
    tagger = trained()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = [masked(t, every) for block in _blocks(texts) for t, (_, every) in zip(block, find_spans(block, tagger), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else m for t, m in zip(texts, out, strict=True)], batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if t is None else len(m) for n, t, m in zip(columns[k].to_pylist(), texts, out, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        trim()

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
