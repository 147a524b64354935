import hashlib
import random

import numpy as np
import pytest

from wirelattice.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.default_file())
    t.no_truncation()
    t.no_padding()
    return t


def check(reference, texts):
    own = bpe.WordBPE(bpe.default_file())
    for text, packed, want in zip(texts, own.encode(texts), reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == want.ids, text[:80]
        assert own.decode(packed) == reference.decode(want.ids, skip_special_tokens=False)


def test_equals_the_library(reference):
    r = random.Random(3)
    letters = "aabcdeinorst'éÜßΣσςİǅ ñ漢字0123456789½²!?.,#$ ́ \x1c\x85\U0001f600<|>/"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    special = ["", " ", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|endoftext|", "it's we'll they'd I'm you've he're 'S", "aaaa aaaaaaa aaa", "abababababab", "x" * 3000, "ΑΣ ΣΑΣ", "é É"]
    check(reference, texts + special)


def test_blocks_do_not_change_results(reference, monkeypatch):
    texts = ["alpha beta gamma"] * 5 + ["delta epsilon"] * 5
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    check(reference, texts)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    assert [t for b in bpe.blocks(texts) for t in b] == texts


def test_documents(spark, documents, hard, reference):
    rows = sorted(bpe.encode_documents(documents(hard), bpe.default_file(), with_ids=True).collect(), key=str)
    assert len(rows) == len(hard)
    by = {i: t for i, t, _ in hard}
    for r in rows:
        want = reference.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids
        packed = np.array(want, "<u4").tobytes()
        assert r["n_tokens"] == len(want) and bytes(r["ids"]) == packed and r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(documents(hard).limit(0), bpe.default_file()).count() == 0


def test_every_code_point_encodes_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    from wirelattice.llm.bpe import default_file, encoder

    library, own = tokenizers.Tokenizer.from_file(default_file()), encoder(default_file())
    library.no_truncation()
    library.no_padding()
    texts = ["a" + chr(c) + "b " + 2 * chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    wrong = []
    for low in range(0, len(texts), 50_000):
        part = texts[low : low + 50_000]
        want = library.encode_batch(part, add_special_tokens=False)
        for t, w, packed in zip(part, want, own.encode(part), strict=True):
            if w.ids != [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]:
                wrong.append(hex(ord(t[1])))
    assert not wrong
