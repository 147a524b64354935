import hashlib
import random
import re

import numpy as np

from wirelattice.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    ok = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m)),
        "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in p.finditer(text) if ok[k](m[0])]


def test_base_spans_against_the_patterns():
    r = random.Random(5)
    for i in range(20_000):
        text = "".join(r.choice("a@.-_%+1 2(3)9b5\né" if i % 3 else "1234.5 -+") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1(" * 70_000, "@" * 100_000):
        pii.base_spans(text)


def test_tagger_on_new_windows():
    tagger = pii.trained()
    texts, spans = pii.labelled_examples(400, np.random.default_rng(77))
    x = np.stack([pii.classes_of(np.frombuffer(t.encode("utf-32-le"), "<u4")) for t in texts])
    assert (tagger.decode(x) == np.stack([pii.tags_of(s) for s in spans])).mean() > 0.97


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    t = pii.Tagger.fresh(rng)
    x, y = rng.integers(0, pii.CLASSES, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))

    def loss():
        s, move, total = t.scores(x), t.w["t"], 0.0
        for i in range(3):
            a = s[0, i]
            for k in range(1, 6):
                a = np.log(np.exp(a[:, None] + move).sum(0)) + s[k, i]
            total += np.log(np.exp(a).sum()) - sum(s[k, i, y[i, k]] for k in range(6)) - sum(move[y[i, k - 1], y[i, k]] for k in range(1, 6))
        return total / 3

    g = t.gradient(x, y)
    for name in t.w:
        at = tuple(int(rng.integers(d)) for d in t.w[name].shape)
        keep = t.w[name][at]
        t.w[name][at] = keep + 1e-5
        up = loss()
        t.w[name][at] = keep - 1e-5
        down = loss()
        t.w[name][at] = keep
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6, name


def test_added_spans():
    texts = ["call (555) 123-4567 now", "mail joe@localhost please", "at 10 . 2 . 33 . 4 there", "it was 1999-12-31 12:30:55", "sha 0123456789abcdef0123 and v 1.2.33"]
    got = [[(k, t[s:e]) for k, s, e in every] for t, (_, every) in zip(texts, pii.find_spans(texts, pii.trained()))]
    assert got == [[("phone", "(555) 123-4567")], [("email", "joe@localhost")], [("ip", "10 . 2 . 33 . 4")], [], []]


def test_windows_are_reconciled_over_long_texts():
    unit = "some words here a.b@c.de and (555) 123-4567 more of them "
    one = pii.find_spans([unit * 3], pii.trained())[0][1]
    many = pii.find_spans([unit * 400], pii.trained())[0][1]
    assert len(many) >= len(one) / 3 * 400 * 0.95 and all(k in pii.KINDS and s < e for k, s, e in many)
    digits = pii.find_spans(["7" * 50_000], pii.trained())[0]
    assert digits == ([], [])


def test_documents(spark, documents, hard):
    rows = [*hard, (20, "write to ann.lee@mail.example.com or 192.168.0.1, +1 (275) 555-2469, 4111 1111 1111 1111", "a")]
    got = {r["doc_id"]: r for r in pii.detect(documents(rows)).collect()}
    assert got[20]["n_email"] == got[20]["n_ip"] == got[20]["n_card"] == got[20]["n_phone"] == 1
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(rows[-1][1]))
    assert got[20]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[20]["spans"] == want
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    docs = documents(rows)
    out = pii.mask_documents(docs)
    assert out.columns == docs.columns
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert text[20][0] == "write to <EMAIL> or <IP>, <PHONE>, <CARD>" and text[20][1] == len(text[20][0]) and text[1] == (None, None)
    assert pii.detect(docs.limit(0)).count() == 0 and pii.mask_documents(docs.limit(0)).count() == 0


def test_an_address_is_never_cut():
    long = "abcdefghij" * 6
    text = f"write to {long}@intranet or to x@y now"
    added = [("email", s, e) for s, e in [pii.whole(text, text.index("@intranet") - 5, text.index("@intranet") + 4, "email")]]
    assert text[added[0][1] : added[0][2]] == long + "@intranet"
