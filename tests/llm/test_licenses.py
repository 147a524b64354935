import random
import re

import pytest

from wirelattice.llm import licenses as lic


def words(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).split()


def shingles(w):
    return {tuple(w[i : i + lic.WORDS]) for i in range(len(w) - lic.WORDS + 1)}


def contained(rows):
    """(doc_id, license) whose template's shingles the whole text holds to 0.8 or more."""
    out = set()
    for i, t, _ in rows:
        mine = shingles(words(t))
        for name, text in lic.TEMPLATES.items():
            want = shingles(words(text))
            if want and len(mine & want) >= lic.CONTAINED * len(want):
                out.add((i, name))
    return out


def test_against_brute_force(spark, documents, hard):
    r = random.Random(4)
    fill = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = list(hard)
    for k, (name, text) in enumerate(lic.TEMPLATES.items()):
        rows.append((100 + k, f"{fill(r.randint(0, 90))}\n{text}.\n{fill(r.randint(0, 90))}", "s"))
        w = text.split()
        if len(w) > 25:
            w[len(w) // 2] = "changed"
            rows.append((200 + k, fill(33) + " " + " ".join(w).upper(), "s"))
            rows.append((300 + k, fill(10) + " " + " ".join(text.split()[: len(w) // 2]), "s"))
    got = {(x["doc_id"], x["license"]) for x in lic.scan(documents(rows)).collect()}
    assert got == contained(rows)


def test_collision_probability(spark):
    """Of a window that holds 0.8 of a piece: above 0.999 for every template."""
    for p in lic.pieces(spark, lic.TEMPLATES).collect():
        m, w = len(p["items"]), p["scale"] * 3 // 2 - lic.WORDS + 1
        need = max(1, -(-m * 8 // 10))
        s = need / (max(w, need) + m - need)
        assert 1 - (1 - s) ** lic.HASHES > 0.999, p["license"]


@pytest.mark.parametrize("shift", range(0, 70, 7))
def test_any_offset(spark, documents, shift):
    rows = [(1, "zz " * shift + lic.TEMPLATES["CC-BY-NC-4.0"], "s"), (2, "zz " * shift + lic.TEMPLATES["MIT-permission"] + " zz" * 50, "s")]
    assert {(x["doc_id"], x["license"]) for x in lic.scan(documents(rows)).collect()} == {(1, "CC-BY-NC-4.0"), (2, "MIT-permission")}


def test_empty(spark, documents, hard):
    assert lic.scan(documents(hard).limit(0)).count() == 0
    assert lic.scan(documents(hard), {}).count() == 0
