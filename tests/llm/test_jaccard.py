import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wirelattice.llm import jaccard, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent, k):
    sets, parent = [shingle_set(t, k) for _, t, _ in rows], {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _, _), s in zip(rows, sets)), key=str)


def near(r, words, rate):
    out = []
    for w in words:
        x = r.random()
        out += [] if x < rate / 3 else [w, "new" + str(r.randrange(10**6))] if x < 2 * rate / 3 else ["sub" + str(r.randrange(10**6))] if x < rate else [w]
    return out


def corpus(seed):
    """Exact and near copies at all similarities, chains, shared passages, tiny documents, documents around ring edges."""
    r = random.Random(seed)
    fresh = lambda n: ["w" + str(r.randrange(10**7)) for _ in range(n)]
    rows, passage = [], fresh(60)
    for n in (3, 4, 5, 7, 9, 12, 20, 40, 90, 200, 400):
        base = fresh(n)
        for rate in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08):
            rows.append(" ".join(near(r, base, rate)))
        chain = base
        for _ in range(5):
            chain = near(r, chain, 0.02)
            rows.append(" ".join(chain).upper())
        rows.append(" ".join(fresh(n) + passage + fresh(n)))
    r.shuffle(rows)
    return [(i * 3, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize(("percent", "k"), [(85, 4), (80, 5)])
def test_against_brute_force(spark, documents, percent, k):
    rows = corpus(k)
    got = jaccard.components(documents(rows).repartition(5), percent, k).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, percent, k)


def test_dense_group_below_the_threshold(spark, documents, monkeypatch):
    r = random.Random(9)
    base = ["w" + str(i) for i in range(150)]
    rows = [(i, " ".join(near(r, base, r.choice([0.01, 0.03, 0.05]))), "s") for i in range(120)]
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "TOGETHER", 7)
    assert sorted(map(tuple, jaccard.components(documents(rows)).collect()), key=str) == brute(rows, 85, 4)


@pytest.mark.parametrize("spare", jaccard.LEVELS)
def test_two_linked_sets_share_a_cell_that_both_keep(spare):
    """Whatever other members the cells have: each set leaves the first cells of the common order."""
    rng, rings = np.random.default_rng(1), jaccard.Rings(spare=spare)
    for n in (5, 6, 7, 8, 9, 12, 13, 14, 30, 31, 100, 337, 1000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = int(0.15 * len(a))
            fresh = rng.integers(0, 2**63, int(rng.integers(0, max(1, most))))
            b = np.unique(np.concatenate([a[int(rng.integers(0, most + 1)) :], fresh.astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                (ka, la), (kb, lb) = jaccard.cells(a, rings), jaccard.cells(b, rings)
                members = {int(k): int(rng.integers(2, 6)) for k in np.intersect1d(ka, kb)}
                for k in (*ka, *kb):
                    members.setdefault(int(k), int(rng.integers(1, 6)))
                kept = []
                for keys, leaves in ((ka, la), (kb, lb)):
                    kept.append(set())
                    for odd in (0, 1):
                        mine = [k for k in map(int, keys) if k >> 1 & 1 == odd and members[k] > 1]
                        mine.sort(key=lambda k: (-(k & 1), -members[k], k))
                        kept[-1].update(mine[leaves[odd] :])
                assert kept[0] & kept[1], n


def test_a_passage_in_most_documents(spark, documents, monkeypatch):
    """Popular cells are left and finer slices taken, and no link is lost."""
    r = random.Random(4)
    passage = ["p" + str(i) for i in range(60)]
    rows = []
    for i in range(60):
        base = ["w" + str(r.randrange(10**7)) for _ in range(r.choice([8, 40, 100]))]
        rows.append((2 * i, " ".join(base + passage), "s"))
        rows.append((2 * i + 1, " ".join(near(r, base, r.choice([0.0, 0.03, 0.1])) + passage), "s"))
    monkeypatch.setattr(jaccard, "SMALL", 1)
    assert sorted(map(tuple, jaccard.components(documents(rows)).collect()), key=str) == brute(rows, 85, 4)


def test_shingle_hashes_follow_words():
    texts = ["A b\tC d e", "a B c D E", "ab c d e", "", None, " \n", "one", "one two", "é ü ß x", "x" * 9000 + " y z w", "x" * 9001 + " y z w"]
    sets = [frozenset(s.tolist()) for s in shingles.shingle_sets(pa.array([t or "" for t in texts]), 4)]
    want = [shingle_set(t, 4) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])
    sliced = pa.array(texts[:4] + ["q r s t u"]).slice(4)
    assert len(next(shingles.shingle_sets(sliced, 4))) == 2


def test_edge_cases(spark, documents, hard):
    docs = documents(hard)
    assert sorted(map(tuple, jaccard.components(docs).collect()), key=str) == brute(hard, 85, 4)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert jaccard.components(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0
