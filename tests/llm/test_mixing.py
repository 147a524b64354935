import random

from wirelattice.llm import mixing


def water(sizes):
    """Shares by weight, excess shared again until no source is above three times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, free, out = sum(sizes.values()), set(sizes), {}
    while True:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * sizes[s]} if w else set()
        if not over:
            return out | {s: rest * weight[s] / w for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        free -= over


def rows_of(n, seed, sources):
    r = random.Random(seed)
    return [(i, "w " * min(2000, int(r.lognormvariate(4, 1))), r.choice(sources)) for i in range(n)]


def test_targets_and_taken_words(spark, documents):
    rows = rows_of(1500, 1, ["a"] * 20 + ["b", "é", "Z", None])
    decided, by = mixing.copies(documents(rows))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, got = water(sizes), {r["source"]: r for r in by.collect()}
    assert {s: r["source_size"] for s, r in got.items()} == sizes
    assert all(abs(got[s]["target"] - want[s]) < 1e-6 * want[s] + 1e-6 for s in want)
    d = decided.collect()
    assert sorted(r["doc_id"] for r in d) == list(range(1500)) and all(0 <= r["copies"] <= 3 for r in d)
    for s in want:
        taken = sum(r["copies"] * r["size"] for r in d if r["source"] == s)
        assert abs(taken - want[s]) <= max(r["size"] for r in d if r["source"] == s) / 2 + 1e-6


def test_reruns_agree(spark, documents):
    rows = rows_of(700, 2, ["a", "b", "c", "d"])
    pick = lambda docs: sorted(map(tuple, mixing.copies(docs)[0].select("doc_id", "copies").collect()))
    assert pick(documents(rows)) == pick(documents(rows[::-1]).repartition(7))


def test_rounding_keeps_expectations(spark, documents):
    # each document's copies average near its source's rate over many ids
    rows = [(i, "w " * 10, "a") for i in range(3000)] + [(5000 + i, "w " * 10, "b") for i in range(3000)]
    d = mixing.copies(documents(rows))[0].groupBy("source").avg("copies").collect()
    assert {r[0]: round(r[1], 2) for r in d} == {"a": 0.67, "b": 1.33}


def test_documents_are_repeated_whole(spark, documents):
    rows = [*rows_of(300, 3, ["a", "b"]), (7, rows_of(300, 3, ["a", "b"])[7][1], rows_of(300, 3, ["a", "b"])[7][2])]
    docs = documents(rows)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    n = mixing.copies(docs)[0].groupBy().sum("copies").first()[0]
    assert out.count() == n


def test_edge_cases(spark, documents, hard):
    docs = documents(hard)
    d = mixing.copies(docs)[0]
    assert d.count() == len(hard) and mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.copies(docs.limit(0))[0].count() == 0
    assert mixing.mix_documents(documents([(1, "", "a"), (2, None, None)])).count() == 0


def test_an_id_that_most_rows_repeat(spark, documents):
    """The group's mass is kept and its rows differ by one copy at most."""
    rows = [(7, "one two three", "a")] * 3000 + [(i, "w " * (i % 9 + 1), "b") for i in range(100, 400)]
    decided, by = mixing.copies(documents(rows))
    got, target = decided.collect(), {r["source"]: r["target"] for r in by.collect()}
    same = [r["copies"] for r in got if r["doc_id"] == 7]
    assert len(got) == len(rows) and len(same) == 3000 and max(same) - min(same) <= 1
    for source in "ab":
        assert abs(sum(r["copies"] * r["size"] for r in got if r["source"] == source) - target[source]) <= 9
    assert mixing.mix_documents(documents(rows)).where("doc_id = 7").count() == sum(same)
