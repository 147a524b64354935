import math

import numpy as np
from pyspark.sql import functions as F

from wirelattice.llm import ann


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, list string, v string")


def brute(rows, every=20, n=20):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ ok[q]
        order = [k for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:n]
        out[int(q)] = [(int(ids[k]), s[k]) for k in order]
    return out


def clustered(n, dim, seed, norms=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + 0.35 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms:
        x *= rng.uniform(0.5, 2, n)[:, None]
    return [(i, [float(a) for a in v.astype(np.float32)]) for i, v in enumerate(x)]


def recall(spark, rows):
    got = {}
    for r in ann.search(table(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows)
    assert set(got) == set(want)
    hits = []
    for q, best in want.items():
        mine = [got[q][k] for k in sorted(got[q])]
        assert [k for k in sorted(got[q])] == list(range(1, len(best) + 1)) and q not in [i for i, _ in mine]
        assert mine == sorted(mine, key=lambda t: (-t[1], t[0]))
        hits.append(len({i for i, _ in mine} & {i for i, _ in best}) / len(best))
    return float(np.mean(hits))


def test_recall(spark):
    assert recall(spark, clustered(3000, 32, 1)) >= 0.9
    assert recall(spark, clustered(2000, 24, 2, norms=True)) >= 0.9


def test_hot_vector_and_ties(spark):
    rows = clustered(300, 16, 3)
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(200)]
    got = ann.search(table(spark, rows), F.col("vec_id") % 20 == 0).where("query_id = 1100").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [7, *range(1000, 1019)]
    own = ann.search(table(spark, rows), F.col("vec_id") == 1000).orderBy("rank").collect()
    assert [r["vec_id"] for r in own] == [7, *range(1001, 1020)]


def test_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "CHUNK", 5)
    assert recall(spark, clustered(900, 16, 5)) >= 0.9


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (20, [0.0, 1.0]), (9, [])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(table(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 8, 1.0), (0, 2, 6, 0.5), (0, 3, 20, 0.0), (20, 1, 6, 0.5), (20, 2, 0, 0.0), (20, 3, 8, 0.0)]
    assert ann.search(table(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(table(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_lists_that_hold_too_few_are_topped_up(spark):
    """Tiny far clusters beside a large one: every query still gets all it can."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (900, 8)) + 20, *(rng.normal(0, 0.1, (3, 8)) + c for c in rng.normal(0, 60, (20, 8)))])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.search(rows, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert len(out) == 48 and {r["count"] for r in out} == {ann.NEAREST}


def test_recall_on_the_embeddings_table(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    table = spark.read.parquet(path)
    rows = ann.usable(table).collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    hit = total = 0
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit, total = hit + len(best & got[int(ids[q])]), total + len(best)
    assert hit >= 0.9 * total
