"""Approximate nearest neighbours by an adaptive dimension scan inside probed lists.

Vectors are lifted by one coordinate, sqrt(M**2 - |x|**2) with M the largest norm, so that the largest inner product is the smallest
distance. An index of lists (k-means centroids, fitted on a bounded sample) and a random rotation are made once; every
vector goes to the list of its nearest centroid. A query probes its nearest lists, as many as the sample needs for a recall of RECALL. Within a block of a list the rotated coordinates are scanned in
column blocks: after each, a candidate's partial distance, scaled up to all dimensions, is tested against the distance of the 21st best
so far; if it exceeds it by more than the test's margin the candidate is abandoned. Survivors get the exact inner product of
the original vectors in double precision. A query whose lists hold fewer vectors than asked for goes on through all lists.

Equal vectors are one class of which the 21 smallest ids are candidates (no query can use more), and equal queries are searched once, so a vector
that a third of all rows share costs no more than any other. Lists are cut into blocks of bounded size, queries of a list into chunks.

Edge cases: null ids and vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; a repeated vec_id counts once (its smallest vector); ties go to the smaller vec_id; with fewer candidates than asked all are returned;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelattice.sources.staging import deploy, materialise

#: Neighbours asked for; rows that the index is fitted on at most; lists at most; k-means rounds; seed.
NEAREST, SAMPLE, LISTS, ROUNDS, SEED = 20, 20_000, 1024, 12, 11
#: Candidates in a block of a list, queries in a chunk, columns that are scanned between two tests, margin of the test.
BLOCK, CHUNK, COLUMNS, MARGIN = 4096, 1024, 16, 2.1
#: Candidates of a block that are scanned together; share of live pairs above which a column block is one matrix product.
STEP, DENSE = 1024, 0.2
#: Recall in the sample for which the number of probed lists is chosen, and sample queries that measure it.
RECALL, TRIALS = 0.97, 300


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, one per id, in double precision."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


class Index:
    """Centroids of the lists and the rotation, fitted on a sample."""

    def __init__(self, sample: np.ndarray, top: float, rows: int):
        rng = np.random.default_rng(SEED)
        x = lifted(sample, top)
        self.top, self.dim = top, x.shape[1]
        q, r = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))
        self.rotation = q * np.sign(np.diag(r))
        k = max(1, min(LISTS, int(np.sqrt(rows) / 2), len(x) // 8))
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = self.nearest(x, centres, 1)[:, 0]
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            count = np.bincount(near, minlength=k)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        self.centres = centres
        self.probes = self._probes(sample, near)

    def _probes(self, sample: np.ndarray, near: np.ndarray) -> int:
        """The fewest lists with which queries from the sample find RECALL of their nearest in the sample."""
        asked = sample[:TRIALS]
        score = asked @ sample.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        best = np.argpartition(-score, min(NEAREST, len(sample) - 1), axis=1)[:, :NEAREST]
        order = np.argsort(self._spread(asked), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(self.centres))[None, :], axis=1)
        need = np.sort(np.take_along_axis(place, near[best], axis=1).ravel()) + 1
        return int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))])

    def _spread(self, queries: np.ndarray) -> np.ndarray:
        """Distances (up to a constant) of queries, scaled to norm M and lying flat, to the centroids."""
        x = np.concatenate([queries * (self.top / np.sqrt((queries * queries).sum(1)))[:, None], np.zeros((len(queries), 1))], axis=1)
        return (self.centres * self.centres).sum(1) - 2 * x @ self.centres.T

    @staticmethod
    def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        d = (centres * centres).sum(1) - 2 * x @ centres.T
        n = min(n, len(centres))
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(len(centres)), (len(x), n))
        return part

    def lists(self, x: np.ndarray, query: bool) -> np.ndarray:
        """The list of each row; of a query, the lists that it probes (only its direction matters)."""
        if not query:
            return self.nearest(lifted(x, self.top), self.centres, 1)
        n = min(self.probes, len(self.centres))
        return np.argsort(self._spread(x), axis=1)[:, :n]


def fit(rows: DataFrame) -> Index | None:
    """An index from SAMPLE rows at most (those with the smallest hash of their id); None for an empty table."""
    stats = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top"), F.count("*").alias("n")).first()
    if not stats["n"]:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    return Index(np.stack([np.asarray(v, float) for v in sample]), float(stats["top"]), int(stats["n"]))


def assign(rows: DataFrame, index: Index, query: bool) -> DataFrame:
    """Each row with its list, or each query with every list that it probes: vec_id, v, list."""
    deploy(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = index.lists(x, query)
                at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["vec_id", "v", "list"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, list int")


def scan(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, index: Index, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the best ``keep`` candidates of a block for each query, nearest first."""
    n, dim = len(queries), index.dim
    flat = np.concatenate([queries * (index.top / np.sqrt((queries * queries).sum(1)))[:, None], np.zeros((n, 1))], axis=1) @ index.rotation
    turned = lifted(vectors, index.top) @ index.rotation
    bound = np.full(n, np.inf)
    found_q, found_c, found_s = (np.zeros(0, t) for t in (np.int64, np.int64, float))
    low = 0
    while low < len(ids):
        part = slice(low, low + (STEP if low else 8 * keep))  # a few first, for a bound
        far = np.zeros((n, len(ids[part])))
        live = np.ones(far.shape, bool)
        for at in range(0, dim, COLUMNS):
            cols = slice(at, min(at + COLUMNS, dim))
            a, b = flat[:, cols], turned[part, cols]
            if live.mean() > DENSE:
                far += np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)
            else:
                q, c = np.nonzero(live)
                diff = a[q] - b[c]
                far[q, c] += (diff * diff).sum(1)
            done = cols.stop
            reach = (1 + MARGIN / np.sqrt(done)) ** 2 if done < dim else 1 + 1e-9
            live &= far * (dim / done) <= (bound * reach)[:, None]
        q, c = np.nonzero(live)
        score = (queries[q] * vectors[low + c]).sum(1)
        found_q, found_c, found_s = np.concatenate([found_q, q]), np.concatenate([found_c, low + c]), np.concatenate([found_s, score])
        order = np.lexsort((ids[found_c], -found_s, found_q))
        found_q, found_c, found_s = found_q[order], found_c[order], found_s[order]
        first = np.r_[True, np.diff(found_q) > 0] if len(found_q) else np.zeros(0, bool)
        rank = np.arange(len(found_q)) - np.maximum.accumulate(np.where(first, np.arange(len(found_q)), 0))
        best = rank < keep
        found_q, found_c, found_s, rank = found_q[best], found_c[best], found_s[best], rank[best]
        last = rank == keep - 1
        norm = np.sqrt((queries * queries).sum(1))
        # |q'|^2 = |x'|^2 = M^2: distance^2 = 2 M^2 - 2 M <q, x> / |q|
        low = part.stop
        bound[found_q[last]] = 2 * index.top**2 - 2 * index.top * found_s[last] / norm[found_q[last]] + 1e-9 * index.top**2
    return found_q, ids[found_c], found_s


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """For each row that ``is_query`` (over vec_id) selects, its ``nearest`` rows: query_id, rank, vec_id, score."""
    deploy(vectors.sparkSession)
    keep = nearest + 1
    rows = materialise(usable(vectors), "ann-rows")
    # vectors of another length than most have no inner product with the rest
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (length["n"] if length else 0))
    index = fit(rows)
    result = "q long, id long, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= keep).drop("r")
    placed = materialise(assign(few, index, False), "ann-lists")
    asked = rows.where(is_query)
    # a class of equal queries is named by its smallest id
    one = materialise(asked.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "ann-queries")
    size = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"q": [], "id": [], "score": []}).astype({"q": "int64", "id": "int64"})
        q, c = q.sort_values("vec_id"), c.sort_values("vec_id")
        at, ids, score = scan(np.stack(q["v"].to_list()), c["vec_id"].to_numpy(), np.stack(c["v"].to_list()), index, keep)
        return pd.DataFrame({"q": q["vec_id"].to_numpy()[at], "id": ids, "score": score})

    def answers(probing: DataFrame) -> DataFrame:
        """(q, found): the best ``keep`` of the lists that each query probes."""
        count = probing.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        cut = size.join(count, "list")
        block, chunk = F.pmod(F.xxhash64("vec_id"), F.col("blocks")), F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
        candidates = placed.join(cut, "list").withColumn("block", block).withColumn("chunk", spread("chunks"))
        questions = probing.join(cut, "list").withColumn("chunk", chunk).withColumn("block", spread("blocks"))
        key = ["list", "block", "chunk"]
        grouped = questions.select(*key, "vec_id", "v").groupBy(*key)
        met = grouped.cogroup(candidates.select(*key, "vec_id", "v").groupBy(*key)).applyInPandas(run, result)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        top = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).select("q", "id", "score")
        near = F.struct((-F.col("score")).alias("far"), "id")
        return materialise(top.groupBy("q").agg(F.collect_list(near).alias("found")), "ann-found")  # at most keep of them

    top = answers(assign(one, index, True))
    # a query whose lists hold too few goes on through all lists
    full = top.where(F.size("found") >= min(keep, placed.count()))
    short = one.join(full.select(F.col("q").alias("vec_id")), "vec_id", "left_anti")
    if not short.isEmpty():
        lists = [r["list"] for r in size.select("list").collect()]  # LISTS at most
        through = F.explode(F.array(*(F.lit(x) for x in lists))).alias("list")
        top = full.unionByName(answers(short.select("vec_id", "v", through)))
    every = asked.join(one.select("v", F.col("vec_id").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q").join(top, "q")
    others = F.slice(F.sort_array(F.filter("found", lambda x: x["id"] != F.col("query_id"))), 1, nearest)
    out = every.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows whose vec_id is divisible by 20, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
