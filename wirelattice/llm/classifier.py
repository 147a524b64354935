"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Word vectors. Every word has two terms: its hash bucket and the bucket of its last two characters. Each term has a fixed sparse random index
vector (one +1, one -1). One pass over all documents adds up, for each term, the index vectors of the same kind of terms within two places: the
context counts of the whole corpus, as exact integers that do not depend on the order of rows. A term's vector is its context direction
without the corpus mean, plus its own index vector.

A document is the mean and the spread of its terms' vectors with the log of its length. The network (one hidden layer)
learns from labelled rows of the training folds, TRAIN_ROWS of them at most, chosen by the hash of their id; a part of these is kept aside
to fit the temperature that calibrates its probabilities. Rows with crc32(doc_id as text) mod 4 = 2 are held out and never learned from.

Edge cases: null and empty texts have zero vectors and get a score too; a doc_id with several labels has the smallest quality; without labels, or
with one class only, the score is the smoothed share of good ones (0.5 without labels); null doc_ids are not held out; repeated rows score alike; empty tables give
empty results; other columns (labels, lang, source) are no input of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelattice.sources.staging import deploy

#: Buckets of words and of word ends, dimensions, neighbours on each side.
WORD_BUCKETS, END_BUCKETS, DIM, REACH = 8192, 2048, 32, 2
TERMS = WORD_BUCKETS + END_BUCKETS
#: Labelled rows that the network learns from at most, hidden units, steps, learning rate, weight decay, seed, threshold.
TRAIN_ROWS, HIDDEN, STEPS, RATE, DECAY, SEED, THRESHOLD = 20_000, 32, 400, 0.02, 1e-4, 5, 0.7
#: Words that are worked on together, and known words that a task keeps.
BLOCK_WORDS, KEPT = 200_000, 500_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places of +1 and of -1 of each term's index vector."""
    rng = np.random.default_rng(SEED)
    plus = rng.integers(0, DIM, TERMS)
    return plus, (plus + rng.integers(1, DIM, TERMS)) % DIM


class Terms:
    """The terms of words, kept between blocks."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of whole texts: word terms, end terms (both end to end) and the number of words of each text."""
        run: list[int] = []
        sizes: list[int] = []
        known = self.known
        for t in texts:
            words = t.split() if t else []
            for w in set(words).difference(known):
                known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS << 16 | (WORD_BUCKETS + zlib.crc32(w[-2:].encode("utf-8", "surrogatepass")) % END_BUCKETS)
            run += map(known.__getitem__, words)
            sizes.append(len(words))
            if len(run) >= BLOCK_WORDS:
                both = np.array(run, np.int64)
                yield both >> 16, both & 0xFFFF, np.array(sizes)
                run, sizes = [], []
                if len(known) > KEPT:
                    known.clear()
        if sizes:
            both = np.array(run, np.int64)
            yield both >> 16, both & 0xFFFF, np.array(sizes)


def context_counts(docs: DataFrame) -> np.ndarray:
    """(TERMS, DIM) sums of neighbours' index vectors over all documents: per task one row a term, added up by term."""
    deploy(docs.sparkSession)
    columns = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = index_vectors()
        total, terms = np.zeros(TERMS * DIM), Terms()
        for batch in batches:
            for words, ends, sizes in terms.of(batch.column(0).to_pylist()):
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for step in range(1, REACH + 1):
                    same = np.flatnonzero(doc[step:] == doc[:-step])
                    for stream in (words, ends):
                        a, b = stream[same], stream[same + step]
                        for x, y in ((a, b), (b, a)):
                            total += np.bincount(x * DIM + plus[y], minlength=TERMS * DIM)
                            total -= np.bincount(x * DIM + minus[y], minlength=TERMS * DIM)
        grid = total.reshape(TERMS, DIM).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS)), *(pa.array(grid[:, i]) for i in range(DIM))], names=["term", *columns])

    parts = docs.select("text").mapInArrow(run, "term long, " + ", ".join(f"{c} long" for c in columns))
    rows = parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # TERMS rows at most
    out = np.zeros((TERMS, DIM))
    out[rows["term"]] = rows[columns].to_numpy()
    return out


def term_vectors(counts: np.ndarray) -> np.ndarray:
    """Unit context directions without the mean direction, plus half the own index vector."""
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1)), 1e-9)[:, None]
    out = unit(counts)
    for kind in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, TERMS)):
        seen = np.abs(counts[kind]).sum(1) > 0
        if seen.any():
            out[kind] = np.where(seen[:, None], out[kind] - out[kind][seen].mean(0), 0)
    plus, minus = index_vectors()
    own = np.zeros((TERMS, DIM))
    own[np.arange(TERMS), plus] += 0.5
    own[np.arange(TERMS), minus] -= 0.5
    return (out + own).astype(np.float32)


#: Features of a document.
FEATURES = 4 * DIM + 1


def pooled(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and spread of both kinds of terms, and the log of its length."""
    out = np.zeros((len(sizes), FEATURES), np.float32)
    full = np.flatnonzero(sizes)
    n = sizes[full, None]
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, stream in enumerate((words, ends)):
            v = vectors[stream]
            mean = np.add.reduceat(v, starts, axis=0) / n
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / n - mean * mean, 0))
            out[full, 2 * k * DIM : (2 * k + 1) * DIM], out[full, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = mean, spread
    out[:, -1] = np.log1p(sizes)
    return out


def features(texts: list[str | None], vectors: np.ndarray, terms: Terms) -> np.ndarray:
    return np.concatenate([np.zeros((0, FEATURES), np.float32), *(pooled(w, e, s, vectors) for w, e, s in terms.of(texts))])


class Network:
    """Standardised features, one hidden layer, a calibrated probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.w1 = None
        if len(np.unique(y)) < 2 or len(y) < 10:
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        aside, learn = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[learn].mean(0), x[learn].std(0) + 1e-3
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m1, m2 = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        for step in range(1, STEPS + 1):
            rows = learn if len(learn) <= 2048 else rng.choice(learn, 2048, replace=False)
            h = np.tanh(z[rows] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[rows]) / len(rows)
            dh = d[:, None] * w[2] * (1 - h * h)
            for i, g in enumerate((z[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True))):
                g = g + DECAY * w[i]
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (1 - 0.9 * step / STEPS) * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = w
        logit, truth = self.logits(x[aside]), y[aside]
        loss = lambda t: np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / t).mean()
        self.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 61)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network:
    """The network, from TRAIN_ROWS labelled documents outside the held-out fold at most."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rows.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            x = features(batch.column(1).to_pylist(), vectors, terms)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    chosen = F.broadcast(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")))  # TRAIN_ROWS at most
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    # one row per id, however often an id is repeated: TRAIN_ROWS at most reach the driver
    known = known.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")
    found = known.mapInArrow(run, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, FEATURES).astype(float)
    return Network(x, (found["quality"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    vectors = term_vectors(context_counts(docs))
    network = learn(docs, labels, vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            s = network.score(features(batch.column(1).to_pylist(), vectors, terms).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
