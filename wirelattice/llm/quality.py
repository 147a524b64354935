"""Quality rules by a hashed n-gram log-likelihood ratio.

Every document's words and word pairs are hashed into 2**BITS buckets. Two multinomials are counted over them:
one of the raw corpus (all documents) and one of the trusted target (documents labelled of good quality). A
document's score is the mean over its n-grams of log(target / raw), with both counts shrunk towards the raw
corpus, so a bucket without evidence weighs nothing. Scores below a fixed threshold, and documents that fail the
base rules, are rejected. DataFrame functions only.

Edge cases: null, empty and blank texts have no words and fail the base rules; without trusted documents all
weights are 0 and only the base rules decide; repeated rows are judged alike; a doc_id with several labels is
trusted if all of them are good; empty tables give empty results; other columns are ignored.
Windows of three words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelattice.llm.words import SPACES, let, words

#: Buckets (a power of two), n-grams that a bucket without evidence counts for, and the least score that stays.
BITS, SHRINK, THRESHOLD = 18, 20.0, -0.08
#: Trusted ids up to this number are broadcast (8 bytes each); beyond it the join is left to shuffle.
BROADCAST_IDS = 4_000_000
SYMBOLS = "#*$%&|<>"


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """Words in windows of three words that occur twice or more: sorts a document's windows only if two are equal."""

    def covered(windows: Column) -> Column:
        marked = lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["k"] == e["k"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["k"] == e["k"], F.lit(False)))
        order = F.sort_array(F.transform(windows, lambda k, p: F.struct(k.alias("k"), p.alias("p"))))
        places = let(order, lambda s: F.sort_array(F.transform(marked(s), lambda e: e["p"])))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    n = F.size(hashes)
    triples = F.zip_with(F.slice(pairs, F.lit(1), n - 2), F.slice(hashes, F.lit(3), n - 2), lambda p, h: F.xxhash64(p, h))
    found = let(triples, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(n < 3, F.lit(0)).otherwise(found).cast("long")


def bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def hashed(docs: DataFrame) -> DataFrame:
    """The rows as ``row``, doc_id, text and 64-bit hashes of the words and of the pairs of words."""
    ones = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    n = F.size("hashes")
    pairs = F.zip_with(F.slice("hashes", F.lit(1), n - 1), F.slice("hashes", F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
    return ones.withColumn("pairs", F.when(n < 2, F.array().cast("array<bigint>")).otherwise(pairs))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``w``: the log ratio of each bucket, by shrunken counts over all documents."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("good_id"))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    seen = hashed(docs).join(good, F.col("doc_id") == F.col("good_id"), "left")
    grams = seen.select(F.explode(F.transform(F.concat("hashes", "pairs"), bucket)).alias("b"), F.col("good_id").isNotNull().cast("long").alias("trusted"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    every = docs.sparkSession.range(1 << BITS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    dense = counts.unionByName(every).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    one = dense.groupBy().agg(F.sum("raw").alias("r"), F.sum("target").alias("t"), F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    share = F.col("t") / F.col("r")
    ratio = F.transform("c", lambda c: F.log((c["target"] + F.lit(SHRINK) * share) / ((c["raw"] + F.lit(SHRINK)) * share)))
    return one.select(F.when(F.col("t") > 0, ratio).otherwise(F.transform("c", lambda c: F.lit(0.0))).alias("w"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the row itself as ``row``, doc_id, the base counts, base_failed, kept, llr."""
    h, text = F.col("hashes"), F.coalesce(F.col("text"), F.lit(""))
    size = lambda s: F.length(s).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of = lambda v, grams: F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(v, bucket(g)))
    llr = let(F.col("w"), lambda v: of(v, "hashes") + of(v, "pairs")) / F.greatest(F.lit(1), F.size("hashes") + F.size("pairs"))
    out = hashed(docs).select(
        "row", "doc_id",
        F.size(h).cast("long").alias("n_words"),
        size(without(text, SPACES)).alias("word_chars"),
        (size(text) - size(without(text, SYMBOLS))).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(h, F.col("pairs")).alias("n_repeat_words"),
        "hashes", "pairs",
    )
    # a column first, as a subquery may not stand inside a lambda; the optimizer puts it back there
    out = out.withColumn("w", weights(docs, labels).scalar()).select(*(c for c in out.columns if c not in ("hashes", "pairs")), llr.alias("llr"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the rules keep.

    A generator instead of a filter: a filter would be pushed below the hashes and compute them several times.
    """
    return judge(docs, labels).select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged against the labelled ones."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
