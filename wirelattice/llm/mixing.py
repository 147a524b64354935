"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target over its size says how many copies a document gets on average; the whole part is certain
and the fraction is rounded dependently. Documents of a source are dealt into chunks of about CHUNK rows by a
hash. In a chunk the fractions meet in pairs: words move at random from one to the other, so that expectations
and the sum of words hold, until one of the two is 0 or 1; the other stays on to meet the next. A chunk leaves one
fractional residual, and residuals combine in the same way up a tree with CHUNK children per node; a source's last
residual goes to the nearer whole number. So the words taken differ from the target by at most half a document; large
documents meet first, which makes that last one a small document as a rule.
Rows that agree in source, doc_id and size are counted first: of k of them with fraction p, floor(k p) are certain and only the rest of
their mass goes into the tree, so an id that a third of all rows repeat is one item there.
DataFrame functions only; all randomness is a hash of ids and a seed, so reruns agree.

Edge cases: null texts and texts without words have size 0 and take no words (they are copied round(target / size)
times); sources without words get target 0; null sources are one source, the last; repeated rows share the
mass of their group as evenly as whole numbers allow; there is one window over the table of sources (a row each); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelattice.llm.words import let, words
from wirelattice.sources.staging import materialise

#: Rows that meet in one node of the tree, the highest multiple of a source's size, the weights, the seed.
CHUNK, MOST, WEIGHTS, SEED = 256, 3, 3, 20_260
#: Decisions up to this number are broadcast (about 185 bytes each as measured: 46 MB); beyond it the join is left to shuffle.
BROADCAST_ROWS = 250_000


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source, source_size, n (documents with words), target.

    Shares by weight with a cap are a water level: sources in order of cap / weight, those below the level
    take their cap, the others level * weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(WEIGHTS)) + 1).withColumn("cap", MOST * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / left("weight")
    with_level = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    chosen = with_level.withColumn("water", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight"))
    return chosen.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"))


def meet(items: Column) -> Column:
    """Pivotal rounding of an array of (order, doc_id, size, p): the decided ones and the residual."""
    done = lambda x, bit: F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.lit(bit).alias("bit")))
    held = lambda x, p, out: F.struct(x["order"].alias("order"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), out.alias("out"))

    def pair(s: Column, x: Column) -> Column:
        up, down = F.least((1 - s["p"]) * s["size"], x["p"] * x["size"]), F.least(s["p"] * s["size"], (1 - x["p"]) * x["size"])
        u = F.pmod(F.xxhash64(s["order"], x["order"], s["doc_id"], x["doc_id"]), F.lit(1 << 40)) / float(1 << 40)
        raised = F.when((1 - s["p"]) * s["size"] <= x["p"] * x["size"], held(x, x["p"] - up / x["size"], F.concat(s["out"], done(s, 1)))).otherwise(held(s, s["p"] + up / s["size"], F.concat(s["out"], done(x, 0))))
        lowered = F.when(s["p"] * s["size"] <= (1 - x["p"]) * x["size"], held(x, x["p"] + down / x["size"], F.concat(s["out"], done(s, 0)))).otherwise(held(s, s["p"] - down / s["size"], F.concat(s["out"], done(x, 1))))
        return F.when(u * (up + down) < down, raised).otherwise(lowered)

    def fold(all_items: Column) -> Column:
        first = all_items[0]
        none = F.array().cast("array<struct<doc_id:bigint,size:bigint,bit:int>>")
        return F.aggregate(F.slice(all_items, F.lit(2), F.greatest(F.size(all_items) - 1, F.lit(0))), held(first, first["p"], none), pair)

    return let(items, fold)


def decisions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, source, copies, k): k rows that agree are taken ``copies`` times each; and the targets by source.

    Sizes are written once; the tree works on their narrow rows, one aggregate with CHUNK rows a group per level.
    """
    sizes = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(words(F.col("text"))).cast("long").alias("size"), "source"), "mix-sizes")
    by = materialise(targets(sizes), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = by.select(F.col("source").alias("of"), rate.alias("rate"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
    alike = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("k"))
    rows = alike.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("whole", F.floor("rate").cast("int"))
    rows = rows.withColumn("mass", F.col("k") * (F.col("rate") - F.col("whole"))).withColumn("ones", F.floor("mass"))
    rows = materialise(rows.drop("of"), "mix-rows")
    worded, blank = rows.where("size > 0"), rows.where("size = 0")
    key = F.xxhash64(F.lit(SEED), "doc_id", "size")
    p = (F.col("mass") - F.col("ones")).alias("p")
    level = worded.select("source", "doc_id", "size", "whole", p, key.alias("order"), F.pmod(key, F.col("chunks")).alias("chunk"))
    name = ["doc_id", "size", "source"]
    one = F.lit(1).cast("long").alias("k")
    nearest = F.col("whole") + F.when(F.col("rate") - F.col("whole") >= 0.5, 1).otherwise(0)
    decided = [
        blank.select(*name, nearest.alias("copies"), "k"),
        worded.where("ones > 0").select(*name, (F.col("whole") + 1).alias("copies"), F.col("ones").alias("k")),
        worded.where("k > ones + 1").select(*name, F.col("whole").alias("copies"), (F.col("k") - F.col("ones") - 1).alias("k")),
    ]
    most = plan.agg(F.max("chunks")).first()[0] or 0
    while True:
        item = F.struct((-F.col("size")).alias("falling"), "order", "doc_id", "size", "p")
        met = level.groupBy("source", "whole", "chunk").agg(F.sort_array(F.collect_list(item)).alias("items"))
        node = materialise(met.select("source", "whole", "chunk", meet(F.col("items")).alias("s")), "mix-level")
        out = node.select("source", "whole", F.explode("s.out").alias("d"))
        decided.append(out.select("d.doc_id", "d.size", "source", (F.col("whole") + F.col("d.bit")).alias("copies"), one))
        up = F.floor(F.col("chunk") / CHUNK).alias("chunk")
        level = node.select("source", "s.doc_id", "s.size", "whole", "s.p", "s.order", up)
        if most <= 1:
            break
        most = -(-most // CHUNK)
    decided.append(level.select(*name, (F.col("whole") + (F.col("p") >= 0.5).cast("int")).alias("copies"), one))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out, by


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, source, copies) for each row, and the targets by source."""
    out, by = decisions(docs)
    out = materialise(out, "mix-decisions")
    few, many = out.where(F.col("k") <= CHUNK), out.where(F.col("k") > CHUNK)
    if not many.isEmpty():
        # a large group's rows are made by many tasks
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / CHUNK)))
        cut = many.withColumn("part", parts).repartition("doc_id", "size", "source", "part")
        cut = cut.withColumn("k", F.least(F.lit(CHUNK), F.col("k") - F.col("part") * CHUNK)).drop("part")
        few = few.unionByName(cut)
    each = few.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("k").cast("int"))))
    return each.select("doc_id", "size", "source", "copies"), by


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, as often as the mix takes them.

    Decisions are joined by doc_id, size and source. Rows that agree in all three share their decisions in the order of their text.
    """
    key = ["doc_id", "size", "source"]
    total = F.sum(F.col("copies") * F.col("k")).cast("long").alias("copies")
    decided = decisions(docs)[0].groupBy(*key).agg(total, F.sum("k").alias("k"))
    decided = materialise(decided, "mix-copies")
    other = decided.select(*(F.col(c).alias(f"of_{c}") for c in key), "copies", "k")
    if decided.count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.size(words(F.col("text"))).cast("long").alias("size"), "source")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    met = rows.join(other, same[0] & same[1] & same[2]).select("row", *key, "copies", "k")
    out = met.where("k = 1").select("row", "copies")
    if not decided.where("k > 1").isEmpty():
        i = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("row.text")))
        share = F.floor(F.col("copies") * F.col("i") / F.col("k")) - F.floor(F.col("copies") * (F.col("i") - 1) / F.col("k"))
        out = out.unionByName(met.where("k > 1").withColumn("i", i).select("row", share.alias("copies")))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix takes of each."""
    decided, by = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    by = by.select(F.col("source").alias("of"), "source_size", "target")
    return decided.join(by, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
