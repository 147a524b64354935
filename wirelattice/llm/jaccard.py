"""N-gram Jaccard join: an exact metric-space join of shingle sets.

Distances. Jaccard distance is a metric, and so is the size of the symmetric difference H. For sets of sizes a and b, J >= 85/100
means H <= (a + b) * 3/37. All documents at Jaccard distance near 1 from every pivot (nearly all of a corpus) would fall into every
boundary window, so pivots are set where distances do tell documents apart:

1. Rings around the empty set: H(x, {}) is the size of x. By the triangle inequality a link joins sizes within a factor 100/85;
   rings grow by half, and a document whose window reaches over its ring's upper edge is replicated into the next ring.
2. Voronoi cells at radius 0: in a ring with at most T symmetric difference the universe of shingles is cut by hash into
   K = T + 1 + R slices, and H is the sum of the slices' differences. So two linked documents agree wholly on at least R + 1 slices.
   In each slice every distinct content is a pivot, and a document lies in the cells of the pivots at distance 0, one per slice.
   The cells of a ring have one order (empty contents, then by falling number of members, then by key). Each document leaves its
   first R cells: of R + 1 shared cells the last in that order comes after R others in either document, so both stay in it. A text
   that many documents hold fills popular cells, which are left; a document with no more than R shared cells has no link at all.
3. Each cell takes a pivot, its smallest document; exact distances of its members to it are computed and members within the threshold
   are linked. A cell whose members then lie in one component is done; so a group of thousands of near copies is settled by its
   first pivots, not by all its pairs. In a cell with few members outside its main component these become pivots, too, and meet all
   members of other components.
4. Recursion. The documents of cells that are still open join again among themselves, in finer slices of their own (LEVELS), ordered by
   the numbers of members that are left. What is open after the finest slices goes to the cells of single shingles, the rarest among
   these documents first: every document is at the same distance 1 - 1/n from each of its n shingles and at 1 from all others; by
   its window it goes to the first n - ceil(0.85 n) + 1 of them, and two linked documents meet in one. There members outside the
   main component become pivots, PIVOTS a round, and meet the members of other components that sizes and ranks leave within
   reach, until no cell with two components is left.
Pairs that meet are first compared by sketches, sizes of SKETCH slices, whose differences bound the symmetric difference from below.

Exact copies form one class first. Within TOGETHER rows a cell's key is sent on once, so a hot cell does not send one row per document.

Edge cases: null and empty texts and texts without words have empty sets and link with nothing; rows that share a doc_id count as one
document (the set that sorts last stands for it where they differ); a null doc_id keeps its row with component_id null; ties do not
matter, as a component is named by its smallest doc_id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelattice.llm.memory import trim
from wirelattice.llm.shingles import U, mix, shingle_sets
from wirelattice.operators.components import connected_components
from wirelattice.sources.staging import deploy, discard, materialise

#: Words of a shingle; the least similarity in hundredths.
WORDS, PERCENT = 4, 85
#: Growth of rings; R as a share of T, for all documents and then for those of cells that are still open.
GROWTH, LEVELS = 1.5, (0.3, 1.0)
#: Slices of a sketch (a byte each).
SKETCH = 256
#: Rows of which cell keys are sent on once.
TOGETHER = 2500
#: Pivots that a cell takes in a round; members outside the main component up to which a cell is settled at once (SMALL <= PIVOTS).
PIVOTS, SMALL = 512, 4
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 2_000_000


class Rings:
    """Ring edges by set size, and slices per ring; R is ``spare`` of T."""

    def __init__(self, percent: int = PERCENT, spare: float = LEVELS[0]):
        self.percent, self.salt = percent, int(spare * 1000)
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * max(GROWTH, 101 / percent))))
        most = [(100 - percent) * 2 * (high - 1) // (100 + percent) for high in self.edges[1:]]
        self.plan = [(t + 1 + math.ceil(spare * t), math.ceil(spare * t)) for t in most]

    def of(self, size: int) -> list[int]:
        """The ring of a size, and the next where the size's window reaches it."""
        r = int(np.searchsorted(self.edges, size, "right")) - 1
        return [r, r + 1] if 100 * size // self.percent >= self.edges[r + 1] else [r]


def cells(shingles: np.ndarray, rings: Rings) -> tuple[np.ndarray, list[int]]:
    """The keys of the cells in which a set lies, and how many of them it leaves in rings of even and of odd number.

    The lowest bit of a key tells an empty content, the next one whether the ring's number is odd. Up to R empty
    contents are left here and now, as they come first in the order.
    """
    out, leaves = [], [0, 0]
    for r in rings.of(len(shingles)):
        k, spare = rings.plan[r]
        slot = ((mix(shingles + U(r + 1 + (rings.salt << 8))) >> U(11)) % U(k)).astype(np.int64)
        content = np.zeros(k, U)
        np.add.at(content, slot, mix(shingles ^ U(0xA5A5A5A5A5A5A5A5)))
        empty = np.bincount(slot, minlength=k) == 0
        key = mix(content + mix(np.arange(k, dtype=U) + U(r << 40))) & ~U(3) | U(r % 2 << 1) | empty.astype(U)
        gone = int(empty.sum()) if empty.sum() <= spare else 0
        out.append(key[~empty] if gone else key)
        leaves[r % 2] = spare - gone
    return np.concatenate(out), leaves


def features(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Per row: doc_id, n, digest of the set, ``sent`` (keys that it sends on), ``shared`` (keys that it shares with others of its
    TOGETHER rows), ``even`` and ``odd`` (cells that it leaves in rings of even and odd number).

    Of exact copies among these only the first has keys.
    """
    deploy(docs.sparkSession)
    rings = Rings(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                yield _keys(part.column(0), shingle_sets(part.column(1), words), rings)
        trim()

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(run, FEATURES)


def finer(sets: DataFrame, ids: DataFrame, rings: Rings) -> DataFrame:
    """The features of the documents ``ids`` in the slices of ``rings``, from their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                items = (np.array(part.column(1)[i].values, np.int64).view(U) for i in range(part.num_rows))
                yield _keys(part.column(0), items, rings)
        trim()

    return few(sets.select("id", "items"), ids).mapInArrow(run, FEATURES)


#: Columns of a document's features.
FEATURES = "doc_id long, n int, digest binary, sent array<long>, shared array<long>, even int, odd int"


def _keys(ids: pa.Array, sets: Iterable[np.ndarray], rings: Rings) -> pa.RecordBatch:
    """The features of some rows."""
    n, digests, leaves, keys, rows, seen = [], [], [], [], [], set()
    for i, (doc, s) in enumerate(zip(ids.to_pylist(), sets, strict=True)):
        n.append(len(s))
        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        leaves.append((None, None))
        if doc is not None and len(s) and digests[-1] not in seen:
            seen.add(digests[-1])
            found, leaves[-1] = cells(s, rings)
            keys.append(found)
            rows.append(np.full(len(found), i, np.int32))
    flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    del keys, rows
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    alone = new & np.r_[new[1:], True] if len(flat) else new
    lists = [_lists(flat[new], row[new], len(n)), _lists(flat[~alone], row[~alone], len(n))]
    even, odd = (pa.array([x[i] for x in leaves], pa.int32()) for i in (0, 1))
    names = ["doc_id", "n", "digest", "sent", "shared", "even", "odd"]
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(digests, pa.binary()), *lists, even, odd], names=names)


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=rows))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values[order], pa.int64()))


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, items, sketch) for the documents ``ids``: their shingles, recomputed from the texts, and the sizes of SKETCH slices of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                items = list(shingle_sets(part.column(1), words))
                sketch = np.array([np.minimum(np.bincount((mix(s) >> U(56)).astype(np.int64), minlength=SKETCH), 127) for s in items], np.int8)
                ends = np.cumsum([0, *map(len, items)])
                flat = np.concatenate(items).view(np.int64) if items else np.zeros(0, np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1) * SKETCH, pa.int32()), pa.array(sketch.ravel(), pa.int8()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["id", "items", "sketch"])
        trim()

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return few(whole.withColumnRenamed("doc_id", "id"), ids).mapInArrow(run, "id long, items array<long>, sketch array<tinyint>")


def few(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, which are broadcast up to BROADCAST_IDS."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def rare_cells(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(cell, x, n, rank): each document in the cells of its rarest shingles, as many as its window needs.

    Shingles that one document alone holds come first and have no cell of two members, so they are only counted. A document of size n that links with one
    of size b shares at least a = 0.85 / 1.85 (n + b) shingles with it, so the first that they share is among its n - a + 1 rarest: a cell keeps
    the documents for which its smallest member leaves this open.
    """
    items = few(sets, ids).select("id", F.size("items").alias("n"), F.explode("items").alias("cell"))
    held = items.withColumn("df", F.count("*").over(Window.partitionBy("cell"))).where("df > 1")
    own = Window.partitionBy("id")
    ranked = held.withColumn("rank", F.row_number().over(own.orderBy("df", "cell")) + F.col("n") - F.count("*").over(own))
    first = ranked.select("cell", F.col("id").alias("x"), "n", "rank").where(in_reach("n", F.ceil(F.col("n") * percent / 100), "rank", percent))
    low = F.min("n").over(Window.partitionBy("cell"))
    return first.withColumn("low", low).where(in_reach("n", F.greatest("low", F.ceil(F.col("n") * percent / 100)), "rank", percent)).drop("low")


def in_reach(n: str, other, rank: str, percent: int):
    """Whether a shingle of this rank can be the first that a set of size n shares with a linked one of size ``other``."""
    return F.col(rank) <= F.col(n) - F.ceil((F.col(n) + other) * percent / (100 + percent)) + 1


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, p) that link.

    A pair's symmetric difference is at least the summed differences of its sketches (the triangle inequality in each slice); pairs that fail by
    these few bytes never fetch their sets. The rest are decided by the exact intersection.
    """
    small = sets.select("id", F.size("items").alias("n"), "sketch")
    a = small.select(F.col("id").alias("x"), F.col("n").alias("xn"), F.col("sketch").alias("xk"))
    b = small.select(F.col("id").alias("p"), F.col("n").alias("pn"), F.col("sketch").alias("pk"))
    apart = F.aggregate(F.zip_with("xk", "pk", lambda u, v: F.abs(u.cast("int") - v.cast("int"))), F.lit(0), lambda t, d: t + d)
    near = pairs.join(a, "x").join(b, "p").where((100 + percent) * apart <= (100 - percent) * (F.col("xn") + F.col("pn"))).select("x", "p", "xn", "pn")
    near = materialise(near, "jaccard-near")
    a, b = (few(sets, near.select(F.col(c).alias("id")).distinct()).select(F.col("id").alias(c), F.col("items").alias(c + "s")) for c in ("x", "p"))
    common = F.size(F.array_intersect("xs", "ps"))
    both = near.join(a, "x").join(b, "p").select("x", "p", common.alias("common"), (F.col("xn") + F.col("pn") - common).alias("total"))
    return both.where(100 * F.col("common") >= percent * F.col("total")).select("x", "p")


def entered(feats: DataFrame, member: DataFrame | None = None) -> DataFrame:
    """(cell, x, leaves): documents, or the classes that ``member`` names, in the cells that two or more doc_ids enter."""
    # a block sends a key once, so a cell has no more rows here than there are blocks
    same = Window.partitionBy("cell")
    sent = feats.select(F.explode("sent").alias("cell"), "doc_id")
    sent = sent.select("cell", "doc_id", F.min("doc_id").over(same).alias("low"), F.max("doc_id").over(same).alias("high"))
    met = sent.where("low <> high").select("cell", "doc_id")
    met = met.unionByName(feats.select(F.explode("shared").alias("cell"), "doc_id"))
    if member is None:
        own = feats.select(F.col("doc_id").alias("x"), "doc_id", "even", "odd")
    else:
        own = member.select("doc_id", F.col("class").alias("x"), "even", "odd")
    leaves = F.when(F.col("cell").bitwiseAND(2) == 0, F.col("even")).otherwise(F.col("odd"))
    return met.join(own, "doc_id").groupBy("cell", "x").agg(F.min(leaves).alias("leaves"))


def kept_cells(region: DataFrame) -> DataFrame:
    """(cell, x, p): the cells of two or more members in which documents stay, with each cell's pivot."""
    size = region.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1")
    order = Window.partitionBy("x", F.col("cell").bitwiseAND(2)).orderBy(F.col("cell").bitwiseAND(1).desc(), F.col("k").desc(), "cell")
    stay = region.join(size, "cell").withColumn("place", F.row_number().over(order)).where("place > leaves").select("cell", "x")
    stay = materialise(stay, "jaccard-stay")
    first = stay.groupBy("cell").agg(F.min("x").alias("p"), F.max("x").alias("high")).where("p <> high").drop("high")
    regions = materialise(stay.join(first, "cell"), "jaccard-regions")
    discard(stay)
    return regions


def components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    feats = materialise(features(docs, percent, words), "jaccard-features")
    known = feats.where("n > 0 and doc_id is not null")
    least = [F.min(c).alias(c) for c in ("even", "odd")]
    classes = known.groupBy("n", "digest").agg(F.min("doc_id").alias("class"), *least)
    member = known.select("doc_id", "n", "digest").join(classes, ["n", "digest"])
    member = member.groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("other"), *least)
    member = materialise(member, "jaccard-classes")
    # rows that share a doc_id tie their classes together
    tied = member.where("class <> other").select(F.col("class").alias("x"), F.col("other").alias("p"))
    links = materialise(tied, "jaccard-links")
    entry = materialise(entered(known, member), "jaccard-cells")
    sizes = materialise(feats.select("doc_id", "n"), "jaccard-sizes")
    shared_ids = known.count() > member.count()
    discard(feats)  # its keys are the largest table of the join and no longer needed
    region = kept_cells(entry)
    discard(entry)

    ids = region.select(F.col("x").alias("id")).distinct()
    sets = materialise(sets_of(docs, ids, words), "jaccard-sets")
    if shared_ids:
        last = sets.groupBy("id").agg(F.max(F.struct("items", "sketch")).alias("s")).select("id", "s.items", "s.sketch")
        sets = materialise(last, "jaccard-sets")
    labels = connected_components(links, "x", "p")

    def met(pairs: DataFrame) -> None:
        """Compare pairs (x, p), add the links found and label anew."""
        nonlocal links, labels
        new = materialise(measured(pairs, sets, percent), "jaccard-links")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = connected_components(links, "x", "p")

    def among(rows: DataFrame) -> DataFrame:
        """The rows of cells with more than one component, with each cell's main component and the number of members outside it."""
        named = rows.join(labels.select(F.col("node").alias("x"), "component"), "x", "left")
        named = named.withColumn("component", F.coalesce("component", "x"))
        counts = named.groupBy("cell", "component").agg(F.count("*").alias("k"))
        tops = counts.groupBy("cell").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("members"))
        tops = tops.select("cell", F.col("top.component").alias("top"), (F.col("members") - F.col("top.k")).alias("others"))
        return materialise(named.join(tops.where("others > 0"), "cell"), "jaccard-open")

    def compared(named: DataFrame, window) -> DataFrame:
        """The cells' pivots, after they met the members of other components in their window."""
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("x"))
        chosen = named.where("component <> top").withColumn("r", rank).where(F.col("r") <= PIVOTS)
        pivots = chosen.select("cell", *(F.col(c).alias("p_" + c) for c in named.columns if c != "cell"))
        both = named.join(pivots, "cell").where((F.col("component") != F.col("p_component")) & window)
        pairs = both.select(F.least("x", "p_x").alias("x"), F.greatest("x", "p_x").alias("p")).distinct()
        met(materialise(pairs, "jaccard-pairs"))
        return pivots

    for level in range(len(LEVELS)):
        if level:
            feats = materialise(finer(sets, left, Rings(percent, LEVELS[level])), "jaccard-features")
            entry = materialise(entered(feats), "jaccard-cells")
            region = kept_cells(entry)
            discard(entry)
            discard(feats)
        met(region.where("x <> p").select("x", "p").distinct())
        # the first pivots have met all members of their cells
        rest = among(region.where("x <> p").select("cell", "x"))
        compared(rest.where(F.col("others") <= SMALL), F.lit(True))
        left = materialise(rest.where(F.col("others") > SMALL).select(F.col("x").alias("id")).distinct(), "jaccard-left")
        if left.isEmpty():
            break
    else:
        rows = rare_cells(sets, left, percent)
        while not (named := among(rows)).isEmpty():
            within = in_reach("n", F.col("p_n"), "rank", percent) & in_reach("p_n", F.col("n"), "p_rank", percent)
            near = 100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")
            pivots = compared(named, within & near)
            # a cell whose outside members were all pivots is done
            more = named.where(F.col("others") > PIVOTS)
            done = pivots.select("cell", F.col("p_x").alias("x"))
            rows = more.join(done, ["cell", "x"], "left_anti").select("cell", "x", "n", "rank")
    named = labels.select(F.col("node").alias("class"), "component")
    final = member.join(named, "class", "left").select("doc_id", F.coalesce("component", "class").alias("component"))
    out = sizes.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows, with all their columns, of one document of each component: the one that names it. Of rows that share its doc_id the first by text stays.

    Rows with a null doc_id stay.
    """
    found = materialise(components(docs, percent, words).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("k")), "jaccard-kept")
    ids = found.select(F.col("doc_id").alias("kept_id"), "k")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    stay = rows.join(ids, F.col("id") == F.col("kept_id"))
    out = stay.where("k = 1").select("row").unionByName(rows.where("id is null").select("row"))
    if not found.where("k > 1").isEmpty():
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("row.text")))
        out = out.unionByName(stay.where("k > 1").withColumn("r", rank).where("r = 1").select("row"))
    return out.select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles, similarity 0.85 or more."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

OP5_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2 having 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways as (select x, y from links union select y, x from links),
reach(doc_id, y) as (select doc_id, doc_id from documents where doc_id is not null union select reach.doc_id, both_ways.y from reach join both_ways on reach.y = both_ways.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.c as component_id from s left join (select doc_id, min(y) as c from reach group by 1) r using (doc_id)
"""
