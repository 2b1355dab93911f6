"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Texts and items are lower-cased and split into words (runs of letters and digits); shingles are FIVE words.
A window of a document has as many shingles as an item. Its fingerprint is the SimHash of its shingles, each
weighing as often as it occurs. Fingerprints are cut into BLOCKS blocks; two that differ in at most RADIUS
bits differ in at most RADIUS / BLOCKS (rounded down) bits of some block, so each item is indexed under all
block values that near to its own, by its size, and an equality join of sizes and blocks finds for every window
all items of its size within RADIUS. What it finds is verified by the exact weighted similarity of the two
multisets of shingles: what they share, over what either has.

Which windows are fingerprinted: a window at the similarity lacks at most a fifth of an item's shingles, so it holds
one of any fifth and one more. Each item is indexed under that many of its own, those that the fewest items share:
a stem of many items names none of them. Of the documents that hold such a shingle, and for its items alone, all
places of the items' shingles are joined; all starts are taken from which one lies inside, as runs. A start is left
only where an exact upper bound says so (what lies inside of shingles that an item has at all, over what either has
at least), or where the window before it holds the same multiset. The index is broadcast only if it is counted
small; else it is joined by shuffle, shingles that very many places hold apart from the others.

At similarity 0.8 the expected difference is about 10 of 64 bits with a deviation under 3; RADIUS 19 lies
three deviations beyond, and is the only place where a window is left before exact comparison.

Defined cases: items and texts of fewer than FIVE words have no shingle and match nothing; null texts are
empty; windows that would reach beyond a document are set to its edge; of a document's windows on an item the
most similar counts, of equal ones the first; repeated items are matched each; rows that repeat a doc_id are one
document; an empty table on either side gives no rows; texts of any length are read whole, and one of many equal
words has one window for each size; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import few, read, sized, texts, without, written
from lakeloom.operators.skew import skew_join

FIVE, LEAST = 5, 0.8
BLOCKS, RADIUS, BITS = 5, 19, 64


def with_shingles(rows: DataFrame) -> DataFrame:
    """rows with text replaced by h, the hashes of all shingles in order."""
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    worded = rows.withColumn("w", words).drop("text").where(F.size("w") >= FIVE)
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - FIVE), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(FIVE))))
    return worded.withColumn("h", hashes).drop("w")


def fingerprinted(rows: DataFrame, most: int) -> DataFrame:
    """rows (with h, hashes, at most `most` of them) with fp, 64 bits: those set in over half of the hashes.

    Counts of several bits are added in the lanes of one number, wide enough for `most`.
    """
    lane = next(w for w in (8, 16, 32) if most < 1 << w)
    mask = sum(1 << (lane * k) for k in range(64 // lane))
    mask -= (mask >> 63) << 64

    def adding(g: int):
        return lambda s, x: s + F.shiftrightunsigned(x, g).bitwiseAND(F.lit(mask).cast("long"))

    totals = rows.withColumns({f"bits_{g}": F.aggregate("h", F.lit(0).cast("long"), adding(g)) for g in range(lane)} | {"half": F.size("h")})
    fp, full = F.lit(0).cast("long"), F.lit((1 << lane) - 1).cast("long")
    for g in range(lane):
        for k in range(64 // lane):
            count = F.shiftrightunsigned(f"bits_{g}", lane * k).bitwiseAND(full)
            more = F.shiftrightunsigned((F.col("half") - 2 * count).cast("long"), 63)  # 1 if negative
            fp = fp.bitwiseOR(F.shiftleft(more, lane * k + g))
    return totals.withColumn("fp", fp).drop("half", *(f"bits_{g}" for g in range(lane)))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with tags, the multiset h as a set: each hash together with which of its repeats it is."""
    ordered = rows.withColumn("ordered", F.array_sort("h"))
    return ordered.withColumn("tags", F.transform("ordered", lambda x, i: F.xxhash64(x, i - F.array_position("ordered", x)))).drop("ordered")


def bounds(k: int) -> tuple[int, int]:
    """The bits of block k."""
    return k * BITS // BLOCKS, (k + 1) * BITS // BLOCKS


def block(fp: Column, k: int) -> Column:
    low, high = bounds(k)
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << high - low) - 1).cast("long"))


def near_masks(k: int) -> list[int]:
    """All values of block k's bits with few enough set."""
    low, high = bounds(k)
    return [m for m in range(1 << high - low) if m.bit_count() <= RADIUS // BLOCKS]


def item_blocks(known: DataFrame) -> DataFrame:
    """known: item, n, fp. The index: n, k, v (all values near to block k of fp), item, item_fp."""
    each = None
    for k in range(BLOCKS):
        masks = F.array(*(F.lit(m).cast("long") for m in near_masks(k)))
        own = known.select("n", F.lit(k).alias("k"), block(F.col("fp"), k).alias("own"), "item", F.col("fp").alias("item_fp"))
        rows = own.select("n", "k", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("v"), "item", "item_fp")
        each = rows if each is None else each.unionByName(rows)
    return each


def near_pairs(windows: DataFrame, known: DataFrame) -> DataFrame:
    """windows: window, n, fp; known: item, n, fp. All (window, item, hamming) of one size within RADIUS."""
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), block(F.col("fp"), k).alias("v")) for k in range(BLOCKS))))
    probes = windows.select("window", "n", "fp", cut.alias("b")).select("window", "n", "fp", "b.k", "b.v")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    return probes.join(item_blocks(known), ["n", "k", "v"]).withColumn("hamming", differ).where(F.col("hamming") <= RADIUS).select("window", "item", "hamming").distinct()


def bounded_runs(found: DataFrame, least: float) -> DataFrame:
    """found: doc_id, item, n, size, at (places of the item's shingles). doc_id, size, n, start, end: runs of starts of all windows that can reach least.

    A window over `inside` such places shares at most that many: similarity inside / (its size + n - inside) at most.
    """
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))
    # the number inside changes only where a place enters (at - n + 1) or has left (at + 1)
    steps = F.array(F.struct(F.greatest(F.lit(0), F.col("at") - F.col("n") + 1).alias("start"), F.lit(1).alias("more")), F.struct((F.col("at") + 1).alias("start"), F.lit(-1).alias("more")))
    changes = found.select("doc_id", "item", "n", "size", last.alias("last"), F.explode(steps).alias("s")).groupBy("doc_id", "item", "n", "size", "last", "s.start").agg(F.sum("s.more").alias("more"))
    order = Window.partitionBy("doc_id", "item", "size").orderBy("start")
    inside = changes.withColumn("inside", F.sum("more").over(order)).withColumn("next", F.lead("start").over(order))
    both = F.least("n", "size") + F.col("n")
    enough = inside.where((F.col("inside") > 0) & (F.col("inside") >= F.lit(least) * (both - F.col("inside")) - 1e-9) & (F.col("start") <= F.col("last")))
    # runs that follow each other are one
    new = F.when(F.lag("end").over(order) + 1 >= F.col("start"), 0).otherwise(1)
    runs = enough.withColumn("end", F.least("last", F.col("next") - 1)).withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("doc_id", "size", "n", "item", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "size", "n", "start", "end").distinct()


def rare_shingles(known: DataFrame, least: float) -> DataFrame:
    """known: item, n, h. item, x: so many of each item's shingles that a window at `least` holds one, those of the fewest items."""
    each = known.select("item", "n", F.explode("h").alias("x"))
    items = each.select("item", "x").distinct().groupBy("x").agg(F.count(F.lit(1)).alias("items"))
    ordered = each.join(items, "x").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("items", "x"))).alias("s"))
    enough = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    some = F.array_distinct(F.transform(F.slice("s", F.lit(1), enough), lambda e: e["x"]))
    return written(ordered.select("item", F.explode(some).alias("x")), "rare")


def placed(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, size, at, x for each shingle."""
    # not posexplode: its inferred filter on h would be pushed down and split a text for each of its words
    return with_shingles(docs).select("doc_id", F.size("h").alias("size"), F.posexplode_outer("h").alias("at", "x"))


def named(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """The pairs (doc_id, item) of which the document holds one of the item's shingles in rare."""
    each = placed(texts(docs)).select("doc_id", "x")
    found = each.join(F.broadcast(rare), "x") if few(rare) else skew_join(each, rare, ["x"])
    return found.select("doc_id", "item").distinct()


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. For each document and item that it holds: the best window.

    doc_id, item_id, start_word, n_shingles, hamming, similarity.
    """
    shingled = with_shingles(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.monotonically_increasing_id()))
    known = written(shingled.withColumn("n", F.size("h")), "items")
    most = known.agg(F.max("n")).first()[0] or 0
    known = written(numbered(fingerprinted(known, most)), "items")
    candidates = written(named(docs, rare_shingles(known, least)), "candidates")
    ids = written(candidates.select("doc_id").distinct(), "touched").toDF("touched_id")
    touched = texts(docs).join(sized(ids), F.col("doc_id").eqNullSafe(F.col("touched_id")), "left_semi")

    index = known.select("item", "n", F.explode("h").alias("held")).distinct()
    wanted = candidates.toDF("named_id", "item").join(index, "item")
    same = F.col("doc_id").eqNullSafe(F.col("named_id")) & (F.col("x") == F.col("held"))
    runs = written(bounded_runs(placed(touched).join(wanted, same).select("doc_id", "item", "n", "size", "at").distinct(), least), "runs")

    touched = with_shingles(touched).withColumnRenamed("doc_id", "held_id").withColumn("held_size", F.size("h"))
    here = F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("size") == F.col("held_size"))
    # a window that loses the shingle it takes up is the one before it
    fresh = F.filter(F.sequence("start", "end"), lambda s: (s == F.col("start")) | (F.get("h", s - 1) != F.get("h", s - 1 + F.col("n"))))
    windows = runs.join(touched, here).select("doc_id", "n", "h", F.explode(fresh).alias("start"))
    windows = windows.select("doc_id", "n", "start", F.slice("h", F.col("start") + 1, F.greatest(F.lit(1), "n")).alias("h"))
    windows = written(numbered(fingerprinted(windows, most)).drop("h").withColumn("window", F.monotonically_increasing_id()), "windows")

    near = near_pairs(windows.select("window", "n", "fp"), known.select("item", "n", "fp"))
    pairs = windows.drop("n", "fp").join(near, "window").join(known.select("item", "item_id", F.col("tags").alias("item_tags")), "item")
    shared = F.size(F.array_intersect("tags", "item_tags"))
    pairs = pairs.withColumn("similarity", shared / (F.size("tags") + F.size("item_tags") - shared)).where(F.col("similarity") >= least)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.size("tags").alias("n"), (-F.col("hamming")).alias("far"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.back")).alias("start_word"), F.col("m.n").alias("n_shingles"), (-F.col("m.far")).alias("hamming"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    return without(docs, written(matches(docs, items).select("doc_id").distinct(), "contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
