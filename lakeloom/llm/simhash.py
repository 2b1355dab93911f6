"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits over the hashes of a text's word shingles. Copies of a fingerprint are first
merged into one representative (its smallest doc_id). Two fingerprints that differ in at most BUDGET bits
agree wholly in at least n of BUDGET + n blocks of bits, so each choice of n blocks is a mask whose bits name
the root nodes of a trie: fingerprints that agree there share a root, and their trie is walked against itself.
n is 2, and more only for so many fingerprints that roots would hold over ROOM each; the links are the same for
any n. The walk takes node pairs together, adds up the bits in which the nodes' prefixes differ, leaves a pair
as soon as the budget is exceeded, and also leaves a pair whose leaves all stand in one component already. A
root emits the links of a spanning forest, never all pairs.

A root with more than HOT fingerprints is not walked in one task: its fingerprints are dealt out again by two
further blocks of the bits that its mask leaves open, and so on until at most FREE bits are open, where a root
can't hold more than 2 to the FREE fingerprints. No fingerprint or link is dropped.

Components come from the links by the large-star and small-star steps, as joins and pre-aggregated
minima, each round written to the shared folder.

Defined cases: a null text is the empty text; texts without a word have fingerprint zero and are linked
like any other; a fingerprint that only rows without a doc_id have links others like any other, but a null
doc_id never becomes a component's id unless its component has no other; rows that repeat a doc_id give a row
each; an empty table gives no rows; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import read, sized, texts, utf8, without, written

WORDS, SEED, BUDGET = 4, 42, 4
#: Fingerprints under one root that are walked in one task; more are dealt out once more.
HOT = 4096
#: Fingerprints under a root, were they spread evenly, from which on roots take another block.
ROOM = 64
#: Up to so many fingerprints of one root are compared as a leaf.
LEAF = 48
#: Open bits of a root that is walked however many fingerprints it holds.
FREE = 20
#: What the pipeline drops: 4/5 of the shingles of so many words. Who is compared: by two fingerprints, of the distinct
#: shingles of 2 and of 3 words, of which either lies within WIDE bits and the other within ALSO (at web scale 64 bits alone
#: link strangers). All 48 pairs of different sets at 0.8 or more on the 0.1 tables are compared; of random edits that leave
#: 0.80 to 0.83, 99.8 %, of those that leave more, 99.9 to 100 %.
SIMILAR_WORDS, WIDE_WORDS, WIDE, ALSO = 5, (2, 3), 10, 18
WIDE_HOT, WIDE_ROOM = 1 << 14, 1 << 10
#: Sets of a component that one task takes in order, and rounds that begin with so many before all are taken at once.
GROUP, LEADS = 256, 3


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words (bytes of UTF-8; only A-Z change)."""
    parts = text.lower().split()
    if len(parts) <= words:
        return np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts), SEED) for _ in parts[:1]), np.uint64)
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    bounds = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[s:e], SEED) for s, e in bounds), np.uint64, len(parts) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes, as a signed number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        some = np.ascontiguousarray(hashes[i : i + 8192]).astype("<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, once: bool = False) -> DataFrame:
    """doc_id, fp for each row of docs; once: a shingle weighs 1 however often it occurs."""

    weighed = np.unique if once else lambda hashes: hashes

    def rows(batches):
        for batch in batches:
            column = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([majority(weighed(shingle_hashes(x.as_py(), words))) for x in column], pa.int64())], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(rows, "doc_id long, fp long")


class Forest:
    """Components of positions; members of the smaller side are relabelled, so labels are always flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return
        x, y = self.members.setdefault(a, [a]), self.members.setdefault(b, [b])
        if len(x) < len(y):
            a, b, x, y = b, a, y, x
        self.label[y] = a
        x += y
        del self.members[b]
        self.links.append((i, j))

    def one(self, a: slice, b: slice) -> bool:
        x, y = self.label[a], self.label[b]
        return bool((x == x[0]).all() and (y == x[0]).all())


def walk(values: np.ndarray, budget: int = BUDGET, leaf: int = LEAF, also: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all of the sorted, distinct uint64 values within budget bits: a self-join of their trie.

    A node is a range of values and the length of the prefix they share; its children part at the next bit.
    also: further fingerprints of the values, of which a link's may differ in ALSO bits.
    """
    forest = Forest(len(values))
    todo = [(0, len(values), 0, len(values))] if len(values) > 1 else []

    def depth(s: int, e: int) -> int:
        return 64 - int(values[s] ^ values[e - 1]).bit_length()

    def cut(s: int, e: int) -> int:
        bit = np.uint64(1) << np.uint64(63 - depth(s, e))
        top = values[e - 1] & ~(bit - np.uint64(1))
        return s + int(np.searchsorted(values[s:e], top))

    def compare(a: int, b: int, c: int, d: int) -> None:
        near = np.bitwise_count(values[a:b, None] ^ values[None, c:d]) <= budget
        if also is not None:
            near &= np.bitwise_count(also[a:b, None] ^ also[None, c:d]) <= ALSO
        near &= forest.label[a:b, None] != forest.label[None, c:d]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            forest.join(a + i, c + j)

    while todo:
        a, b, c, d = todo.pop()
        if a == c:
            if b - a < 2 or forest.one(slice(a, b), slice(a, b)):
                continue
            if b - a <= leaf:
                compare(a, b, c, d)
                continue
            m = cut(a, b)
            todo += [(a, m, m, b), (m, b, m, b), (a, m, a, m)]  # the children against themselves come first
            continue
        # accumulated difference: the bits that both prefixes fix
        fixed = min(depth(a, b), depth(c, d))
        if (int(values[a] ^ values[c]) >> (64 - fixed)).bit_count() > budget or forest.one(slice(a, b), slice(c, d)):
            continue
        if (b - a) * (d - c) <= leaf * leaf:
            compare(a, b, c, d)
        elif depth(a, b) <= depth(c, d) and b - a > 1 or d - c == 1:
            m = cut(a, b)
            todo += [(m, b, c, d), (a, m, c, d)]
        else:
            m = cut(c, d)
            todo += [(a, b, m, d), (a, b, c, m)]
    return forest.links


def blocks(bits: list[int], n: int) -> list[list[int]]:
    return [[int(b) for b in part] for part in np.array_split(np.array(bits), n)]


def roots(bits: list[int], budget: int, whole: int = 2) -> list[list[int]]:
    """The bit sets of which a pair within budget agrees on at least one: `whole` of budget + `whole` blocks."""
    return [sum(some, []) for some in combinations(blocks(bits, budget + whole), whole)]


def whole_blocks(n: int, budget: int, room: int = ROOM) -> int:
    """How many blocks make a root for n fingerprints."""
    whole = 2
    while n >> (64 * whole // (budget + whole)) > room:
        whole += 1
    return whole


def mask_of(bits: list[int]) -> int:
    """The bits as a signed number."""
    out = sum(1 << b for b in bits)
    return out - (out >> 63 << 64)


def further(mask: int, budget: int) -> list[int]:
    """The masks of the next deal of a root's fingerprints: its own bits and blocks of the open ones."""
    own = [b for b in range(64) if mask >> b & 1]
    return [mask_of(own + more) for more in roots([b for b in range(64) if not mask >> b & 1], budget)]


def _walk_groups(batches: Iterator[pa.RecordBatch], hot: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, fp, rep and perhaps also) in order of mask and of fp's bits in it, the key: links (a, b), and rows of hot groups as they are."""
    held: list[tuple[np.ndarray, ...]] = []  # the group that may go on in the next batch
    hot_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names)))
        if held:
            columns = tuple(np.concatenate([held[0][i], x]) for i, x in enumerate(columns))
            held = []
        mask, fp, rep, *also = columns
        key = fp & mask
        starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(mask)])
        links, through = [], []
        last = len(starts) - 1
        for g in np.flatnonzero((sizes > LEAF) | (np.arange(len(starts)) == last) | (np.arange(len(starts)) == 0)).tolist():
            s, n = int(starts[g]), int(sizes[g])
            here = (int(mask[s]), int(key[s]))
            some = tuple(x[s : s + n] for x in columns)
            if here == hot_key or n > hot and 64 - (here[0] % (1 << 64)).bit_count() > FREE:
                hot_key = here
                through.append(some)
            elif g == last:  # it may go on
                held = [some]
            elif n > 1:
                links.append(_group_links(*some[1:3], budget, *some[3:]))
        small = (sizes <= LEAF) & (sizes > 1)
        small[[0, last]] = False
        inside = np.repeat(small, sizes)
        if inside.any():
            group = np.repeat(np.arange(len(starts)), sizes)
            links.append(_small_links(fp[inside], rep[inside], group[inside], budget, *(x[inside] for x in also)))
        yield from _emitted(names, links, through)
    if held and len(held[0][0]) > 1:
        yield from _emitted(names, [_group_links(*held[0][1:3], budget, *held[0][3:])], [])


def _emitted(names: list[str], links: list[tuple[np.ndarray, np.ndarray]], through: list[tuple]) -> Iterator[pa.RecordBatch]:
    if links:
        a, b = (np.concatenate([x[i] for x in links]) for i in (0, 1))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), pa.int64()) for _ in names)], names=["a", "b", *names])
    for some in through:
        null = pa.nulls(len(some[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, *(pa.array(x) for x in some)], names=["a", "b", *names])


def _group_links(fp: np.ndarray, rep: np.ndarray, budget: int, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fp.view(np.uint64))
    pairs = walk(fp.view(np.uint64)[order], budget, also=None if also is None else also.view(np.uint64)[order])
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return rep[order][at[:, 0]], rep[order][at[:, 1]]


def _small_links(fp: np.ndarray, rep: np.ndarray, group: np.ndarray, budget: int, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Groups of a few members: each member against the k-th after it, for all groups at once; a spanning forest of what is near."""
    found, k = [np.zeros((0, 2), np.int64)], 1
    at = np.arange(len(fp) - 1)
    fp = fp.view(np.uint64)
    while len(at):
        at = at[at + k < len(fp)]
        at = at[group[at] == group[at + k]]
        near = np.bitwise_count(fp[at] ^ fp[at + k]) <= budget
        if also is not None:
            near &= np.bitwise_count(also[at].view(np.uint64) ^ also[at + k].view(np.uint64)) <= ALSO
        found.append(np.stack([at[near], at[near] + k], axis=1))
        k += 1
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    keep = []
    for i, j in np.concatenate(found).tolist():
        x, y = top(i), top(j)
        if x != y:
            parent[x] = y
            keep.append((i, j))
    pairs = np.array(keep, np.int64).reshape(-1, 2)
    return rep[pairs[:, 0]], rep[pairs[:, 1]]


def _deal(rows: DataFrame, hot: int, budget: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = rows.repartition(parts, "mask", key).sortWithinPartitions("mask", key)
    emits = ", ".join(f"{c} long" for c in ["a", "b", *rows.columns])
    return dealt.mapInArrow(lambda batches: _walk_groups(batches, hot, budget), emits)


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT, whole: int | None = None, room: int = ROOM) -> DataFrame:
    """distinct: fp, rep and perhaps also (see walk), each fp once. Links (a, b) of reps that connect all fingerprints within budget bits."""
    first = [mask_of(bits) for bits in roots(list(range(64)), budget, whole or whole_blocks(distinct.count(), budget, room))]
    rest = [c for c in distinct.columns if c != "rep" and c != "fp"]
    rows = distinct.select(F.explode(F.array(*(F.lit(m).cast("long") for m in first))).alias("mask"), "fp", "rep", *rest)
    out = None
    while True:
        found = written(_deal(rows, hot, budget), "trie-links")
        direct = found.where("a is not null").select("a", "b")
        out = direct if out is None else out.unionByName(direct)
        again = found.where("a is null").select("mask", "fp", "rep", *rest)
        masks = [r.mask for r in again.select("mask").distinct().collect()]  # as many as roots at most, 15 times as many each deal
        if not masks:
            return out
        table = rows.sparkSession.createDataFrame([(m, further(m % (1 << 64), budget)) for m in masks], "mask long, masks array<long>")
        rows = again.join(F.broadcast(table), "mask").select(F.explode("masks").alias("mask"), "fp", "rep", *rest)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. For each id that has a link and isn't its component's smallest: id, root (the smallest).

    Large-star and small-star in turn until nothing changes; minima are aggregated before they are shuffled
    and a hub's edges meet its minimum in a join that can be split.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, before = written(pairs, "star"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        before = state
        both = now.union(now.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(small.union(low.toDF("hi", "lo")).distinct(), "star")


def linked(each: DataFrame, distinct: DataFrame, budget: int, hot: int, room: int) -> DataFrame:
    """each: doc_id, fp; distinct: fp, rep, perhaps also. doc_id, fp, component_id for each row."""
    last = None
    if not distinct.where("rep is null").isEmpty():  # those get ids beyond all others, for the walk alone
        last = distinct.agg(F.max("rep")).first()[0] or 0
        distinct = written(distinct.withColumn("rep", F.coalesce("rep", F.lit(last) + 1 + F.monotonically_increasing_id())), "distinct-fingerprints")
    roots_of = components(links(distinct, budget, hot, room=room))
    name = F.coalesce("root", "rep")
    named = distinct.join(roots_of, distinct["rep"] == roots_of["id"], "left").select("fp", (name if last is None else F.when(name <= last, name)).alias("component_id"))
    return each.join(written(named, "components"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, hot: int = HOT, once: bool = False, room: int = ROOM) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    each = written(fingerprints(docs, words, once), "fingerprints")
    distinct = written(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    return linked(each, distinct, budget, hot, room)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: those with its smallest doc_id."""
    each = near_duplicates(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stands"))
    return without(docs, written(each.where("not stands").select("doc_id"), "dropped"))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of shingles share 4/5 or more of what either has; empty ones are alike."""
    a, b = len(x), len(y)
    if 5 * min(a, b) < 4 * max(a, b):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * shared >= 4 * (a + b - shared)


class Alike:
    """Sets that were added, by their smallest hashes: similar sets share one of the first fifth of either."""

    def __init__(self):
        self.index: dict[int, list[int]] = {}
        self.sets: list[np.ndarray] = []
        self.seen: set[bytes] = set()

    @staticmethod
    def first(x: np.ndarray) -> list[int]:
        return x[: len(x) - -(-4 * len(x) // 5) + 1].tolist()

    def add(self, x: np.ndarray) -> None:
        key = xxhash.xxh3_128_digest(x.tobytes())
        if key in self.seen:
            return
        self.seen.add(key)
        for h in self.first(x) if len(x) else ():
            self.index.setdefault(h, []).append(len(self.sets))
        self.sets.append(x)

    def meets(self, x: np.ndarray) -> bool:
        if xxhash.xxh3_128_digest(x.tobytes()) in self.seen:
            return True
        looked: set[int] = set()
        for h in self.first(x) if len(x) else ():
            for j in self.index.get(h, ()):
                if j not in looked:
                    looked.add(j)
                    if similar(x, self.sets[j]):
                        return True
        return False


def _dropped(rule: str):
    """Rows (group, leads, doc_id, tags) in order of group, leads (those first) and doc_id: ids of each group that `rule` drops.

    standing: those similar to one before them that is not dropped. leads: those similar to one that leads.
    earlier: those similar to any before them.
    """

    def rows(batches):
        group, alike = None, Alike()
        for batch in batches:
            out, tags = [], batch.column(3)
            for i, (g, leads, d) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if g != group:
                    group, alike = g, Alike()
                x = tags[i].values.to_numpy()
                gone = (rule != "leads" or not leads) and alike.meets(x)
                if gone:
                    out.append(d)
                if leads if rule == "leads" else rule == "earlier" or not gone:
                    alike.add(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["dropped_id"])

    return rows


def _dropped_of(rows: DataFrame, rule: str) -> DataFrame:
    """rows: group, leads, doc_id, tags. The ids that `rule` drops in some group, written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("group", "leads", "doc_id", "tags").repartition(parts, "group").sortWithinPartitions("group", F.desc("leads"), "doc_id")
    return written(dealt.mapInArrow(_dropped(rule), "dropped_id long").distinct(), "dropped")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, component_id. component_id, doc_id, tags (sorted hashes of distinct shingles of SIMILAR_WORDS) for each row."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                some = batch.slice(i, 100)
                sets = [np.unique(shingle_hashes(x.as_py(), SIMILAR_WORDS).view(np.int64)) for x in utf8(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(2), some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["component_id", "doc_id", "tags"])

    return texts(docs, "component_id").mapInArrow(rows, "component_id long, doc_id long, tags array<long>")


def two_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, also (of the distinct shingles of WIDE_WORDS) for each row of docs."""

    def rows(batches):
        for batch in batches:
            some = [x.as_py() for x in utf8(batch.column(1))]
            prints = [pa.array([majority(np.unique(shingle_hashes(x, words))) for x in some], pa.int64()) for words in WIDE_WORDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *prints], names=["doc_id", "fp", "also"])

    return texts(docs).mapInArrow(rows, "doc_id long, fp long, also long")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of the documents that either fingerprint links with others."""
    each, edges = written(two_fingerprints(docs), "fingerprints"), None
    for own, other in (("fp", "also"), ("also", "fp")):
        named = each.select("doc_id", F.col(own).alias("fp"), F.col(other).alias("also"))
        distinct = written(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by("also", "doc_id").alias("also")), "distinct-fingerprints")
        copies = named.join(distinct.select("fp", "rep"), "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = links(distinct, WIDE, WIDE_HOT, room=WIDE_ROOM).unionByName(copies)
        edges = found if edges is None else edges.unionByName(found)
    roots_of = components(edges)
    return written(roots_of.unionByName(roots_of.select(F.col("root").alias("id"), "root").distinct()).toDF("doc_id", "component_id"), "compared")


def _but(rows: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows whose doc_id is not (left_semi: is) among ids, one column."""
    return rows.join(sized(ids.toDF("other_id")), F.col("doc_id") == F.col("other_id"), how)


def dropped_similar(sets: DataFrame, group: int = GROUP, leads: int = LEADS) -> list[DataFrame]:
    """sets: component_id, doc_id (each once), tags, written. Tables of the ids that go: those similar to one of their component that has a smaller doc_id and stays.

    That rule alone decides, at any size. A component of up to `group` is taken in order by one task. Of a larger one
    the first `group` are, and those of them that stay are held against all others, which are dealt out by parts; what
    is still open goes on. If after `leads` such rounds more than `group` are open, rounds take all of a component at
    once, in tiles of two parts: whoever is similar to none open before it stays, whoever is similar to one of those goes.
    """
    gone, now, own, one = [], sets, F.xxhash64("doc_id"), F.lit(0).cast("long")
    for turn in range(1 << 30):
        large = written(now.groupBy("component_id").count().where(F.col("count") > group).select("component_id", F.ceil(F.col("count") / F.lit(group)).alias("deals")), "large")
        rest = now.join(sized(large), "component_id", "left")
        gone.append(_dropped_of(rest.where("deals is null").select(F.col("component_id").alias("group"), F.lit(False).alias("leads"), "doc_id", "tags"), "standing"))
        if large.isEmpty():
            return gone
        rest = rest.where("deals is not null")
        part, every = F.pmod(own, F.col("deals")), F.sequence(one, F.col("deals") - 1)
        if turn < leads:
            place = F.row_number().over(Window.partitionBy("component_id").orderBy("doc_id"))
            first = written(rest.select("component_id", "doc_id").withColumn("place", place).where(F.col("place") <= group).select("doc_id"), "first")
            ahead = _but(rest, first, "left_semi")
            gone.append(_dropped_of(ahead.select(F.col("component_id").alias("group"), F.lit(False).alias("leads"), "doc_id", "tags"), "standing"))
            staying, others = _but(ahead, gone[-1]), _but(rest, first)
            both = staying.select("component_id", F.lit(True).alias("leads"), "doc_id", "tags", F.explode(every).alias("part")).unionByName(others.select("component_id", F.lit(False).alias("leads"), "doc_id", "tags", part.alias("part")))
        else:
            tile = F.transform(every, lambda x: F.xxhash64("component_id", F.least(part, x), F.greatest(part, x)))
            late = _dropped_of(rest.select(F.explode(tile).alias("group"), F.lit(False).alias("leads"), "doc_id", "tags"), "earlier")
            staying, others = _but(rest, late), _but(rest, late, "left_semi")
            cells = lambda rows, lead: rows.select("component_id", F.lit(lead).alias("leads"), "doc_id", "tags", F.explode(F.transform(every, lambda x: part * F.col("deals") + x if lead else x * F.col("deals") + part)).alias("part"))
            both = cells(staying, True).unionByName(cells(others, False))
        gone.append(_dropped_of(both.withColumn("group", F.xxhash64("component_id", "part")), "leads"))
        now = written(_but(others, gone[-1]).select("component_id", "doc_id", "tags"), "open")


def deduplicate_similar(docs: DataFrame, group: int | None = None, leads: int | None = None) -> DataFrame:
    """The rows of docs without those that share 0.8 or more of their 5-word shingles with one of smaller doc_id that stays.

    The trie self-join at a wide budget only names who is compared: documents of one component, by the exact sets of
    their shingles (see dropped_similar). Of rows that repeat a doc_id the one whose set sorts first is compared, and
    all are kept or dropped. Rows without a doc_id are kept.
    """
    named = compared(docs.where("doc_id is not null"))
    ids = named.select(F.col("doc_id").alias("compared_id"), "component_id")
    wanted = texts(docs).join(sized(ids), F.col("doc_id") == F.col("compared_id")).select("doc_id", "text", "component_id")
    sets = written(shingle_sets(wanted), "sets")
    if not sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = written(sets.groupBy("component_id", "doc_id").agg(F.min("tags").alias("tags")), "sets")
    gone = dropped_similar(sets, group or GROUP, LEADS if leads is None else leads)
    every = gone[0]
    for more in gone[1:]:
        every = every.unionByName(more)
    return without(docs, written(every.distinct(), "dropped"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
