"""Language-model scores by a Katz backoff model with Good-Turing discounts.

Training counts every token of every training text: words (lower-cased A-Z, split at ASCII white space) and
one end for each text; and every pair of a word and the one before it, over all words.

    P(w | b) = d(n) n / n(b) where the pair b w occurs, else alpha(b) P(w)
    P(w) = d(n) n / (N + 1), and what the discounts leave is that of one unseen word, which stands for all

d are Good-Turing discounts for counts up to 5 (absolute discounts where the counts of counts allow none), of
pairs and of words; a context whose pairs lose nothing counts one more, so that something is left to back off
to; alpha makes the words after each context sum to one. A context that was not seen backs off with weight
one. The context of a text's first token is an end.

How it is dealt out. Texts are cut into blocks of about TOKENS tokens, written as numbers of the block's own
vocabulary. A block asks for the counts of its distinct words and pairs, each once, and says how often its
training texts hold them; the questions go to buckets, ranges of the 64-bit hash of a word or pair, which add
up what all blocks say, write the sums as tables (a row for each bucket, its keys in order) and answer each
block. So no word or context is hot, however common, and nothing is gathered in one place. What contexts need
for alpha are whole numbers (how many followers occur how often), summed in the same way: one block alone,
the first that holds a pair, counts it as a follower. New texts are scored by the same steps, with the rows
of the tables among the questions.

Defined cases: a null text is the empty text, whose one token is its end; without training texts N and V
are 0 and every token is unseen; rows that repeat a doc_id give a row each; a null doc_id is not trained on
and not held out; an empty table gives no rows; a text of more than TOKENS tokens is a block of its own,
read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from struct import Struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import crc_mod, held_out, read, released, removed, texts, utf8, written

LAST_DISCOUNTED = 5
#: No word holds white space, so this can't be one.
END = b"\n"
#: Tokens of a block, questions to a bucket (as far as blocks' tokens tell), and buckets for each task at least.
TOKENS, ROOM, SPREAD = 2_000_000, 1_000_000, 4
HASH_SEED = 42


def tokens(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(END)
    return out


def discounts(of: dict[int, int]) -> tuple[np.ndarray, float]:
    """Good-Turing factors d[1:] for counts 1 to LAST_DISCOUNTED from counts of counts; and an absolute discount for all counts, 0 if the factors hold."""
    k = LAST_DISCOUNTED
    d = np.ones(k + 1)
    n = [0] + [of.get(r, 0) for r in range(1, k + 2)]
    if all(n[1:]):
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            for r in range(1, k + 1):
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if all(0 < x < 1 for x in d[1:]):
                return d, 0.0
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.ones(k + 1), absolute


def discounted(n: np.ndarray, d: np.ndarray, absolute: float) -> np.ndarray:
    n = np.asarray(n, float)
    return n * d[np.minimum(n, LAST_DISCOUNTED).astype(int)] * (n <= LAST_DISCOUNTED) + n * (n > LAST_DISCOUNTED) - absolute * (n > 0)


@dataclass
class Counts:
    """What all buckets of words, or of pairs, hold together: the sum, how many there are, and how many occur 1, 2 ... 6 times."""

    total: int
    types: int
    few: list[int]

    def discounts(self) -> tuple[np.ndarray, float]:
        return discounts({r + 1: n for r, n in enumerate(self.few)})


@dataclass
class Tables:
    """counts: kind (words, pairs), bucket, keys, counts; contexts: bucket, keys, followers, alpha (see unfolded); buckets of each kind."""

    counts: DataFrame
    contexts: DataFrame | None
    buckets: dict[str, int]
    words: Counts
    pairs: Counts

    @property
    def unseen(self) -> float:
        """P of the unseen word."""
        (d, absolute), w = self.words.discounts(), self.words
        taken = sum((1 - d[r]) * r * w.few[r - 1] for r in range(1, LAST_DISCOUNTED + 1)) + absolute * w.types
        return (taken + 1) / (w.total + 1)


# Numbers in few bytes

HEAD = Struct("<IB")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, or the bits of others, byte by byte of all of them, compressed; bytes that are 0 everywhere at the top are left."""
    x = np.ascontiguousarray(x)
    if x.dtype.itemsize < 8:
        x = x.astype(np.uint64)
    planes = x.view(np.uint8).reshape(-1, 8).T
    k = 8
    while k and not planes[k - 1].any():
        k -= 1
    return HEAD.pack(len(x), k) + pa.compress(np.ascontiguousarray(planes[:k]).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, k = HEAD.unpack_from(data)
    out = np.zeros((n, 8), np.uint8)
    if n and k:
        out[:, :k] = np.frombuffer(pa.decompress(data[HEAD.size :], n * k, "zstd", asbytes=True), np.uint8).reshape(k, n).T
    return out.reshape(-1).view(np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def rows_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that are in order of their first columns, by those."""
    held, now = [], None
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            if held and row[:keys] != now:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fields(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


LONG, BYTES, INT, TEXT = pa.int64(), pa.binary(), pa.int32(), pa.string()


# Blocks

BLOCK = fields(block=LONG, docs=pa.list_(LONG), train=BYTES, sizes=BYTES, words=BYTES, tokens=BYTES, n_tokens=LONG, n_words=LONG)
BLOCK_SQL = "block long, docs array<long>, train binary, sizes binary, words binary, tokens binary, n_tokens long, n_words long"


class Numbers(dict):
    """A number for each word, in order of arrival."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, text, train). A block's words are its own, the commonest first."""
    number, docs, train, some, first, n = Numbers(), [], [], [], None, 0

    def out():
        ids = np.concatenate(some)
        order = np.argsort(-np.bincount(ids), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = list(number)
        hashes = np.fromiter((xxhash.xxh64_intdigest(names[i], HASH_SEED) for i in order.tolist()), np.uint64, len(order))
        sizes = np.array([len(x) for x in some])
        return batch_of(BLOCK, [(first, docs, packed(np.array(train, np.uint64)), packed(sizes), hashes.tobytes(), packed(rank[ids]), len(ids), len(hashes))])

    for batch in batches:
        rows, ids, column, flags = batch.column(0), batch.column(1), utf8(batch.column(2)), batch.column(3)
        for i in range(batch.num_rows):
            words = tokens(column[i].as_py())
            if first is None:
                first = rows[i].as_py()
            some.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            docs.append(ids[i].as_py())
            train.append(bool(flags[i].as_py()))
            n += len(words)
            if n >= TOKENS:
                yield out()
                number, docs, train, some, first, n = Numbers(), [], [], [], None, 0
    if some:
        yield out()


class Block:
    """A block's tokens and its distinct words and pairs, in order of their keys."""

    def __init__(self, train: bytes, sizes: bytes, words: bytes, tokens_: bytes):
        self.sizes = unpacked(sizes).astype(np.int64)
        self.token = unpacked(tokens_).astype(np.int64)
        self.train = np.repeat(unpacked(train) > 0, self.sizes)
        self.word = np.frombuffer(words, np.uint64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        # each text ends with an end, so one stands before the next
        self.before = np.r_[self.token[-1:], self.token[:-1]]
        self.word_order = np.argsort(self.word, kind="stable")
        codes, self.pair = np.unique(self.before * len(self.word) + self.token, return_inverse=True)
        self.pair_before, self.pair_word = codes // len(self.word), codes % len(self.word)
        key = self.word[self.pair_before] * np.uint64(0x9E3779B97F4A7C15) + self.word[self.pair_word]
        key ^= key >> np.uint64(32)
        self.pair_key = key * np.uint64(0xD6E8FEB86659FD93)
        self.pair_order = np.argsort(self.pair_key, kind="stable")

    def asked(self) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """kind, keys in order, and how often the training texts hold them."""
        n_words = np.bincount(self.token[self.train], minlength=len(self.word))
        n_pairs = np.bincount(self.pair[self.train], minlength=len(self.pair_key))
        return [("words", self.word[self.word_order], n_words[self.word_order]), ("pairs", self.pair_key[self.pair_order], n_pairs[self.pair_order])]


def in_buckets(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """bucket, start, end: n equal ranges of keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return list(zip(bucket[bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


# Counts

ASKED = fields(kind=TEXT, bucket=INT, block=LONG, keys=BYTES, counts=BYTES)
ASKED_SQL = "kind string, bucket int, block long, keys binary, counts binary"
SUMMED = fields(kind=TEXT, bucket=INT, block=LONG, keys=BYTES, counts=BYTES, total=LONG, types=LONG, few=pa.list_(LONG))
SUMMED_SQL = ASKED_SQL + ", total long, types long, few array<long>"
#: The block that rows of a table come under.
TABLE = -1


def asking(buckets: dict[str, int], learn: bool):
    """Questions of blocks; learn: with their own counts."""

    def rows(batches):
        for (name,), ((train, sizes, words, tokens_),) in rows_of(batches, 1):
            for kind, keys, counts in Block(train, sizes, words, tokens_).asked():
                said = counts if learn else np.zeros_like(counts)
                out = [(kind, b, name, packed_keys(keys[s:e]), packed(said[s:e])) for b, s, e in in_buckets(keys, buckets[kind])]
                yield batch_of(ASKED, out)

    return rows


def summing(learn: bool):
    """Rows (kind, bucket, block, keys, counts) by kind and bucket: an answer for each block and, to learn, the bucket's table.

    Of each key an answer holds twice its count, and one more for the first block that counted it.
    """

    def rows(batches):
        for (kind, bucket), some in rows_of(batches, 2):
            parts = [unpacked_keys(r[1]) for r in some]
            keys, said = np.concatenate(parts), np.concatenate([unpacked(r[2]) for r in some])
            order = np.argsort(keys, kind="stable")
            keys, said = keys[order], said[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums = np.add.reduceat(said, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
            counted = np.flatnonzero(said)
            own = counted[np.r_[True, group[counted][1:] != group[counted][:-1]][: len(counted)]]
            answer = sums[group] * np.uint64(2)
            answer[own] += np.uint64(1)
            back = np.empty_like(answer)
            back[order] = answer
            out = []
            if learn:
                held = sums > 0
                few = np.bincount(np.minimum(sums, LAST_DISCOUNTED + 2).astype(np.int64), minlength=LAST_DISCOUNTED + 3)
                out.append((kind, bucket, TABLE, packed_keys(keys[first][held]), packed(sums[held]), int(sums.sum()), int(held.sum()), few[1 : LAST_DISCOUNTED + 2].tolist()))
            at = np.cumsum([len(p) for p in parts])
            out += [(f"{kind} answered", bucket, r[0], None, packed(back[e - len(p) : e]), None, None, None) for r, p, e in zip(some, parts, at, strict=True) if r[0] != TABLE]
            yield batch_of(SUMMED, out)

    return rows


def dealt(rows: DataFrame, *by: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows that are equal in `by` together and in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by).sortWithinPartitions(*by, *then)


def counts_of(table: DataFrame, kind: str) -> Counts:
    few = [F.sum(F.col("few")[r]) for r in range(LAST_DISCOUNTED + 1)]
    total, types, *few = (int(x or 0) for x in table.where(F.col("kind") == kind).agg(F.sum("total"), F.sum("types"), *few).first())
    return Counts(total, types, few)


# Scores but for backoff weights, and what contexts need

#: Whole numbers of a context: followers that occur after it 1 to 5 times, all followers, their sum; followers that occur anywhere 1 to 5 times, and the sum of the others' counts.
FOLLOWERS = 2 * LAST_DISCOUNTED + 3
PART = fields(kind=TEXT, bucket=INT, block=LONG, keys=BYTES, followers=pa.list_(BYTES), wanted=BYTES, docs=pa.list_(LONG), sums=pa.list_(BYTES), open=pa.list_(BYTES))
PART_SQL = "kind string, bucket int, block long, keys binary, followers array<binary>, wanted binary, docs array<long>, sums array<binary>, open array<binary>"


def followers(block: Block, n_word: np.ndarray, n_pair: np.ndarray, own: np.ndarray) -> np.ndarray:
    """FOLLOWERS numbers for each word of the block as a context, over the pairs that this block counts for all."""
    b, n, m = block.pair_before[own], n_pair[own], n_word[block.pair_word[own]]
    size = len(block.word)
    out = np.zeros((FOLLOWERS, size), np.int64)
    for r in range(1, LAST_DISCOUNTED + 1):
        out[r - 1] = np.bincount(b[n == r], minlength=size)
        out[LAST_DISCOUNTED + 1 + r] = np.bincount(b[m == r], minlength=size)
    out[LAST_DISCOUNTED] = np.bincount(b, minlength=size)
    np.add.at(out[LAST_DISCOUNTED + 1], b, n)
    np.add.at(out[-1], b[m > LAST_DISCOUNTED], m[m > LAST_DISCOUNTED])
    return out


def weights(f: np.ndarray, words: Counts, pairs: Counts) -> tuple[np.ndarray, np.ndarray]:
    """log10 of alpha and of the factor that pairs seen after the context get besides, from a context's numbers; a context without followers: 0."""
    k = LAST_DISCOUNTED
    (d1, absolute1), (d2, absolute2) = words.discounts(), pairs.discounts()
    r = np.arange(1, k + 1)
    total = f[k + 1].astype(float)
    lost = ((1 - d2[1:]) * r) @ f[:k] + absolute2 * f[k]
    more = (lost < 1e-9) & (total > 0)
    below = np.maximum(total + more, 1)
    lower = (d1[1:] * r) @ f[k + 2 : 2 * k + 2] + f[-1] - absolute1 * f[k]
    with np.errstate(divide="ignore"):
        alpha = np.log10((lost + more) / below) - np.log10((words.total + 1 - lower) / (words.total + 1))
    return np.where(total > 0, alpha, 0.0), np.where(more, np.log10(np.maximum(total, 1) / below), 0.0)


def scoring(words: Counts, pairs: Counts, unseen: float, buckets: int):
    """Blocks with the answers to them: each document's sums, its open places, and the contexts' numbers."""
    below = float(np.log10(words.total + words.types + 1))

    def rows(batches):
        (d1, absolute1), (d2, absolute2) = words.discounts(), pairs.discounts()
        for (name,), parts in rows_of(batches, 1):
            mine = next(p for p in parts if p[0] == "block")
            answers = {k: np.concatenate([unpacked(p[2]) for p in parts if p[0] == k]).astype(np.int64) for k in ("words answered", "pairs answered")}
            docs, block = mine[3], Block(*mine[4:8])
            n_word, n_pair = np.empty(len(block.word), np.int64), np.empty(len(block.pair_key), np.int64)
            n_word[block.word_order] = answers["words answered"] >> 1
            n_pair[block.pair_order] = answers["pairs answered"]
            own, n_pair = (n_pair & 1) > 0, n_pair >> 1
            n = len(docs)
            with np.errstate(divide="ignore", invalid="ignore"):
                alone = np.where(n_word > 0, np.log10(discounted(n_word, d1, absolute1) / (words.total + 1)), np.log10(unseen))
                seen = n_pair > 0
                p = np.where(seen, np.log10(discounted(n_pair, d2, absolute2) / n_word[block.pair_before]), alone[block.pair_word])
            known = np.bincount(block.doc, n_word[block.token] > 0, n)
            base = np.bincount(block.doc, (np.log10(n_word + 1.0) - below)[block.token], n)
            sums = [packed(block.sizes), packed(known.astype(np.int64)), packed(base), packed(np.bincount(block.doc, p[block.pair], n))]

            # open: tokens that back off from a known context, and seen ones after a context whose pairs may lose nothing
            least = np.full(len(block.word), np.iinfo(np.int64).max)
            np.minimum.at(least, block.pair_before[seen], n_pair[seen])
            lossless = least > LAST_DISCOUNTED if not absolute2 else np.zeros(len(block.word), bool)
            backs = (~seen & (n_word[block.pair_before] > 0))[block.pair]
            may = (seen & lossless[block.pair_before])[block.pair]
            at = np.flatnonzero(backs | may)
            codes, where = np.unique(block.doc[at] * len(block.word) + block.before[at], return_inverse=True)
            of_doc, context = codes // len(block.word), codes % len(block.word)
            wanted = np.zeros(len(block.word), bool)
            wanted[context] = True
            place = np.cumsum(wanted[block.word_order]) - 1  # among the wanted ones, in order of their keys
            of_word = np.empty(len(block.word), np.int64)
            of_word[block.word_order] = place
            backed = np.bincount(where, backs[at], len(codes)).astype(np.int64)
            maybe = np.bincount(where, may[at], len(codes)).astype(np.int64)
            opened = [packed(np.diff(of_doc, prepend=0)), packed(of_word[context]), packed(backed), packed(maybe)]
            yield batch_of(PART, [("documents", None, name, None, None, None, docs, sums, opened)])

            numbers = followers(block, n_word, n_pair, own)
            told = block.word_order[((numbers[LAST_DISCOUNTED] > 0) | wanted)[block.word_order]]
            keys, numbers, wanted = block.word[told], numbers[:, told], wanted[told]
            out = [("contexts", b, name, packed_keys(keys[s:e]), [packed(x[s:e]) for x in numbers], packed(wanted[s:e]), None, None, None) for b, s, e in in_buckets(keys, buckets)]
            yield batch_of(PART, out)

    return rows


CONTEXTS = fields(kind=TEXT, bucket=INT, block=LONG, keys=BYTES, followers=pa.list_(BYTES), alpha=BYTES, factor=BYTES)
CONTEXTS_SQL = "kind string, bucket int, block long, keys binary, followers array<binary>, alpha binary, factor binary"


def weighing(words: Counts, pairs: Counts, learn: bool):
    """Contexts' numbers by bucket: the weights that each block wants and, to learn, the table of contexts."""

    def rows(batches):
        for (bucket,), some in rows_of(batches, 1):
            parts = [unpacked_keys(r[1]) for r in some]
            keys = np.concatenate(parts)
            said = np.stack([np.concatenate([unpacked(r[2][k]) for r in some]) for k in range(FOLLOWERS)])
            names, where = np.unique(keys, return_inverse=True)
            order = np.argsort(where, kind="stable")
            starts = np.searchsorted(where[order], np.arange(len(names)))
            numbers = np.add.reduceat(said[:, order], starts, axis=1).astype(np.int64)
            alpha, factor = weights(numbers, words, pairs)
            held = numbers[LAST_DISCOUNTED] > 0
            out = [("contexts", bucket, TABLE, packed_keys(names[held]), [packed(x[held]) for x in numbers], packed(alpha[held]), packed(factor[held]))] if learn else []
            at = np.cumsum([len(p) for p in parts])
            for r, p, e in zip(some, parts, at, strict=True):
                if r[0] != TABLE:
                    mine = where[e - len(p) : e][unpacked(r[3]) > 0]
                    out.append(("answered", bucket, r[0], None, None, packed(alpha[mine]), packed(factor[mine])))
            yield batch_of(CONTEXTS, out)

    return rows


def finishing(batches):
    """Each document's sums with the weights of its open places."""
    names = fields(doc_id=LONG, n_tokens=LONG, n_known=LONG, base_score=pa.float64(), score=pa.float64())
    for _, parts in rows_of(batches, 1):
        mine = next(p for p in parts if p[0] == "documents")
        weight = [np.concatenate([np.zeros(0), *(unpacked(p[k]).view(np.float64) for p in parts if p[0] == "answered")]) for k in (2, 3)]
        sizes, known = (unpacked(x).astype(np.int64) for x in mine[5][:2])
        base, score = (unpacked(x).view(np.float64) for x in mine[5][2:])
        doc, context, backed, maybe = (unpacked(x).astype(np.int64) for x in mine[6])
        more = backed * weight[0][context] + maybe * weight[1][context]
        score = score + np.bincount(np.cumsum(doc), more, len(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(mine[4], LONG), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], schema=names)


# The whole

SCORES_SQL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def modelled(docs: DataFrame, tables: Tables | None = None) -> tuple[Tables, DataFrame]:
    """docs: doc_id, text, train. The tables, and doc_id, n_tokens, n_known, train_tokens, base_score, score for each row.

    Without tables they are learnt from the rows with train; else they are only read.
    """
    spark, learn = docs.sparkSession, tables is None
    rows = texts(docs, "train").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "train")
    blocks = written(rows.mapInArrow(blocks_of, BLOCK_SQL), "blocks")
    if learn:
        n_tokens, n_words = (int(x or 0) for x in blocks.agg(F.sum("n_tokens"), F.sum("n_words")).first())
        least = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = {"words": max(least, n_words // ROOM), "pairs": max(least, n_tokens // ROOM)}
    else:
        buckets = tables.buckets
    asked = blocks.select("block", "train", "sizes", "words", "tokens").mapInArrow(asking(buckets, learn), ASKED_SQL)
    if not learn:
        asked = asked.unionByName(tables.counts.select("kind", "bucket", "block", "keys", "counts"))
    counts = written(dealt(asked, "kind", "bucket", then=("block",)).mapInArrow(summing(learn), SUMMED_SQL), "counts", "kind")
    released(spark)
    if learn:
        table = counts.where(F.col("block") == TABLE)
        tables = Tables(table, None, buckets, counts_of(table, "words"), counts_of(table, "pairs"))
    words, pairs = tables.words, tables.pairs

    answers = counts.where(F.col("block") != TABLE).select("block", "kind", "bucket", "counts")
    own = blocks.select("block", F.lit("block").alias("kind"), "docs", "train", "sizes", "words", "tokens")
    met = own.unionByName(answers, allowMissingColumns=True).select("block", "kind", "bucket", "counts", "docs", "train", "sizes", "words", "tokens")
    some = written(dealt(met, "block", then=("kind", "bucket")).mapInArrow(scoring(words, pairs, tables.unseen, buckets["words"]), PART_SQL), "scored", "kind")
    removed(blocks)
    released(spark)

    told = some.where("kind = 'contexts'").select("bucket", "block", "keys", "followers", "wanted")
    if not learn:
        told = told.unionByName(tables.contexts.select("bucket", "block", "keys", "followers"), allowMissingColumns=True)
    contexts = written(dealt(told, "bucket", then=("block",)).mapInArrow(weighing(words, pairs, learn), CONTEXTS_SQL), "contexts", "kind")
    if learn:
        tables.contexts = contexts.where("kind = 'contexts'")

    documents = some.where("kind = 'documents'").select("block", "kind", "docs", "sums", "open")
    back = contexts.where("kind = 'answered'").select("block", "kind", "bucket", "alpha", "factor")
    met = back.unionByName(documents, allowMissingColumns=True).select("block", "kind", "bucket", "alpha", "factor", "docs", "sums", "open")
    scores = dealt(met, "block", then=("kind", "bucket")).mapInArrow(finishing, SCORES_SQL)
    total = F.lit(words.total).cast("long").alias("train_tokens")
    return tables, scores.select("doc_id", "n_tokens", "n_known", total, "base_score", "score")


def train_tables(train: DataFrame) -> Tables:
    """The model of all rows of train (doc_id, text)."""
    return modelled(train.select("doc_id", "text", F.lit(True).alias("train")))[0]


def score_by_tables(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    return modelled(docs.select("doc_id", "text", F.lit(False).alias("train")), tables)[1]


def unfolded(table: DataFrame) -> DataFrame:
    """A table of counts as plain rows: kind, key (hash), n."""

    def rows(batches):
        for (kind, keys, counts), _ in rows_of(batches, 3):
            k, n = unpacked_keys(keys).view(np.int64), unpacked(counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k), TEXT), pa.array(k), pa.array(n)], names=["kind", "key", "n"])

    return table.select("kind", "keys", "counts").mapInArrow(rows, "kind string, key long, n long")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("train", F.coalesce(crc_mod(7) != 2, F.lit(False)))
    return modelled(docs)[1].select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")
