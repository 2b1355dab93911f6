"""Alignment of two tokenizers over the same bytes, by bitsets of token ends.

Texts are encoded by a byte-level vocabulary (A, over space + text) and by one of pieces (B, which adds the space
itself). A bit for each byte marks where a token ends; the AND of both bitsets is where both end, and cuts the tokens
into groups. The number of set bits up to a cut (rank: running popcounts of whole words, and of the part of one word)
is how many tokens of either side end there, so cuts become ranges of tokens. Within a group every token of A is
linked with every token of B.

Texts are cut into segments, before spaces that no token of either side reaches across; both sides end there. Segments
met before are kept with their groups and pairs, and a text is put together from its segments. The new segments of a
block of texts share one bitset: a segment's last byte is always a cut. Where a model may change a text, or has pieces
with a space inside, a text is one segment.

How often an id pair is linked is counted over the corpus: each text's distinct pairs are written once, counted by
pair with partial sums, and met with their counts again, by broadcast if the pairs are counted few, else by a join
that splits the pairs that very many texts hold.

Defined cases: null and empty texts, and those whose bytes either side doesn't give back (a text's own U+2581), have no
tokens: zeros and an empty string. Rows that repeat a doc_id are documents of their own, with or without a doc_id.
Texts of any length are read whole; a group is expanded up to CELLS links, a larger one by its distinct ids. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from hashlib import sha256
from itertools import chain, count, islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, pieces
from lakeloom.llm.common import SMALL, read, texts, written
from lakeloom.llm.merging import Merges
from lakeloom.operators.skew import skew_join

BYTES = "byte_bpe_50k.json"
#: Links of one group that are expanded one by one.
CELLS = 256
#: Segments that a worker keeps, and bytes of their groups; when full it starts anew.
SEGMENTS, SEGMENT_BYTES = 400_000, 64_000_000
#: Bytes of text that are read together, and of the longest piece that is merged by looking at all neighbours.
BLOCK, LONG = 1_000_000, 32
#: Texts that hold a pair from which it is split, where pairs aren't broadcast.
HOT = 100_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters, special = byte_letters(), {t["id"] for t in model["added_tokens"]}
    by_id = {i: bytes(map(letters.__getitem__, t)) for t, i in model["model"]["vocab"].items() if i not in special}
    if sorted(by_id) != list(range(len(by_id))):
        raise ValueError("the ids must be 0 to n - 1")
    return [by_id[i] for i in range(len(by_id))]


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """Words of 64 bits; bit p is set where a token ends with byte p."""
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def selected(words: np.ndarray) -> np.ndarray:
    """The places of all set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def ranks(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    upto = words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
    return before[word] + np.bitwise_count(upto)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: each position as often as its count says, and 0 to c - 1 within it."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct pairs, in order, and their times together."""
    if not len(text):
        return text, pair, times
    # the text stands above the pair where both fit in 64 bits
    wide = int(pair.max()) + 1
    if wide * (int(text.max()) + 1) < 1 << 63:
        code = text * wide + pair
        if int(times.sum()) <= 2 * len(times):  # nearly all once: sorting alone is faster than finding places
            code = np.sort(np.repeat(code, times))
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            code, times = code[first], np.diff(first, append=len(code))
            return code // wide, code % wide, times
        code, where = np.unique(code, return_inverse=True)
        text, pair = code // wide, code % wide
    else:
        order = np.lexsort((pair, text))
        new = np.r_[True, (text[order][1:] != text[order][:-1]) | (pair[order][1:] != pair[order][:-1])]
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(new) - 1
        text, pair = text[order][new], pair[order][new]
    return text, pair, np.bincount(where, weights=times).astype(np.int64)


class Digits:
    """The decimals of ids as rows of characters."""

    def __init__(self, n: int):
        names = [str(i).encode() for i in range(n)]
        self.length = np.array([len(x) for x in names], np.int64)
        self.wide = int(self.length.max())
        self.rows = np.frombuffer(b"".join(x.ljust(self.wide) for x in names), np.uint8).reshape(n, self.wide)


class Cuts:
    """Both sides' ids of a block of texts, cut into groups. text: of each token; all places are over the whole block."""

    def __init__(self, a: list[list[int]], b: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray):
        flat = (np.fromiter(chain.from_iterable(side), np.int64, sum(map(len, side))) for side in (a, b))
        self._cut(*flat, *(np.array([len(ids) for ids in side], np.int64) for side in (a, b)), a_sizes, b_sizes)

    @classmethod
    def flat(cls, *given: np.ndarray) -> Cuts:
        """From all ids of either side in a row, how many each text has, and the tokens' sizes."""
        out = cls.__new__(cls)
        out._cut(*given)
        return out

    def _cut(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        self.a, self.b, self.n_a, self.n_b, self.texts = a, b, n_a, n_b, len(n_a)
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        size = int(a_ends[-1]) if len(a_ends) else 0
        if size != (int(b_ends[-1]) if len(b_ends) else 0):
            raise ValueError("both sides must have the same bytes")
        if not size:
            self.a_stop = self.b_stop = self.text = np.zeros(0, np.int64)
        else:
            a_bits, b_bits = bitset(a_ends, size), bitset(b_ends, size)
            cuts = selected(a_bits & b_bits)
            self.a_stop, self.b_stop = ranks(a_bits, cuts), ranks(b_bits, cuts)
            self.text = np.searchsorted(np.cumsum(self.n_a), self.a_stop)  # texts of the groups
        self.a_start, self.b_start = (np.r_[0, x[:-1]] if len(x) else x for x in (self.a_stop, self.b_stop))
        self.wide_a, self.wide_b = self.a_stop - self.a_start, self.b_stop - self.b_start

    def n_groups(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)

    def n_links(self) -> np.ndarray:
        out = np.zeros(self.texts, np.int64)
        np.add.at(out, self.text, self.wide_a * self.wide_b)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, a, b, times: each text's distinct linked id pairs, and how often it links them."""
        links = self.wide_a * self.wide_b
        small = np.flatnonzero(links <= CELLS)
        at, inside = spread(links[small])
        group = small[at]
        i, j = self.a_start[group] + inside // self.wide_b[group], self.b_start[group] + inside % self.wide_b[group]
        keys = [(self.text[group], self.a[i], self.b[j], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(links > CELLS).tolist():
            xs, x_times = np.unique(self.a[self.a_start[g] : self.a_stop[g]], return_counts=True)
            ys, y_times = np.unique(self.b[self.b_start[g] : self.b_stop[g]], return_counts=True)
            keys.append((np.full(len(xs) * len(ys), self.text[g]), np.repeat(xs, len(ys)), np.tile(ys, len(xs)), np.outer(x_times, y_times).ravel()))
        text, a, b, times = (np.concatenate(x) for x in zip(*keys, strict=True))
        if not len(text):
            return text, a, b, times
        wide_b = int(b.max()) + 1
        text, pair, times = distinct(text, a * wide_b + b, times)
        return text, pair // wide_b, pair % wide_b, times

    def written(self, a_digits: Digits, b_digits: Digits) -> list[bytes]:
        """Each text's groups: a1,a2|b1;a3|b2,b3."""
        n_a, n_b, groups = len(self.a), len(self.b), len(self.text)
        of_a, of_b = np.repeat(np.arange(groups), self.wide_a), np.repeat(np.arange(groups), self.wide_b)
        wide = max(a_digits.wide, b_digits.wide) + 1
        cells, length, text = np.empty((n_a + n_b, wide), np.uint8), np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.int64)
        last_group = np.r_[self.text[1:] != self.text[:-1], True] if groups else np.zeros(0, bool)
        for ids, group, shift, stop, digits, end in ((self.a, of_a, self.b_start, self.a_stop, a_digits, "|"), (self.b, of_b, self.a_stop, self.b_stop, b_digits, ";")):
            token = np.arange(len(ids))
            place = token + shift[group]  # tokens of the other side that stand before it
            last = token == stop[group] - 1
            size = digits.length[ids]
            rows = np.zeros((len(ids), wide), np.uint8)
            rows[:, : digits.wide] = digits.rows[ids]
            rows[token, size] = np.where(last, ord(end), ord(","))
            cells[place], text[place] = rows, self.text[group]
            length[place] = size + ~(last & last_group[group] & (end == ";"))
        flat = cells[np.arange(wide) < length[:, None]]
        stops = [0, *np.cumsum(np.bincount(text, weights=length, minlength=self.texts).astype(np.int64)).tolist()]
        data = flat.tobytes()
        return [data[s:e] for s, e in pairwise(stops)]


class Known(dict):
    """The ids of pieces of text by the byte-level vocabulary; a new piece is merged, the lowest id first, then leftmost."""

    def __init__(self, a: bpe.PrefixBPE):
        super().__init__()
        self.a, self.single = a, [a.ids[bytes([i])] for i in range(256)]
        pairs = np.array([(x, y, i) for (x, y), i in a.merged.items()], np.int64).reshape(-1, 3)
        self.merges = Merges(pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 2])

    def learn(self, found: set[str]) -> None:
        """Those that are new are merged together; long ones are left to the other way."""
        new = [(p, data) for p in found.difference(self) if len(data := p.encode()) <= LONG]
        if new:
            symbols = np.array(self.single, np.int64)[np.frombuffer(b"".join(data for _, data in new), np.uint8)]
            sizes = np.fromiter((len(data) for _, data in new), np.int64, len(new))
            self.update(zip((p for p, _ in new), self.merges.merged(symbols, sizes), strict=True))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) > LONG:
            return tuple(self.a.encode(data))
        merged, never = self.a.merged.get, len(self.a.tokens)
        ids = [self.single[x] for x in data]
        ranks = [merged(pair, never) for pair in pairwise(ids)]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            ids[i : i + 2] = [best]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = merged((best, ids[i + 1]), never)
            if i:
                ranks[i - 1] = merged((ids[i - 1], best), never)
        self[piece] = out = tuple(ids)
        return out


_READY: dict[bytes, tuple] = {}


def segments_of(tokens: list[bytes], model: bytes) -> Segments:
    """This worker's encoders and the segments that it has met so far."""
    key = sha256(model).digest()
    if key not in _READY:
        a, b = bpe.PrefixBPE(tokens), pieces.Pieces(model)
        sizes = np.array([len(t) for t in tokens], np.int64), np.array([len(s) for s in b.surface], np.int64)
        known, split = Known(a), regex.compile(public_tokenizers.PATTERN).findall
        _READY[key] = known, Segments(known, b, split, sizes, (Digits(len(tokens)), Digits(len(b.names))))
    known, met = _READY[key]
    if len(known) > pieces.KEPT:
        known.clear()
    if len(met.places) > SEGMENTS or met.size > SEGMENT_BYTES:
        met.clear()
    return met


def tokens_of(known: Known, b: pieces.Pieces, kept: pieces.Kept, split, some: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """Which texts have tokens, and their ids of either side."""
    held, left, right = [], [], []
    full = {i: (b.stretches(text), split(" " + text)) for i, text in enumerate(some) if text}
    kept.learn(set().union(*(x for x, _ in full.values())))
    known.learn(set().union(*(x for _, x in full.values())))
    for i, (stretches, found) in full.items():
        other = b.encode_stretches(stretches, kept)
        other.pop()  # the end id
        # A's tokens are cut from these bytes themselves
        if pieces.SPACE not in some[i] if b.exact else b"".join(map(b.surface.__getitem__, other)) == (" " + some[i]).encode():
            held.append(i)
            left.append(list(chain.from_iterable(map(known.__getitem__, found))))
            right.append(other)
    return held, left, right


_ODD = re.compile(r"\s ").search
_CUT = re.compile(r"(?s)(?<=\S) (?=.)").split


def segments(text: str) -> list[str]:
    """A text that isn't empty, cut at each space that follows no blank and isn't the last character."""
    return _CUT(text) if text[0] == " " or text[-1] == " " or _ODD(text) else text.split(" ")


class Segments:
    """The segments met so far, in the order met: whether each has tokens, its groups and its distinct linked pairs."""

    def __init__(self, known: Known, b: pieces.Pieces, split, sizes: tuple[np.ndarray, np.ndarray], digits: tuple[Digits, Digits]):
        self.known, self.b, self.split, self.sizes, self.digits = known, b, split, sizes, digits
        self.wide = len(b.names)
        self.cut = b.exact and not any(pieces.SPACE in p.lstrip(pieces.SPACE) for p in b.ids)
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = defaultdict(count().__next__)
        self.size, self.written = 0, []
        #: of each segment: 1 if it has tokens, n_a, n_b, n_groups, n_links, the place of its first pair, how many pairs
        self.counts = np.zeros((7, 0), np.int64)
        #: pairs: a * wide + b, and times
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        self.counts = np.concatenate((self.counts, np.zeros((7, len(new)), np.int64)), 1)
        self.written += [b""] * len(new)
        plain = self._plain(new) if self.cut else np.zeros(len(new), bool)
        at = np.flatnonzero(plain)
        if len(at):
            self._add(at, self._together([new[i] for i in at.tolist()]), len(new))
        if len(at) < len(new):
            rest = np.flatnonzero(~plain)
            held, left, right = tokens_of(self.known, self.b, pieces.Kept(self.b), self.split, [new[i] for i in rest.tolist()])
            self._add(rest[held], Cuts(left, right, *self.sizes), len(new))

    def _plain(self, new: list[str]) -> np.ndarray:
        """Which segments are short, end in no blank, have no mark of their own, and have only characters that are symbols of B."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        letters = np.frombuffer("".join(new).encode("utf-32-le"), "<u4")
        known = (self.b.merges[0][letters] >= 0) & (letters != ord(pieces.SPACE))
        blank = np.fromiter((s[-1].isspace() for s in new), bool, len(new))
        return np.logical_and.reduceat(known, np.cumsum(sizes) - sizes) & (sizes < pieces.LONG) & ~blank

    def _together(self, plain: list[str]) -> Cuts:
        """Segments in a row, each with its space before it: tokens of neither side reach across."""
        row = " " + " ".join(plain)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
        letters = np.frombuffer(row.encode("utf-32-le"), "<u4")
        symbols, merges = self.b.merges
        b, n_b = merges.flat(np.where(letters == 32, symbols[ord(pieces.SPACE)], symbols[letters]), sizes)
        found = self.split(row)
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        in_bytes = np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF))[stops - 1]
        a, n = self.known.merges.flat(np.array(self.known.single, np.int64)[np.frombuffer(row.encode(), np.uint8)], np.diff(in_bytes, prepend=0))
        ends = np.searchsorted(stops, np.cumsum(sizes))  # the last piece of each segment
        return Cuts.flat(a, b, np.diff(np.cumsum(n)[ends], prepend=0), n_b, *self.sizes)

    def _add(self, at: np.ndarray, cuts: Cuts, new: int) -> None:
        """at: the places of the segments among the last `new`."""
        at = at + self.counts.shape[1] - new
        text, a, b, times = cuts.pairs()
        pairs = np.bincount(text, minlength=cuts.texts)
        self.counts[:, at] = np.ones(len(at), np.int64), cuts.n_a, cuts.n_b, cuts.n_groups(), cuts.n_links(), len(self.pair) + np.cumsum(pairs) - pairs, pairs
        for i, g in zip(at.tolist(), cuts.written(*self.digits), strict=True):
            self.written[i] = g
            self.size += len(g)
        self.size += 16 * len(text)
        self.pair, self.times = np.concatenate((self.pair, a * self.wide + b)), np.concatenate((self.times, times))

    def aligned(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], tuple[np.ndarray, ...]]:
        """Which texts have tokens; of these n_a, n_b, n_groups, n_links, their groups, and their distinct pairs (place in some, a, b, times)."""
        full = [i for i, t in enumerate(some) if t]
        cut = [segments(some[i]) if self.cut else [some[i]] for i in full]
        before = len(self.places)
        code = np.fromiter(map(self.places.__getitem__, chain.from_iterable(cut)), np.int64)
        if len(self.places) > before:
            self._learn(list(islice(self.places, before, None)))
        if not full:
            return np.zeros(0, np.int64), np.zeros((4, 0), np.int64), [], (code, code, code, code)
        sizes = np.array([len(x) for x in cut], np.int64)
        start = np.cumsum(sizes) - sizes
        has = np.minimum.reduceat(self.counts[0, code], start) > 0
        held = np.array(full, np.int64)[has]
        counts = np.add.reduceat(self.counts[1:5, code], start, 1)[:, has]
        written, places = self.written, code.tolist()
        groups = [b";".join(map(written.__getitem__, places[s : s + n])) for s, n in zip(start[has].tolist(), sizes[has].tolist(), strict=True)]
        code, text = code[np.repeat(has, sizes)], np.repeat(held, sizes[has])
        at, inside = spread(self.counts[6, code])
        pair = self.counts[5, code][at] + inside
        text, pair, times = distinct(text[at], self.pair[pair], self.times[pair])
        return held, counts, groups, (text, pair // self.wide, pair % self.wide, times)


ONE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
SCHEMA = ONE + ", a int, b int, times long"


def cut_texts(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, with_groups: bool = False) -> DataFrame:
    """Two kinds of rows: one for each row of docs (n_a not null), and one for each of its distinct linked id pairs (a not null)."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast((byte_tokens(byte_path or public_tokenizers.path(BYTES)), pieces.model_bytes(piece_path)))

    def rows(batches):
        tokens, model = vocabulary.value
        for batch in batches:
            done = 0
            for some in bpe.in_blocks(batch.column(1), BLOCK):
                held, counts, groups, (text, x, y, times) = segments_of(tokens, model).aligned(some)
                row, doc = batch.column(2).slice(done, len(some)), batch.column(0).slice(done, len(some))
                done += len(some)
                ones = np.zeros((4, len(some)), np.int64)
                ones[:, held] = counts
                digests, lists = [""] * len(some), [""] * len(some)
                for i, g in zip(held.tolist(), groups, strict=True):
                    digests[i] = sha256(g).hexdigest()
                    if with_groups:
                        lists[i] = g.decode()
                null = pa.nulls(len(some), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [row, doc, *map(pa.array, ones), pa.array(digests, pa.string()), pa.array(lists, pa.string()) if with_groups else pa.nulls(len(some), pa.string()), null, null, pa.nulls(len(some), pa.int64())],
                    names=[f.split(" ")[0] for f in SCHEMA.split(", ")],
                )
                rows_of = row.take(pa.array(text))
                no = pa.nulls(len(text), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows_of, no, no, no, no, no, pa.nulls(len(text), pa.string()), pa.nulls(len(text), pa.string()), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(times)],
                    names=[f.split(" ")[0] for f in SCHEMA.split(", ")],
                )

    return texts(docs, F.monotonically_increasing_id().alias("row")).mapInArrow(rows, SCHEMA)


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, with_groups: bool = False, few: int = SMALL, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups, for each row of docs."""
    both = written(cut_texts(docs, byte_path, piece_path, with_groups), "cuts")
    pairs = both.where("a is not null").select("row", "a", "b", "times")
    counted = written(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("texts")), "pair-counts")
    best = counted.groupBy("a").agg(F.max("texts").alias("most"))  # a row for each id of A at most: the size of its vocabulary
    known = counted.join(F.broadcast(best), "a").select("a", "b", "texts", (F.col("texts") == F.col("most")).alias("best"))
    if counted.count() <= few:
        met = pairs.join(F.broadcast(known), ["a", "b"])
    else:
        # no more than KEYS pairs may be split: from so many texts on that fewer pairs are in as many
        keys = counted.select("a", "b", F.col("texts").alias("_rows"))
        met = skew_join(pairs, known, ["a", "b"], splittable(counted, hot), keys=keys)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("texts")).alias("count_sum"))
    ones = both.where("n_a is not null").drop("a", "b", "times")
    none = F.lit(0).cast("long")
    out = ones.join(sums, "row", "left").withColumns({"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)


def splittable(counted: DataFrame, hot: int, most: int = 50_000) -> int:
    """The least power of two times `hot` that at most `most` pairs are over."""
    levels = counted.where(F.col("texts") > hot).groupBy(F.floor(F.log2(F.col("texts") / F.lit(hot))).alias("level")).count().collect()
    above, level = 0, max((r["level"] for r in levels), default=-1) + 1
    sizes = {r["level"]: r["count"] for r in levels}
    while level > 0 and above + sizes.get(level - 1, 0) <= most:
        level -= 1
        above += sizes.get(level, 0)
    return hot << level


def op12_token_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read(spark, sf_dir, "documents"))
