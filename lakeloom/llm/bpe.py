"""Byte-level BPE, encoded by prefix dynamic programming.

For each prefix of a piece one token can be the last of its encoding: the longest token that ends there
and that may follow the last token of what stands before it. Whether one token may follow another is
decided by taking both apart along their merges. A table of these last tokens gives the encoding read
from its end; an append only extends the table, an edit renews it up to where it agrees again.

Defined cases: a null text is the empty text, with no token; any other text decodes to its own bytes;
pieces of any length take time in proportion to it; an empty table gives no rows; a repeated row gives a row
each time, and rows without a doc_id are encoded like others; other columns are not read.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from itertools import accumulate, chain
from operator import itemgetter

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import read, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker keeps, and pairs of tokens it knows; when full it starts anew, so memory is bounded and results are the same.
KEPT_PIECES, KEPT_PAIRS = 150_000, 300_000
#: Bytes of text whose pieces are encoded together.
BLOCK = 2_000_000


def load_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by id, from a file of rank lines."""
    with open(path, "rb") as f:
        by_rank = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("the ranks must be 0 to n - 1")
    return [by_rank[i] for i in range(len(by_rank))]


class PrefixBPE:
    """Encoder and decoder for a vocabulary in which every single byte is a token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        self.ends: dict[bytes, int] = {}
        for i, t in enumerate(tokens):
            if len(t) == 1 or self._learn(i, t):
                self.ends[t] = i
        self.known.clear()
        for t in list(self.ends):
            for k in range(1, len(t)):
                self.ends.setdefault(t[k:], -1)

    def _learn(self, i: int, t: bytes) -> bool:
        """Find the last merge that makes token i; False if no merges make it."""
        for k in range(1, len(t)):
            a, b = self.ids.get(t[:k], i), self.ids.get(t[k:], i)
            if a < i and b < i and self.follows(a, b):
                self.left[i], self.right[i] = a, b
                self.merged[a, b] = i
                return True
        return False

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, encoded together, give a and b."""
        key = a << 32 | b
        if (seen := self.known.get(key)) is not None:
            return seen
        out = self._follows(a, b)
        if len(self.known) > KEPT_PAIRS:
            self.known.clear()
        self.known[key] = out
        return out

    def _follows(self, a: int, b: int) -> bool:
        # A merge across the border comes first if it ranks below the last merge undone on either side.
        limit = len(self.tokens)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b and self.left[a] != a or self.left[b] == b:
                if self.left[a] == a:
                    return True
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> None:
        """last: for each prefix of data that it covers, the last token (the empty prefix: -1). Goes on to the end."""
        ends, known, follows = self.ends, self.known, self.follows
        for i in range(len(last), (len(data) if until is None else until) + 1):
            found = []
            start = i - 1
            while start >= 0:
                t = ends.get(data[start:i])
                if t is None:
                    break
                if t >= 0:
                    found.append((t, start))
                start -= 1
            for t, start in reversed(found):
                if not start:
                    break
                p = last[start]
                ok = known.get(p << 32 | t)
                if follows(p, t) if ok is None else ok:
                    break
            last.append(t)

    def read(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        last = [-1]
        self.extend(piece, last)
        return self.read(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The encoding of one piece under appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, [-1]
        bpe.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def edit(self, start: int, end: int, put: bytes) -> int:
        """Replace data[start:end]; the number of prefixes that were computed anew."""
        old, shift = self.last, len(put) - (end - start)
        self.data = self.data[:start] + put + self.data[end:]
        self.last = self.last[: start + 1]
        same, i = 0, start
        while i < len(self.data):
            i += 1
            self.bpe.extend(self.data, self.last, i)
            # a token reaches no further back than the longest one: after so many equal entries all are equal
            same = same + 1 if i - shift > end and self.last[i] == old[i - shift] else 0
            if same >= self.bpe.longest:
                self.last += old[i - shift + 1 :]
                break
        return i - start

    def ids(self) -> list[int]:
        if (whole := self.bpe.ids.get(self.data)) is not None:
            return [whole]
        return self.bpe.read(self.last)


_READY: dict[str, tuple] = {}


def encoder(tokens: list[bytes], name: str) -> tuple[PrefixBPE, dict[str, tuple[int, ...]]]:
    """This worker's encoder and its pieces so far."""
    if name not in _READY:
        _READY[name] = (PrefixBPE(tokens), {})
    return _READY[name]


def learn(bpe: PrefixBPE, kept: dict[str, tuple[int, ...]], pieces: set[str]) -> None:
    """Encode pieces in order: each goes on from the table of the one before it, cut to the prefix they share."""
    last, before, ids = [-1], b"", bpe.ids
    for p, data in sorted(((p, p.encode()) for p in pieces), key=itemgetter(1)):
        if (whole := ids.get(data)) is not None:
            kept[p] = (whole,)
            continue
        n = 0
        for x, y in zip(data, before, strict=False):
            if x != y:
                break
            n += 1
        del last[n + 1 :]
        bpe.extend(data, last)
        kept[p] = tuple(bpe.read(last))
        before = data


def encode_texts(bpe: PrefixBPE, kept: dict[str, tuple[int, ...]], split, some: list[str]) -> list[list[int]]:
    """The ids of each text. kept goes with the vocabulary; when it is full it starts anew."""
    if len(kept) > KEPT_PIECES:
        kept.clear()
    pieces = [split(t) for t in some]
    learn(bpe, kept, set().union(*pieces).difference(kept))
    return [list(chain.from_iterable(map(kept.__getitem__, p))) for p in pieces]


def in_blocks(column: pa.Array, size: int):
    """The texts of a column in lists of about size bytes, a long text alone."""
    some, held = [], 0
    for x in column:
        some.append(x.as_py())
        held += len(some[-1])
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def tokenized(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids for each row of docs."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    tokens = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # a vocabulary's size is fixed: under 1 MB here

    def rows(batches):
        bpe, kept = encoder(tokens.value, path)
        split = regex.compile(pattern).findall
        decimal = [str(i) for i in range(len(bpe.tokens))].__getitem__
        for batch in batches:
            counts, written, decoded, lists = [], [], [], []
            for some in in_blocks(batch.column(1), BLOCK):
                for ids in encode_texts(bpe, kept, split, some):
                    counts.append(len(ids))
                    written.append(sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    decoded.append(sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        lists.append(pa.array(ids, pa.int32()))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(written, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                bounds = pa.array([0, *accumulate(counts)], pa.int32())
                columns["ids"] = pa.ListArray.from_arrays(bounds, pa.concat_arrays([pa.array([], pa.int32()), *lists]))
            yield pa.RecordBatch.from_pydict(columns)

    return texts(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(read(spark, sf_dir, "documents"), with_ids=False)
