"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the longest prefixes that the model's compiled character map knows (a double-array trie);
each byte of the result keeps the span of source bytes it comes from. The normalised text is cut where no piece of
the vocabulary can reach across, so cuts can't change the result, and each stretch is merged by score, leftmost first;
stretches met before are kept. Every piece is projected through the alignment to the span of source bytes it covers:
copied characters to their own bytes, replaced ones to the whole prefix that the map replaced, the prefix space that
the model adds and the end id to empty spans.

Models read: merging ones (BPE), with or without byte pieces, without pieces of the user's own.

Defined cases: a null or empty text has the end id alone and decodes to nothing; a text's own U+2581 is a space after
decoding, as in the library; stretches of any length take n log n; an empty table gives no rows; a repeated row gives
a row each time, and rows without a doc_id are encoded like others; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from functools import cached_property
from hashlib import sha256
from itertools import accumulate, chain, compress, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.bpe import in_blocks
from lakeloom.llm.common import read, texts
from lakeloom.llm.merging import Merges

MODEL = "piece_bpe_32k.model"
SPACE = "\u2581"
#: Stretches whose pieces a worker keeps; when full it starts anew, so memory is bounded and results are the same.
KEPT = 400_000
#: Bytes of text that are encoded together, and characters of the longest stretch that is kept.
BLOCK, LONG = 2_000_000, 64
#: Stretches of so many characters are merged by looking at all neighbours, longer ones by a heap.
SHORT = 16


def fields(data: bytes):
    """The fields (number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[i : i + size]
            i += size


def character_map(compiled: bytes) -> dict[str, str]:
    """The prefixes of a compiled map and what replaces each, read from its double array."""
    if not compiled:
        return {}
    size = struct.unpack_from("<I", compiled)[0]
    units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
    strings, labels = compiled[4 + size :], units & (1 << 31 | 255)
    jump = lambda unit: int((unit >> 10) << ((unit & 512) >> 6))
    letters = np.arange(1, 256)
    out: dict[str, str] = {}
    todo = [(jump(units[0]), b"")]
    while todo:
        at, prefix = todo.pop()
        places = np.minimum(at ^ letters, len(units) - 1)
        for byte in letters[labels[places] == letters].tolist():
            here = at ^ byte
            key, below = prefix + bytes([byte]), here ^ jump(units[here])
            if units[here] >> 8 & 1:
                start = int(units[below]) & ~(1 << 31)
                out[key.decode()] = strings[start : strings.index(0, start)].decode()
            todo.append((below, key))
    return out


class Pieces:
    """A model: pieces, scores, its normaliser; encoder and decoder."""

    NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, model: bytes):
        self.names, self.scores, self.kinds = [], [], []
        trainer, normaliser = {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only models that merge (BPE) are read")
        if self.OWN in self.kinds or self.UNUSED in self.kinds:
            raise ValueError("models with pieces of the user's own, or unused ones, are not read")
        if trainer.get(24, 0) or not normaliser.get(5, 1):
            raise ValueError("models with spaces at the end of words, or without marks for spaces, are not read")
        self.map = character_map(normaliser.get(2, b""))
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.longest = max(map(len, self.map), default=0)
        firsts = "".join(sorted({k[0] for k in self.map}))
        self.candidates = re.compile(f"[{re.escape(firsts)}]") if firsts else None
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == self.NORMAL}
        #: decoding gives back space + text for each text without the mark itself
        self.exact = self.prefix and not self.squeeze and not self.map and bool(trainer.get(35, 0))
        self.unknown, self.end = self.kinds.index(self.UNKNOWN), self._special(trainer.get(47, b"</s>").decode())
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        by_byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == self.BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if trainer.get(35, 0) else None
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        # bytes that a piece stands for in the normalised text, and in a decoded one
        self.marked = [b"" if k == self.CONTROL else bytes([int(p[1:-1], 16)]) if k == self.BYTE else p.encode() for p, k in zip(self.names, self.kinds, strict=True)]
        self.surface = [self.unknown_surface.encode() if k == self.UNKNOWN else m.replace(SPACE.encode(), b" ") for m, k in zip(self.marked, self.kinds, strict=True)]
        self.lengths, self.widths = (np.array([len(m) for m in x], np.int64) for x in (self.marked, self.surface))
        self.split = re.compile(self._stretches()).findall
        #: neighbours that stand so in some piece: between all others a stretch can be cut
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    def _special(self, name: str) -> int:
        return self.names.index(name) if name in self.names else -1

    def _stretches(self) -> str:
        """A pattern of stretches that no piece crosses: cut before a space's mark that follows another character, and around line ends."""
        many = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in many):
            return r"(?s).+"
        if any("\n" in p for p in many):
            return f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"(?s){SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+"

    def normalised(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The normalised text, and the prefixes that were replaced: (start, end) in characters of text, and what stands for them."""
        if self.candidates is None:
            replaced: list[tuple[int, int, str]] = []
            plain = text
        else:
            replaced, out, done, known = [], [], 0, self.map
            for m in self.candidates.finditer(text):
                s = m.start()
                if s < done:
                    continue
                for e in range(min(len(text), s + self.longest), s, -1):
                    if (put := known.get(text[s:e])) is not None:
                        out += [text[done:s], put]
                        replaced.append((s, e, put))
                        done = e
                        break
            plain = "".join(out) + text[done:]
        if self.squeeze:
            plain = re.sub(" +", " ", plain).strip(" ")
        if not plain:
            return "", replaced
        normal = (SPACE if self.prefix else "") + plain.replace(" ", SPACE)
        return normal.rstrip(SPACE) if self.squeeze else normal, replaced

    def alignment(self, text: str, replaced: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the normalised text the start and the end of the source bytes it comes from."""
        starts, ends, at, done = [], [], 0, 0
        raw: list[bytes] = []
        for s, e, put in [*replaced, (len(text), len(text), "")]:
            same = text[done:s].encode()
            raw += [same, put.encode()]
            own = np.arange(at, at + len(same))
            at += len(same)
            size = len(text[s:e].encode())
            starts += [own, np.full(len(raw[-1]), at)]
            ends += [own + 1, np.full(len(raw[-1]), at + size)]
            at, done = at + size, e
        start, end = np.concatenate(starts), np.concatenate(ends)
        blank = np.frombuffer(b"".join(raw), np.uint8) == 32
        if self.squeeze:  # of a run of spaces the first stays, of those at either edge none
            keep = ~blank | np.r_[False, ~blank[:-1]]
            inner = np.flatnonzero(~blank)
            if not len(inner):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            keep[: inner[0]] = keep[inner[-1] + 1 :] = False
            start, end, blank = start[keep], end[keep], blank[keep]
        if not len(start):
            return start, end
        wide = np.where(blank, len(SPACE.encode()), 1)
        start, end = np.repeat(start, wide), np.repeat(end, wide)
        if self.prefix:
            start, end = np.r_[[0] * 3, start], np.r_[[0] * 3, end]
        return start, end

    def merged(self, stretch: str) -> list[str]:
        """The stretch's characters, neighbours merged while a piece stands for them: best score first, then leftmost."""
        parts, rank, never = list(stretch), self.rank, math.inf
        if len(parts) <= SHORT:
            ranks = [rank.get(x + y, never) for x, y in pairwise(parts)]
            while ranks and (best := min(ranks)) != never:
                i = ranks.index(best)
                parts[i] += parts.pop(i + 1)
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank.get(parts[i] + parts[i + 1], never)
                if i:
                    ranks[i - 1] = rank.get(parts[i - 1] + parts[i], never)
            return parts
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (found, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def of_stretch(self, stretch: str) -> tuple[int, ...]:
        ids: list[int] = []
        for p in self.merged(stretch):
            if (known := self.ids.get(p)) is not None:
                ids.append(known)
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def cut(self, stretch: str) -> list[str]:
        """The stretch in parts that no piece crosses."""
        out, start, joined = [], 0, self.joined
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in joined:
                out.append(stretch[start:i])
                start = i
        return [*out, stretch[start:]]

    def stretches(self, text: str) -> list[str]:
        return self.split(self.normalised(text)[0])

    @cached_property
    def merges(self) -> tuple[np.ndarray, Merges]:
        """The id of each character that is a piece or one byte (others: -1), and the pairs of pieces that make a piece."""
        letters = np.full(0x110000, -1, np.int64)
        if self.bytes:
            letters[:128] = self.bytes[:128]
        for p, i in self.ids.items():
            if len(p) == 1:
                letters[ord(p)] = i
        pairs = [(x, y, i) for p, i in self.ids.items() for k in range(1, len(p)) if (x := self.ids.get(p[:k])) is not None and (y := self.ids.get(p[k:])) is not None]
        left, right, whole = np.array(pairs, np.int64).reshape(-1, 3).T
        ranks = np.unique(-np.array(self.scores), return_inverse=True)[1]  # equal scores stay equal
        return letters, Merges(left, right, ranks[whole], whole)

    def encode(self, text: str, kept: Kept | None = None) -> list[int]:
        """The ids of a text, with the end id."""
        return self.encode_stretches(self.stretches(text), Kept(self) if kept is None else kept)

    def encode_stretches(self, stretches: list[str], kept: Kept) -> list[int]:
        ids = list(chain.from_iterable(map(kept.__getitem__, stretches)))
        if not self.bytes:  # unknown characters in a row are one
            ids = [x for i, x in enumerate(ids) if x != self.unknown or not i or ids[i - 1] != x]
        ids.append(self.end)
        return ids

    def encode_all(self, some: list[str], kept: Kept) -> list[list[int]]:
        """The ids of each text, with the end id; what is new in them is merged together."""
        cut = [self.stretches(t) for t in some]
        kept.learn(set().union(*cut))
        return [self.encode_stretches(x, kept) for x in cut]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each id the bytes of text it covers: start and end."""
        if self.exact and SPACE not in text:  # pieces cover what they decode to, but for the space before the text
            stop = np.maximum(np.cumsum(self.widths[np.array(ids, np.int64)]) - 1, 0)
            return np.r_[0, stop[:-1]], stop
        if not self.bytes and self.unknown in ids:
            raise ValueError("spans need a model with byte pieces where characters are unknown")
        normal, replaced = self.normalised(text)
        start, end = self.alignment(text, replaced)
        last = len(text.encode())
        stop = np.cumsum(self.lengths[np.array(ids, np.int64)])
        if not normal:
            return np.full(len(ids), last), np.full(len(ids), last)
        begin = np.r_[0, stop[:-1]]
        inside = stop > begin
        return np.where(inside, start[np.minimum(begin, len(start) - 1)], last), np.where(inside, end[np.maximum(stop - 1, 0)], last)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix or self.squeeze:  # one mark goes from the first piece; where spaces are squeezed, from each until something stands
            for i in ids:
                if self.kinds[i] == self.CONTROL:
                    continue
                if not self.marked[i].startswith(SPACE.encode()) or self.kinds[i] != self.NORMAL:
                    break
                out = out[1:]
                if not self.squeeze or self.names[i] != SPACE:
                    break
        try:
            return out.decode()
        except UnicodeDecodeError:
            return _replaced(out)


class Kept(dict):
    """The ids of stretches met so far; those of a new one are put together from its parts. Long ones aren't kept."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        parts = self.pieces.cut(stretch)
        ids = self.pieces.of_stretch(stretch) if len(parts) == 1 else sum((self[p] for p in parts), ())
        if len(stretch) <= LONG:
            self[stretch] = ids
        return ids

    def learn(self, stretches: set[str]) -> None:
        """Those that are new are merged together; long ones, and those with characters that are no pieces, are left to the other way."""
        letters, merges = self.pieces.merges
        new = [s for s in stretches.difference(self) if len(s) <= LONG]
        if not new:
            return
        symbols = letters[np.frombuffer("".join(new).encode("utf-32-le"), "<u4")]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        known = np.minimum.reduceat(symbols, np.cumsum(sizes) - sizes) >= 0
        if known.any():
            self.update(zip(compress(new, known.tolist()), merges.merged(symbols[np.repeat(known, sizes)], sizes[known]), strict=True))


def _replaced(data: bytes) -> str:
    """data as text, each byte that begins no valid character as U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[i : i + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            size = 1
        i += size
    return "".join(out)


_READY: dict[bytes, tuple[Pieces, Kept]] = {}


def ready(model: bytes) -> tuple[Pieces, Kept]:
    """This worker's model and its stretches so far."""
    key = sha256(model).digest()
    if key not in _READY:
        pieces = Pieces(model)
        _READY[key] = pieces, Kept(pieces)
    pieces, kept = _READY[key]
    if len(kept) > KEPT:
        kept.clear()
    return pieces, kept


def model_bytes(path: str | None = None) -> bytes:
    """A model file; its size is fixed by its vocabulary, half a megabyte here."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes (of the text, by spans) and, if asked for, ids and their spans (starts, ends) for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def rows(batches):
        data = model.value
        decimal = [str(i) for i in range(len(ready(data)[0].names))].__getitem__
        for batch in batches:
            counts, written, decoded, covered, lists = [], [], [], [], ([], [], [])
            for some in in_blocks(batch.column(1), BLOCK):
                pieces, kept = ready(data)
                for text, ids in zip(some, pieces.encode_all(some, kept), strict=True):
                    starts, ends = pieces.spans(text, ids)
                    counts.append(len(ids))
                    written.append(sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    decoded.append(sha256(pieces.decode(ids).encode()).hexdigest())
                    covered.append(int(np.maximum(ends - np.maximum(starts, np.r_[0, ends[:-1]]), 0).sum()))
                    if with_ids:
                        for into, x in zip(lists, (ids, starts, ends), strict=True):
                            into.append(pa.array(x, pa.int32()))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(written, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "covered_bytes": pa.array(covered, pa.int64())}
            if with_ids:
                bounds = pa.array([0, *accumulate(counts)], pa.int32())
                for name, x in zip(("ids", "starts", "ends"), lists, strict=True):
                    columns[name] = pa.ListArray.from_arrays(bounds, pa.concat_arrays([pa.array([], pa.int32()), *x]))
            yield pa.RecordBatch.from_pydict(columns)

    more = ", ids array<int>, starts array<int>, ends array<int>" * with_ids
    return texts(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long" + more)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), with_ids=False)
