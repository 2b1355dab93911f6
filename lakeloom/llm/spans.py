"""Spans in texts: base matches, their digest, and how a batch of documents becomes rows.

Matches are those of the plain patterns, leftmost and without overlap for each kind. Each scan passes
over a text once, however long its runs are.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa

Span = tuple[str, int, int]


def joined(found: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], order[x[0]], x[2])))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def span_rows(batches: Iterator[pa.RecordBatch], base: Callable[[str], list[Span]], more: Callable[[str, list[Span]], list[Span]], base_kinds: tuple[str, ...], kinds: tuple[str, ...], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A row for each (doc_id, text): counts of the base kinds, the base digest and all spans."""
    for batch in batches:
        counts: list[list[int]] = [[] for _ in base_kinds]
        digests, spans = [], []
        column = batch.column(1)
        for i in range(batch.num_rows):
            text = column[i].as_py()
            found = base(text)
            for k, n in zip(base_kinds, counts, strict=True):
                n.append(sum(f[0] == k for f in found))
            digests.append(digest(joined(found, base_kinds)))
            spans.append(joined(found + more(text, found), kinds))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *names, "base_sha256", "spans"])


class Taken:
    """Intervals that are in use; whether another is free is told in logarithmic time."""

    def __init__(self, found: list[Span]):
        ordered = sorted((s, e) for _, s, e in found)
        self.starts = [s for s, _ in ordered]
        self.ends = list(itertools.accumulate((e for _, e in ordered), max))

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return not i or self.ends[i - 1] <= start
