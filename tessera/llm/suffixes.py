"""Suffix-array dedup of bytes: a hash-compared suffix sort.

Suffixes are the window starts of runs that share a gram (see repeats). They are sorted by mergesort; two are compared by
their longest common extension, found by binary search over prefix polynomial hashes, so that a comparison takes a
logarithmic number of steps. A first pass over their first eight bytes leaves only ties to the mergesort. Neighbours of the
sorted suffixes that agree in all bytes of a window are repeats; that they do is verified on the bytes, so that a collision
of hashes cannot remove text. All candidates go this way, copies of whole texts too: without the sort nothing is removed.

Defined cases: a null or empty text has no bytes; matches never cross documents; repeated rows are copies of each other;
doc_id may be of any type, null or repeated; a very long text is read a stretch at a time; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import load, prefix, span

LENGTH = 200
GRAM = 32


class Suffixes:
    """Suffixes of buf, compared up to a length of their own; those of one key have one length."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.hashes = buf, prefix(buf)

    def common(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Length of the longest common extension, at most length: whole ones first, then binary search."""
        out = length.copy()
        rest = np.flatnonzero(span(self.hashes, a, a + length) != span(self.hashes, b, b + length))
        a, b = a[rest], b[rest]
        low, high = np.zeros(len(rest), np.int64), length[rest]  # low agree, high do not
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            same = span(self.hashes, a, a + mid) == span(self.hashes, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid, low + 1))
        out[rest] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        n = self.common(a, b, length)
        last = np.minimum(n, length - 1)
        return (n < length) & (self.buf[a + last] < self.buf[b + last])

    def sort(self, starts: np.ndarray, key: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The order of the suffixes by key, then bytes, then place."""
        head = np.zeros(len(starts), np.uint64)
        for k in range(8):
            head = (head << np.uint64(8)) | self.buf[starts + k]
        order = np.lexsort((head, key))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (head[order][1:] != head[order][:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(order)]]))
        # runs whose neighbours all agree are in order already
        pair = np.flatnonzero(~new)
        apart = np.zeros(len(order), bool)
        i, j = order[pair], order[pair - 1]
        apart[pair] = span(self.hashes, starts[i], starts[i] + length[i]) != span(self.hashes, starts[j], starts[j] + length[i])
        tied = np.add.reduceat(apart, first) > 0
        first, size = first[tied], size[tied]
        width = 1
        while len(first):
            more = size > width
            first, size = first[more], size[more]
            if len(first):
                self._merge(order, starts, length, first, size, width)
            width *= 2
        return order

    def _merge(self, order: np.ndarray, starts: np.ndarray, length: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> None:
        """Merges neighbouring sorted blocks of width within each run: every element finds its rank in the other block."""
        run = np.repeat(np.arange(len(first)), size)
        base = first[run]
        at = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        block = at // width
        other = (block ^ 1) * width
        n = np.clip(size[run] - other, 0, width)
        own, long = starts[order[base + at]], length[order[base + at]]
        low, high = np.zeros(len(run), np.int64), n.copy()
        for _ in range(width.bit_length()):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) >> 1
            it = starts[order[base[live] + other[live] + mid]]
            # left elements come before equal right ones
            before = np.where(block[live] & 1, ~self.less(own[live], it, long[live]), self.less(it, own[live], long[live]))
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
        place = base + (block >> 1) * 2 * width + at % width + low
        moved = order[base + at]
        order[place] = moved

    def neighbours(self, starts: np.ndarray, key: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order, and which of it agree with the one before in their whole length, verified on the bytes."""
        order = self.sort(starts, key, length)
        same = np.zeros(len(order), bool)
        at = 1 + np.flatnonzero((key[order][1:] == key[order][:-1]) & (length[order][1:] == length[order][:-1]))
        a, b, n = starts[order[at - 1]], starts[order[at]], length[order[at]]
        whole = self.common(a, b, n) >= n
        at, a, b, n = at[whole], a[whole], b[whole], n[whole]
        same[at] = repeats.equal_bytes(self.buf, a, b, n)
        return order, same


def alike(r: repeats.Runs) -> np.ndarray:
    """The suffixes at which runs begin, sorted: neighbours that agree to their end are equal."""
    order, same = Suffixes(r.buf).neighbours(r.offs[r.of], r.alike_at_best(), r.n + r.w - 1)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same)
    return out


def resolve(r: repeats.Runs) -> np.ndarray:
    """The suffixes at which windows begin, sorted: neighbours that agree in a window are repeats."""
    run, at = r.windows()
    order, same = Suffixes(r.buf).neighbours(r.offs[r.of[run]] + at, r.meeting(run, at), np.full(len(run), r.w, np.int64))
    out = np.zeros(len(run), bool)
    out[order[same]] = out[order[np.flatnonzero(same) - 1]] = True
    return out


def kind(length: int = LENGTH, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(False, length, gram, alike, resolve)


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    own = kind(length, gram)
    return repeats.removed(documents, repeats.repeated(documents, own, limit), own).withColumnRenamed("n_items", "n_bytes")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(load(spark, sf_dir, "documents"))
