"""Substring dedup of words with fixed-block anchors.

Among runs that share a gram (see repeats), each run's non-overlapping blocks of half a window are indexed, and every rolling
window of that length probes the index. A repeat of a whole window holds a whole block of the other side, so no repeat is
missed. Each hit is extended to both sides, word by word by binary search over prefix hashes, to the maximal exact repeat; one
of a window or more, verified on its bytes, covers its words on both sides. All candidates go this way, copies of whole texts
too: without the index nothing is removed.

A block that stands in very many places would be extended from each of them to each; the windows around its hits are instead
grouped by the hash of all their words, and neighbours verified on their bytes, which marks the same windows.

Defined cases: a null or empty text has no words; windows never cross documents; repeated rows are copies of each other;
doc_id may be of any type, null or repeated; a very long text is read a stretch at a time; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import Chunk, load, mixed, prefix, span, word_hashes, words_of

LENGTH = 35
GRAM = 8
#: Places of a block that hits are extended to one by one.
PLACES = 32


def agreeing(p: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places a and b on (or before them) agree, at most so many, by binary search."""
    low, high = np.zeros(len(a), np.int64), most + 1  # low agree, high do not
    for _ in range(int(most.max(initial=0) + 1).bit_length()):
        mid = (low + high) >> 1
        same = span(p, a - mid, a) == span(p, b - mid, b) if back else span(p, a, a + mid) == span(p, b, b + mid)
        live = high - low > 1
        low, high = np.where(live & same, mid, low), np.where(live & ~same, mid, high)
    return low


def alike(r: repeats.Runs) -> np.ndarray:
    """Runs whose first blocks hit each other and extend to the end of both are equal; verified on the bytes."""
    c = Chunk(r.buf, r.offs, 0)
    starts, ends, heads = words_of(c)
    p = prefix(word_hashes(c, starts, ends))
    head, size = heads[r.of], np.diff(heads)[r.of]
    key = r.alike_at_best() + mixed(span(p, head, head + (r.w + 1) // 2))
    order = np.lexsort((span(p, head, head + size), key))
    a, b = order[:-1], order[1:]
    bytes_a, bytes_b = (r.offs[r.of[z] + 1] - r.offs[r.of[z]] for z in (a, b))
    at = np.flatnonzero((key[a] == key[b]) & (size[a] == size[b]) & (bytes_a == bytes_b))
    at = at[agreeing(p, head[a[at]], head[b[at]], size[a[at]]) == size[a[at]]]
    same = np.zeros(len(order), bool)
    same[at + 1] = repeats.equal_bytes(r.buf, r.offs[r.of[a[at]]], r.offs[r.of[b[at]]], bytes_a[at])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same)
    return out


def resolve(r: repeats.Runs) -> np.ndarray:
    c = Chunk(r.buf, r.offs, 0)
    starts, ends, heads = words_of(c)
    p = prefix(word_hashes(c, starts, ends))
    head, size = heads[r.of], np.diff(heads)[r.of]
    block = (r.w + 1) // 2
    own = r.group.view(np.uint64)

    def spots(count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, place and key of count blocks of each run, step words apart, sorted by key."""
        run = np.repeat(np.arange(len(count)), count)
        at = head[run] + step * (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
        key = mixed(span(p, at, at + block) + mixed(own[run]))
        order = np.argsort(key, kind="stable")
        return run[order], at[order], key[order]

    # the index of non-overlapping blocks, and the probes: every rolling window
    run_b, at_b, key_b = spots(size // block, block)
    run_a, at_a, key_a = spots(np.maximum(size - block + 1, 0), 1)
    left, right = np.searchsorted(key_b, key_a, "left"), np.searchsorted(key_b, key_a, "right")
    places = right - left
    few = (places > 0) & (places <= PLACES)
    first = np.concatenate([[0], np.cumsum(r.n)])
    mark = np.zeros(int(first[-1]) + 1, np.int64)  # where marked windows begin and end

    # extension of each hit to the maximal repeat
    hit = np.repeat(np.flatnonzero(few), places[few])
    ref = np.repeat(left[few], places[few]) + np.arange(len(hit)) - np.repeat(np.cumsum(places[few]) - places[few], places[few])
    x, a, y, b = run_a[hit], at_a[hit], run_b[ref], at_b[ref]
    other = (x != y) | (a != b)
    x, a, y, b = x[other], a[other], y[other], b[other]
    before = agreeing(p, a, b, np.minimum(a - head[x], b - head[y]), back=True)
    after = agreeing(p, a, b, np.minimum(head[x] + size[x] - a, head[y] + size[y] - b))
    long = before + after >= r.w
    x, a, y, b, n = x[long], (a - before)[long], y[long], (b - before)[long], (before + after)[long]
    # the hits of one repeat, once
    once = np.unique(np.stack([x, a, y, b]), axis=1, return_index=True)[1] if len(x) else np.zeros(0, np.int64)
    x, a, y, b, n = x[once], a[once], y[once], b[once], n[once]
    if len(x):
        bytes_a, bytes_b = (ends[z + n - 1] - starts[z] for z in (a, b))
        fine = bytes_a == bytes_b
        x, a, y, b, n, bytes_a = x[fine], a[fine], y[fine], b[fine], n[fine], bytes_a[fine]
        fine = repeats.equal_bytes(r.buf, starts[a], starts[b], bytes_a)
        for z, at in ((x, a), (y, b)):
            lo = first[z[fine]] + at[fine] - head[z[fine]]
            np.add.at(mark, lo, 1)
            np.add.at(mark, lo + n[fine] - r.w + 1, -1)
    out = np.cumsum(mark[:-1]) > 0

    # blocks that stand in very many places
    many = places > PLACES
    if many.any():
        hits = np.zeros(len(mark) + len(r.n) * r.w + 1, np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        hits[base[run_a[many]] + at_a[many] - head[run_a[many]] + 1] = 1
        hits = np.cumsum(hits)
        run, place = r.windows()
        live = np.flatnonzero(hits[base[run] + place + r.w - block + 1] > hits[base[run] + place])
        run, place = run[live], place[live]
        w = head[run] + place
        whole = mixed(span(p, w, w + r.w) + r.meeting(run, place))
        order = np.argsort(whole, kind="stable")
        near = np.flatnonzero(whole[order][1:] == whole[order][:-1])
        i, j = order[near], order[near + 1]
        n, m = (ends[w[k] + r.w - 1] - starts[w[k]] for k in (i, j))
        i, j, n = i[n == m], j[n == m], n[n == m]
        fine = repeats.equal_bytes(r.buf, starts[w[i]], starts[w[j]], n)
        out[live[i[fine]]] = out[live[j[fine]]] = True
    return out


def kind(length: int = LENGTH, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(True, length, gram, alike, resolve)


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = repeats.GROUP_LIMIT) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256."""
    own = kind(length, gram)
    return repeats.removed(documents, repeats.repeated(documents, own, limit), own).withColumnRenamed("n_items", "n_words")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(load(spark, sf_dir, "documents"))
