"""Repeated substrings over a whole corpus: what the suffix-array and the fixed-block operator share.

A window of w items (bytes or words) is repeated if the same items also start anywhere else. Windows meet where they must:
each selects, of its grams, the one of the least hash, and equal windows select equal grams, so that a text sends on one row
for each run of windows with the same gram (a run is about w / 2 long), not one a window. Runs whose gram is nowhere else
hold no repeat. This only routes; what is repeated is decided by the operator's own method over the runs of one gram, on
their items, and nothing is removed that it did not find.

Copies do not make that work grow. Documents of one text (by 128 bits of its SHA-256) are one text with a number of copies;
the method sees a text with copies twice. Runs with equal gram and equal items (by two 64-bit hashes) are a class; the method
sees the first and the last of it. What it finds for those holds for the others once a digest of their own bytes, taken from
each document as it is rewritten, is that of the bytes that were compared; where it is not, nothing is removed.

A gram with very many classes is not gathered: its classes of several runs are compared each by itself, and the windows of all
its classes are dealt by their own hash and compared, as runs of one window, by the same method.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, chunks, mixed, prefix, span, stored, word_hashes, words_of

#: Classes of one gram that a task compares at once; those of a gram with more are dealt by window.
GROUP_LIMIT = 2048
#: Bytes of run texts that a task compares at a time, beyond the last whole group.
TASK_BYTES = 2 << 20
#: Items or bytes of a long text that are looked at at a time.
STRETCH = 1 << 20
DIGEST = 16


@dataclass(frozen=True)
class Kind:
    """words: items are words, else bytes. w items a window, g a gram.

    The method: alike numbers the runs of whole groups, equal ones alike; resolve marks their repeated windows.
    """

    words: bool
    w: int
    g: int
    alike: Callable[["Runs"], np.ndarray]
    resolve: Callable[["Runs"], np.ndarray]


@dataclass
class Runs:
    """Runs of whole groups: text of run k is buf[offs[of[k]]:offs[of[k] + 1]], with n[k] windows, gram at item off[k] of it."""

    buf: np.ndarray
    offs: np.ndarray
    of: np.ndarray
    group: np.ndarray
    n: np.ndarray
    off: np.ndarray
    w: int

    def some(self, rows: np.ndarray) -> "Runs":
        return Runs(self.buf, self.offs, self.of[rows], self.group[rows], self.n[rows], self.off[rows], self.w)

    def alike_at_best(self) -> np.ndarray:
        """Equal runs have equal numbers: their gram, where it stands, and how many windows they have."""
        return mixed(self.group.view(np.uint64) + mixed((self.off << 32 | self.n).astype(np.uint64)))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Run and place in it, of each window."""
        run = np.repeat(np.arange(len(self.n)), self.n)
        return run, np.arange(len(run)) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def meeting(self, run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Equal windows have equal numbers: their gram, and where it stands in the window."""
        return mixed(self.group.view(np.uint64)[run] + mixed((self.off[run] - at).astype(np.uint64)))


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def runs_of(values: np.ndarray, heads: np.ndarray, w: int, g: int) -> dict[str, np.ndarray]:
    """The runs of windows with one gram. values: the items; heads: where each document's items begin, and the end."""
    n, p = len(values), prefix(values)
    if n < w:
        return {k: np.zeros(0, np.int64) for k in ("h", "ctx", "doc", "lo", "n", "off")}
    at = np.arange(n - g + 1)
    grams = mixed(span(p, at, at + g))
    bits = np.uint64(max(20, n.bit_length()))
    # the least hash; of equal ones the first in the window
    chosen = least((grams >> bits << bits) | at.astype(np.uint64), w - g + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    across = np.zeros(n - w + 2, np.int32)
    inner = heads[1:-1]
    np.add.at(across, np.clip(inner - w + 1, 0, n - w + 1), 1)
    np.add.at(across, np.clip(inner, 0, n - w + 1), -1)
    i = np.flatnonzero(np.cumsum(across[:-1]) == 0)
    if not len(i):
        return runs_of(values[:0], heads, w, g)
    a = chosen[i].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1)]))
    lo, last, a = i[new], i[np.concatenate([new[1:] - 1, [len(i) - 1]])], a[new]
    ctx = mixed(mixed(span(p, lo, last + w)) + mixed(((a - lo) << 32 | (last - lo)).astype(np.uint64)))
    doc = np.searchsorted(heads, lo, "right") - 1
    return {"h": grams[a].view(np.int64), "ctx": ctx.view(np.int64), "doc": doc, "lo": lo - heads[doc], "n": last - lo + 1, "off": a - lo}


def runs_within(values: np.ndarray, w: int, g: int) -> Iterator[dict[str, np.ndarray]]:
    """runs_of one text, a stretch of its windows at a time."""
    for lo in range(0, max(1, len(values) - w + 1), STRETCH):
        own = values[lo : lo + STRETCH + w - 1]
        r = runs_of(own, np.array([0, len(own)]), w, g)
        r["lo"] = r["lo"] + lo
        yield r


def stretches(buf: np.ndarray, size: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Of a text, each ending before a white space, so that no word is cut."""
    lo, n = 0, len(buf)
    while lo < n:
        hi, step = lo + size, 4096
        while hi < n:
            near = buf[hi : hi + step]
            white = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            if len(white):
                hi += int(white[0])
                break
            hi, step = hi + step, step * 2
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, hashes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of a text, and its hash if asked for."""
    parts = []
    for lo, hi in stretches(buf):
        c = Chunk(buf[lo:hi], np.array([0, hi - lo]), 0)
        a, b, _ = words_of(c)
        parts.append((a + lo, b + lo, word_hashes(c, a, b) if hashes else a[:0]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Text:
    """One text: its number of items, and the bytes of items [a, b), words joined by one space."""

    def __init__(self, buf: np.ndarray, words: bool):
        self.buf, self.list = buf, None
        if words and len(buf) <= STRETCH:
            self.list = buf.tobytes().split()
        elif words:
            self.starts, self.ends, _ = word_spans(buf)
        self.words, self.n = words, len(self.list) if self.list is not None else len(self.starts) if words else len(buf)

    def items(self, a: int, b: int) -> bytes:
        if self.list is not None:
            return b" ".join(self.list[a:b])
        if not self.words:
            return self.buf[a:b].tobytes()
        return b" ".join(self.buf[self.starts[a] : self.ends[b - 1]].tobytes().split()) if b > a else b""

    def kept(self, a: np.ndarray, b: np.ndarray) -> str:
        """SHA-256 of the items outside the intervals, words joined by one space."""
        out, first = hashlib.sha256(), True
        for lo, hi in zip([0, *b.tolist()], [*a.tolist(), self.n], strict=True):
            for x in range(lo, hi, STRETCH):
                out.update((b"" if first or not self.words else b" ") + self.items(x, min(hi, x + STRETCH)))
                first = False
        return out.hexdigest()


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching intervals [a, b)."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate([[True], a[1:] > b[:-1]])
    return a[first], b[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(a) - 1]])]


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id, t (128 bits of the text's digest), text (binary, null is empty)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return documents.select("doc_id", F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("t"), text.alias("text"))


def distinct_texts(documents: DataFrame, least: int) -> DataFrame:
    """id (a number given here), t, m (documents that have the text), text, of the texts of least bytes or more."""
    texts = texts_of(documents).where(F.length("text") >= least).select("t", "text")
    again = stored(texts.groupBy("t").agg(F.count("*").alias("m")).where("m > 1"))
    single = texts.join(again, "t", "left_anti").select("t", F.lit(1).alias("m"), "text")
    # drawn together within each task before they are dealt, so that a text with very many copies is no large group
    several = texts.join(again.select("t"), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    # the numbers are those of this one writing
    return stored(single.union(several.join(again, "t").select("t", F.col("m").cast("int"), "text")).select(F.monotonically_increasing_id().alias("id"), "t", "m", "text"))


RUN = "h long, ctx long, id long, m int, lo int, n int, off int"


def run_rows(texts: DataFrame, kind: Kind) -> DataFrame:
    """h, ctx, id, m, lo, n, off: the runs of texts (id, m, text)."""
    names = [x.split()[0] for x in RUN.split(", ")]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2), 1 << 19):
                if c.n == 1:
                    values = word_spans(c.buf, True)[2] if kind.words else c.buf
                    found = runs_within(values, kind.w, kind.g)
                elif kind.words:
                    starts, ends, heads = words_of(c)
                    found = [runs_of(word_hashes(c, starts, ends), heads, kind.w, kind.g)]
                else:
                    found = [runs_of(c.buf, c.offs, kind.w, kind.g)]
                for r in found:
                    if len(r["h"]):
                        at = pa.array(r["doc"] + c.first)
                        yield pa.RecordBatch.from_arrays([pa.array(r["h"]), pa.array(r["ctx"]), batch.column(0).take(at), batch.column(1).take(at), *[pa.array(r[k].astype(np.int32)) for k in ("lo", "n", "off")]], names)

    return texts.select("id", "m", "text").mapInArrow(select, RUN)


def classes_of(runs: DataFrame) -> DataFrame:
    """h, ctx, c (runs of the class, copies counted), one and two (its first and last run)."""
    one = F.struct("id", "lo", "n", "off", "m")
    return stored(runs.groupBy("h", "ctx").agg(F.sum("m").alias("c"), F.min(one).alias("one"), F.max(one).alias("two")))


def shown(classes: DataFrame, group) -> DataFrame:
    """The runs that the method sees of each class."""
    each = F.explode(F.array_distinct(F.array("one", "two")))
    out = classes.select(group.alias("g"), "h", "ctx", (F.col("c") == 1).alias("once"), each.alias("r"))
    return out.select("r.id", F.struct("g", "h", "ctx", "once", "r.lo", "r.n", "r.off", (F.col("r.m") > 1).alias("twice")).alias("r"))


def with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """id, r, text: rows (id, r) gathered by text, at most as many as it has runs."""
    lists = rows.groupBy("id").agg(F.collect_list("r").alias("r"))
    return texts.select("id", "text").join(lists.hint("shuffle_hash"), "id").select("id", "r", "text")


def each_run(batch: pa.RecordBatch, words: bool, rows: int = 4096) -> Iterator[tuple[int, Text, pa.StructArray]]:
    """Row, text and some of the runs of with_texts()' rows, those of one row one after the other."""
    lists = batch.column(1)
    flat, counts = lists.flatten(), lists.value_lengths().to_numpy()
    ends = np.cumsum(counts)
    for c in chunks(batch.column(2), 1 << 22):
        for k in range(c.n):
            row = c.first + k
            text = Text(c.buf[c.offs[k] : c.offs[k + 1]], words)
            first = int(ends[row] - counts[row])
            for lo in range(first, int(ends[row]), rows):
                yield row, text, flat.slice(lo, min(rows, int(ends[row]) - lo))


def repeated(documents: DataFrame, kind: Kind, limit: int = GROUP_LIMIT) -> DataFrame:
    """t, r: the text's list of (a, b, lo, hi, digest): its items [a, b), which may overlap, are covered by repeated windows.

    Where there is a digest, that is so if it is the one of the items [lo, hi).
    """
    w = kind.w
    texts = distinct_texts(documents, 2 * w - 1 if kind.words else w)  # shorter ones hold no window
    runs = run_rows(texts, kind)
    met = runs.groupBy("h").agg(F.sum("m").alias("_c")).where("_c > 1").select("h")
    # stored, so that the join reads both sides from shuffles of its own and splits a frequent gram
    met = stored(runs.join(stored(met), "h"), plain=True)
    classes = classes_of(met)
    hot = stored(classes.groupBy("h").agg(F.count("*").alias("_k")).where(F.col("_k") > limit).select("h"))
    members = met.select("h", "ctx", "id", "lo", "n")
    if not hot.limit(1).count():
        rows = shown(classes, F.col("h"))
    else:
        rows = shown(classes.join(hot, "h", "left_anti"), F.col("h"))
        dense = classes.join(hot, "h", "left_semi")
        rows = rows.union(shown(dense.where("c > 1"), F.xxhash64("h", "ctx")))
        dealt = stored(deal(with_texts(texts, dense.select("one.id", F.struct("one.lo", "one.n", F.least("c", F.lit(2).cast("long")).cast("int").alias("m")).alias("r"))), kind), plain=True)
        rows = rows.union(shown(classes_of(dealt).where("c > 1"), F.xxhash64("h", "ctx", F.lit(1))))
        members = members.union(dealt.where("m = 1").select("h", "ctx", "id", "lo", "n"))
    found = with_texts(texts, rows).mapInArrow(_gathered(fetch(kind)), FETCHED)
    judged = stored(found.repartition("g").sortWithinPartitions("g").mapInArrow(compare(kind), JUDGED))
    sole = judged.where("once").select("id", "a", "b", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(None).cast("binary").alias("digest"))
    held = judged.where("not once").select("h", "ctx", "a", "b", "digest").distinct()
    same = members.join(held, ["h", "ctx"]).select("id", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"), "lo", (F.col("lo") + F.col("n") + (w - 1)).alias("hi"), "digest")
    # at most as many as the text has runs
    lists = sole.union(same).groupBy("id").agg(F.collect_set(F.struct("a", "b", "lo", "hi", "digest")).alias("r"))
    return lists.join(texts.select("id", "t"), "id").select("t", "r")


FETCHED = "g long, h long, ctx long, once boolean, id long, lo int, n int, off int, twice boolean, text binary"
JUDGED = "h long, ctx long, once boolean, id long, a int, b int, digest binary"


def fetch(kind: Kind) -> Callable:
    """The items of each run."""
    names = [x.split()[0] for x in FETCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, part in each_run(batch, kind.words):
                lo, n = (part.field(k).to_pylist() for k in ("lo", "n"))
                data = [text.items(a, a + m + kind.w - 1) for a, m in zip(lo, n, strict=True)]
                same = pa.array(np.full(len(part), row))
                yield pa.RecordBatch.from_arrays([*[part.field(x) for x in ("g", "h", "ctx", "once")], batch.column(0).take(same), *[part.field(x) for x in ("lo", "n", "off", "twice")], pa.array(data, pa.binary())], names)

    return run


def deal(rows: DataFrame, kind: Kind) -> DataFrame:
    """The windows of runs, each as a run of its own, known by two hashes."""
    w = kind.w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, part in each_run(batch, kind.words, 256):
                lo, n, m = (part.field(k).to_numpy() for k in ("lo", "n", "m"))
                a, ends = int(lo.min()), int((lo + n).max()) + w - 1
                # runs of one text lie close to each other as a rule; far ones are taken one by one
                near = [np.arange(len(lo))] if ends - a <= STRETCH else [np.array([k]) for k in range(len(lo))]
                for own in near:
                    a, ends = int(lo[own].min()), int((lo[own] + n[own]).max()) + w - 1
                    data = np.frombuffer(text.items(a, ends), np.uint8)
                    p = prefix(word_spans(data, True)[2] if kind.words else data)
                    at = np.repeat(lo[own] - a, n[own]) + np.arange(int(n[own].sum())) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                    h = mixed(span(p, at, at + w))
                    ctx = mixed(span(p, at, at + w // 2) + np.uint64(w))
                    same = pa.array(np.full(len(at), row))
                    whole = lambda x, k=len(at): pa.array(np.full(k, x, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), batch.column(0).take(same), pa.array(np.repeat(m[own], n[own])), pa.array((at + a).astype(np.int32)), whole(1), whole(0)], [x.split()[0] for x in RUN.split(", ")])

    return rows.mapInArrow(_gathered(run, 20_000), RUN)


def compare(kind: Kind) -> Callable:
    """What the method finds repeated in runs sorted by group; a group is compared once it is whole."""
    w = kind.w

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = next(chunks(batch.column(9), 1 << 62))
        once, twice = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 8))
        group, n, off = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 6, 7))
        # a text with copies is seen twice
        of = np.concatenate([np.arange(len(n)), np.flatnonzero(twice)])
        r = Runs(c.buf, c.offs, of, group[of], n[of], off[of], w)
        number = kind.alike(r)
        _, rep, number, size = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        whole = np.flatnonzero(size[number[: len(n)]] > 1)
        # windows are compared where a run without its like stands beside others; of equal runs one is enough
        _, place, runs = np.unique(r.group[rep], return_inverse=True, return_counts=True)
        take = rep[(runs[place] > 1) & (np.bincount(place, size == 1) > 0)[place]]
        own = r.some(take)
        run, at = own.windows()
        hit = kind.resolve(own) if len(take) else np.zeros(0, bool)
        run, at = take[run[hit]], at[hit]
        left = size[number[run]] == 1
        run, at = run[left], at[left]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)]) if len(run) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(run) - 1]]) if len(first) else first
        run, a, b = np.concatenate([whole, run[first]]), np.concatenate([np.zeros(len(whole), np.int64), at[first]]), np.concatenate([n[whole] + w - 1, at[last] + w])
        # of a class the places within its runs, with what their items must be; of a sole run its places in the text
        digests = {k: hashlib.blake2b(c.text(k), digest_size=DIGEST).digest() for k in set(run[~once[run]].tolist())}
        lo = np.where(once[run], batch.column(5).to_numpy()[run], 0)
        own = pa.array(run)
        return pa.RecordBatch.from_arrays([batch.column(1).take(own), batch.column(2).take(own), batch.column(3).take(own), batch.column(4).take(own), pa.array((lo + a).astype(np.int32)), pa.array((lo + b).astype(np.int32)), pa.array([digests.get(k) for k in run.tolist()], pa.binary())], [x.split()[0] for x in JUDGED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            lo, g = 0, batch.column(0).to_numpy()
            lengths = np.diff(next(chunks(batch.column(9), 1 << 62)).offs) if batch.num_rows else np.zeros(0, np.int64)
            edges = np.flatnonzero(g[1:] != g[:-1]) + 1
            for hi in [*edges.tolist(), batch.num_rows]:
                new = batch.slice(lo, hi - lo)
                if held and new.num_rows and size >= TASK_BYTES and held[-1].column(0)[-1].as_py() != int(g[lo]):
                    yield judge(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
                if new.num_rows:
                    held.append(new)
                    size += int(lengths[lo:hi].sum())
                lo = hi
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _gathered(f: Callable, rows: int = 5000) -> Callable:
    """f with its small batches drawn together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in f(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def removed(documents: DataFrame, cover: DataFrame, kind: Kind) -> DataFrame:
    """A row a document: doc_id, n_items, n_removed, n_spans, kept_sha256."""
    key = documents.schema["doc_id"].dataType.simpleString()
    def one(text: Text, r: pa.StructArray) -> tuple[int, int, int, str]:
        a, b, lo, hi = (r.field(k).to_numpy().astype(np.int64) for k in ("a", "b", "lo", "hi"))
        fine = np.ones(len(a), bool)
        known: dict[tuple[int, int], bytes] = {}
        for k, told in enumerate(r.field("digest").to_pylist()):
            if told is not None:
                place = int(lo[k]), int(hi[k])
                if place not in known:
                    known[place] = hashlib.blake2b(text.items(*place), digest_size=DIGEST).digest()
                fine[k] = known[place] == told
        a, b = merged(a[fine], b[fine])
        return text.n, int((b - a).sum()), len(a), text.kept(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, counts = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            for c in chunks(batch.column(1), 1 << 22):
                rows = [one(Text(c.buf[c.offs[k] : c.offs[k + 1]], kind.words), flat.slice(int(ends[c.first + k] - counts[c.first + k]), int(counts[c.first + k]))) for k in range(c.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), *[pa.array(x) for x in zip(*rows, strict=True)]], ["doc_id", "n_items", "n_removed", "n_spans", "kept_sha256"])

    joined = texts_of(documents).alias("d").join(cover.alias("o").hint("shuffle_hash"), F.col("d.t") == F.col("o.t"), "left").select("d.doc_id", "d.text", "o.r")
    return joined.mapInArrow(run, f"doc_id {key}, n_items long, n_removed long, n_spans long, kept_sha256 string")


def equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, step: int = 4 << 20) -> np.ndarray:
    """Whether buf[a:a + n] == buf[b:b + n], elementwise."""
    out = np.ones(len(a), bool)
    total = np.cumsum(n)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + step)))
        m = n[lo:hi]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        differ = buf[np.repeat(a[lo:hi], m) + inner] != buf[np.repeat(b[lo:hi], m) + inner]
        which = np.repeat(np.arange(lo, hi), m)[differ]
        out[which] = False
        lo = hi
    return out
