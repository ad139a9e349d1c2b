"""SimHash near-duplicates with BK-trees.

Fingerprints of distinct value meet in shards: the 64 bits are cut into blocks, and two fingerprints that differ in at most
four bits agree in all blocks but four, so each goes to one shard for every choice of the others. There are five blocks or
more, as few as keep a shard at some tens of fingerprints, so that the trees do the searching and not the cuts. Each shard
holds a BK-tree, children keyed by the integer Hamming distance to their parent; a search follows only edges within the
radius. The fingerprints of shards over a limit meet again by more blocks, which loses no link and ends: fingerprints that
agree in 60 bits are 16 at most. A shard sends on a spanning forest of its links, never all pairs; components come from star
contraction of those edges.

A tree is built where its shard's fingerprints meet. It is not broadcast: a broadcast goes through the driver, where the
trees together are the fingerprints of all documents.

Defined cases: a null or empty text has fingerprint zero and links like any other; equal fingerprints are one tree node;
repeated rows are kept; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, load, stored

RADIUS = 4
#: Fingerprints of a shard, on average at most if they were even; and those that a task compares at once.
SHARD_MEAN = 64
SHARD_LIMIT = 4096
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts hashes: the bits that are set in over half of them. No hash: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.cumsum(counts)[full] - counts[full]
    pieces = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts.tolist(), counts[full].tolist(), strict=True)])
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], pieces, axis=0)  # at most 255 a lane
    bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.searchsorted(pieces, starts), axis=0)
    over = 2 * bits > counts[full][:, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def shingle_hashes(text: bytes, size: int = 4) -> list[int]:
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(line[a:b], 42) for a, b in zip(starts[: max(1, len(words) - size + 1)].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)]


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), 1 << 19):
                each = [shingle_hashes(c.text(k)) for k in range(c.n)]
                counts = np.array([len(x) for x in each], np.int64)
                prints = majority(np.array([h for x in each for h in x], np.uint64), counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fingerprint long")


class BKTree:
    """Nodes are unsigned integers; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return new

    def near(self, value: int, radius: int) -> Iterator[int]:
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if -radius <= e - d <= radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that join what is not yet joined: the components are those of all links."""
    tree, root, links, parts = BKTree(), [], [], 0

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for value in values:
        met: dict[int, int] = {}
        for at in tree.near(value, radius):
            met.setdefault(top(at), at)
            if len(met) == parts:
                break  # every component of the shard is met
        new = tree.add(value)
        root.append(new)
        parts += 1 - len(met)
        for r, at in met.items():
            links.append((tree.values[at], value))
            root[r] = new
    return links


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of the block choices of which one at least is equal in two values that differ in radius bits or fewer."""
    cuts = np.array_split(np.arange(64), blocks)
    return [sum(1 << int(b) for k in pick for b in cuts[k]) for pick in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS, mean: int = SHARD_MEAN) -> int:
    """The fewest blocks with which n even fingerprints are mean a shard, or less."""
    return next(b for b in range(radius + 1, 65) if n <= mean << (64 * (b - radius) // b) or b == 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(radius: int, limit: int):
    """Edges (true, a, b) of the shards up to the limit, and the fingerprints (false, a, a) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        at, over = None, False

        def out(rows: list[tuple[bool, int, int]]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), *[pa.array([_signed(x) for x in c], pa.int64()) for c in cols[1:]]], ["edge", "a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()])
            values = batch.column(2).to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            rows = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
                if lo == hi:
                    continue
                if (key := (int(keys[0, lo]), int(keys[1, lo]))) != at:
                    if len(held) > 1:
                        rows += [(True, *e) for e in forest(held, radius)]
                    at, held, over = key, [], False
                held += values[lo:hi].tolist()
                if over or len(held) > limit:  # not held here: they meet again
                    rows += [(False, v, v) for v in held]
                    held, over = [], True
            if rows:
                yield out(rows)
        if len(held) > 1:
            yield out([(True, *e) for e in forest(held, radius)])

    return run


def links(prints: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT, mean: int = SHARD_MEAN) -> DataFrame:
    """a, b (long): edges over the distinct fingerprints of the column fingerprint, with the components of all links."""
    todo = stored(prints.select("fingerprint").distinct())
    blocks, edges = blocks_for(todo.count(), radius, mean), None
    # two values that agree in all but radius bits are in no more than 1 << radius, so that with 64 blocks a shard ends
    limit = max(limit, 1 << radius)
    while True:
        masks = F.array(*[F.lit(_signed(m)) for m in block_masks(blocks, radius)])
        deal = todo.select(F.posexplode(masks).alias("shard", "_mask"), "fingerprint").select("shard", F.col("fingerprint").bitwiseAND(F.col("_mask")).alias("_key"), "fingerprint")
        found = stored(deal.repartition("shard", "_key").sortWithinPartitions("shard", "_key").mapInArrow(_search(radius, limit), "edge boolean, a long, b long"))
        own = found.where("edge").select("a", "b")
        edges = own if edges is None else edges.union(own)
        if not found.where("not edge").limit(1).count():
            break
        todo, blocks = stored(found.where("not edge").select(F.col("a").alias("fingerprint")).distinct()), min(64, blocks + 2)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, label (the least node of its component), for the nodes of edges (a, b): alternating large and small stars.

    Their number of rounds grows with the logarithm of the nodes, so that 200 are beyond any table; an error if they are not.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = stored(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
        before = state
    raise RuntimeError("components did not converge")


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """fingerprint, component_id (the least doc_id of its component), for the fingerprints of prints (doc_id, fingerprint)."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_least")))
    labels = components(links(nodes, radius))
    own = nodes.join(labels, nodes["fingerprint"] == labels["node"], "left")
    roots = own.where("label is not null").groupBy("label").agg(F.min("_least").alias("_root"))
    return stored(own.join(roots, "label", "left").select("fingerprint", F.coalesce("_root", "_least").alias("component_id")))


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long), component_id."""
    prints = stored(fingerprints(documents))
    return prints.join(_roots(prints, radius), "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicated(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the least doc_id (null last), then the least text digest.

    A row is known by doc_id and the digest of its text, so rows without doc_id, or that share one, are told apart.
    """
    digest = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", digest.alias("digest"))
    kept = _roots(stored(fingerprints(documents.select(key.alias("doc_id"), "text"))), radius).select(F.col("component_id.doc_id").alias("_id"), F.col("component_id.digest").alias("_digest")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("doc_id").alias("_own"), digest.alias("_text"))
    rows = rows.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_digest")), "left_semi").dropDuplicates(["_own", "_text"])
    return rows.select(*[F.col(f"_row.`{c}`") for c in documents.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
