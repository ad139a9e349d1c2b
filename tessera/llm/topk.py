"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into shards of bounded size; a shard keeps, for each dimension, its vectors sorted by that component.
Queries come to the shards in blocks of bounded size. For a query all lists are read in step, a stretch of each at a time,
from the top where its component is positive and from the bottom where it is negative; each vector met is scored at once.
Reading stops when the threshold, the score of an unseen vector at best, is below the k-th best score, or all vectors were
met. How deep that is depends on the data: where few dimensions carry most of the score it is a small part of the lists;
where all dimensions weigh the same, every vector stands near the top of one of them and is met early. The shards' k best
are then merged.

Scores are exact integers: where doubles could not hold them, they are summed as integers without bound.

Defined cases: a vector that is null or holds a null or non-finite component, or has no id, takes no part, nor one whose
length is not that of the query; every row is a candidate and, where asked, a query of its own, also where rows repeat an id
or a vector: only the query's own row is left out; ties go to the smaller id; a score beyond 64 bits counts as the end of
their range; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, spread, stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Shard:
    """Sorted lists of one shard: for each dimension the places of its vectors, by falling component.

    ranks: the order of the vectors' ids; copies: how many rows each vector stands for.
    """

    def __init__(self, vectors: np.ndarray, ranks: np.ndarray, copies: np.ndarray):
        self.vectors, self.ranks, self.copies = vectors.astype(np.float64), ranks, copies
        self.order = np.argsort(-self.vectors.T, axis=1, kind="stable").astype(np.int32)
        self.largest = float(np.abs(self.vectors).max(initial=0.0))

    def scores(self, rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return self.vectors[rows] @ query
        q = [int(x) for x in query.tolist()]
        return np.array([float(min(max(sum(int(a) * b for a, b in zip(v, q, strict=True)), _LOW), _HIGH)) for v in self.vectors[rows].tolist()], np.float64).reshape(len(rows))

    def top(self, query: np.ndarray, own: int, k: int, first: int = 16) -> tuple[np.ndarray, list[int], int]:
        """Places and scores of the k best rows for the query, one row of the vector at place own left out, and how many vectors were scored."""
        n, d = self.vectors.shape
        # whole numbers whose sums doubles hold exactly
        exact = d * self.largest * float(np.abs(query).max(initial=0.0)) < 2.0**53
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        scores, seen, met = np.full(n, -np.inf), np.zeros(n, bool), 0
        depth, last = (first, 0) if len(up) + len(down) else (n, n)
        while True:
            depth = min(depth, n)
            mark = np.zeros(n, bool)
            mark[self.order[up, last:depth].ravel()] = True
            mark[self.order[down, n - depth : n - last].ravel()] = True
            new = np.flatnonzero(mark & ~seen if len(up) + len(down) else ~seen)
            seen[new] = True
            scores[new] = self.scores(new, query, exact)
            if own >= 0 and self.copies[own] == 1:
                scores[own] = -np.inf
            met += len(new)
            if met == n:
                break
            edge = (self.vectors[self.order[up, depth - 1], up] * query[up]).sum() + (self.vectors[self.order[down, n - depth], down] * query[down]).sum()
            # the bound may be off by what doubles round
            if met > k and edge + 1e-12 * abs(edge) + 1e-9 < np.partition(scores, n - k)[n - k]:
                break
            last, depth = depth, depth * 2
        low = np.partition(scores, n - min(k, n))[n - min(k, n)]
        at = np.flatnonzero((scores >= low) & (scores > -np.inf))
        if exact:
            told = [int(x) for x in scores[at].tolist()]
        else:
            q = [int(x) for x in query.tolist()]
            told = [min(max(sum(int(a) * b for a, b in zip(v, q, strict=True)), _LOW), _HIGH) for v in self.vectors[at].tolist()]
        best = sorted(range(len(at)), key=lambda i: (-told[i], self.ranks[at[i]]))[:k]
        out = [(int(at[i]), told[i]) for i in best for _ in range(min(k, int(self.copies[at[i]]) - (at[i] == own)))][:k]
        return np.array([i for i, _ in out], np.int64), [x for _, x in out], met


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of double, whole numbers), n: floor(scale * x) of each usable vector, and how many rows have it."""

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)

    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    used = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return used.select("vec_id", F.transform("embedding", whole).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(-1, size)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for queries and candidates (vec_id, v, n). A query that is a candidate is not its own."""
    vectors, queries = stored(vectors), stored(queries)
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-queries.count() // block))
    key = F.xxhash64("vec_id", "v")
    right = vectors.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), "vec_id", "v", "n")
    # a block of queries goes to each shard once
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"), "vec_id", "v", key.alias("_k1"), F.xxhash64(F.lit(1), "v").alias("_k2"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    names = ["query_id", "_k1", "_k2", "vec_id", "score"]

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        lengths = [pc.list_value_length(x["v"]).to_numpy() for x in (q, c)]
        for size in sorted(set(lengths[0].tolist()) & set(lengths[1].tolist())):
            asked, own = (x.filter(pa.array(n == size)) for x, n in zip((q, c), lengths, strict=True))
            ids = own["vec_id"].combine_chunks()
            ranks = np.empty(len(ids), np.int64)
            ranks[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            m = _matrix(own["v"], size)
            shard = Shard(m, ranks, own["n"].to_numpy())
            place = {(i, v.tobytes()): at for at, (i, v) in enumerate(zip(ids.to_pylist(), m, strict=True))}
            rows, places, scores = [], [], []
            for row, (i, v) in enumerate(zip(asked["vec_id"].to_pylist(), _matrix(asked["v"], size), strict=True)):
                at, told, _ = shard.top(v, place.get((i, v.tobytes()), -1), k)
                rows += [row] * len(told)
                places.append(at)
                scores += told
            rows = pa.array(rows, pa.int64())
            found = [*[asked[x].combine_chunks().take(rows) for x in ("vec_id", "_k1", "_k2")], ids.take(pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))), pa.array(scores, pa.int64())]
            out.append(pa.Table.from_arrays(found, names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([c["vec_id"].slice(0, 0), *[pa.array([], pa.int64())] * 2, c["vec_id"].slice(0, 0), pa.array([], pa.int64())], names)

    # a shard of right is small by construction and its blocks of queries come one group at a time
    deal = right.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*") if blocks > 1 else right.withColumn("block", F.lit(0))
    found = left.groupBy("shard", "block").cogroup(deal.groupBy("shard", "block")).applyInArrow(search, f"query_id {kind}, _k1 long, _k2 long, vec_id {kind}, score long")
    best = Window.partitionBy("query_id", "_k1", "_k2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # rows that repeat an id and its vector are queries each
    again = queries.where("n > 1").select(F.col("vec_id").alias("_id"), key.alias("_l1"), F.xxhash64(F.lit(1), "v").alias("_l2"), "n")
    same = (F.col("query_id") == F.col("_id")) & (F.col("_k1") == F.col("_l1")) & (F.col("_k2") == F.col("_l2"))
    found = found.join(again, same, "left").select("query_id", "rank", "vec_id", "score", F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    return spread(found, "n", "_copy").drop("_copy")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(load(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
