"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Document rates r minimise the entropy distance to one copy each, sum r ln r - r, under
sum r * size = target and r <= 3. The dual is convex with one multiplier a source: r = min(3, exp(lambda * size / mean size)).
Its Newton steps are distributed: a step is one aggregation of (source, size) counts. The rates are then rounded to whole
copies: the whole part, and one more copy below a cut of the hashed dither that meets the target.

Rows that agree in all that counts are drawn together with their number before anything is shuffled, and told apart by their
place in that group: the dither of the j-th is that of the first, moved on by j times the golden ratio, so that any number
of them gets its share of copies, none of them can tie at the cut, and which of them is the j-th does not matter.

Defined cases: a null or empty text has size 0, rate 1 and takes 0; null is a source of its own, last; repeated rows, and
rows that share an id or have none, are documents of their own, each with its own dither; an empty table gives no rows;
other columns play no part in the query and stay as they are in mix().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut_at, load, spread, stored

CAP = 3.0
#: The per-source columns that with_copies() needs.
SOURCE_COLUMNS = ("source", "source_size", "target", "mean", "lam", "cut")
GOLDEN = (math.sqrt(5) - 1) / 2


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, n: how many documents agree in these."""
    return documents.select("doc_id", "source", size_of(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def ranked(per: DataFrame) -> DataFrame:
    """per with _rank, its place by source, null last: sorted over all tasks, then numbered within each."""
    per = stored(per.orderBy(F.asc_nulls_last("source")).withColumn("_part", F.spark_partition_id()))
    counts = per.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a task
    before = counts.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last("source"))) - 1
    return per.withColumn("_own", own).join(before, F.col("_part") == F.col("_p")).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_own", "_part", "_p", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """source, source_size, mean, target from source, size, n.

    The water level c: sources whose cap is below weight * c get their cap, the others weight * c. It rises until no more
    sources are full, by one aggregation a step.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("_n"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    per = stored(ranked(per).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("_cap") < F.col("_w") * level
        used, open_ = per.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("_w")).otherwise(0))).first()
        above = (total - (used or 0)) / open_ if open_ else math.inf
        if above <= level:
            break
        level = above
        if not open_:
            break
    return per.select("source", "source_size", (F.col("source_size") / F.greatest("_n", F.lit(1))).alias("mean"), F.least("_cap", F.col("_w") * F.lit(level)).cast("double").alias("target"))


def rate(size: Column, mean: Column, lam: Column, cap: float = CAP) -> Column:
    x = size / F.greatest(mean, F.lit(1e-9))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(cap), F.exp(F.least(lam * x, F.lit(math.log(cap) + 1)))))


def multipliers(sizes: DataFrame, per: DataFrame, cap: float = CAP, steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """per with the multiplier lam of each source, by safeguarded Newton steps on the logarithm of the dual's gradient.

    Steps halve where Newton's leaves the bracket, so that 200 are beyond what doubles can need; an error if they are not.
    """
    counts = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")))
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
    start = F.when(free, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(math.inf))
    state = stored(per.withColumns({"lam": start, "_lo": F.lit(-math.inf), "_hi": F.lit(math.inf), "_off": F.when(free, F.lit(1.0)).otherwise(F.lit(0.0))}))
    for _ in range(steps):
        if not state.where(F.col("_off") > tolerance).limit(1).count():
            return state.select("source", "source_size", "mean", "target", "lam")
        live = state.where(F.col("_off") > tolerance).select(F.col("source").alias("_s"), "mean", "lam")
        at = counts.join(live, F.col("source").eqNullSafe(F.col("_s")))
        r, x = rate(F.col("size"), F.col("mean"), F.col("lam"), cap), F.col("size") / F.col("mean")
        sums = at.groupBy("_s").agg(F.sum(F.col("n") * F.col("size") * r).alias("_f"), F.sum(F.when(r < cap, F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("_d"))
        state = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        gap = F.log("target") - F.log("_f")
        lo, hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("_lo")), F.when(gap < 0, F.col("lam")).otherwise(F.col("_hi"))
        inf = F.lit(math.inf)
        apart = F.when((hi < inf) & (lo > -inf), (lo + hi) / 2).when(hi < inf, hi - 1 - F.abs(hi)).otherwise(lo + 1 + F.abs(lo))
        newton = F.when(F.col("_d") > 0, F.col("lam") + gap * F.col("_f") / F.col("_d"))
        moved = F.when((newton > lo) & (newton < hi), newton).otherwise(apart)
        on = F.col("_f").isNotNull()
        state = stored(state.select("source", "source_size", "mean", "target", F.when(on & (F.abs(gap) > tolerance), moved).otherwise(F.col("lam")).alias("lam"), F.when(on, lo).otherwise(F.col("_lo")).alias("_lo"), F.when(on, hi).otherwise(F.col("_hi")).alias("_hi"), F.when(on, F.when(hi - lo < 1e-14, 0.0).otherwise(F.abs(gap))).otherwise(F.col("_off")).alias("_off")))
    raise RuntimeError("entropy balancing did not converge")


def dither(key: list[Column], place: Column, seed: int) -> Column:
    """In [0, 1): a hash of the key, moved on by place times the golden ratio."""
    first = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    x = first + place * F.lit(GOLDEN)
    return x - F.floor(x)


def key_of(r: Column, dithered: Column) -> Column:
    """In [0, 1); at a cut of a half each document gets its fraction in expectation."""
    return (dithered - (r - F.floor(r)) + 1) / 2


def mixture(sizes: DataFrame, key: list[str], weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, seed: int = 7) -> DataFrame:
    """One row a source with SOURCE_COLUMNS, from source, size, n and the columns key that tell groups apart."""
    per = stored(multipliers(sizes, stored(targets(sizes, weights, cap)), cap))
    p = per.withColumnRenamed("source", "_s")
    at = spread(sizes.where("size > 0"), "n", "_place").join(p, F.col("source").eqNullSafe(F.col("_s")))
    r = rate(F.col("size"), F.col("mean"), F.col("lam"), cap)
    at = stored(at.select("source", "size", "target", r.alias("_r"), key_of(r, dither([F.col(c) for c in key], F.col("_place"), seed)).alias("_key")))
    whole = at.groupBy("source").agg(F.greatest(F.max("target") - F.sum(F.floor("_r") * F.col("size")), F.lit(0.0)).alias("wanted"))
    cuts = cut_at(at.where(F.col("_r") < cap), "_key", "source", whole, weight="size").withColumnRenamed("source", "_c")
    return stored(p.join(cuts, F.col("_s").eqNullSafe(F.col("_c")), "left").select(F.col("_s").alias("source"), "source_size", "target", "mean", "lam", F.coalesce("cut", F.lit(0.5)).alias("cut")))


def with_copies(rows: DataFrame, per: DataFrame, key: list[str], cap: float = CAP, seed: int = 7) -> DataFrame:
    """rows (source, size, _place, key and any others) with mix_rate, mix_copies and the columns source_size, target of per."""
    own = per.select(*[F.col(c).alias(f"_m_{c}") for c in SOURCE_COLUMNS])
    r = rate(F.col("size"), F.col("_m_mean"), F.col("_m_lam"), cap)
    extra = (F.col("mix_rate") < cap) & (key_of(F.col("mix_rate"), dither([F.col(c) for c in key], F.col("_place"), seed)) < F.col("_m_cut"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor("mix_rate") + F.when(extra, 1).otherwise(0)).cast("int")
    out = rows.join(own, F.col("source").eqNullSafe(F.col("_m_source"))).withColumn("mix_rate", r).withColumn("mix_copies", copies)
    return out.withColumnRenamed("_m_source_size", "source_size").withColumnRenamed("_m_target", "target").drop("_m_source", "_m_mean", "_m_lam", "_m_cut")


def _fingerprint(documents: DataFrame, seed: int) -> Column:
    """64 bits of all columns of a row, nulls told apart; kinds without a hash go by their JSON."""
    parts = []
    for f in documents.schema:
        c = F.col(f"`{f.name}`")
        plain = isinstance(f.dataType, (T.AtomicType, T.NullType)) and not isinstance(f.dataType, T.VariantType)
        parts += [c if plain else F.to_json(F.struct(c.alias("c"))), c.isNull()]
    return F.xxhash64(F.lit(seed), *parts)


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, seed: int = 7) -> DataFrame:
    """documents with each row repeated as often as the mix takes it.

    Rows that occur once stay where they are. Rows that agree in all columns (128 bits of them) are drawn together, and as
    many are written out as the mix takes of them all.
    """
    key = ["_k1", "_k2"]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"), _fingerprint(documents, 1).alias("_k1"), _fingerprint(documents, 2).alias("_k2"))
    groups = stored(rows.groupBy("source", "size", *key).agg(F.count("*").alias("n")))
    per = mixture(groups, key, weights, cap, seed)
    again = stored(groups.where("n > 1"))
    names = [F.col(f"_row.`{c}`") for c in documents.columns]
    if not again.limit(1).count():
        return with_copies(rows.withColumn("_place", F.lit(0)), per, key, cap, seed).withColumn("_copy", F.explode(F.expr("array_repeat(1, mix_copies)"))).select(*names)
    single = rows.join(again.select(*key), key, "left_anti").withColumn("_place", F.lit(0))
    out = with_copies(single, per, key, cap, seed).withColumn("_copy", F.explode(F.expr("array_repeat(1, mix_copies)"))).select("_row")
    totals = with_copies(spread(again, "n", "_place"), per, key, cap, seed).groupBy(*key).agg(F.sum("mix_copies").alias("_total"))
    shown = rows.join(again.select(*key), key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row"))
    more = spread(shown.join(totals, key), "_total", "_copy").select("_row")
    return out.union(more).select(*names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["doc_id", "size"]
    sizes = stored(sized(load(spark, sf_dir, "documents")))
    out = with_copies(spread(sizes, "n", "_place"), mixture(sizes, key), key)
    return out.select("doc_id", "size", "source_size", "target", (F.col("mix_copies") * F.col("size")).cast("long").alias("taken"), F.col("mix_copies").alias("copies"), F.col("mix_rate").alias("rate"))
