"""Helpers shared by the corpus operators: written intermediates, byte and word views of Arrow text, exact rank cuts."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; only where none is set (tests on one machine), a temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame, plain: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    Reads are split by bytes. plain: rows take the same bytes however alike they are, so that a task does not get very many
    rows where a frequent key compresses them to almost nothing. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    how = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {"compression": "zstd"}
    df.write.options(**how).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Equal rows that a task writes out at a time.
CHUNK = 4096


def spread(groups: DataFrame, n: str, place: str) -> DataFrame:
    """Each row of groups n times, with its place from 0. Large groups are dealt in chunks to all tasks first."""
    few = groups.where(F.col(n) <= CHUNK).withColumn("_lo", F.lit(0).cast("long"))
    many = groups.where(F.col(n) > CHUNK).withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(CHUNK).cast("long"))))
    many = many.repartition(F.xxhash64("_lo", *[c for c, kind in groups.dtypes if kind in ("bigint", "string", "double", "int")]))
    out = few.where(F.col(n) > 0).union(many)
    return out.withColumn(place, F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + CHUNK, F.col(n)) - 1))).drop("_lo", n)


# -- texts in Arrow batches ------------------------------------------------------------------------------------------


class Chunk:
    """Some whole texts as one byte buffer. Text k of the chunk is buf[offs[k]:offs[k + 1]]; first is its row in the batch."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first, self.n = buf, offs, first, len(offs) - 1

    def text(self, k: int) -> bytes:
        return self.buf[self.offs[k] : self.offs[k + 1]].tobytes()


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """The texts of a string or binary column in order, about limit bytes at a time, a longer text alone. Null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Chunk(whole[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


def words_of(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the place of its first word (one more at the end)."""
    if not len(c.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(c.n + 1, np.int64)
    solid = ~((c.buf == 32) | ((c.buf >= 9) & (c.buf <= 13)))
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[0] = after[-1] = False
    edges = c.offs[1:-1]
    before[edges[edges < len(solid)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, c.offs)


# -- polynomial hashes, modulo 2 ** 64 -----------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_GROWN: dict[str, np.ndarray] = {}
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if not _GROWN or len(_GROWN["up"]) < n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _GROWN[name] = np.multiply.accumulate(x)
    return _GROWN["up"][:n], _GROWN["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of unsigned 64-bit values (bytes go through a table of random ones)."""
    if values.dtype == np.uint8:
        values = _BYTES[values]
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of values[a:b], elementwise: equal for equal spans wherever they stand."""
    return (p[b] - p[a]) * powers(len(p))[1][a]


def word_hashes(c: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(span(prefix(c.buf), starts, ends) + (ends - starts).astype(np.uint64))


# -- ranks over all rows without a sort into one task -------------------------------------------------------------


def cut_at(df: DataFrame, key: str, by: str | None, wanted: DataFrame | float, weight: str | None = None, bins: int = 512, rounds: int = 6) -> DataFrame | float:
    """The value c of the double column key such that the rows with key < c carry nearly, and at most, the wanted weight.

    Histograms of ever narrower bins narrow c down; each is one aggregation with partial sums, and no group is gathered. Six
    rounds of 512 bins are 2 ** 54, so that only rows of the same double stay together.
    With by, one cut for each value of that column, from wanted (by, wanted); else one number. key must be within [0, 1).
    """
    one = by is None
    spark = df.sparkSession
    df = df.select(F.lit(0).alias("_of") if one else F.col(by).alias("_of"), F.col(key).alias("_key"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"))
    if one:
        wanted = spark.range(1).select(F.lit(0).alias("_by"), F.lit(float(wanted)).alias("_need"))
    else:
        wanted = wanted.select(F.col(by).alias("_by"), F.col("wanted").cast("double").alias("_need"))
    state = wanted.withColumns({"_lo": F.lit(0.0), "_width": F.lit(1.0)})
    for _ in range(rounds):
        at = F.floor((F.col("_key") - F.col("_lo")) / F.col("_width") * bins)
        sums = df.join(F.broadcast(state) if one else state, F.col("_of").eqNullSafe(F.col("_by"))).where((F.col("_key") >= F.col("_lo")) & (F.col("_key") < F.col("_lo") + F.col("_width"))).groupBy("_of", at.alias("_bin")).agg(F.sum("_w").alias("_w"))
        # at most `bins` rows for each group
        lists = sums.groupBy("_of").agg(F.array_sort(F.collect_list(F.struct("_bin", "_w"))).alias("_bins"))
        step = F.aggregate(
            F.coalesce("_bins", F.array().cast("array<struct<_bin:bigint,_w:double>>")),
            F.struct(F.col("_need").alias("left"), F.lit(bins).cast("bigint").alias("bin"), F.lit(False).alias("done")),
            lambda s, b: F.when(s["done"], s).when(s["left"] - b["_w"] < 0, F.struct(s["left"].alias("left"), b["_bin"].alias("bin"), F.lit(True).alias("done"))).otherwise(F.struct((s["left"] - b["_w"]).alias("left"), s["bin"].alias("bin"), s["done"].alias("done"))),
        )
        joined = state.join(lists, F.col("_by").eqNullSafe(F.col("_of")), "left").withColumn("_s", step)
        state = stored(joined.select("_by", F.col("_s.left").alias("_need"), (F.col("_lo") + F.col("_s.bin") * F.col("_width") / bins).alias("_lo"), (F.when(F.col("_s.done"), F.col("_width") / bins).otherwise(F.lit(0.0))).alias("_width")))
        # a finished group has width 0: no row is in its bins any more
        state = state.withColumn("_width", F.when(F.col("_width") > 0, F.col("_width")).otherwise(F.lit(1e-300)))
    if one:
        return state.first()["_lo"] if state.take(1) else math.inf
    return state.select(F.col("_by").alias(by), F.col("_lo").alias("cut"))
