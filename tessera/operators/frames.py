"""Framed streams: splitting into chunks, integrity checks, and reassembly with all its errors, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import checksum32

FRAME_KINDS = ("message", "chunk", "schema", "dictionary", "delta", "checkpoint")
#: Chunks of a text beyond which it is cut in one pass.
MANY = 64


def split(df: DataFrame, message_id: str, payload: str, size: int) -> DataFrame:
    """Chunk frames of at most size characters or bytes; an empty payload is one empty chunk, a null one none.

    Characters are counted from a text's start for each chunk, so a text of very many chunks is cut into pieces in one pass
    first; one that is no valid UTF-8 keeps its bytes.
    """
    p = F.col(payload)
    count = lambda c: F.greatest(F.ceil(F.length(c) / size), F.lit(1)).cast("int")
    cut = df.where(p.isNotNull()).select(F.col(message_id).alias("message_id"), count(p).alias("chunk_count"), p.alias("_p"))
    first = F.lit(0)
    if df.schema[payload].dataType.typeName() == "string":
        pieces = F.when((F.col("chunk_count") > MANY) & F.is_valid_utf8("_p"), F.regexp_extract_all("_p", F.lit(f"(?s).{{1,{MANY * size}}}"), 0)).otherwise(F.array("_p"))
        cut = cut.select("message_id", "chunk_count", F.posexplode(pieces).alias("_piece", "_p"))
        first = F.col("_piece") * MANY
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), count(F.col("_p")) - 1)).alias("_i"))
    out = cut.select("message_id", (first + F.col("_i")).alias("chunk_index"), "chunk_count", F.substr("_p", F.col("_i") * size + 1, F.lit(size)).alias("payload"))
    return out.select(F.lit("chunk").alias("kind"), "message_id", "chunk_index", "chunk_count", F.lit(0).alias("segment_id"), (F.col("chunk_index").cast("long") * size).alias("offset"), F.length("payload").alias("length"), checksum32(F.col("payload")).alias("checksum"), "payload")


def checked(frames: DataFrame) -> DataFrame:
    """frames with error_code: 1003 for a wrong length, 1005 for a wrong checksum, else null."""
    code = F.when(F.length("payload") != F.col("length"), 1003).when(checksum32(F.col("payload")) != F.col("checksum"), 1005)
    return frames.withColumn("error_code", code)


def reassemble(frames: DataFrame) -> DataFrame:
    """message_id, payload, error_code: of chunk frames; other kinds are skipped.

    1302 for missing metadata, for counts that differ, and for an index that comes twice; 1305 for an incomplete set (a count
    of zero is never complete); 1003 for an index beyond the count. A message is as large as its payload, so its chunks
    are gathered only once they are known to make it up.
    """
    own = frames.where(F.col("kind") == "chunk")
    told = own.groupBy("message_id").agg(
        F.count("*").alias("_n"), F.count_distinct("chunk_index").alias("_d"), F.min("chunk_count").alias("_lo"), F.max("chunk_count").alias("_hi"), F.max("chunk_index").alias("_top"),
        F.count_if(F.col("message_id").isNull() | F.col("chunk_index").isNull() | F.col("chunk_count").isNull()).alias("_bare"),
    )
    code = F.when(F.col("_bare") > 0, 1302).when(F.col("_lo") != F.col("_hi"), 1302).when(F.col("_d") < F.col("_n"), 1302).when(F.col("_top") >= F.greatest("_hi", F.lit(1)), 1003).when(F.col("_n") != F.col("_hi"), 1305)
    told = told.select("message_id", code.alias("error_code"))
    good = own.join(told.where("error_code is null").select("message_id"), "message_id", "left_semi")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "payload"))), lambda x: x["payload"])
    empty = F.lit("").cast(frames.schema["payload"].dataType)
    whole = good.groupBy("message_id").agg(parts.alias("_p")).select("message_id", F.aggregate("_p", empty, lambda a, x: F.concat(a, x)).alias("payload") if frames.schema["payload"].dataType.typeName() == "binary" else F.array_join("_p", "").alias("payload"))
    return whole.withColumn("error_code", F.lit(None).cast("int")).unionByName(told.where("error_code is not null"), allowMissingColumns=True)
