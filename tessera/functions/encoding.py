"""Encodings as column expressions: variable-length integers, bit packing, dictionaries, shapes, presence, checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zigzag(c: Column) -> Column:
    c = c.cast("long")
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1).cast("long")))


#: LEB128 bytes that fit into one long beside each other; the others, three at most, make up a second one.
_HEAD = 7


def varint(c: Column) -> Column:
    """Hex of the LEB128 bytes of an unsigned 64-bit value."""
    c = c.cast("long")
    rest = [c, *[F.shiftrightunsigned(c, 7 * i) for i in range(1, 10)], F.lit(0).cast("long")]
    n = sum((F.when(r != 0, 1).otherwise(0) for r in rest[1:10]), F.lit(1))

    def shown(at: range) -> Column:
        """The bytes of these places, first ones first; of those beyond the last all bits are zero."""
        bits = [F.shiftleft(rest[i].bitwiseAND(F.lit(127).cast("long")).bitwiseOR(F.when(rest[i + 1] != 0, F.lit(128)).otherwise(F.lit(0)).cast("long")), 8 * (at[-1] - i)) for i in at]
        return F.substr(F.lpad(F.hex(reduce(Column.bitwiseOR, bits)), 2 * len(at), "0"), F.lit(1), 2 * F.greatest(n - at[0], F.lit(0)))

    return F.lower(F.concat(shown(range(_HEAD)), F.when(rest[_HEAD] != 0, shown(range(_HEAD, 10))).otherwise("")))


def unvarint(hexed: Column) -> Column:
    """The value of LEB128 bytes in hex.

    Null where they are no bytes, none or more than ten, where a byte but the last ends the value or the last does not, or
    where they are beyond 64 bits.
    """
    whole = hexed.rlike("^([89a-fA-F][0-9a-fA-F]){0,9}[0-7][0-9a-fA-F]$") & ((F.length(hexed) < 20) | hexed.rlike("0[01]$"))
    fine = F.when(whole, hexed)
    out = []
    for at in (range(_HEAD), range(_HEAD, 10)):
        # outside of any condition, so that it is computed once for all its bytes
        part = F.conv(F.rpad(F.substr(fine, F.lit(2 * at[0] + 1), F.lit(2 * len(at))), 2 * len(at), "0"), 16, 10).cast("long")
        out += [F.shiftleft(F.shiftrightunsigned(part, 8 * (at[-1] - i)).bitwiseAND(F.lit(127).cast("long")), 7 * i) for i in at]
    return reduce(Column.bitwiseOR, out)


def checksum32(c: Column) -> Column:
    """The first four bytes of SHA-256, little-endian."""
    h = F.sha2(c.cast("binary"), 256)
    return F.conv(F.concat(*[F.substr(h, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


def bit_packed(df: DataFrame, position: str, flag: str) -> DataFrame:
    """byte_no, byte: flags by position, least bit first."""
    bit = F.when(F.col(flag), F.call_function("shiftleft", F.lit(1), (F.col(position) % 8).cast("int"))).otherwise(0)
    return df.groupBy(F.floor(F.col(position) / 8).alias("byte_no")).agg(F.sum(bit).alias("byte"))


def presence(df: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """column, byte_no, byte: bitmap of the values that are not null, a column at a time."""
    long = df.select(position, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("_set")) for c in columns])))
    bit = F.when(F.col("_set"), F.call_function("shiftleft", F.lit(1), (F.col(position) % 8).cast("int"))).otherwise(0)
    return long.groupBy("column", F.floor(F.col(position) / 8).alias("byte_no")).agg(F.sum(bit).alias("byte"))


def dictionary(df: DataFrame, column: str, position: str) -> DataFrame:
    """value, id: distinct values numbered by first appearance. The window runs over the distinct values only."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(position).alias("_at"))
    return first.select("value", (F.row_number().over(Window.orderBy("_at")) - 1).cast("long").alias("id"))


def sorted_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct strings of the columns, sorted."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).where("value is not null").distinct().orderBy("value")


def shapes(df: DataFrame, maps: str) -> DataFrame:
    """Distinct sorted key lists of a map column, comma-joined, with their counts."""
    return df.groupBy(F.array_join(F.array_sort(F.map_keys(maps)), ",").alias("shape")).agg(F.count("*").alias("n"))


def hot_index(df: DataFrame) -> DataFrame:
    """name, ordinal of the columns, sorted by name."""
    return df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(sorted(df.columns))], "name string, ordinal int")
