"""Canonical text and logical hash: SHA-256 of a kind-prefixed text, the same for equal values however they are stored."""

from __future__ import annotations

import hashlib
import math
from datetime import datetime, timezone
from decimal import Decimal
from typing import Any
from uuid import UUID

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import StateError, Tagged, path_parts

# -- native columns ---------------------------------------------------------------------------------------------------


def escaped(c: Column) -> Column:
    for raw in ("\\", ":", ","):
        c = F.replace(c, F.lit(raw), F.lit("\\" + raw))
    return c


def _float_text(x: float | None) -> str | None:
    if x is None:
        return None
    if x == 0:
        return "0"
    return f"{x:.15f}".rstrip("0").rstrip(".") if math.isfinite(x) else {math.inf: "inf", -math.inf: "-inf"}.get(x, "NaN")


@F.arrow_udf(T.StringType())
def float_text(x: pa.Array) -> pa.Array:
    """Fifteen exact decimals, trimmed: no built-in expression expands the binary value exactly."""
    return pa.array(map(_float_text, x.to_pylist()), pa.string())


def _decimal_text(scaled: Column, scale: Column) -> Column:
    """scaled: text of a whole number without leading zeros."""
    zeros = F.when(scaled == "0", scale).otherwise(F.least(scale, F.length(scaled) - F.length(F.rtrim(scaled, F.lit("0")))))
    return F.concat(F.when(scaled == "0", scaled).otherwise(F.substr(scaled, F.lit(1), F.length(scaled) - zeros)), F.lit("@"), (scale - zeros).cast("string"))


def _unscaled(c: Column, scale: int) -> Column:
    """Text of a decimal column times ten to its scale, for any scale: its digits, not its product, which may not fit."""
    text = F.translate(F.format_number(c, scale), ",.", "")
    bare = F.ltrim(F.replace(text, F.lit("-"), F.lit("")), F.lit("0"))
    return F.when(bare == "", F.lit("0")).otherwise(F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), bare))


def _utc_text(c: Column, kind: T.DataType) -> Column:
    """A timestamp in UTC with nine decimals, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        micros = F.unix_micros(c)
        days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
        rest = F.pmod(micros, F.lit(86_400_000_000))
        at = lambda x, n: F.lpad(x.cast("string"), n, "0")
        part = lambda size, most: F.pmod(F.floor(rest / F.lit(size)), F.lit(most))
        date = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
        return F.concat(date, F.lit("T"), at(part(3_600_000_000, 24), 2), F.lit(":"), at(part(60_000_000, 60), 2), F.lit(":"), at(part(1_000_000, 60), 2), F.lit("."), at(F.pmod(rest, F.lit(1_000_000)), 6), F.lit("000Z"))
    text = c.cast("string")
    whole = F.substring_index(text, ".", 1)
    return F.concat(F.replace(whole, F.lit(" "), F.lit("T")), F.lit("."), F.rpad(F.substr(text, F.length(whole) + 2), 9, "0"), F.lit("Z"))


@F.arrow_udf(T.StringType())
def json_text(x: pa.Array) -> pa.Array:
    """Canonical text of tagged JSON."""
    from ..sources.jsonio import loads

    return pa.array([None if v is None else value_text(loads(v)) for v in x.to_pylist()], pa.string())


def canonical(c: Column, kind: T.DataType, logical: str | None = None) -> Column:
    """Canonical text of a typed column. logical: a kind that the type alone does not tell, from the field's metadata."""
    if isinstance(kind, T.StructType):
        if {f.name for f in kind} == {"currency", "scaled", "scale"}:
            body = F.concat(F.lit("money:"), c["currency"], F.lit(":"), _decimal_text(c["scaled"].cast("string"), c["scale"]))
        elif {f.name for f in kind} == {"scaled", "scale"}:
            body = F.concat(F.lit("d:"), _decimal_text(c["scaled"].cast("string"), c["scale"]))
        else:
            fields = sorted(kind, key=lambda f: f.name)
            each = [F.concat(escaped(F.lit(f.name)), F.lit(":"), canonical(c[f.name], f.dataType, f.metadata.get("logical_type"))) for f in fields]
            body = F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType, logical)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(canonical(e["key"], kind.keyType).alias("k"), canonical(e["value"], kind.valueType).alias("v")))
        body = F.concat(F.lit("map{"), F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["k"], F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        body = c.cast("string")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        body = F.concat(F.lit("u:" if logical == "unsigned" else "i:"), c.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        body = F.concat(F.lit("f:"), float_text(c.cast("double")))
    elif isinstance(kind, T.DecimalType):
        body = F.concat(F.lit("u:"), c.cast("string")) if logical == "unsigned" else F.concat(F.lit("d:"), _decimal_text(_unscaled(c, kind.scale), F.lit(kind.scale)))
    elif isinstance(kind, T.BinaryType):
        body = F.concat(F.lit("b:"), F.lower(F.hex(c)))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        body = F.concat(F.lit("ts:"), _utc_text(c, kind))
    elif isinstance(kind, T.DateType):
        body = F.concat(F.lit("date:"), c.cast("string"))
    elif isinstance(kind, T.StringType):
        plain = {"uuid": ("uuid:", F.lower(c)), "date": ("date:", c), "duration": ("dur:", c), "url": ("url:", c), "email": ("email:", F.lower(c)), "ref": ("ref:", c), "enum": ("enum:", escaped(c))}
        head, text = plain.get(logical, ("s:", escaped(c)))
        body = F.concat(F.lit(head), text)
    elif isinstance(kind, T.VariantType):
        body = json_text(F.to_json(c))  # dates and binaries of a VARIANT are texts there
    else:
        raise StateError("unsupported_feature", f"no canonical form of {kind.simpleString()}")
    return F.coalesce(F.when(c.isNotNull(), body), F.lit("null"))


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Canonical text of a row as an object of its columns."""
    fields = sorted((df.schema[n] for n in columns or df.columns), key=lambda f: f.name)
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(escaped(F.lit(f.name)), F.lit(":"), canonical(F.col(f"`{f.name}`"), f.dataType, f.metadata.get("logical_type"))) for f in fields]), F.lit("}"))


def logical_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.sha2(row_text(df, columns), 256)


def distinct_by_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of each logical value."""
    return df.withColumn("_hash", logical_hash(df, columns)).dropDuplicates(["_hash"]).drop("_hash")


def logically_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, equal: rows of the two sides matched by key and compared by hash; false where one side lacks the row."""
    x = a.select(F.col(key).alias("_k"), logical_hash(a).alias("_x"))
    y = b.select(F.col(key).alias("_l"), logical_hash(b).alias("_y"))
    return x.join(y, F.col("_k").eqNullSafe(F.col("_l")), "full").select(F.coalesce("_k", "_l").alias(key), F.coalesce(F.col("_x") == F.col("_y"), F.lit(False)).alias("equal"))


def sign(*_: Any) -> Any:
    raise StateError("unsupported_feature", "signatures")


verify = sign

# -- dynamic values -----------------------------------------------------------------------------------------------------


def _escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace(":", "\\:").replace(",", "\\,")


def _trimmed(scaled: int, scale: int) -> str:
    while scale > 0 and scaled % 10 == 0:
        scaled, scale = scaled // 10, scale - 1
    return f"{scaled}@{scale}"


def utc_nanos(text: str) -> str:
    """RFC 3339 as UTC with nine decimals; digits beyond are cut."""
    head, _, rest = text.strip().partition(".")
    digits = ""
    while rest[:1].isdigit():
        digits, rest = digits + rest[0], rest[1:]
    try:
        at = datetime.fromisoformat((head + rest).replace("z", "Z").replace("t", "T"))
        if at.tzinfo is None or "T" not in head.upper():
            raise ValueError
    except ValueError:
        raise StateError("validation_error", f"not an RFC 3339 timestamp: {text}") from None
    return at.astimezone(timezone.utc).replace(tzinfo=None).isoformat(timespec="seconds") + "." + (digits + "0" * 9)[:9] + "Z"


def value_text(v: Any) -> str:
    """Canonical text of a dynamic value."""
    if not isinstance(v, Tagged):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return f"i:{v}"
        if isinstance(v, float):
            return "f:" + _float_text(v)
        if isinstance(v, str):
            return "s:" + _escape(v)
        if isinstance(v, list):
            return "[" + ",".join(map(value_text, v)) + "]"
        return "{" + ",".join(f"{_escape(k)}:{value_text(v[k])}" for k in sorted(v)) + "}"
    x = v.value
    simple = {"bytes": lambda: "b:" + x.hex(), "uuid": lambda: f"uuid:{UUID(x)}", "timestamp": lambda: "ts:" + utc_nanos(x), "date": lambda: "date:" + x, "duration": lambda: "dur:" + x, "url": lambda: "url:" + x, "email": lambda: "email:" + x.lower(), "enum": lambda: "enum:" + _escape(x), "ref": lambda: "ref:" + x, "unsigned": lambda: f"u:{x}", "decimal": lambda: "d:" + _trimmed(*x), "money": lambda: f"money:{x[0]}:{_trimmed(*x[1:])}", "message": lambda: value_text(x.get("fields", {}))}
    if v.kind in simple:
        return simple[v.kind]()
    if v.kind == "map":
        return "map{" + ",".join(f"{a}:{b}" for a, b in sorted((value_text(a), value_text(b)) for a, b in x)) + "}"
    # own forms: typed arrays, tables, tensors, deltas and blob references
    from ..sources.jsonio import dumps

    return f"{v.kind}:{dumps(v)}"


def value_hash(v: Any) -> str:
    return hashlib.sha256(value_text(v).encode()).hexdigest()


def decimal_of(scaled: int, scale: int) -> Decimal:
    return Decimal(scaled).scaleb(-scale)


__all__ = ["canonical", "decimal_of", "distinct_by_hash", "escaped", "float_text", "logical_hash", "logically_equal", "path_parts", "row_text", "sign", "utc_nanos", "value_hash", "value_text", "verify"]
