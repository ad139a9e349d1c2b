"""Table views: select, filter, scan, paths. Every predicate reaches the Parquet scan, and only named columns are read."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import StateError, variant_path

EPSILON = 2.220446049250313e-16
_OPS: dict[str, Callable[[Column, float], Column]] = {
    "gt": lambda c, x: c > x, "ge": lambda c, x: c >= x, "lt": lambda c, x: c < x, "le": lambda c, x: c <= x,
    "eq": lambda c, x: F.abs(c - F.lit(x)) <= EPSILON,
}


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that there are, in name order."""
    return df.select(*[F.col(f"`{n}`") for n in sorted(set(names) & set(df.columns))])


def _known(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise StateError("invalid_path", "no such column", column)
    return df.schema[column].dataType


def filter_eq(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows whose value is the given one; null is null. A value of another kind than the column's matches nothing."""
    kind = _known(df, column)
    own = {bool: T.BooleanType, int: T.IntegralType, float: T.FractionalType, str: T.StringType, bytes: T.BinaryType}
    if value is not None and type(value) in own and not isinstance(kind, own[type(value)]):
        return df.where(F.lit(False))
    return df.where(F.col(f"`{column}`").eqNullSafe(F.lit(value)))


def numeric(column: str, op: str, value: float, kind: T.DataType) -> Column:
    """NaN matches nothing, whatever the order that Spark gives it."""
    c = F.col(f"`{column}`")
    test = _OPS[op](c, value)
    return test & ~F.isnan(c) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else test


def filter_numeric(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    kind = _known(df, column)
    return df.where(numeric(column, op, value, kind)) if isinstance(kind, T.NumericType) else df.where(F.lit(False))


def filter_bool(df: DataFrame, column: str, wanted: bool) -> DataFrame:
    return df.where(F.col(f"`{column}`") == F.lit(wanted)) if isinstance(_known(df, column), T.BooleanType) else df.where(F.lit(False))


def scan_numeric_gt(df: DataFrame, column: str, value: float) -> DataFrame:
    """n: how many values are greater."""
    if not isinstance(_known(df, column), T.NumericType):
        raise StateError("type_mismatch", "not numeric", column)
    return df.where(numeric(column, "gt", value, df.schema[column].dataType)).agg(F.count("*").alias("n"))


def hot_field(df: DataFrame, name: str) -> DataFrame:
    """One column; none of a missing name."""
    return df.select(F.col(f"`{name}`")) if name in df.columns else df.select().limit(0)


def project_variant(doc: Column, paths: dict[str, str]) -> Column:
    """An object with what is at each path of a VARIANT, keyed by path text; what is missing is left out."""
    found = [F.struct(F.lit(p).alias("key"), at_variant(doc, p, kind).cast("string").alias("value")) for p, kind in paths.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))


def at_variant(doc: Column, path: str, kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, p, kind) for p in variant_path(path)])


#: Kinds that the strict accessors accept, by what schema_of_variant says. An unsigned value beyond 63 bits is a decimal there.
_STRICT = {"string": ("STRING",), "bigint": ("BIGINT", "INT", "SMALLINT", "TINYINT"), "boolean": ("BOOLEAN",), "double": ("DOUBLE", "FLOAT", "DECIMAL"), "unsigned": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL(19,0)", "DECIMAL(20,0)")}
#: Tagged kinds whose value is a text.
_TEXTS = ("timestamp", "date", "duration", "uuid", "ref")


def _inner(doc: Column, path: str) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, p, "variant") for p in variant_path(path)])


def kind_at(doc: Column, path: str) -> Column:
    """Name of the kind of what is at a path of a VARIANT: its $type if it is tagged; null if there is nothing."""
    inner = _inner(doc, path)
    told = F.schema_of_variant(inner)
    tag = F.try_variant_get(inner, '$["$type"]', "string")
    out = F.when(inner.isNull(), F.lit(None).cast("string")).when(tag.isNotNull(), tag)
    for head, kind in (("VOID", "null"), ("BOOLEAN", "bool"), ("DECIMAL(19,0)", "unsigned"), ("DECIMAL(20,0)", "unsigned"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"), ("STRING", "string"), ("ARRAY", "array"), ("OBJECT", "object"), ("BINARY", "bytes"), ("TIMESTAMP", "timestamp"), ("DATE", "date")):
        out = out.when(told.startswith(head), F.lit(kind))
    return out.otherwise(F.lit("int"))


def get_strict(doc: Column, path: str, kind: str) -> Column:
    """struct<value, error_code, error_path>: the value if it is of just that kind; VARIANT casts alone would be lenient.

    kind: string (also the text of a tagged timestamp, date, duration, uuid or ref), bigint, unsigned (as decimal), boolean,
    double, or bytes (of a tagged value, as binary).
    """
    inner = _inner(doc, path)
    told = F.schema_of_variant(inner)
    tag = F.try_variant_get(inner, '$["$type"]', "string")
    if kind == "bytes":
        fits, value = F.coalesce(tag == "bytes", F.lit(False)), F.try_to_binary(F.try_variant_get(inner, '$["$value"]', "string"), F.lit("base64"))
    else:
        fits = F.lit(False)
        for k in _STRICT[kind]:
            fits = fits | told.startswith(k)
        value = F.try_variant_get(inner, "$", {"unsigned": "decimal(20,0)"}.get(kind, kind))
        if kind == "unsigned":
            fits = fits & (value >= 0)
        if kind == "string":
            text = F.coalesce(tag.isin(*_TEXTS), F.lit(False))
            fits, value = fits | text, F.when(text, F.try_variant_get(inner, '$["$value"]', "string")).otherwise(value)
    fits = F.coalesce(fits, F.lit(False))
    code = F.when(inner.isNull(), F.lit(1203)).when(~fits, F.lit(1102))
    return F.struct(F.when(fits, value).alias("value"), code.alias("error_code"), F.when(code.isNotNull(), F.lit(path)).alias("error_path"))


def table_rows(df: DataFrame, key: str, doc: str, columns: dict[str, str]) -> DataFrame:
    """key, row_no and the named columns (with their types) of table documents in a column of tagged JSON, a row a table row.

    Typed arrays and plain lists alike; a missing column, and the end of a shorter one, is null.
    """
    v = F.try_parse_json(F.col(f"`{doc}`"))
    cell = lambda c, kind: F.coalesce(F.try_variant_get(v, f'$["$value"]["{c}"]["$value"]', f"array<{kind}>"), F.try_variant_get(v, f'$["$value"]["{c}"]', f"array<{kind}>"))
    lists = df.where(kind_at(v, "/") == "table").select(F.col(f"`{key}`").alias(key), *[cell(c, kind).alias(c) for c, kind in columns.items()])
    rows = lists.select(key, F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"`{c}`"), F.array().cast(f"array<{kind}>")).alias(c) for c, kind in columns.items()])).alias("row_no", "_row"))
    return rows.select(key, "row_no", *[F.col(f"_row.`{c}`") for c in columns])


def inspect(df: DataFrame, name: str) -> DataFrame:
    """name, n_rows, n_columns."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


#: Rows of a range of ids on average, and rows of a batch at most.
_RANGE, _BATCH = 1 << 16, 256


def batches(df: DataFrame, group: str, columns: list[str], size: int = _BATCH) -> DataFrame:
    """group, first, rows: the rows of each group, ordered by the columns, in arrays of structs of size rows at most.

    first is the number that the first of them has in its group. The first column is a number; its values are dealt to
    ranges of equal width, so that no task gets or counts through a whole group. Nulls come last.
    """
    q = lambda c: F.col(f"`{c}`")
    at = q(columns[0]).cast("double")
    whole = df.agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.greatest(F.floor(F.count("*") / _RANGE), F.lit(1)).alias("_n"))
    place = F.least(F.floor((at - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * F.col("_n")), F.col("_n") - 1)
    dealt = df.crossJoin(F.broadcast(whole)).select(q(group).alias("_group"), F.struct(*[q(c) for c in columns]).alias("_row"), F.coalesce(place, F.col("_n")).alias("_part"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_group", "_part").agg(F.count("*").alias("_size")).select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), before.alias("_start"))
    number = F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*[F.asc_nulls_last(F.col("_row").getField(c)) for c in columns])) - 1
    listed = dealt.withColumn("_no", number).groupBy("_group", "_part", F.floor(F.col("_no") / size).alias("_batch")).agg(F.array_sort(F.collect_list(F.struct("_no", "_row"))).alias("_rows"))
    placed = listed.join(F.broadcast(starts), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.select(F.col("_group").alias(group), (F.col("_start") + F.col("_batch") * size).alias("first"), F.transform("_rows", lambda x: x["_row"]).alias("rows"))
