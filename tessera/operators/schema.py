"""Schemas by field id: the schema language, validation as one expression, compatibility as a full outer join, migration."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import StateError

#: Spark type of each primitive, and the range of the narrower integers.
PRIMITIVES: dict[str, T.DataType] = {
    "null": T.NullType(), "bool": T.BooleanType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(),
    "string": T.StringType(), "bytes": T.BinaryType(), "uuid": T.StringType(), "timestamp": T.StringType(), "date": T.StringType(), "duration": T.StringType(), "url": T.StringType(), "email": T.StringType(),
    "decimal": T.StructType().add("scaled", T.DecimalType(38, 0)).add("scale", T.IntegerType()), "money": T.StructType().add("currency", T.StringType()).add("scaled", T.LongType()).add("scale", T.IntegerType()), "object": T.VariantType(), "table": T.VariantType(),
}
RANGES = {name: ((0, (1 << bits) - 1) if name[0] == "u" else (-(1 << bits - 1), (1 << bits - 1) - 1)) for bits in (8, 16, 32, 64) for name in (f"u{bits}", f"i{bits}")}
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: str
    optional: bool = False
    default: str | None = None
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    name: str
    version: int
    fields: tuple[Field, ...] = field(default=())

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.type), f.optional, {"id": f.id, "hints": list(f.hints), "logical_type": f.type} | ({"default": f.default} if f.default is not None else {})) for f in self.fields])

    def table(self, spark: SparkSession) -> DataFrame:
        """A row a field."""
        return spark.createDataFrame([(self.version, f.id, f.name, f.type, f.optional, f.default, list(f.hints)) for f in self.fields], "version int, id int, name string, type string, optional boolean, default string, hints array<string>")

    def hash(self) -> str:
        body = [asdict(f) | {"hints": sorted(f.hints)} for f in sorted(self.fields, key=lambda f: f.id)]
        return hashlib.sha256(json.dumps([self.name, self.version, body], sort_keys=True).encode()).hexdigest()


_HEAD = re.compile(r"schema\s+(\w+)(?:\s+v(\S+))?\s*\{")
_LINE = re.compile(r"#(\d+)\s+(\w+)(\?)?\s*:\s*([^=@]+?)\s*(?:=\s*(.*?))?\s*$")


def parse_schema(text: str) -> Schema:
    """One field a line: #id name?: type = default @hint ...; a version that is no number is 1."""
    head = _HEAD.search(text)
    if not head:
        raise StateError("parse_error", "no schema")
    fields: list[Field] = []
    for raw in text[head.end() :].splitlines():
        line = raw.split("//")[0].strip().rstrip(",")
        if line in ("", "}"):
            continue
        hints = tuple(re.findall(r"(?:^|\s)@([\w:.-]+)", line))
        m = _LINE.match(re.sub(r"\s@[\w:.-]+", "", line))
        if not m:
            raise StateError("parse_error", line)
        renamed = Field(int(m[1]), m[2], re.sub(r"\s+", "", m[4]), bool(m[3]), m[5], hints)
        spark_type(renamed.type)
        fields.append(renamed)
    if not fields:
        raise StateError("parse_error", "no fields")
    if len({f.id for f in fields}) < len(fields):
        raise StateError("parse_error", "field id twice")
    return Schema(head[1], int(head[2]) if (head[2] or "").isdigit() else 1, tuple(fields))


def spark_type(name: str) -> T.DataType:
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    if m := re.fullmatch(r"typed<(u8|i32|f32|f64|bool)>", name):
        return T.ArrayType(PRIMITIVES[m[1]], False)
    if name.startswith("enum["):
        return T.StringType()
    return PRIMITIVES.get(name, T.VariantType())  # else an object by its schema's name


def _wrong(c: Column, name: str, kind: T.DataType) -> Column:
    """True where a value that is there is not of the type; null fails every type but null."""
    text, number = isinstance(kind, T.StringType), isinstance(kind, T.NumericType)
    never = F.lit(True)
    if name.endswith("[]") or name.startswith("typed<"):
        inner = name[:-2] if name.endswith("[]") else name[6:-1]
        return c.isNull() | F.exists(c, lambda x: _wrong(x, inner, kind.elementType)) if isinstance(kind, T.ArrayType) else never
    if name.startswith("enum["):
        return c.isNull() | ~c.isin(*name[5:-1].split(",")) if text else never
    if name == "null":
        return c.isNotNull()
    if name in RANGES:
        lo, hi = RANGES[name]
        if not isinstance(kind, (T.IntegralType, T.DecimalType)):
            return never
        wide = c.cast("decimal(20,0)")
        return c.isNull() | ~wide.between(F.lit(lo).cast("decimal(20,0)"), F.lit(hi).cast("decimal(20,0)"))
    fits = {"bool": isinstance(kind, T.BooleanType), "f32": number, "f64": number, "bytes": isinstance(kind, T.BinaryType), "decimal": isinstance(kind, (T.StructType, T.DecimalType)), "money": isinstance(kind, T.StructType), "timestamp": text or isinstance(kind, T.TimestampType), "date": text or isinstance(kind, T.DateType)}.get(name, text if name in PRIMITIVES and name not in ("object", "table") else isinstance(kind, (T.StructType, T.MapType, T.VariantType)))
    if not fits:
        return never
    return c.isNull() | ~c.rlike(UUID) if name == "uuid" else c.isNull()


def errors(df: DataFrame, schema: Schema, present: str | None = None) -> Column:
    """array<struct<error_code, error_path>> of a row in field order; empty if it is valid. Other columns are let be.

    present: a column with the names that the row has, where absence and null differ; without it a null of an optional field
    is absence.
    """
    out = []
    for f in schema.fields:
        path = F.lit(f"/{f.name}")
        miss = F.struct(F.lit(1103).alias("error_code"), path.alias("error_path"))
        wrong = F.struct(F.lit(1102).alias("error_code"), path.alias("error_path"))
        if f.name not in df.columns:
            out.append(F.lit(None).cast("struct<error_code:int,error_path:string>") if f.optional else miss)
            continue
        c = F.col(f"`{f.name}`")
        bad = F.when(_wrong(c, f.type, df.schema[f.name].dataType), wrong)
        if present:
            there = F.array_contains(present, f.name)
            out.append(F.when(~there, F.lit(None) if f.optional else miss).otherwise(bad))
        else:
            out.append(F.when(c.isNotNull(), bad) if f.optional else F.when(c.isNull() & F.lit(f.type != "null"), miss).otherwise(bad))
    return F.array_compact(F.array(*out))


def validate(df: DataFrame, schema: Schema, present: str | None = None) -> DataFrame:
    """df with error_code and error_path of the first error."""
    first = F.get(errors(df, schema, present), 0)
    return df.withColumn("_first", first).select(*df.columns, F.col("_first.error_code").alias("error_code"), F.col("_first.error_path").alias("error_path"))


def compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    """seq, id, step, name, detail from two tables of fields: old ids first, then new ones."""
    a = old.select(F.col("id").alias("_a"), F.col("name").alias("_an"), F.col("type").alias("_at"))
    b = new.select(F.col("id").alias("_b"), F.col("name").alias("_bn"), F.col("type").alias("_bt"), "optional", "default")
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    lost, added = F.col("_b").isNull(), F.col("_a").isNull()
    step = F.when(lost, "incompatible").when(added, F.when(F.col("optional"), "add_optional").when(F.col("default").isNotNull(), "add_default").otherwise("incompatible")).when(F.col("_at") != F.col("_bt"), "incompatible").when(F.col("_an") != F.col("_bn"), "rename").otherwise("copy")
    detail = F.when(lost, "removed").when(added & ~F.col("optional") & F.col("default").isNull(), "new required field").when(~added & (F.col("_at") != F.col("_bt")), "type changed").when(~added & (F.col("_an") != F.col("_bn")), F.col("_an")).when(added, F.col("default"))
    return both.select(added.alias("is_new"), F.coalesce("_a", "_b").alias("id"), step.alias("step"), F.coalesce("_bn", "_an").alias("name"), detail.alias("detail"))


def migrate(df: DataFrame, old: Schema, new: Schema) -> DataFrame:
    """df as the new schema has it: copied, renamed by id, added with null or default; an incompatible field is an error."""
    before = {f.id: f for f in old.fields}
    out = []
    for f in new.fields:
        if was := before.get(f.id):
            if was.type != f.type:
                raise StateError("validation_error", "type changed", f"/{f.name}")
            out.append(F.col(f"`{was.name}`").alias(f.name))
        elif f.optional or f.default is not None:
            out.append(_default(f).alias(f.name))
        else:
            raise StateError("validation_error", "new required field", f"/{f.name}")
    if lost := before.keys() - {f.id for f in new.fields}:
        raise StateError("validation_error", "field removed", f"/{before[min(lost)].name}")
    return df.select(*out)


def _default(f: Field) -> Column:
    kind = spark_type(f.type)
    if f.default is None:
        return F.lit(None).cast(kind)
    return F.lit(f.default.strip('"')).cast(kind)


def apply_defaults(df: DataFrame, schema: Schema) -> DataFrame:
    """df with nulls and missing columns filled where the schema has a default."""
    for f in schema.fields:
        if f.default is not None:
            df = df.withColumn(f.name, F.coalesce(F.col(f.name), _default(f)) if f.name in df.columns else _default(f))
    return df
