"""Deltas: ordered changes that lead from one state to another.

Keyed tables are diffed by a full outer join and changed by an ordered fold, both native. Nested documents (dynamic values)
are diffed and changed one document at a time in Arrow batches.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import value_hash
from ..functions.model import Op, StateError, Tagged, at_path, kind_of, path_parts, same
from ..functions.pieces import pieces

OPS = ("set", "replace", "remove", "append", "prepend", "insert", "increment", "decrement", "merge", "move", "copy", "clear")

# -- keyed tables -----------------------------------------------------------------------------------------------------


_INTEGRAL = ("byte", "short", "integer", "long")
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _step(c: Column) -> Column:
    """A key as a step of a path: '~' and '/' are written '~0' and '~1'."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _told(c: Column, kind: T.DataType) -> Column:
    """A value as text that reads as the same value."""
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return c.cast("string") if isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType) else F.to_json(c, _JSON)


def _read(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unbase64(c)
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(c)
    return c.cast(kind) if isinstance(kind, T.AtomicType) else F.from_json(c, kind, _JSON)


def diff_tables(base: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, seq, kind, path, value (text): the changes of each row, columns in name order.

    Integral columns change by increment or decrement, others by replace; a new row sets its object, nulls included, and a
    lost one is removed. A column that only target has is set, one that only base has is removed, in each row they share.
    """
    columns = sorted((set(base.columns) | set(target.columns)) - {key})
    old, new = ({f.name: f.dataType for f in df.schema} for df in (base, target))
    q = lambda c: F.col(f"`{c}`")
    a = base.select(q(key).alias("_ak"), F.lit(True).alias("_a"), F.struct(F.lit(0).alias("_none"), *[q(c).alias(c) for c in columns if c in old]).alias("_x"))
    b = target.select(q(key).alias("_bk"), F.lit(True).alias("_b"), F.struct(F.lit(0).alias("_none"), *[q(c).alias(c) for c in columns if c in new]).alias("_y"))
    both = a.join(b, F.col("_ak").eqNullSafe(F.col("_bk")), "full")
    none = F.lit(None).cast("string")
    op = lambda kind, path, value: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), path.alias("path"), value.alias("value"))
    k = F.coalesce("_ak", "_bk")
    at = F.concat(F.lit("/"), _step(F.coalesce(k.cast("string"), F.lit(""))))
    changes = []
    for c in columns:
        path = F.concat(at, F.lit("/"), _step(F.lit(c)))
        if c not in new:
            changes.append(op("remove", path, none))
            continue
        y = F.col("_y").getField(c)
        if c not in old:
            changes.append(op("set", path, _told(y, new[c])))
            continue
        x = F.col("_x").getField(c)
        plain = op("replace", path, _told(y, new[c]))
        if old[c].typeName() in _INTEGRAL and new[c].typeName() in _INTEGRAL:
            d = y.cast("decimal(20,0)") - x.cast("decimal(20,0)")
            plain = F.when(d.isNotNull(), op(F.when(d > 0, "increment").otherwise("decrement"), path, F.abs(d).cast("decimal(20,0)").cast("string"))).otherwise(plain)
            changes.append(F.when(~x.cast("long").eqNullSafe(y.cast("long")), plain))
        elif old[c] == new[c] and not isinstance(new[c], (T.MapType, T.VariantType)):
            changes.append(F.when(~x.eqNullSafe(y), plain))
        else:
            changes.append(F.when(~_told(x, old[c]).eqNullSafe(_told(y, new[c])), plain))
    row = F.to_json(F.struct(*[F.col("_y").getField(c).alias(c) for c in columns if c in new]), _JSON) if set(columns) & set(new) else F.lit("{}")
    ops = F.when(F.col("_b").isNull(), F.array(op("remove", at, none))).when(F.col("_a").isNull(), F.array(op("set", at, row))).otherwise(F.array_compact(F.array(*changes)) if changes else F.array().cast("array<struct<kind:string,path:string,value:string>>"))
    listed = both.select(k.alias("_k"), ops.alias("_ops"))
    return listed.select(F.col("_k").alias(key), F.posexplode("_ops").alias("seq", "_op")).select(q(key), F.col("seq").cast("long"), "_op.*")


def apply_tables(base: DataFrame, ops: DataFrame, key: str, schema: T.StructType | None = None) -> DataFrame:
    """base after the changes (key, seq, kind, path, value) of its rows, in the order of seq; schema: of the outcome, if not base's.

    A row's set or remove voids what came before it, and a column's set, replace or remove the same for that column; after it
    increments and decrements add up. All of this is windows that spill and aggregates, so that a key may have any number of
    changes, and the changes, which may be costly to make, are made once. A removed column is null, or goes where schema
    lacks it.
    """
    schema = schema or base.schema
    fields = [f for f in schema if f.name != key]
    q = lambda c: F.col(f"`{c}`")
    step = F.get(F.split("path", "/"), 2)
    ops = ops.select(q(key).alias("_k"), F.col("seq").alias("_seq"), F.col("kind").alias("_kind"), F.col("value").alias("_value"), F.replace(F.replace(step, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("_c"))
    resets, by, change = F.col("_kind").isin("set", "replace", "remove", "clear"), F.col("_value").try_cast("decimal(38,0)"), F.struct("_seq", "_kind", "_value")
    # one shuffle by key and one sort: the order by column is that of the second window
    every = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = ops.where(F.col("_c").isin([f.name for f in fields]) | F.expr("_c is null and _kind in ('set', 'replace', 'remove')"))
    told = told.withColumn("_row", F.max(F.when(F.col("_c").isNull(), change)).over(every)).withColumn("_live", F.expr("_c is not null and (_row is null or _seq > _row._seq)"))
    told = told.withColumn("_reset", F.max(F.when(F.col("_live") & resets, change)).over(Window.partitionBy("_k", "_c")))
    moved = F.when(F.expr("_live and (_reset is null or _seq >= _reset._seq)"), F.when(F.col("_kind") == "increment", by).when(F.col("_kind") == "decrement", -by))
    own = lambda f, c: F.when(F.col("_c") == f.name, c)
    changed = told.groupBy("_k").agg(F.max("_row").alias("_row"), *[x for i, f in enumerate(fields) for x in (F.max(own(f, F.when(F.col("_live"), F.col("_reset")))).alias(f"_c{i}"), F.sum(own(f, moved)).alias(f"_by{i}"))])
    old = base.select(q(key).alias("_bk"), F.lit(True).alias("_here"), *[q(f.name).alias(f"_b{i}") if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f"_b{i}") for i, f in enumerate(fields)])
    both = old.join(changed, F.col("_bk").eqNullSafe(F.col("_k")), "full").where(F.coalesce(F.col("_row._kind") != "remove", F.col("_here"), F.lit(False)))
    whole = F.from_json("_row._value", T.StructType(fields), _JSON) if fields else None
    out = []
    for i, f in enumerate(fields):
        c, fresh = F.col(f"_c{i}"), F.coalesce(F.col("_row._kind").isin("set", "replace"), F.lit(False))
        v = F.when(c.isNotNull(), _read(c["_value"], f.dataType)).when(fresh, whole[f.name]).otherwise(F.col(f"_b{i}").cast(f.dataType))
        if f.dataType.typeName() in _INTEGRAL:
            v = (v.cast("decimal(38,0)") + F.coalesce(F.col(f"_by{i}"), F.lit(0).cast("decimal(38,0)"))).cast(f.dataType)
        out.append(v.alias(f.name))
    done = dict(zip([f.name for f in fields], out, strict=True))
    return both.select(*[F.coalesce("_bk", "_k").cast(f.dataType).alias(key) if f.name == key else done[f.name] for f in schema])


def fold_counters(ops: DataFrame, key: str, seq: str = "seq", kind: str = "kind", value: str = "value") -> DataFrame:
    """key, state (double): set, replace, increment, decrement, remove and clear of one number, in the order of seq.

    The order matters once kinds mix, so a key's operations are folded sorted. Keys with many are not gathered: what stands
    before the last set, replace, remove or clear has no effect, and after it sums suffice; both are plain aggregates.
    """
    resets = F.col(kind).isin("set", "replace", "remove", "clear")
    last = ops.groupBy(F.col(key).alias("_l")).agg(F.max(F.when(resets, F.col(seq))).alias("_at"), F.max_by(F.when(F.col(kind).isin("set", "replace"), F.col(value)).when(F.col(kind) == "clear", F.lit(0.0)), F.when(resets, F.col(seq))).alias("_from"))
    rest = ops.join(last, F.col(key).eqNullSafe(F.col("_l"))).where(F.col("_at").isNull() | (F.col(seq) >= F.col("_at")))
    moved = F.sum(F.when(F.col(kind) == "increment", F.col(value)).when(F.col(kind) == "decrement", -F.col(value)).otherwise(0.0))
    start = F.when(F.max("_at").isNull(), F.lit(0.0)).otherwise(F.max("_from"))
    return rest.groupBy(key).agg((start + moved).alias("state"))


# -- array and map columns ----------------------------------------------------------------------------------------------


def append(a: Column, v: Column) -> Column:
    return F.array_append(a, v)


def prepend(a: Column, v: Column) -> Column:
    return F.array_prepend(a, v)


def clear(a: Column) -> Column:
    """Empty, and null where it is null."""
    return F.slice(a, 1, 0)


def set_at(a: Column, i: int, v: Column) -> Column:
    """Sets an element; at the end appends; beyond it is null."""
    out = F.concat(F.slice(a, 1, i), F.array(v), F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))
    return F.when(F.size(a) >= i, out)


def insert_at(a: Column, i: int, v: Column) -> Column:
    return F.when(F.size(a) >= i, F.array_insert(a, i + 1, v))


def remove_at(a: Column, i: int) -> Column:
    return F.when(F.size(a) > i, F.concat(F.slice(a, 1, i), F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0)))))


def merge_maps(a: Column, b: Column) -> Column:
    """Shallow; b wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


# -- nested documents ---------------------------------------------------------------------------------------------------


def diff(base: Any, target: Any, path: str = "") -> list[Op]:
    """Objects: removes in key order, then keys of the target; arrays: by place, then appends, or removes from the end."""
    if isinstance(base, dict) and isinstance(target, dict):
        out = [Op("remove", f"{path}/{k}") for k in sorted(base.keys() - target.keys())]
        for k in sorted(target):
            out += diff(base[k], target[k], f"{path}/{k}") if k in base else [Op("set", f"{path}/{k}", target[k], valued=True)]
        return out
    if isinstance(base, list) and isinstance(target, list):
        shared = min(len(base), len(target))
        out = [op for i in range(shared) for op in diff(base[i], target[i], f"{path}/{i}")]
        out += [Op("append", path or "/", v, valued=True) for v in target[shared:]]
        return out + [Op("remove", f"{path}/{i}") for i in range(len(base) - 1, shared - 1, -1)]
    if kind_of(base) == kind_of(target) == "int" and base != target:
        return [Op("increment" if target > base else "decrement", path or "/", abs(target - base), valued=True)]
    return [] if same(base, target) else [Op("replace", path or "/", target, valued=True)]


class _Place:
    """A parent and the key or place in it."""

    def __init__(self, root: list, path: str):
        parts = path_parts(path)
        self.path, self.holder, self.key = path, root, 0
        for part in parts:
            inner = self.holder[self.key] if not isinstance(self.holder, dict) or self.key in self.holder else self._miss()
            if isinstance(inner, Tagged) and inner.kind == "message":
                inner = inner.value.setdefault("fields", {})
            if isinstance(inner, list):
                if not part.isdigit():
                    self._miss()
                self.key = int(part)
            elif isinstance(inner, dict):
                self.key = part
            else:
                self._miss()
            self.holder = inner
            if part is not parts[-1] and not self.there():
                self._miss()

    def _miss(self):
        raise StateError("invalid_path", "nothing there", self.path)

    def there(self) -> bool:
        return self.key in self.holder if isinstance(self.holder, dict) else self.key < len(self.holder)

    def get(self) -> Any:
        return self.holder[self.key] if self.there() else self._miss()

    def put(self, value: Any) -> None:
        if isinstance(self.holder, list) and self.key == len(self.holder):
            self.holder.append(value)
        elif isinstance(self.holder, dict) or self.key < len(self.holder):
            self.holder[self.key] = value
        else:
            self._miss()

    def drop(self, root: list) -> None:
        if self.holder is root:
            root[0] = None
        elif isinstance(self.holder, dict):
            self.holder.pop(self.key, None)
        elif self.there():
            self.holder.pop(self.key)
        else:
            self._miss()

    def array(self) -> list:
        out = self.get()
        return out if isinstance(out, list) else self._wrong("array")

    def _wrong(self, what: str):
        raise StateError("type_mismatch", f"{what} expected", self.path)


def change(root: list, op: Op) -> None:
    """One change of root[0], in place."""
    need = {"set", "replace", "append", "prepend", "insert", "increment", "decrement", "merge"}
    if (op.kind in need and not op.valued) or (op.kind in ("move", "copy") and op.source is None) or (op.kind == "insert" and op.index is None):
        raise StateError("validation_error", f"{op.kind} lacks a part", op.path)
    if op.kind in ("move", "copy"):
        value = copy.deepcopy(_Place(root, op.source).get())
        if op.kind == "move":
            _Place(root, op.source).drop(root)
        _Place(root, op.path).put(value)
        return
    at = _Place(root, op.path)
    if op.kind in ("set", "replace"):
        at.put(copy.deepcopy(op.value))
    elif op.kind == "remove":
        at.drop(root)
    elif op.kind in ("append", "prepend", "insert"):
        items = at.array()
        i = {"append": len(items), "prepend": 0}.get(op.kind, op.index)
        if i > len(items):
            raise StateError("invalid_path", "beyond the end", op.path)
        items.insert(i, copy.deepcopy(op.value))
    elif op.kind in ("increment", "decrement"):
        old, by = at.get(), op.value.value if isinstance(op.value, Tagged) and op.value.kind == "unsigned" else op.value
        unsigned = isinstance(old, Tagged) and old.kind == "unsigned"
        if kind_of(by) != "int" or not (unsigned or kind_of(old) == "int"):
            raise StateError("type_mismatch", "integer expected", op.path)
        new = (old.value if unsigned else old) + (by if op.kind == "increment" else -by)
        if not (0 <= new < 1 << 64 if unsigned else -(1 << 63) <= new < 1 << 63):
            raise StateError("validation_error", "out of range", op.path)
        at.put(Tagged("unsigned", new) if unsigned else new)
    elif op.kind == "merge":
        into = at.get()
        if not isinstance(into, dict) or not isinstance(op.value, dict):
            raise StateError("type_mismatch", "object expected", op.path)
        into.update(copy.deepcopy(op.value))
    elif op.kind == "clear":
        old = at.get()
        empty = {"array": [], "object": {}, "string": "", "bytes": Tagged("bytes", b"")}.get(kind_of(old))
        if empty is None:
            raise StateError("type_mismatch", "nothing to clear", op.path)
        at.put(type(empty)() if not isinstance(empty, Tagged) else empty)
    else:
        raise StateError("validation_error", f"no operation {op.kind}", op.path)


def apply(base: Any, ops: list[Op], from_hash: str | None = None, check: bool = False) -> Any:
    """All or nothing: the first error leaves base as it is. check: from_hash must be the hash of base."""
    if check and from_hash is not None and from_hash != value_hash(base):
        raise StateError("validation_error", "the delta is for another state")
    root = [copy.deepcopy(base)]
    for op in ops:
        change(root, op)
    return root[0]


def _columns(f, base: pa.Array, other: pa.Array) -> tuple[list, list, list]:
    values, codes, paths = [], [], []
    for a, b in zip(base.to_pylist(), other.to_pylist(), strict=True):
        try:
            values.append(f(a, b))
            codes.append(None)
            paths.append(None)
        except StateError as e:
            values.append(None)
            codes.append(e.code)
            paths.append(e.path)
    return values, codes, paths


def _documents(df: DataFrame, key: str, a: str, b: str, f) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = _columns(f, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], [key, "value", "error_code", "error_path"])

    return df.select(key, a, b).mapInArrow(run, f"{key} {kind}, value string, error_code int, error_path string")


def diff_documents(df: DataFrame, key: str, base: str, target: str) -> DataFrame:
    """key, value (the delta as tagged JSON), error_code, error_path, for tagged JSON columns."""
    from ..sources.jsonio import dumps, loads

    return _documents(df, key, base, target, lambda a, b: dumps(Tagged("delta", (None, diff(loads(a), loads(b))))))


def apply_documents(df: DataFrame, key: str, base: str, delta: str, check: bool = False) -> DataFrame:
    """key, value (tagged JSON), error_code, error_path."""
    from ..sources.jsonio import dumps, loads

    def one(a: str, d: str) -> str:
        told = loads(d)
        return dumps(apply(loads(a), told.value[1], told.value[0], check))

    return _documents(df, key, base, delta, one)


__all__ = ["OPS", "append", "apply", "apply_documents", "apply_tables", "at_path", "change", "clear", "diff", "diff_documents", "diff_tables", "fold_counters", "insert_at", "merge_maps", "prepend", "remove_at", "set_at"]
