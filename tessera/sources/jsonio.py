"""Tagged JSON: kinds that JSON lacks are objects of $type and $value. As text between Spark and Python, and as columns."""

from __future__ import annotations

import base64
import json
import math
from typing import Any
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.model import Op, StateError, Tagged

#: Element types of typed arrays, with the range of the integral ones.
ELEMENTS = {"u8": (0, 255), "i32": (-(1 << 31), (1 << 31) - 1), "f32": None, "f64": None, "bool": None}
_TEXTS = ("timestamp", "date", "duration", "ref")


def element(kind: str, v: Any) -> Any:
    """A typed array's element, checked."""
    if kind not in ELEMENTS:
        raise StateError("unsupported_feature", f"typed array of {kind}")
    if kind == "bool":
        if isinstance(v, bool):
            return v
    elif isinstance(v, (int, float)) and not isinstance(v, bool):
        if (span := ELEMENTS[kind]) is None:
            return float(v)
        if isinstance(v, int) and span[0] <= v <= span[1]:
            return v
    elif v is None and kind in ("f32", "f64"):
        return math.nan
    raise StateError("type_mismatch", f"{v!r} is no {kind}")


def _plain(v: Any) -> Any:
    if v is None or type(v) in (str, int, bool):
        return v
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if not isinstance(v, Tagged):
        return v
    x = v.value
    if v.kind in ("enum", "url", "email", "unsigned"):
        return x
    tag, body = v.kind, x
    if v.kind == "bytes":
        body = base64.b64encode(x).decode()
    elif v.kind == "uuid":
        body = str(UUID(x))
    elif v.kind == "decimal":
        body = {"scaled": str(x[0]), "scale": x[1]}
    elif v.kind == "money":
        body = dict(zip(("currency", "scaled", "scale"), x, strict=True))
    elif v.kind == "map":
        body = [[_plain(a), _plain(b)] for a, b in x]
    elif v.kind == "typed_array":
        tag, body = f"typed_array:{x[0]}", [_plain(e) for e in x[1]]
    elif v.kind == "tensor":
        body = {"shape": list(x[0]), "data": _plain(x[1])} | ({"layout": x[2]} if x[2] else {})
    elif v.kind == "blob_ref":
        body = {k: y.hex() if isinstance(y, bytes) else y for k, y in x.items() if y is not None}
    elif v.kind == "delta":
        ops = [{"kind": o.kind, "path": o.path} | ({"value": _plain(o.value)} if o.valued else {}) | ({"from": o.source} if o.source is not None else {}) | ({"index": o.index} if o.index is not None else {}) for o in x[1]]
        body = ({"from_hash": x[0]} if x[0] else {}) | {"ops": ops}
    elif v.kind in ("table", "message"):
        body = {k: _plain(y) for k, y in x.items() if y is not None}
    return {"$type": tag, "$value": body}


def _tagged(tag: str, v: Any) -> Any:
    try:
        if tag == "bytes":
            return Tagged(tag, base64.b64decode(v, validate=True))
        if tag == "uuid":
            return Tagged(tag, str(UUID(v)))
        if tag in _TEXTS:
            if not isinstance(v, str):
                raise TypeError
            return Tagged(tag, v)
        if tag == "decimal":
            return Tagged(tag, (int(v["scaled"]), int(v["scale"])))
        if tag == "money":
            return Tagged(tag, (str(v["currency"]), int(v["scaled"]), int(v["scale"])))
        if tag == "map":
            return Tagged(tag, [(_value(a), _value(b)) for a, b in v])
        if tag.startswith("typed_array:"):
            kind = tag.partition(":")[2]
            return Tagged("typed_array", (kind, [element(kind, x) for x in v]))
        if tag == "table":
            return Tagged(tag, {k: _value(x) for k, x in v.items()})
        if tag == "tensor":
            return Tagged(tag, ([int(x) for x in v["shape"]], _value(v["data"]), v.get("layout")))
        if tag == "blob_ref":
            return Tagged(tag, v | ({"hash": bytes.fromhex(v["hash"])} if "hash" in v else {}) | {"uri": v["uri"]})
        if tag == "delta":
            return Tagged(tag, (v.get("from_hash"), [Op(o["kind"], o["path"], _value(o.get("value")), o.get("from"), o.get("index"), "value" in o) for o in v["ops"]]))
        if tag == "message":
            return Tagged(tag, {k: _value(x) if k in ("fields", "payload") else x for k, x in v.items()})
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        if isinstance(e, StateError):
            raise
        raise StateError("parse_error", f"bad {tag}") from None
    raise StateError("unsupported_feature", f"$type {tag}")


def _value(v: Any) -> Any:
    if v is None or type(v) in (str, float, bool):
        return v
    if isinstance(v, list):
        return [_value(x) for x in v]
    if isinstance(v, dict):
        if isinstance(v.get("$type"), str) and "$value" in v:
            return _tagged(v["$type"], v["$value"])
        return {k: _value(x) for k, x in v.items()}
    if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
        if not 0 <= v < 1 << 64:
            raise StateError("invalid_number", str(v))
        return Tagged("unsigned", v)
    return v


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise StateError("duplicate_key", next(k for k, _ in pairs if sum(k == x for x, _ in pairs) > 1))
    return out


# made once: json.dumps and json.loads make one at each call
_ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
_DECODER = json.JSONDecoder(object_pairs_hook=_unique)


def dumps(v: Any) -> str:
    return _ENCODER.encode(_plain(v))


def loads(text: str | None) -> Any:
    if text is None:
        return None
    try:
        return _value(_DECODER.decode(text))
    except json.JSONDecodeError as e:
        raise StateError("parse_error", f"{e.lineno}:{e.colno} {e.msg}") from None


# -- columns ------------------------------------------------------------------------------------------------------------


def tagged(kind: str, body: Column) -> Column:
    """Tagged JSON of a column."""
    return F.to_json(F.struct(F.lit(kind).alias("$type"), body.alias("$value")))


def untagged(doc: Column, path: str, kind: str, cast: str) -> Column:
    """The $value at a VARIANT path where its $type is kind."""
    return F.when(F.try_variant_get(doc, f'{path}["$type"]', "string") == kind, F.try_variant_get(doc, f'{path}["$value"]', cast))
