"""Dynamic values, paths and error codes.

A value is None, bool, int, float, str, list or dict, or a Tagged of one of KINDS. In DataFrames a dynamic document is its
tagged JSON text (see sources.jsonio), or a VARIANT parsed from it.
"""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numeric error codes of the format.
ERRORS = {
    "invalid_magic": 1001, "unsupported_version": 1002, "invalid_length": 1003, "segment_out_of_bounds": 1004, "checksum_failed": 1005,
    "schema_not_found": 1101, "type_mismatch": 1102, "required_field_missing": 1103, "invalid_field_id": 1104, "invalid_dictionary_ref": 1105, "invalid_shape_ref": 1106,
    "message_too_large": 1201, "unsupported_feature": 1202, "invalid_path": 1203, "duplicate_key": 1204,
    "parse_error": 1301, "validation_error": 1302, "invalid_utf8": 1303, "invalid_number": 1304, "unexpected_eof": 1305, "internal": 1999,
}

#: Beyond the plain ones. typed_array: (element, list); decimal: (scaled, scale); money: (currency, scaled, scale); map: list
#: of pairs; table: dict of lists or typed arrays; tensor: (shape, typed array, layout); blob_ref: dict; delta: (from_hash,
#: list of Op); message: dict with fields; the rest: text, bytes or int.
KINDS = ("bytes", "uuid", "timestamp", "date", "duration", "decimal", "money", "map", "typed_array", "table", "tensor", "message", "delta", "ref", "blob_ref", "enum", "url", "email", "unsigned")


class Tagged(NamedTuple):
    kind: str
    value: Any


class Op(NamedTuple):
    kind: str
    path: str
    value: Any = None
    source: str | None = None
    index: int | None = None
    valued: bool = False


class StateError(ValueError):
    """An error with its stable name, numeric code and the path or place where it arose."""

    def __init__(self, name: str, message: str = "", path: str = ""):
        super().__init__(f"{name}: {message}" + (f" at {path}" if path else ""))
        self.name, self.code, self.message, self.path = name, ERRORS[name], message, path


def kind_of(value: Any) -> str:
    if isinstance(value, Tagged):
        return value.kind
    for kind, types in (("null", type(None)), ("bool", bool), ("int", int), ("float", float), ("string", str), ("array", list), ("object", dict)):
        if isinstance(value, types):
            return kind
    raise StateError("internal", f"no kind for {type(value).__name__}")


def same(a: Any, b: Any) -> bool:
    """Structural equality: kinds differ, so 1, 1.0 and true do; NaN equals NaN."""
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, Tagged):
        a, b = a.value, b.value
        if not isinstance(a, (list, dict, tuple, Tagged)):
            return a == b
    if isinstance(a, (list, tuple)):
        return type(a) is type(b) and len(a) == len(b) and all(same(x, y) if not isinstance(x, tuple) else tuple(map(str, x)) == tuple(map(str, y)) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(x, b[k]) for k, x in a.items())
    return a == b or (a != a and b != b)


def path_parts(path: str) -> list[str]:
    """'/a/0/b' as ['a', '0', 'b']; '' and '/' are the root, empty parts are skipped."""
    return [p for p in path.split("/") if p]


def at_path(value: Any, path: str) -> tuple[bool, Any]:
    """Whether there is anything at the path, and what. A number is a place in an array, and a key of an object."""
    for part in path_parts(path):
        if isinstance(value, Tagged) and value.kind in ("message", "table"):
            value = value.value.get("fields", {}) if value.kind == "message" else value.value
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return False, None
    return True, value


def path_column(path: Column) -> Column:
    """array<struct<key, idx>> of a path column."""
    return F.transform(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: F.struct(p.alias("key"), F.when(p.rlike("^[0-9]+$"), p.cast("int")).alias("idx")))


def variant_path(path: str) -> list[str]:
    """The VARIANT paths to try for a path: numbers as places and as keys."""
    out = ["$"]
    for part in path_parts(path):
        key = '["' + re.sub(r'(["\\])', r"\\\1", part) + '"]'
        out = [x + f"[{part}]" for x in out if part.isdigit()] + [x + key for x in out]
    return out
