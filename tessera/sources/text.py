"""The text form of values: one expression each, read by recursive descent over a token stream, and written canonically.

read() and write() work on columns of text; a bad row gives an error code and place, never a failed job.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from typing import Any
from uuid import UUID

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Op, StateError, Tagged
from ..functions.pieces import pieces
from .jsonio import ELEMENTS, dumps, element, loads

DEPTH = 200
_TOKENS = re.compile(
    r"""\s*(?:(?P<skip>//[^\n]*|\#(?![0-9])[^\n]*|/\*.*?\*/)
    |(?P<open>/\*)
    |(?P<string>"(?:[^"\\]|\\.)*")
    |(?P<path>/[A-Za-z0-9_./-]*)
    |(?P<field>\#[0-9]+)
    |(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)
    |(?P<number>[0-9-][0-9.eE+-]*)
    |(?P<mark>[{}\[\]():,=?]))""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f"}
#: Delta keywords: what follows the path.
_OPERATIONS = {
    "set": "value", "replace": "value", "append": "value", "prepend": "value", "merge": "value", "remove": "", "clear": "",
    "inc": "by", "increment": "by", "dec": "by", "decrement": "by", "insert": "at", "move": "from", "copy": "from",
}
_SHORT = {"inc": "increment", "dec": "decrement"}


class Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, [], 0
        at, end, match, keep = 0, len(text.rstrip()), _TOKENS.match, self.tokens.append
        while at < end:
            m = match(text, at)
            kind = m.lastgroup if m else None
            if kind is None or kind == "open":
                at = m.start(kind) if m else len(text) - len(text[at:].lstrip())
                raise self.error("comment without end" if m else f"unexpected {text[at]!r}", at)
            if kind != "skip":
                keep((kind, m[kind], m.start(kind)))
            at = m.end()
        self.tokens.append(("end", "", len(text)))

    def error(self, message: str, at: int | None = None) -> StateError:
        at = self.tokens[min(self.i, len(self.tokens) - 1)][2] if at is None else at
        line = self.text.count("\n", 0, at) + 1
        return StateError("parse_error", message, f"{line}:{at - self.text.rfind(chr(10), 0, at)}")

    def peek(self, mark: str) -> bool:
        kind, text, _ = self.tokens[self.i]
        return text == mark and kind in ("mark", "name")

    def take(self, mark: str) -> bool:
        hit = self.peek(mark)
        self.i += hit
        return hit

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise self.error(f"{mark} expected")

    def of(self, *kinds: str) -> str:
        kind, text, _ = self.tokens[self.i]
        if kind not in kinds:
            raise self.error(f"{' or '.join(kinds)} expected")
        self.i += 1
        return self.unquoted(text) if kind == "string" else text

    def unquoted(self, raw: str) -> str:
        def one(m: re.Match) -> str:
            if m[1]:
                return chr(int(m[1], 16))
            if m[2] not in _ESCAPES:
                raise self.error(f"escape \\{m[2]}")
            return _ESCAPES[m[2]]

        return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", one, raw[1:-1], flags=re.S) if "\\" in raw else raw[1:-1]

    def root(self) -> Any:
        after = self.tokens[self.i + 1][1:2] if len(self.tokens) > self.i + 1 else ("",)
        head = {"message": self.message, "table": self.table, "delta": self.delta, "schema": self.schema}.get(self.tokens[self.i][1] if self.tokens[self.i][0] == "name" else "")
        named = head is not None and (after[0] == "{" or self.tokens[self.i + 1][0] == "name")
        out = head() if named else self.value(0)
        if self.tokens[self.i][0] != "end":
            raise self.error("end expected")
        return out

    def several(self, close: str) -> Iterator[None]:
        """Items up to close, with commas between them and perhaps after the last."""
        tokens = self.tokens
        while tokens[self.i][:2] != ("mark", close):
            yield
            if tokens[self.i][:2] != ("mark", ","):
                self.need(close)
                return
            self.i += 1
        self.i += 1

    def value(self, depth: int) -> Any:
        if depth > DEPTH:
            raise self.error("too deep")
        kind, text, _ = self.tokens[self.i]
        if kind == "string":
            self.i += 1
            return self.unquoted(text)
        if kind == "number":
            self.i += 1
            return self.number(text)
        if kind == "mark" and text == "{":
            self.i += 1
            out: dict[str, Any] = {}
            for _ in self.several("}"):
                key = self.of("name", "string")
                if key in out:
                    raise self.error(f"key {key} twice")
                self.need(":")
                out[key] = self.value(depth + 1)
            return out
        if kind == "mark" and text == "[":
            self.i += 1
            return [self.value(depth + 1) for _ in self.several("]")]
        if kind == "name":
            self.i += 1
            if text in ELEMENTS and self.take("["):
                return Tagged("typed_array", (text, [self.checked(text, self.value(depth + 1)) for _ in self.several("]")]))
            if self.take("("):
                return self.literal(text, [self.value(depth + 1) for _ in self.several(")")])
            return {"null": None, "true": True, "false": False}.get(text, text)
        raise self.error("value expected")

    def checked(self, kind: str, v: Any) -> Any:
        try:
            return element(kind, v)
        except StateError as e:
            raise self.error(e.message) from None

    def number(self, text: str) -> Any:
        try:
            if set(text) & set(".eE"):
                return float(text)
            n = int(text)
        except ValueError:
            raise self.error(f"number {text}") from None
        if not -(1 << 63) <= n < 1 << 64:
            raise self.error(f"number {text} out of range")
        return n if n < 1 << 63 else Tagged("unsigned", n)

    def literal(self, name: str, args: list[Any]) -> Any:
        one = args[0] if args else None
        try:
            if name in ("timestamp", "date", "duration", "url", "email", "ref") and len(args) == 1 and isinstance(one, str):
                return Tagged(name, one)
            if name == "uuid" and len(args) == 1:
                return Tagged(name, str(UUID(one)))
            if name == "bytes" and len(args) == 1:
                return Tagged(name, base64.b64decode(one, validate=True))
            if name == "enum" and len(args) == 1 and isinstance(one, str):
                return Tagged(name, one)
            if name == "decimal" and len(args) == 2 and isinstance(args[1], int):
                return Tagged(name, (self.scaled(one, args[1]), args[1]))
            if name == "money" and len(args) == 3 and isinstance(one, str):
                return Tagged(name, (one, self.scaled(args[1], args[2]), args[2]))
        except (ValueError, TypeError, AttributeError):
            pass
        raise self.error(f"bad {name}")

    def scaled(self, v: Any, scale: int) -> int:
        """The value times ten to the scale; digits beyond are cut towards zero."""
        text = v if isinstance(v, str) else f"{v:.17f}".rstrip("0") if isinstance(v, float) else str(v)
        m = re.fullmatch(r"([+-]?)([0-9]*)(?:\.([0-9]*))?", text)
        if not m or not (m[2] or m[3]) or not 0 <= scale <= 1000:
            raise self.error(f"decimal {text}")
        n = int((m[2] or "0") + ((m[3] or "") + "0" * scale)[:scale])
        return -n if m[1] == "-" else n

    def heading(self) -> str | None:
        self.i += 1
        return self.of("name") if self.tokens[self.i][0] == "name" else None

    def message(self) -> Tagged:
        name = self.heading()
        fields = self.value(0) if self.peek("{") else self.need("{")
        return Tagged("message", {"type": name, "fields": fields})

    def table(self) -> Tagged:
        name, columns = self.heading(), {}
        self.need("{")
        for _ in self.several("}"):
            key = self.of("name", "string")
            self.need(":")
            column = self.value(1)
            if key in columns or not (isinstance(column, list) or isinstance(column, Tagged) and column.kind == "typed_array"):
                raise self.error(f"column {key}")
            columns[key] = column
        return Tagged("table", columns)

    def delta(self) -> Tagged:
        self.i += 1
        source, ops = None, []
        if self.take("from"):
            self.need("hash")
            self.need("(")
            source = self.of("string")
            self.need(")")
        self.need("{")
        while not self.take("}"):
            word = self.of("name")
            if (form := _OPERATIONS.get(word)) is None:
                raise self.error(f"operation {word}")
            path, value, origin, index = self.of("path"), None, None, None
            if form == "value":
                self.take("=")
            elif form == "by":
                if not self.take("by"):
                    self.need("=")
            elif form == "at":
                self.need("at")
                index = int(self.of("number"))
                self.take("=")
            elif form == "from":
                self.need("from")
                origin = self.of("path")
            if form in ("value", "by", "at"):
                value = self.value(1)
            ops.append(Op(_SHORT.get(word, word), path, value, origin, index, form in ("value", "by", "at")))
            self.take(",")
        return Tagged("delta", (source, ops))

    def schema(self) -> dict:
        """A schema block as an object: name, version and fields."""
        self.i += 1
        name, version, fields = self.of("name"), 1, []
        if self.tokens[self.i][0] == "name" and (m := re.fullmatch(r"v([0-9]+)", self.tokens[self.i][1])):
            version, self.i = int(m[1]), self.i + 1
        self.need("{")
        while not self.take("}"):
            number = int(self.of("field")[1:])
            field = {"id": number, "name": self.of("name"), "optional": self.take("?")}
            self.need(":")
            field["type"] = self.of("name")
            if self.take("="):
                field["default"] = self.value(1)
            fields.append(field)
            self.take(",")
        return {"name": name, "version": version, "fields": fields}


def parse(text: str) -> Any:
    return Reader(text).root()


def quoted(s: str) -> str:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = s.replace(raw, out)
    return f'"{s}"'


def _number(x: float) -> str:
    if not math.isfinite(x):
        return "null"
    text = repr(x)
    return text if set(text) & set(".e") else text + ".0"


def _key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", k) else quoted(k)


def _fixed(scaled: int, scale: int) -> str:
    digits = str(abs(scaled)).rjust(scale + 1, "0")
    return ("-" if scaled < 0 else "") + (digits[:-scale] + "." + digits[-scale:] if scale else digits)


def write_value(v: Any, indent: int = 0) -> str:
    """Canonical text: keys sorted, two blanks a level; what is written reads as the same value."""
    pad, close = "  " * (indent + 1), "  " * indent
    block = lambda head, lines: f"{head}{{\n" + "".join(f"{pad}{x},\n" for x in lines) + close + "}" if lines else head + "{}"
    inner = lambda d: [f"{_key(k)}: {write_value(d[k], indent + 1)}" for k in sorted(d)]
    if not isinstance(v, Tagged):
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        if isinstance(v, float):
            return _number(v)
        if isinstance(v, (int, str)):
            return quoted(v) if isinstance(v, str) else str(v)
        if isinstance(v, list):
            return "[" + ", ".join(write_value(x, indent + 1) for x in v) + "]"
        return block("", inner(v))
    x = v.value
    if v.kind == "unsigned":
        return str(x)
    if v.kind == "bytes":
        return f'bytes("{base64.b64encode(x).decode()}")'
    if v.kind in ("uuid", "timestamp", "date", "duration", "url", "email", "ref", "enum"):
        return f"{v.kind}({quoted(x)})"
    if v.kind == "decimal":
        return f'decimal("{_fixed(*x)}", {x[1]})'
    if v.kind == "money":
        return f'money({quoted(x[0])}, "{_fixed(*x[1:])}", {x[2]})'
    if v.kind == "typed_array":
        return f"{x[0]}[" + ", ".join(write_value(e) for e in x[1]) + "]"
    if v.kind == "message":
        return block("message " + (x["type"] + " " if x.get("type") else ""), inner(x.get("fields") or {}))
    if v.kind == "table":
        return block("table ", inner(x))
    if v.kind == "delta":
        lines = []
        for o in x[1]:
            rest = {"value": lambda o=o: f" = {write_value(o.value, indent + 1)}", "by": lambda o=o: f" by {write_value(o.value)}", "at": lambda o=o: f" at {o.index} = {write_value(o.value, indent + 1)}", "from": lambda o=o: f" from {o.source}", "": str}[_OPERATIONS[o.kind]]()
            lines.append(f"{o.kind} {o.path}{rest}")
        return block("delta " + (f"from hash({quoted(x[0])}) " if x[0] else ""), lines)
    # kinds without a text form of their own: as tagged objects
    import json

    return write_value(json.loads(dumps(v)), indent)


def mapped(df: DataFrame, key: str, column: str, f) -> DataFrame:
    """key, value, error_code, error_path: f of each text of a column, or the error that it raises."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for x in batch.column(1).to_pylist():
                try:
                    rows.append((None if x is None else f(x), None, None))
                except StateError as e:
                    rows.append((None, e.code, e.path))
            values, codes, places = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), pa.array(codes, pa.int32()), pa.array(places, pa.string())], [key, "value", "error_code", "error_path"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, value string, error_code int, error_path string")


def read(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, value (tagged JSON), error_code, error_path of a column of texts."""
    return mapped(df, key, column, lambda x: dumps(parse(x)))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, value (tagged JSON), error_code, error_path of the text files under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))
    return read(files, "path", "content")


def write(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, value (text), error_code, error_path of a column of tagged JSON."""
    return mapped(df, key, column, lambda x: write_value(loads(x)))
