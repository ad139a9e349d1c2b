"""python -m tessera COMMAND: validate, fmt, convert, inspect, hash, diff, patch on single files, schema check, and benchmark of them all."""

from __future__ import annotations

import argparse
import json
import sys
import time

from .functions.canonical import value_hash
from .functions.model import StateError, Tagged, kind_of
from .operators.delta import apply, diff
from .operators.schema import parse_schema
from .sources import container
from .sources.jsonio import dumps
from .sources.text import parse, write_value


def load(path: str):
    data = sys.stdin.buffer.read() if path == "-" else open(path, "rb").read()
    return container.decode(data) if path.endswith(".sxb") or data[:3] == container.MAGIC else parse(data.decode())


def save(value, to: str, path: str | None) -> None:
    data = {"text": lambda: (write_value(value) + "\n").encode(), "json": lambda: (dumps(value) + "\n").encode(), "binary": lambda: container.encode(value)}[to]()
    if path:
        with open(path, "wb") as f:
            f.write(data)
    else:
        sys.stdout.buffer.write(data)


def inspect(value) -> str:
    kind = kind_of(value)
    if kind == "table":
        columns = [c.value[1] if isinstance(c, Tagged) else c for c in value.value.values()]
        return f"table {len(columns[0]) if columns else 0} x {len(columns)}"
    inner = value.value.get("fields") if kind == "message" else value
    return f"{kind} {len(inner)}" if isinstance(inner, (dict, list)) else kind


def benchmark(seconds: float) -> dict[str, float]:
    """Operations a second of one process, each for about so many seconds, on a small record and on a batch of 1,000 rows."""
    small = {"id": Tagged("uuid", "6f9619ff-8b86-d011-b42d-00c04fc964ff"), "name": "Ada", "active": True, "score": [1, 2, 3]}
    batch = [{"tenant": "acme", "type": "click" if i % 3 == 0 else "view", "timestamp": 1_700_000_000_000 + i, "user_id": f"u-{i * 7919 % 100_003}", "active": i % 2 == 0} for i in range(1000)]
    table = Tagged("table", {"id": list(range(10_000)), "temp": [20 + i * 7919 % 10_007 / 1000.7 for i in range(10_000)]})
    text, packed, events, scanned = write_value(small), container.encode(small), container.encode(batch), container.encode(table)
    change = diff(small, small | {"name": "Bob", "active": False})
    runs = {
        "text_parse_small": lambda: parse(text), "binary_encode_small": lambda: container.encode(small), "binary_decode_small": lambda: container.decode(packed),
        "binary_encode_batch_1k": lambda: container.encode(batch), "binary_decode_batch_1k": lambda: container.decode(events), "hot_field_1k": lambda: container.field_values(events, "type"),
        "table_scan_10k": lambda: container.count_greater(scanned, "temp", 25), "logical_hash_small": lambda: value_hash(small), "delta_apply_small": lambda: apply(small, change),
    }
    out = {}
    for name, run in runs.items():
        n, began = 0, time.perf_counter()
        while (took := time.perf_counter() - began) < seconds or not n:
            run()
            n += 1
        out[name] = round(n / max(took, 1e-9), 3)
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "fmt", "inspect", "hash"):
        sub.add_parser(name).add_argument("file")
    c = sub.add_parser("convert")
    c.add_argument("file")
    c.add_argument("--to", choices=("text", "json", "binary"), required=True)
    c.add_argument("-o", "--output")
    for name in ("diff", "patch"):
        c = sub.add_parser(name)
        c.add_argument("base")
        c.add_argument("other")
        c.add_argument("-o", "--output")
    c = sub.add_parser("schema")
    c.add_argument("action", choices=("check",))
    c.add_argument("file")
    c = sub.add_parser("benchmark")
    c.add_argument("--seconds", type=float, default=0.5)
    a = p.parse_args(args)
    try:
        if a.command == "validate":
            load(a.file)
            print("ok")
        elif a.command == "fmt":
            save(load(a.file), "text", None)
        elif a.command == "inspect":
            print(inspect(load(a.file)))
        elif a.command == "hash":
            print(value_hash(load(a.file)))
        elif a.command == "convert":
            save(load(a.file), a.to, a.output)
        elif a.command == "benchmark":
            print(json.dumps(benchmark(a.seconds)))
        elif a.command == "diff":
            save(Tagged("delta", (None, diff(load(a.base), load(a.other)))), "text", a.output)
        elif a.command == "patch":
            told = load(a.other)
            form = "text" if not a.output else {"sxb": "binary", "json": "json"}.get(a.output.rpartition(".")[2], "text")
            save(apply(load(a.base), told.value[1], told.value[0]), form, a.output)
        else:
            with open(a.file, encoding="utf-8") as f:
                schema = parse_schema(f.read())
            print(f"{schema.name} v{schema.version} {len(schema.fields)} fields {schema.hash()}")
    except (StateError, OSError, UnicodeDecodeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
