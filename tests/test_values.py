import hashlib
import json
import random
import struct

import pytest

from tessera.functions.canonical import utc_nanos, value_hash, value_text
from tessera.functions.model import Op, StateError, Tagged, at_path, same
from tessera.operators.delta import apply, diff
from tessera.sources import container, framestream
from tessera.sources.jsonio import dumps, loads
from tessera.sources.text import parse, write_value


def some(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 6)
    if kind < 6:
        return [None, rng.random() < 0.5, rng.randrange(-1000, 1000), rng.uniform(-100, 100), "".join(rng.choices("abc:,\\\"é\n ", k=rng.randrange(8))), Tagged("unsigned", (1 << 63) + rng.randrange(100))][kind]
    if kind == 6:
        return [some(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdefg") + str(i): some(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(60))
def test_forms_round_trip(seed):
    v = some(random.Random(seed))
    assert same(parse(write_value(v)), v) and same(container.decode(container.encode(v)), v) and same(loads(dumps(v)), v)
    assert value_text(parse(write_value(v))) == value_text(v)


@pytest.mark.parametrize("seed", range(60))
def test_apply_of_diff_is_target(seed):
    rng = random.Random(seed)
    a, b = some(rng), some(rng)
    if isinstance(a, dict) and isinstance(b, dict):
        b = a | b
    assert same(apply(a, diff(a, b)), b)
    told = parse(write_value(Tagged("delta", (None, diff(a, b)))))
    assert same(apply(a, told.value[1]), b)


def test_all_operations():
    doc = {"n": 10, "a": [1, 2], "x": 1, "from": 2, "obj": {"k": 1}, "s": "text"}
    ops = parse("delta { set /new 1 replace /s = \"t\" inc /n by 3 dec /n by 2 append /a 3 prepend /a 0 insert /a at 1 9 merge /obj { j: 2 } move /moved from /from copy /c from /n remove /x clear /obj }").value[1]
    assert apply(doc, ops) == {"n": 11, "a": [0, 9, 1, 2, 3], "moved": 2, "obj": {}, "s": "t", "new": 1, "c": 11}
    assert doc["n"] == 10
    assert apply({"users": {"42": {}}}, [Op("set", "/users/42/s", 1, valued=True)]) == {"users": {"42": {"s": 1}}}


@pytest.mark.parametrize("op, code", [(Op("set", "/a/b/c", 1, valued=True), 1203), (Op("append", "/n", 1, valued=True), 1102), (Op("insert", "/l", 1, index=9, valued=True), 1203), (Op("increment", "/s", 1, valued=True), 1102), (Op("set", "/n"), 1302), (Op("clear", "/n"), 1102), (Op("remove", "/l/7"), 1203)])
def test_delta_errors(op, code):
    with pytest.raises(StateError) as e:
        apply({"n": 1, "l": [1], "s": "x"}, [op])
    assert e.value.code == code


def test_hash_is_of_canonical_text():
    v = parse('{ b: 1, a: "x:y", t: timestamp("2024-01-02T03:04:05.5+01:00"), d: decimal("1.500", 3), m: money("INR", "49.99", 2), f: 24.05 }')
    text = "{a:s:x\\:y,b:i:1,d:d:15@1,f:f:24.050000000000001,m:money:INR:4999@2,t:ts:2024-01-02T02:04:05.500000000Z}"
    assert value_text(v) == text and value_hash(v) == hashlib.sha256(text.encode()).hexdigest()
    assert utc_nanos("2024-01-01T00:00:00.1234567899Z").endswith("00.123456789Z")
    with pytest.raises(StateError):
        utc_nanos("yesterday")


def test_text_grammar():
    assert parse("// c\n{ a: [1, 2.5, -3,], # d\n b: word, /* e */ c: u8[1, 255] }") == {"a": [1, 2.5, -3], "b": "word", "c": Tagged("typed_array", ("u8", [1, 255]))}
    assert parse("message OrderCreated { id: uuid(\"6F9619FF-8B86-D011-B42D-00C04FC964FF\") }").value["type"] == "OrderCreated"
    assert parse("schema User v2 { #1 id: uuid #2 name?: string = \"x\" }")["fields"][1] == {"id": 2, "name": "name", "optional": True, "type": "string", "default": "x"}
    assert parse('decimal("-0.129", 2)') == Tagged("decimal", (-12, 2))
    for bad in ("{ a: 1, a: 2 }", "[1", "{ a 1 }", "u8[300]", "1e", "/* x", '"\\q"', "[" * 300):
        with pytest.raises(StateError) as e:
            parse(bad)
        assert e.value.code == 1301


def test_columnar_containers():
    events = [{"tenant": "acme", "ts": i, "on": i % 2 == 0, "v": i / 3} for i in range(100)]
    data = container.encode(events)
    assert container.decode(data) == events and container.field_values(data, "ts") == list(range(100)) and container.field_values(data, "no") == []
    assert container.decode(container.encode(events[:63])) == events[:63]
    table = Tagged("table", {"temp": [20 + 0.1 * i for i in range(128)], "ok": [True] * 128})
    assert container.count_greater(container.encode(table), "temp", 25) == sum(20 + 0.1 * i > 25 for i in range(128))
    for name, code in (("ok", 1102), ("none", 1203)):
        with pytest.raises(StateError) as e:
            container.count_greater(container.encode(table), name, 1)
        assert e.value.code == code


def test_malformed_containers_only_raise_state_errors():
    data = container.encode({"a": [1, "x", 2.5], "b": None})
    rng = random.Random(1234)
    for _ in range(64):
        with pytest.raises(StateError):
            container.decode(data[: rng.randrange(len(data))])
    for at, code in ((0, 1001), (3, 1002), (5, 1003), (len(data) - 1, 1005)):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(StateError) as e:
            container.decode(bytes(bad))
        assert e.value.code == code
    bad = bytearray(data)
    bad[15:19] = struct.pack("<I", 1 << 30)
    with pytest.raises(StateError) as e:
        container.decode(bytes(bad))
    assert e.value.code == 1004


def _patched(data, kind, at, byte):
    """One byte of a segment changed, its checksum made right."""
    out = bytearray(data)
    for k in range(struct.unpack("<H", out[9:11])[0]):
        head = 11 + 16 * k
        _, number, _, place, size, _ = struct.unpack("<HBBIII", out[head : head + 16])
        if container.SEGMENTS[number - 1] == kind:
            out[place + at] = byte
            out[head + 12 : head + 16] = struct.pack("<I", container.checksum(bytes(out[place : place + size])))
    return bytes(out)


@pytest.mark.parametrize("kind, at, byte, code", [("shape_table", 2, 0xFF, 1106), ("shape_table", 0, 9, 1106), ("dictionary", 0, 0, 1105), ("dictionary", 2, 0xFF, 1105), ("value_data", 0, 0xFE, 1302)])
def test_segments_are_validated(kind, at, byte, code):
    with pytest.raises(StateError) as e:
        container.decode(_patched(container.encode({"x": 1}), kind, at, byte))
    assert e.value.code == code


def test_dictionary_references_and_wide_numbers():
    events = [{"t": "a" if i % 2 else "b"} for i in range(70)]
    data = container.encode(events)
    body = next(b for _, k, _, b in container.segments_of(data) if k == "column_data")
    with pytest.raises(StateError) as e:
        container.decode(_patched(data, "column_data", len(body) - 1, 9))
    assert e.value.code == 1105
    body = b"\x10" + b"\xff" * 10
    head = container.MAGIC + struct.pack("<BBIH", 1, 0, 27 + len(body), 1) + struct.pack("<HBBIII", 1, 5, 0, 27, len(body), container.checksum(body))
    with pytest.raises(StateError) as e:
        container.decode(head + body)
    assert e.value.code == 1304


def test_header_hashes():
    own = bytes.fromhex(value_hash({"a": 1}))
    data = container.encode({"a": 1}, b"s" * 32, own)
    assert container.hashes_of(data) == (b"s" * 32, own) and container.decode(data, True) == {"a": 1}
    other = container.encode({"a": 2}, None, own)
    assert container.decode(other) == {"a": 2} and container.hashes_of(other) == (None, own)
    with pytest.raises(StateError) as e:
        container.decode(other, True)
    assert e.value.code == 1302


def test_frames_pack_and_unpack():
    frames = [{"kind": "chunk", "message_id": "m", "chunk_index": i, "chunk_count": 2, "segment_id": 0, "offset": 6 * i, "payload": p} for i, p in enumerate((b"hello ", b"world"))] + [{"kind": "checkpoint", "payload": b""}]
    data = framestream.pack(frames)
    assert [f["payload"] for f in framestream.unpack(data + b"more")] == [b"hello ", b"world", b""]
    with pytest.raises(StateError) as e:
        list(framestream.unpack(data.replace(b"world", b"worle")))
    assert e.value.code == 1005


def test_paths():
    assert at_path({"a": [{"7": 1}]}, "/a/0/7") == (True, 1) and at_path([1], "/3") == (False, None) and at_path(5, "/") == (True, 5)


def test_command_line(tmp_path, capsys):
    from tessera.__main__ import main

    a, b, d = tmp_path / "a.sx", tmp_path / "b.sx", tmp_path / "d.sx"
    a.write_text("{ n: 1, l: [1] }")
    b.write_text("{ n: 4, l: [1, 2] }")
    assert main(["validate", str(a)]) == 0 and main(["diff", str(a), str(b), "-o", str(d)]) == 0 and main(["patch", str(a), str(d), "-o", str(tmp_path / "c.sxb")]) == 0
    capsys.readouterr()
    assert main(["hash", str(b)]) == 0 and main(["hash", str(tmp_path / "c.sxb")]) == 0
    x, y = capsys.readouterr().out.split()
    assert main(["benchmark", "--seconds", "0.01"]) == 0 and json.loads(capsys.readouterr().out)["table_scan_10k"] > 0
    assert x == y and main(["inspect", str(tmp_path / "none")]) == 1
