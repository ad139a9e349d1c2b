"""Work whose memory must not grow with the input, and the results it must keep."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import encoding as E
from tessera.functions.model import StateError
from tessera.operators import delta as D
from tessera.operators import table as V
from tessera.plans import queries as Q
from tessera.sources import container, text


def test_batches_number_the_rows_of_skewed_and_null_groups(spark):
    """Against a plain row number: ids far apart, negative, null; a null group; equal ids."""
    rows = [(i % 3 or None, i * i * (-1) ** i, str(i)) for i in range(900)] + [(1, None, "n"), (1, 10**17, "far"), (2, 4, "y"), (2, 4, "x")]
    df = spark.createDataFrame(rows, "g long, id long, t string")
    got = V.batches(df, "g", ["id", "t"], 70).collect()
    assert all(1 <= len(r["rows"]) <= 70 for r in got)
    told = sorted((r["g"] or 0, r["first"] + i, x["t"]) for r in got for i, x in enumerate(r["rows"]))
    wanted = []
    for g in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        wanted += [(g or 0, i, r[2]) for i, r in enumerate(own)]
    assert told == sorted(wanted)


def test_batches_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(V, "_RANGE", 100)
    df = spark.range(5000).select((F.col("id") % 4).alias("g"), "id")
    got = V.batches(df, "g", ["id"]).collect()
    assert max(len(r["rows"]) for r in got) <= 26  # 100 ids of four groups, and not 256
    assert sorted((r["g"], r["first"] + i, x["id"]) for r in got for i, x in enumerate(r["rows"])) == sorted((i % 4, i // 4, i) for i in range(5000))


def test_event_containers_have_hundreds_of_rows(spark):
    """2,500 events of a key are no single container; a null event type keeps its row and number."""
    sf = "/root/testdata/sf0.01"
    sizes = [len(container.decode(bytes(r["b"]))) for r in Q._batches(spark, sf).collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 256


def test_hot_values_keep_the_rows_of_null_types(spark, tmp_path):
    spark.createDataFrame([(i, 4, "a" if i % 2 else None, float(i)) for i in range(300)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["row_no"], r["value"]) for r in Q.QUERIES["container_hot_values"](spark, str(tmp_path)).collect())
    assert got == [(i, '"a"' if i % 2 else None) for i in range(300)]


def test_values_of_containers_are_handed_on_in_pieces(spark, monkeypatch):
    """Of forty containers of a thousand values in one Arrow batch, never more than a few are held."""
    caught = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: caught.update(f=f) or self)
    container.hot_values(spark.range(1).select("id", F.lit(b"").alias("b")), "id", "b", "x")
    packed = container.encode([{"x": i} for i in range(1000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([packed] * 40, pa.binary())], ["id", "b"])
    held = [b.num_rows for b in caught["f"](iter([batch]))]
    assert sum(held) == 40_000 and max(held) < 10_000


def test_varints_of_four_bytes_and_more(spark):
    """Beyond the three bytes of the query's SQL: as the container writes them."""
    wide = [2097151, 2097152, 4194304, 5999999, 268435455, 268435456, (1 << 63) - 1]
    got = spark.createDataFrame([(x,) for x in wide], "x long").select("x", E.varint(F.col("x")).alias("v")).select("x", "v", E.unvarint(F.col("v")).alias("back")).collect()
    assert [(r["v"], r["back"]) for r in got] == [(container.put_varint(x).hex(), x) for x in wide]


def test_containers_are_taken_out_of_arrow_in_pieces(spark, monkeypatch):
    """A batch of 20 containers of 400 KB is no single list of values; the outcome is the same."""
    caught = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: caught.update(f=f) or self)
    container.read(spark.range(1).select("id", F.lit(b"").alias("b")), "id", "b")
    packed = container.encode([{"x": i} for i in range(50_000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array([packed] * 19 + [b"bad"], pa.binary())], ["id", "b"])
    out = list(caught["f"](iter([batch])))
    assert max(b.num_rows for b in out) < 20 and [i for b in out for i in b.column(0).to_pylist()] == list(range(20))
    assert [c for b in out for c in b.column(2).to_pylist()] == [None] * 19 + [1001]


@pytest.mark.parametrize("name", ["text_typed", "text_message", "json_tags", "container_round_trip", "apply_move_copy", "apply_nested_delta", "apply_delta_errors", "accessors"])
def test_rows_of_one_file_are_worked_on_by_all_tasks(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)


def test_there_and_back_is_one_pass(spark, sf):
    """And not four, each with a Python worker in every task; the outcome is that of four, and the first error is told."""
    plan = Q.QUERIES["json_tags"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("MapInArrow") == 1
    docs = ['{"a":[1,2.5,null],"b":{"$type":"bytes","$value":"Tw=="}}', '{"u":18446744073709551615}', None, "{", '{"$type":"bytes","$value":"?"}', '" é\\n"']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, j string")
    packed = container.write(df, "id", "j")
    steps = text.read(text.write(container.read(packed.select("id", "value"), "id", "value").select("id", "value"), "id", "value").select("id", "value"), "id", "value").select("id", "value")
    got = container.there_and_back(df, "id", "j").collect()
    assert sorted((r["id"], r["value"]) for r in got) == sorted((r["id"], r["value"]) for r in steps.collect())
    assert {r["id"]: r["error_code"] for r in got if r["error_code"]} == {3: 1301, 4: 1301}


@pytest.mark.parametrize("text_, place", [("  { a: 1 /* x", "1:10"), ("{ a: ! }", "1:6"), ("{ a:\n   ! }", "2:4"), (" /* c */ { a: 1 } // d \n ", None), (" \n ", "2:2"), ("{ a: 1 }  x ", "1:11")])
def test_places_of_errors_after_blanks(text_, place):
    if place is None:
        assert text.parse(text_) == {"a": 1}
        return
    with pytest.raises(StateError) as e:
        text.parse(text_)
    assert e.value.name == "parse_error" and e.value.path == place


def test_changes_of_tables_are_made_once(spark, sf):
    plan = Q.QUERIES["apply_tables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Generate posexplode") == 1


def test_changes_of_tables_against_a_plain_fold(spark):
    """Row and column changes of all kinds mixed; null keys, keys without a base row, columns that the schema lacks."""
    import json
    import random

    rnd = random.Random(5)
    base = {k: {"n": k or 0, "s": f"b{k}"} for k in (None, *range(1, 40))}
    ops = []
    for k in (None, *range(1, 60)):
        for seq in rnd.sample(range(30), rnd.randrange(7)):
            kind = rnd.choice(["set", "remove", "increment", "decrement", "replace", "clear"])
            c = rnd.choice([None, "n", "s", "gone"]) if kind in ("set", "remove", "replace") else rnd.choice(["n", "gone"]) if kind != "clear" else "s"
            value = json.dumps({"n": seq, "s": "r"}) if c is None and kind != "remove" else None if kind in ("remove", "clear") else str(rnd.randrange(9))
            ops.append((k, seq, kind, f"/{k}" + (f"/{c}" if c else ""), value))
    wanted = []
    for k in (None, *range(1, 60)):
        row = dict(base[k]) if k in base else None
        for _, _, kind, path, value in sorted((o for o in ops if o[0] == k), key=lambda o: o[1]):
            c = path.split("/")[2] if path.count("/") > 1 else None
            if c is None:
                row = None if kind == "remove" else json.loads(value)
            elif row is not None and c != "gone":
                by = {"increment": 1, "decrement": -1}.get(kind)
                row[c] = (None if row[c] is None else row[c] + by * int(value)) if by else value if value is None or c == "s" else int(value)
        if row is not None:
            wanted.append((k or 0, row["n"], row["s"]))
    got = D.apply_tables(spark.createDataFrame([(k, r["n"], r["s"]) for k, r in base.items()], "k long, n long, s string"), spark.createDataFrame(ops, "k long, seq long, kind string, path string, value string"), "k")
    assert sorted((r["k"] or 0, r["n"] if r["n"] is not None else -99, r["s"] or "") for r in got.collect()) == sorted((k, n if n is not None else -99, s or "") for k, n, s in wanted)
