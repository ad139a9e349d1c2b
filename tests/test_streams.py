import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import registry
from tessera.functions.model import StateError
from tessera.operators import frames as R
from tessera.operators import schema as S
from tessera.operators import table as V
from tessera.sources import container, framestream
from tessera.streaming.reassembly import reassemble_stream


def test_stream_reassembly(spark, tmp_path):
    own = R.split(spark.createDataFrame([("a", "hello world"), ("b", "x" * 30), ("c", "short")], "id string, text string"), "id", "text", 6)
    bad = own.where("message_id = 'b' and chunk_index = 0")
    for k, part in enumerate((own.where("chunk_index % 2 = 0"), own.where("chunk_index % 2 = 1").union(bad))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = reassemble_stream(stream).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "cp")).start()
    end, got = time.time() + 90, set()
    try:
        while time.time() < end and len(got) < 3:  # timeouts keep batches coming, so there is no last one to wait for
            time.sleep(1)
            got = {(r["message_id"], r["payload"], r["error_code"]) for r in spark.table("whole").collect()}
    finally:
        q.stop()
    assert {("a", "hello world", None), ("c", "short", None)} <= got and ("b", None, 1302) in got


def test_frame_files(spark, tmp_path):
    framestream.register(spark)
    own = R.split(spark.createDataFrame([("a", bytearray(b"hello world")), ("b", bytearray(b""))], "id string, data binary"), "id", "data", 6)
    own.select("kind", "message_id", *[F.col(c).cast("long") for c in ("chunk_index", "chunk_count", "segment_id", "offset", "length", "checksum")], "payload").write.format("frames").mode("append").save(str(tmp_path / "f"))
    back = spark.read.format("frames").load(str(tmp_path / "f"))
    assert back.where("message_id = 'a'").count() == 2
    got = {r["message_id"]: bytes(r["payload"]) for r in R.reassemble(back).collect()}
    assert got == {"a": b"hello world", "b": b""}


def _frame(i, size=5):
    data = bytes([65 + i % 26]) * size
    return ("chunk", f"m{i}", 0, 1, 0, 0, size, container.checksum(data), bytearray(data))


def test_frame_files_are_overwritten_bounded_and_cleaned(spark, tmp_path):
    framestream.register(spark)
    path = tmp_path / "f"
    df = spark.createDataFrame([_frame(i) for i in range(40)], framestream.SCHEMA).repartition(2)
    for mode, n in (("overwrite", 40), ("overwrite", 40), ("append", 80), ("overwrite", 40)):
        df.write.format("frames").option("most", 25).mode(mode).save(str(path))
        assert spark.read.format("frames").load(str(path)).count() == n
    names = [f.name for f in path.iterdir()]
    assert all(n.startswith("part-") for n in names) and len(names) >= 8  # at most five frames a file, nothing left in staging
    assert spark.read.format("frames").load(path.as_uri()).count() == 40
    with pytest.raises(Exception, match="type_mismatch"):
        df.withColumn("kind", F.when(F.col("message_id") == "m7", F.lit("nonsense")).otherwise(F.col("kind"))).write.format("frames").mode("overwrite").save(str(path))
    assert sorted(f.name for f in path.iterdir()) == sorted(names)  # a failed job leaves what was there
    assert spark.read.format("frames").load(str(tmp_path / "none")).count() == 0


def test_frame_writer_tries_again(tmp_path):
    """The files of an attempt that is not committed are not published; an aborted job leaves nothing."""
    from pyspark.sql import Row

    names = [x.split()[0] for x in framestream.SCHEMA.split(", ")]
    rows = [Row(**dict(zip(names, _frame(i), strict=True))) for i in range(3)]
    w = framestream._Writer(str(tmp_path / "f"))
    w.write(iter(rows))
    again = w.write(iter(rows))
    w.commit([again, None])
    assert len(list((tmp_path / "f").iterdir())) == 1
    w = framestream._Writer(str(tmp_path / "f"), True)
    w.abort([w.write(iter(rows))])
    assert len(list((tmp_path / "f").iterdir())) == 1


def test_frame_streams(spark, tmp_path):
    framestream.register(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write = lambda lo: spark.createDataFrame([_frame(i) for i in range(lo, lo + 3)], framestream.SCHEMA).coalesce(1).write.format("frames").mode("append").save(a)
    write(0)
    for n in (3, 6):
        q = spark.readStream.format("frames").load(a).writeStream.format("frames").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(b)
        q.awaitTermination(120)
        assert sorted(r["message_id"] for r in spark.read.format("frames").load(b).collect()) == [f"m{i}" for i in range(n)]
        write(n)


def test_incomplete_and_zero_counts(spark):
    rows = [("chunk", "a", 0, 2, "x"), ("chunk", "z", 0, 0, "x"), ("message", "m", 0, 1, "x"), ("chunk", None, 0, 1, "x")]
    got = {r["message_id"]: r["error_code"] for r in R.reassemble(spark.createDataFrame(rows, "kind string, message_id string, chunk_index int, chunk_count int, payload string")).collect()}
    assert got == {"a": 1305, "z": 1305, None: 1302}


def test_schema_language_and_errors():
    s = S.parse_schema("schema U v1 {\n  #1 id: uuid @hot\n  #2 tags?: string[]\n  #3 n: typed<u8>\n  #4 e: enum[a, b] = a\n}")
    assert [f.type for f in s.fields] == ["uuid", "string[]", "typed<u8>", "enum[a,b]"] and s.fields[0].hints == ("hot",) and s.fields[3].default == "a"
    assert s.hash() == S.Schema("U", 1, s.fields[::-1]).hash()
    for bad in ("", "schema X v1 {\n}", "schema X v1 {\n nonsense\n}", "schema X v1 {\n #1 a: u8\n #1 b: u8\n}"):
        with pytest.raises(StateError):
            S.parse_schema(bad)
    assert S.parse_schema("schema X vx {\n #1 a: u8\n}").version == 1


def test_canonical_text_is_that_of_the_value_in_any_zone(spark):
    from datetime import datetime, timezone

    from tessera.functions import canonical as C
    from tessera.functions.canonical import utc_nanos

    times = ["2024-03-10T07:30:00.000001Z", "2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "1969-12-31T23:59:59.999999Z", "1883-11-18T12:00:00Z", "0001-01-01T00:00:00Z"]
    df = spark.createDataFrame([(i, datetime.fromisoformat(t).replace(tzinfo=timezone.utc)) for i, t in enumerate(times)], "i int, t timestamp")
    want = {i: "ts:" + utc_nanos(t) for i, t in enumerate(times)}
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert {r["i"]: r["c"] for r in df.select("i", C.canonical(F.col("t"), df.schema["t"].dataType).alias("c")).collect()} == want
            plain = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.5' AS t, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS u")
            assert [plain.select(C.canonical(F.col(c), plain.schema[c].dataType)).first()[0] for c in "tu"] == ["ts:2024-03-10T02:30:00.500000000Z", "ts:2024-01-01T00:00:00.000000000Z"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_canonical_text_of_decimals_and_variants(spark):
    from decimal import Decimal

    from pyspark.sql import types as T

    from tessera.functions import canonical as C

    for scale, x, want in ((20, "1.5", "15@1"), (20, "-0.00000000000000000001", "-1@20"), (38, "0." + "9" * 38, "9" * 38 + "@38"), (0, "-120", "-120@0"), (2, "0", "0@0"), (3, "1234567890.100", "12345678901@1"), (18, "-12345678901234567890.000000000000000001", "-12345678901234567890000000000000000001@18")):
        df = spark.createDataFrame([(Decimal(x),), (None,)], T.StructType().add("d", T.DecimalType(38, scale)))
        assert [r[0] for r in df.select(C.canonical(F.col("d"), T.DecimalType(38, scale))).collect()] == ["d:" + want, "null"]
    df = spark.sql("""SELECT parse_json('{"b": [1, 2.5, null, "x:y"], "a": {"$type": "decimal", "$value": {"scaled": "150", "scale": 2}}}') AS v UNION ALL SELECT NULL""")
    assert [r[0] for r in df.select(C.canonical(F.col("v"), T.VariantType())).collect()] == ["{a:d:15@1,b:[i:1,f:2.5,null,s:x\\:y]}", "null"]
    df = spark.sql("SELECT CAST(NULL AS STRUCT<a: INT>) AS s UNION ALL SELECT named_struct('a', CAST(NULL AS INT))")
    assert len({r[0] for r in df.select(C.logical_hash(df)).collect()}) == 2


def test_changes_of_tables_lead_to_the_target(spark):
    from tessera.operators import delta as D

    base = spark.createDataFrame([("a/b", 1, "x", 1.5, True), ("c~", 2, None, None, False), (None, None, "n", float("nan"), None), ("gone", 9, "y", 0.0, True)], "k string, n long, `s/t` string, f double, old boolean")
    target = spark.sql("""SELECT * FROM VALUES ('a/b', CAST(NULL AS BIGINT), 'x', CAST(1.5 AS DOUBLE), X'00FF', array(1, NULL), TIMESTAMP'2024-01-02 03:04:05.678901'),
        ('c~', 7, 'new', CAST('-Infinity' AS DOUBLE), CAST(NULL AS BINARY), CAST(NULL AS ARRAY<INT>), CAST(NULL AS TIMESTAMP)), (NULL, 5, NULL, CAST('NaN' AS DOUBLE), X'', array(), TIMESTAMP'1960-01-01 00:00:00'),
        ('born', CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST('NaN' AS DOUBLE), X'61', array(2), TIMESTAMP'2024-01-02 03:04:05.678901') AS t(k, n, `s/t`, f, b, l, at)""")
    ops = D.diff_tables(base, target, "k")
    got = D.apply_tables(base, ops, "k", target.schema)
    assert got.schema.simpleString() == target.schema.simpleString() and sorted(map(repr, got.collect())) == sorted(map(repr, target.collect()))
    kinds = {(r["k"], r["path"]): (r["kind"], r["value"]) for r in ops.collect()}
    assert kinds["a/b", "/a~1b/old"] == ("remove", None) and kinds["c~", "/c~0/n"] == ("increment", "5") and kinds["c~", "/c~0/s~1t"] == ("replace", "new")
    assert D.diff_tables(target, target, "k").count() == 0
    # any number and order of changes of one key
    many = [("a/b", 0, "increment", "/a~1b/n", "4"), ("a/b", 1, "set", "/a~1b", '{"n":10,"s/t":null,"f":2.0,"old":null}'), ("a/b", 2, "increment", "/a~1b/n", "5"), ("a/b", 3, "replace", "/a~1b/n", "100"), ("a/b", 4, "decrement", "/a~1b/n", "1"), ("c~", 0, "remove", "/c~0", None), ("gone", 0, "remove", "/gone", None), ("gone", 1, "set", "/gone", '{"n":3}'), ("x", 0, "set", "/x", '{"n":1}')]
    done = {r["k"]: (r["n"], r["s/t"], r["f"]) for r in D.apply_tables(base, spark.createDataFrame(many, "k string, seq long, kind string, path string, value string"), "k").collect()}
    assert done["a/b"] == (99, None, 2.0) and done["gone"] == (3, None, None) and done["x"] == (1, None, None) and "c~" not in done and len(done) == 4


def test_unknown_columns(spark):
    df = spark.range(3)
    with pytest.raises(StateError) as e:
        V.filter_numeric(df, "no", "gt", 1)
    assert e.value.code == 1203
    with pytest.raises(StateError) as e:
        V.scan_numeric_gt(df.select(F.col("id").cast("string").alias("s")), "s", 1)
    assert e.value.code == 1102
    assert V.filter_numeric(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"), "v", "gt", 0).count() == 1


def test_files_of_both_forms(spark, tmp_path):
    (tmp_path / "a.sxb").write_bytes(container.encode({"a": 1}))
    (tmp_path / "b.sx").write_text("{ a: 2 }")
    (tmp_path / "c.sx").write_text("{ a: ")
    got = {r["path"].rpartition("/")[2]: (r["value"], r["error_code"]) for r in container.load(spark, str(tmp_path)).collect()}
    assert got == {"a.sxb": ('{"a":1}', None), "b.sx": ('{"a":2}', None), "c.sx": (None, 1301)}


def test_sql_functions(spark):
    registry.register(spark)
    row = spark.sql("""SELECT state_parse_text('{ a: [1, 2] }') AS p, state_field('{"a":{"b":7}}', '/a/b') AS f, state_canonical('{"a":1}') AS c, state_parse_text('{') AS bad""").first()
    assert (row["p"], row["f"], row["c"], row["bad"]) == ('{"a":[1,2]}', "7", "{a:i:1}", None)


def test_long_texts_are_split_in_pieces(spark):
    """The same chunks for texts of any length, kind and validity; those of a long text do not cost its square."""
    long = "".join(chr(97 + k % 26) + ("é😀\n" if k % 7 == 0 else "") for k in range(300_000))
    texts = [long, "é😀\nx" * 200, "abcdefg" * R.MANY, "abcdefg" * R.MANY + "h", "", None, "ab"]
    got = R.split(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", 7).collect()
    for k, t in enumerate(texts):
        own = sorted((r["chunk_index"], r["payload"], r["offset"], r["chunk_count"]) for r in got if r["message_id"] == k)
        want = [] if t is None else [t[a : a + 7] for a in range(0, max(1, len(t)), 7)]
        assert own == [(i, x, 7 * i, len(want)) for i, x in enumerate(want)]
    odd = spark.createDataFrame([(1, b"\xff\xfe" + b"123456789" * 60)], "id long, b binary").selectExpr("id", "CAST(b AS string) AS t")
    parts = R.split(odd, "id", "t", 4).selectExpr("chunk_index", "CAST(payload AS binary) AS b").collect()
    assert b"".join(bytes(r["b"]) for r in sorted(parts)) == b"\xff\xfe" + b"123456789" * 60
