"""The registered queries of the library's operators on the driver's tables, each with its SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical as C
from ..functions import encoding as E
from ..operators import delta as D
from ..operators import frames as R
from ..operators import schema as S
from ..operators import table as V
from ..sources import container, framestream, jsonio, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table dealt out evenly, for work that costs far more than their shuffle.

    A file of a few MB, or with few row groups, is read by a task or two, however many rows it has and cores there are.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return load(spark, sf_dir, table).select(*columns).repartition(parts)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for files of a query, in the folder that the cluster shares; only where none is set (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        coded = [c for c in ("error_code", "label_error") if sql and f"AS {c}" in sql]  # 0 for none: integers without nulls
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.coalesce(c, F.lit(0)) for c in coded})) if coded else f
        if sql:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'CAST(coalesce({c}, 0) AS INTEGER) AS {c}' for c in coded)}) FROM ({sql})" if coded else sql
        return f

    return keep


# -- tables: scans, filters, projections ------------------------------------------------------------------------------


@add("scan_count_gt", "SELECT count(*) AS n FROM events WHERE value > 25 AND NOT isnan(value)")
def scan_count_gt(spark, d):
    return V.scan_numeric_gt(load(spark, d, "events"), "value", 25)


for _op, _sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    add(f"filter_num_{_op}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sign} 25")(lambda spark, d, op=_op: V.filter_numeric(load(spark, d, "lineitem"), "l_quantity", op, 25).select("l_orderkey", "l_linenumber", "l_quantity"))
add("filter_num_eq", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE abs(l_quantity - 25) <= 2.220446049250313e-16")(lambda spark, d: V.filter_numeric(load(spark, d, "lineitem"), "l_quantity", "eq", 25).select("l_orderkey", "l_linenumber", "l_quantity"))
add("filter_num_int", "SELECT p_partkey, p_size FROM part WHERE p_size > 25")(lambda spark, d: V.filter_numeric(load(spark, d, "part"), "p_size", "gt", 25).select("p_partkey", "p_size"))
add("filter_eq_str", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'P'")(lambda spark, d: V.filter_eq(load(spark, d, "orders"), "o_orderstatus", "P").select("o_orderkey", "o_orderstatus"))
add("filter_eq_kind", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber = 2 OR l_quantity = 25.0 AND false GROUP BY 1")(
    lambda spark, d: (lambda t: V.filter_eq(t, "l_linenumber", 2).unionByName(V.filter_eq(t, "l_quantity", 25)).groupBy("l_linenumber").agg(F.count("*").alias("n")))(load(spark, d, "lineitem"))
)
add("filter_eq_null", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 = 0")(
    lambda spark, d: V.filter_eq(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("flag of.row")), "flag of.row", None).select("l_orderkey", "l_linenumber")
)
add("filter_bool", "SELECT doc_id, quality = 1 AS good FROM labels WHERE quality = 1")(lambda spark, d: V.filter_bool(load(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "good", True))
add("select_columns", "SELECT event_id, event_type FROM events")(lambda spark, d: V.select_columns(load(spark, d, "events"), ["event_type", "event_id", "absent"]))
add("hot_field", "SELECT event_type FROM events")(lambda spark, d: V.hot_field(load(spark, d, "events"), "event_type"))
add("hot_field_missing", "SELECT count(*) AS n FROM events WHERE false")(lambda spark, d: V.hot_field(load(spark, d, "events"), "absent").agg(F.count("*").alias("n")))


@add("project_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def project_path(spark, d):
    return load(spark, d, "events").select("event_id", V.at_variant(F.try_parse_json("props"), "/k", "bigint").alias("k"))


@add("project_paths", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 1 AS n_found FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def project_paths(spark, d):
    found = load(spark, d, "events").select("event_id", V.project_variant(F.try_parse_json("props"), {"/k": "bigint", "/absent/0": "string"}).alias("m"))
    return found.select("event_id", F.try_element_at("m", F.lit("/k")).alias("k"), F.size("m").alias("n_found"))


@add("get_strict", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 1102 AS text_error, 1203 AS missing_error FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def get_strict(spark, d):
    v = F.try_parse_json("props")
    return load(spark, d, "events").select("event_id", V.get_strict(v, "/k", "bigint")["value"].alias("k"), V.get_strict(v, "/k", "string")["error_code"].alias("text_error"), V.get_strict(v, "/x", "bigint")["error_code"].alias("missing_error"))


@add("paths", "SELECT event_id, 'events' AS k0, CAST(event_id AS VARCHAR) AS k1, CAST(event_id AS INTEGER) AS i1 FROM events")
def paths(spark, d):
    from ..functions.model import path_column

    out = load(spark, d, "events").select("event_id", path_column(F.concat(F.lit("/events//"), F.col("event_id").cast("string"), F.lit("/"))).alias("p"))
    return out.select("event_id", F.get("p", F.lit(0))["key"].alias("k0"), F.get("p", F.lit(1))["key"].alias("k1"), F.get("p", F.lit(1))["idx"].alias("i1"))


_TABLES = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6}


@add("inspect_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, CAST({n} AS BIGINT) AS n_columns FROM {t}" for t, n in _TABLES.items()))
def inspect_tables(spark, d):
    from functools import reduce

    return reduce(DataFrame.union, [V.inspect(load(spark, d, t), t) for t in _TABLES])


# -- canonical text, hashes ---------------------------------------------------------------------------------------------

_ESC = "replace(replace(replace({c}, '\\', '\\\\'), ':', '\\:'), ',', '\\,')"
_FLOAT = "CASE WHEN {c} = 0 THEN '0' ELSE rtrim(rtrim(printf('%.15f', {c}), '0'), '.') END"
_NATION = "'{n_name:s:' || " + _ESC.format(c="n_name") + " || ',n_nationkey:i:' || n_nationkey || ',n_regionkey:i:' || n_regionkey || '}'"
_EVENT = "'{event_id:i:' || event_id || ',event_type:s:' || " + _ESC.format(c="event_type") + " || ',props:s:' || " + _ESC.format(c="props") + " || ',ts:ts:' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z,user_id:i:' || user_id || ',value:f:' || " + _FLOAT.format(c="value") + " || '}'"

add("canonical_nation", f"SELECT n_nationkey, {_NATION} AS canonical FROM nation")(lambda spark, d: (lambda t: t.select("n_nationkey", C.row_text(t).alias("canonical")))(load(spark, d, "nation")))
add("logical_hash_nation", f"SELECT n_nationkey, sha256({_NATION}) AS hash FROM nation")(lambda spark, d: (lambda t: t.select("n_nationkey", C.logical_hash(t).alias("hash")))(load(spark, d, "nation")))
add("logical_hash_events", f"SELECT event_id, sha256({_EVENT}) AS hash FROM events")(lambda spark, d: (lambda t: t.select("event_id", C.logical_hash(t).alias("hash")))(load(spark, d, "events")))
add("normalize_float", f"SELECT event_id, {_FLOAT.format(c='value')} AS t FROM events")(lambda spark, d: load(spark, d, "events").select("event_id", C.float_text(F.col("value")).alias("t")))
add("normalize_timestamp", "SELECT event_id, 'ts:' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS t FROM events")(lambda spark, d: (lambda t: t.select("event_id", C.canonical(F.col("ts"), t.schema["ts"].dataType).alias("t")))(load(spark, d, "events")))
_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
add("normalize_decimal", f"SELECT p_partkey, 'd:' || CASE WHEN {_CENTS} % 100 = 0 THEN {_CENTS} // 100 || '@0' WHEN {_CENTS} % 10 = 0 THEN {_CENTS} // 10 || '@1' ELSE {_CENTS} || '@2' END AS t FROM part")(
    lambda spark, d: load(spark, d, "part").select("p_partkey", C.canonical(F.struct(F.round(F.col("p_retailprice") * 100).cast("decimal(38,0)").alias("scaled"), F.lit(2).alias("scale")), T.StructType().add("scaled", T.DecimalType(38, 0)).add("scale", T.IntegerType())).alias("t"))
)


@add("canonical_nested", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '{s:null}' WHEN p_partkey % 3 = 1 THEN '{s:{a:null,b:i:' || p_size || '}}' ELSE '{s:{a:null,b:null}}' END AS t,
  'd:' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-' END || CASE WHEN p_size % 10 = 0 THEN p_size // 10 || '@29' ELSE p_size || '@30' END AS tiny FROM part
""")
def canonical_nested(spark, d):
    """A null struct is not a struct of nulls; decimals of thirty places."""
    k = F.col("p_partkey") % 3
    s = F.when(k != 0, F.struct(F.lit(None).cast("string").alias("a"), F.when(k == 1, F.col("p_size")).alias("b")))
    t = load(spark, d, "part").select("p_partkey", s.alias("s"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "").otherwise("-"), F.lit("0."), F.lpad(F.col("p_size").cast("string"), 30, "0")).cast("decimal(38,30)").alias("tiny"))
    return t.select("p_partkey", C.row_text(t, ["s"]).alias("t"), C.canonical(F.col("tiny"), T.DecimalType(38, 30)).alias("tiny"))


add("logical_hash_variant", "SELECT event_id, sha256('{k:i:' || CAST(json_extract(props, '$.k') AS BIGINT) || '}') AS hash FROM events")(
    lambda spark, d: load(spark, d, "events").select("event_id", F.sha2(C.canonical(F.parse_json("props"), T.VariantType()), 256).alias("hash"))
)


@add("dedup_by_hash", f"SELECT sha256('{{l_linestatus:s:' || l_linestatus || ',l_returnflag:s:' || l_returnflag || '}}') AS hash, count(*) AS n FROM lineitem GROUP BY 1")
def dedup_by_hash(spark, d):
    t = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return t.groupBy(C.logical_hash(t).alias("hash")).agg(F.count("*").alias("n"))


@add("distinct_by_hash", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_by_hash(spark, d):
    return C.distinct_by_hash(load(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@add("logically_equal", "SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 7 <> 1 AS equal FROM customer")
def logically_equal(spark, d):
    t = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    other = t.where("c_custkey % 7 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return C.logically_equal(t, other, "c_custkey")


# -- deltas -------------------------------------------------------------------------------------------------------------


def _orders(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: some rows lost, some new, some with another priority or customer."""
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    base = t.where("o_orderkey % 11 <> 3")
    target = t.where("o_orderkey % 7 <> 2").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 3 WHEN o_orderkey % 5 = 1 THEN o_custkey - 2 ELSE o_custkey END").alias("o_custkey"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderpriority END").alias("o_orderpriority"))
    return base, target


@add("diff_orders", """
WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 11 <> 3),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 3 WHEN o_orderkey % 5 = 1 THEN o_custkey - 2 ELSE o_custkey END AS c,
  CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 7 <> 2),
j AS (SELECT coalesce(a.k, b.k) AS o_orderkey, a.k AS ak, b.k AS bk, a.c AS ac, b.c AS bc, a.p AS ap, b.p AS bp FROM a FULL JOIN b ON a.k = b.k)
SELECT o_orderkey, CAST(0 AS BIGINT) AS seq, 'remove' AS kind, '/' || o_orderkey AS path, NULL AS value FROM j WHERE bk IS NULL
UNION ALL SELECT o_orderkey, 0, 'set', '/' || o_orderkey, '{"o_custkey":' || bc || ',"o_orderpriority":"' || bp || '"}' FROM j WHERE ak IS NULL
UNION ALL SELECT o_orderkey, 0, CASE WHEN bc > ac THEN 'increment' ELSE 'decrement' END, '/' || o_orderkey || '/o_custkey', CAST(abs(bc - ac) AS VARCHAR) FROM j WHERE ac <> bc
UNION ALL SELECT o_orderkey, CASE WHEN ac <> bc THEN 1 ELSE 0 END, 'replace', '/' || o_orderkey || '/o_orderpriority', bp FROM j WHERE ap <> bp
""")
def diff_orders(spark, d):
    return D.diff_tables(*_orders(spark, d), "o_orderkey")


@add("apply_ordered_fold", """
WITH o AS (SELECT user_id, event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'set' WHEN 1 THEN 'decrement' WHEN 2 THEN 'clear' ELSE 'increment' END AS kind, CAST(event_id % 100 AS DOUBLE) AS v FROM events),
l AS (SELECT user_id, max(seq) FILTER (kind IN ('set', 'clear')) AS last_at, arg_max(CASE WHEN kind = 'set' THEN v ELSE 0 END, seq) FILTER (kind IN ('set', 'clear')) AS base FROM o GROUP BY user_id)
SELECT o.user_id, coalesce(min(l.base), 0) + coalesce(sum(CASE kind WHEN 'increment' THEN v WHEN 'decrement' THEN -v END) FILTER (l.last_at IS NULL OR seq > l.last_at), 0) AS state FROM o JOIN l USING (user_id) GROUP BY o.user_id
""")
def apply_ordered_fold(spark, d):
    kind = F.expr("CASE event_id % 6 WHEN 0 THEN 'set' WHEN 1 THEN 'decrement' WHEN 2 THEN 'clear' ELSE 'increment' END")
    return D.fold_counters(load(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 100).cast("double").alias("value")), "user_id")


def _arrays(name: str, sql: str, f) -> None:
    add(name, f"SELECT vec_id, CAST(len(a) AS INTEGER) AS n, a[1] AS first, a[3] AS third, a[-1] AS last FROM (SELECT vec_id, {sql} AS a FROM embeddings)")(
        lambda spark, d: load(spark, d, "embeddings").select("vec_id", f(F.col("embedding")).alias("a")).select("vec_id", F.size("a").alias("n"), F.try_element_at("a", F.lit(1)).alias("first"), F.try_element_at("a", F.lit(3)).alias("third"), F.try_element_at("a", F.lit(-1)).alias("last"))
    )


def _lit():
    return F.lit(1.5).cast("float")


_arrays("array_append", "list_append(embedding, CAST(1.5 AS FLOAT))", lambda a: D.append(a, _lit()))
_arrays("array_prepend", "list_prepend(CAST(1.5 AS FLOAT), embedding)", lambda a: D.prepend(a, _lit()))
_arrays("array_insert", "list_concat(list_append(embedding[1:2], CAST(1.5 AS FLOAT)), embedding[3:])", lambda a: D.insert_at(a, 2, _lit()))
_arrays("array_set", "list_concat(list_append(embedding[1:2], CAST(1.5 AS FLOAT)), embedding[4:])", lambda a: D.set_at(a, 2, _lit()))
_arrays("array_remove", "list_concat(embedding[1:2], embedding[4:])", lambda a: D.remove_at(a, 2))
_arrays("array_clear", "embedding[1:0]", D.clear)

add("apply_set_merge", "SELECT n_nationkey, 'x' AS a, CAST(n_regionkey AS VARCHAR) AS b, n_name AS c, CAST(3 AS INTEGER) AS n FROM nation")(
    lambda spark, d: load(spark, d, "nation").select("n_nationkey", D.merge_maps(F.create_map(F.lit("a"), F.col("n_name"), F.lit("c"), F.col("n_name")), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("n_regionkey").cast("string"))).alias("m")).select("n_nationkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"), F.size("m").alias("n"))
)


def _documents(spark, d) -> DataFrame:
    t = spread(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    body = lambda balance, tags: F.to_json(F.struct(F.struct("c_name", balance.alias("balance")).alias("account"), tags.alias("tags")))
    return t.select("c_custkey", body(F.floor("c_acctbal"), F.array("c_mktsegment", F.lit("x"))).alias("base"), body(F.floor("c_acctbal") + F.col("c_custkey") % 3, F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).otherwise(F.array("c_mktsegment", F.lit("x"), F.lit("y")))).alias("target"))


@add("apply_nested_delta", """
SELECT c_custkey, '{"account":{"balance":' || CAST(floor(c_acctbal) AS BIGINT) + c_custkey % 3 || ',"c_name":"' || c_name || '"},"tags":["' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '"]}' ELSE '","x","y"]}' END AS value, CAST(NULL AS INTEGER) AS error_code FROM customer
""")
def apply_nested_delta(spark, d):
    t = _documents(spark, d)
    # the base goes along, so that the deltas are not joined back to it
    both = D.diff_documents(t.select(F.struct("c_custkey", "base").alias("row"), "base", "target"), "row", "base", "target").select("row.c_custkey", "row.base", F.col("value").alias("delta"))
    return D.apply_documents(both, "c_custkey", "base", "delta").select("c_custkey", "value", "error_code")


@add("diff_nested", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END + 1 AS INTEGER) AS n_ops, CASE WHEN c_custkey % 2 = 0 THEN 'remove' ELSE 'append' END AS last_kind FROM customer")
def diff_nested(spark, d):
    ops = D.diff_documents(_documents(spark, d), "c_custkey", "base", "target").select("c_custkey", F.from_json(F.variant_get(F.parse_json("value"), '$["$value"]["ops"]', "string"), "array<struct<kind:string,path:string>>").alias("ops"))
    return ops.select("c_custkey", F.size("ops").alias("n_ops"), F.element_at("ops", -1)["kind"].alias("last_kind"))


@add("apply_tables", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 3 WHEN o_orderkey % 5 = 1 THEN o_custkey - 2 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_totalprice / 7 AS share, o_orderdate AS placed FROM orders WHERE o_orderkey % 7 <> 2
""")
def apply_tables(spark, d):
    """A column lost, two added, nulls, rows lost and new: the changes lead from the base to the target."""
    base, target = _orders(spark, d)
    target = target.withColumn("o_orderpriority", F.when((F.col("o_orderkey") % 4 != 0) | (F.col("o_orderkey") % 3 == 0), F.col("o_orderpriority")))
    target = target.join(load(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("share"), F.col("o_orderdate").alias("placed")), "o_orderkey")
    base = base.withColumn("lost", F.lit("x"))
    return D.apply_tables(base, D.diff_tables(base, target, "o_orderkey"), "o_orderkey", target.schema)


@add("apply_move_copy", """
SELECT c_custkey, '{"c":' || c_custkey + 5 || ',"l":[' || c_nationkey || ',2,3],"m":{"name":"' || c_name || '"},"n":' || c_custkey + 5 || ',"r":"new"}' AS value, CAST(NULL AS INTEGER) AS error_code FROM customer
""")
def apply_move_copy(spark, d):
    t = spread(spark, d, "customer", "c_custkey", "c_name", "c_nationkey").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("n"), F.col("c_name").alias("x"), F.lit("old").alias("r"), F.array(F.lit(2)).alias("l"), F.struct().alias("m"))).alias("base"), F.concat(F.lit("delta { inc /n by 5 copy /c from /n move /m/name from /x replace /r \"new\" append /l 3 prepend /l "), F.col("c_nationkey").cast("string"), F.lit(" }")).alias("t"))
    told = text.read(t.select(F.struct("c_custkey", "base").alias("row"), "t"), "row", "t").select("row.c_custkey", "row.base", F.col("value").alias("delta"))
    return D.apply_documents(told, "c_custkey", "base", "delta").select("c_custkey", "value", "error_code")


@add("apply_delta_errors", "SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 1203 WHEN 1 THEN 1102 WHEN 2 THEN 1203 END AS INTEGER) AS error_code, CASE c_custkey % 4 WHEN 0 THEN '/a/b/c' WHEN 1 THEN '/s' WHEN 2 THEN '/none' END AS error_path FROM customer")
def apply_delta_errors(spark, d):
    k = F.col("c_custkey") % 4
    t = spread(spark, d, "customer", "c_custkey").select("c_custkey", F.lit('{"s":"x","n":1}').alias("base"), F.when(k == 0, "delta { set /a/b/c = 1 }").when(k == 1, "delta { set /n = 2 inc /s by 1 }").when(k == 2, "delta { move /m from /none }").otherwise("delta { remove /n }").alias("t"))
    told = text.read(t.select(F.struct("c_custkey", "base").alias("row"), "t"), "row", "t").select("row.c_custkey", "row.base", F.col("value").alias("delta"))
    return D.apply_documents(told, "c_custkey", "base", "delta").select("c_custkey", "error_code", "error_path")


# -- schemas ----------------------------------------------------------------------------------------------------------------

CUSTOMER = """
schema Customer v1 {
  #1 c_custkey: u32
  #2 c_name: string @hot
  #3 c_nationkey: u8
  #4 c_acctbal: f64
  #5 c_mktsegment: enum[BUILDING,AUTOMOBILE,MACHINERY]
  #6 c_phone?: string
}
"""
CUSTOMER_2 = """
schema Customer v2 {
  #1 c_custkey: u32
  #2 full_name: string
  #3 c_nationkey: u8
  #4 c_acctbal: f64
  #5 c_mktsegment: enum[BUILDING,AUTOMOBILE,MACHINERY]
  #6 c_phone?: string
  #7 active: bool = true
  #8 email?: string
}
"""


@add("validate_customer", """
SELECT c_custkey, CAST(CASE WHEN c_custkey % 10 = 0 THEN 1103 WHEN c_nationkey NOT BETWEEN 0 AND 255 THEN 1102 WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 1102 END AS INTEGER) AS error_code,
  CASE WHEN c_custkey % 10 = 0 THEN '/c_name' WHEN c_nationkey NOT BETWEEN 0 AND 255 THEN '/c_nationkey' WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN '/c_mktsegment' END AS error_path FROM customer
""")
def validate_customer(spark, d):
    t = load(spark, d, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")))
    return S.validate(t, S.parse_schema(CUSTOMER)).select("c_custkey", "error_code", "error_path")


@add("validate_presence", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1102 END AS INTEGER) AS error_code, CASE WHEN c_custkey % 2 = 0 THEN '/c_phone' END AS error_path FROM customer")
def validate_presence(spark, d):
    names = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("c_custkey"), F.lit("c_phone"))).otherwise(F.array(F.lit("c_custkey")))
    t = load(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("c_phone"), names.alias("present"))
    schema = S.Schema("Phone", 1, (S.Field(1, "c_custkey", "u32"), S.Field(6, "c_phone", "string", True)))
    return S.validate(t, schema, "present").select("c_custkey", "error_code", "error_path")


@add("validate_array", "SELECT vec_id, CAST(NULL AS INTEGER) AS error_code, CAST(CASE WHEN vec_id % 2 = 0 THEN 1102 END AS INTEGER) AS label_error FROM embeddings")
def validate_array(spark, d):
    t = load(spark, d, "embeddings").withColumn("flags", F.array(F.col("label") * 0, F.when(F.col("vec_id") % 2 == 0, 300).otherwise(3)))
    a = S.validate(t, S.Schema("E", 1, (S.Field(1, "embedding", "f32[]"),))).select("vec_id", "error_code")
    b = S.validate(t, S.Schema("E", 1, (S.Field(1, "flags", "u8[]"),))).select("vec_id", F.col("error_code").alias("label_error"))
    return a.join(b, "vec_id")


@add("schema_compat", """
WITH a(id, name, type) AS (VALUES (1, 'c_custkey', 'u32'), (2, 'c_name', 'string'), (3, 'c_nationkey', 'u8'), (4, 'c_acctbal', 'f64'), (5, 'c_mktsegment', 'e'), (6, 'c_phone', 'string')),
b(id, name, type, optional, dflt) AS (VALUES (1, 'c_custkey', 'u32', false, NULL), (2, 'full_name', 'string', false, NULL), (3, 'c_nationkey', 'u8', false, NULL), (4, 'c_acctbal', 'f64', false, NULL), (5, 'c_mktsegment', 'e', false, NULL), (6, 'c_phone', 'string', true, NULL), (7, 'active', 'bool', false, 'true'), (8, 'email', 'string', true, NULL))
SELECT a.id IS NULL AS is_new, CAST(coalesce(a.id, b.id) AS INTEGER) AS id,
  CASE WHEN b.id IS NULL THEN 'incompatible' WHEN a.id IS NULL THEN CASE WHEN optional THEN 'add_optional' WHEN dflt IS NOT NULL THEN 'add_default' ELSE 'incompatible' END
    WHEN a.type <> b.type THEN 'incompatible' WHEN a.name <> b.name THEN 'rename' ELSE 'copy' END AS step,
  coalesce(b.name, a.name) AS name, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN dflt WHEN a.name <> b.name THEN a.name END AS detail
FROM a FULL JOIN b ON a.id = b.id
""")
def schema_compat(spark, d):
    return S.compatibility(S.parse_schema(CUSTOMER).table(spark), S.parse_schema(CUSTOMER_2).table(spark))


@add("schema_migrate", "SELECT c_custkey, c_name AS full_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS VARCHAR) AS c_phone, true AS active, CAST(NULL AS VARCHAR) AS email FROM customer")
def schema_migrate(spark, d):
    t = load(spark, d, "customer").withColumn("c_phone", F.lit(None).cast("string"))
    return S.migrate(t, S.parse_schema(CUSTOMER), S.parse_schema(CUSTOMER_2))


@add("schema_defaults", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN false ELSE true END AS active FROM customer")
def schema_defaults(spark, d):
    t = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit(False)).alias("active"))
    return S.apply_defaults(t, S.parse_schema(CUSTOMER_2)).select("c_custkey", "active")


@add("schema_hash", """
WITH f(k, body) AS (SELECT n_nationkey, '[{"default": null, "hints": [], "id": 1, "name": "id", "optional": false, "type": "u32"}, {"default": "' || n_nationkey || '", "hints": ["hot"], "id": 2, "name": "n", "optional": true, "type": "i64"}]' FROM nation)
SELECT CAST(k AS INTEGER) AS version, sha256('["' || (SELECT n_name FROM nation WHERE n_nationkey = k) || '", ' || k || ', ' || body || ']') AS hash FROM f
""")
def schema_hash(spark, d):
    """A schema a nation, its fields in another order; schemas are small and parsed where they are used."""
    names = [(r["n_nationkey"], r["n_name"]) for r in load(spark, d, "nation").select("n_nationkey", "n_name").collect()]
    own = [S.parse_schema(f"schema X v{k} {{\n  #2 n?: i64 = {k} @hot\n  #1 id: u32\n}}") for k, _ in names]
    return spark.createDataFrame([(s.version, S.Schema(n, s.version, s.fields).hash()) for s, (_, n) in zip(own, names, strict=True)], "version int, hash string")


# -- frames -----------------------------------------------------------------------------------------------------------------

_SIZE = 256
_CHUNKS = f"SELECT doc_id, i AS chunk_index, CAST(greatest(ceil(length(text) / {_SIZE}.0), 1) AS INTEGER) AS chunk_count, substr(text, CAST(i * {_SIZE} + 1 AS BIGINT), {_SIZE}) AS payload FROM (SELECT doc_id, text, CAST(unnest(range(CAST(greatest(ceil(length(text) / {_SIZE}.0), 1) AS BIGINT))) AS INTEGER) AS i FROM documents WHERE text IS NOT NULL)"
_SUM32 = "CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT)"


def _split(spark, d) -> DataFrame:
    return R.split(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), "id", "text", _SIZE)


@add("chunk_split", f"SELECT CAST(doc_id AS VARCHAR) AS message_id, chunk_index, chunk_count, CAST(chunk_index AS BIGINT) * {_SIZE} AS \"offset\", CAST(length(payload) AS INTEGER) AS length, {_SUM32} AS checksum FROM (SELECT *, sha256(payload) AS h FROM ({_CHUNKS}))")
def chunk_split(spark, d):
    return _split(spark, d).select("message_id", "chunk_index", "chunk_count", "offset", "length", "checksum")


@add("chunk_reassemble", "SELECT CAST(doc_id AS VARCHAR) AS message_id, sha256(text) AS hash, CAST(NULL AS INTEGER) AS error_code FROM documents WHERE text IS NOT NULL")
def chunk_reassemble(spark, d):
    return R.reassemble(_split(spark, d)).select("message_id", F.sha2("payload", 256).alias("hash"), "error_code")


@add("chunk_errors", f"""
WITH c AS ({_CHUNKS}), n AS (SELECT doc_id, max(chunk_count) AS n FROM c GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 1302 WHEN doc_id % 5 = 1 AND n > 1 THEN 1302 WHEN doc_id % 5 = 2 AND n > 1 THEN 1305 END AS INTEGER) AS error_code FROM n
""")
def chunk_errors(spark, d):
    own = _split(spark, d)
    k, last = F.col("message_id").cast("long") % 5, F.col("chunk_index") == F.col("chunk_count") - 1
    # 0: the first comes twice; 1: the last tells another count; 2: the last is missing
    bad = own.where(~((k == 2) & last & (F.col("chunk_count") > 1))).withColumn("chunk_count", F.when((k == 1) & last & (F.col("chunk_count") > 1), F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
    return R.reassemble(bad.union(own.where((k == 0) & (F.col("chunk_index") == 0)))).select("message_id", "error_code")


@add("chunk_integrity", f"SELECT CAST(doc_id AS VARCHAR) AS message_id, chunk_index, CAST(CASE WHEN doc_id % 3 = 0 AND length(payload) > 0 THEN 1003 WHEN doc_id % 3 = 1 THEN 1005 END AS INTEGER) AS error_code FROM ({_CHUNKS})")
def chunk_integrity(spark, d):
    k = F.col("message_id").cast("long") % 3
    own = _split(spark, d)
    payload = F.when((k == 0) & (F.col("length") > 0), F.substr("payload", F.lit(2))).otherwise(F.col("payload"))
    return R.checked(own.withColumns({"payload": payload, "checksum": F.when(k == 1, F.col("checksum") + 1).otherwise(F.col("checksum"))})).select("message_id", "chunk_index", "error_code")


@add("frame_reassemble_conversations", "SELECT CAST(conv_id AS VARCHAR) AS message_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id")
def frame_reassemble_conversations(spark, d):
    t = load(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    place = t.groupBy("conv_id").agg(F.count("*").cast("int").alias("chunk_count"), F.min("turn").alias("_first"))
    frames = t.join(place, "conv_id").select(F.lit("chunk").alias("kind"), F.col("conv_id").cast("string").alias("message_id"), (F.col("turn") - F.col("_first")).cast("int").alias("chunk_index"), "chunk_count", F.col("text").alias("payload"))
    return R.reassemble(frames).where("error_code is null").select("message_id", F.sha2("payload", 256).alias("hash"))


@add("frame_files", f"SELECT CAST(n_nationkey AS VARCHAR) AS message_id, sha256(n_name) AS hash, CAST(ceil(length(n_name) / 3.0) AS BIGINT) AS n_frames FROM nation")
def frame_files(spark, d):
    """Written to frame files, twice over the same place, and read again."""
    framestream.register(spark)
    path = scratch(spark, "frames")
    own = R.split(load(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").cast("binary").alias("b")), "id", "b", 3)
    frames = own.select("kind", "message_id", *[F.col(c).cast("long") for c in ("chunk_index", "chunk_count", "segment_id", "offset", "length", "checksum")], "payload")
    for _ in range(2):
        frames.write.format("frames").option("most", 64).mode("overwrite").save(path)
    back = spark.read.format("frames").load(path)
    whole = R.reassemble(R.checked(back).where("error_code is null").drop("error_code")).select("message_id", F.sha2("payload", 256).alias("hash"))
    return whole.join(back.groupBy("message_id").agg(F.count("*").alias("n_frames")), "message_id")


add("checksum32", f"SELECT p_partkey, {_SUM32} AS c FROM (SELECT p_partkey, sha256(p_name) AS h FROM part)")(lambda spark, d: load(spark, d, "part").select("p_partkey", E.checksum32(F.col("p_name")).alias("c")))


# -- encodings --------------------------------------------------------------------------------------------------------------

add("zigzag", "SELECT p_partkey, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v AS back FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) AS v FROM part)")(
    lambda spark, d: load(spark, d, "part").select("p_partkey", (F.col("p_size").cast("long") * F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)).alias("v")).select("p_partkey", E.zigzag(F.col("v")).alias("z"), E.unzigzag(E.zigzag(F.col("v"))).alias("back"))
)
add("varint", "SELECT event_id, CASE WHEN event_id < 128 THEN printf('%02x', event_id) WHEN event_id < 16384 THEN printf('%02x%02x', event_id % 128 + 128, event_id // 128) ELSE printf('%02x%02x%02x', event_id % 128 + 128, event_id // 128 % 128 + 128, event_id // 16384) END AS v, event_id AS back FROM events")(
    lambda spark, d: load(spark, d, "events").select("event_id", E.varint(F.col("event_id")).alias("v")).select("event_id", "v", E.unvarint(F.col("v")).alias("back"))
)
add("varint_wide", "SELECT event_id, CAST(CASE WHEN v < 34359738368 THEN 5 WHEN v < 4398046511104 THEN 6 WHEN v < 562949953421312 THEN 7 WHEN v < 72057594037927936 THEN 8 ELSE 9 END AS INTEGER) AS n_bytes, v AS back, CAST(10 AS INTEGER) AS n_negative FROM (SELECT event_id, event_id * 1234567890123 + 34359738367 AS v FROM events)")(
    lambda spark, d: load(spark, d, "events").select("event_id", (F.col("event_id") * 1234567890123 + 34359738367).alias("v")).select("event_id", (F.length(E.varint(F.col("v"))) / 2).cast("int").alias("n_bytes"), E.unvarint(E.varint(F.col("v"))).alias("back"), (F.length(E.varint(-F.col("v"))) / 2).cast("int").alias("n_negative"))
)
add("varint_errors", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_partkey % 128 WHEN 7 THEN -1 END AS back FROM part")(
    lambda spark, d: load(spark, d, "part").select("p_partkey", E.unvarint(F.element_at(F.array(F.lower(F.lpad(F.hex(F.col("p_partkey") % 128), 2, "0")), *map(F.lit, ("80", "8001ff", "xyz1", "", "ffffffffffffffffff02", "8", "ffffffffffffffffff01"))), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("back"))
)
add("bitpack_flags", "SELECT p_partkey // 8 AS byte_no, CAST(sum(CASE WHEN p_size > 25 THEN 1 << (p_partkey % 8) ELSE 0 END) AS BIGINT) AS byte FROM part GROUP BY 1")(
    lambda spark, d: E.bit_packed(load(spark, d, "part").select("p_partkey", (F.col("p_size") > 25).alias("flag")), "p_partkey", "flag")
)
add("presence_map", "SELECT 'p_name' AS \"column\", p_partkey // 8 AS byte_no, CAST(sum(1 << (p_partkey % 8)) AS BIGINT) AS byte FROM part GROUP BY 2 UNION ALL SELECT 'odd', p_partkey // 8, CAST(sum(CASE WHEN p_partkey % 2 = 1 THEN 1 << (p_partkey % 8) ELSE 0 END) AS BIGINT) FROM part GROUP BY 2")(
    lambda spark, d: E.presence(load(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 1, F.lit("x")).alias("odd")), "p_partkey", ["p_name", "odd"])
)
add("dict_encode", "SELECT value, row_number() OVER (ORDER BY first_at) - 1 AS id FROM (SELECT o_orderpriority AS value, min(o_orderkey) AS first_at FROM orders GROUP BY 1)")(lambda spark, d: E.dictionary(load(spark, d, "orders"), "o_orderpriority", "o_orderkey"))
add("dictionary_distinct", "SELECT DISTINCT value FROM (SELECT l_returnflag AS value FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem)")(lambda spark, d: E.sorted_dictionary(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]))
add("shape_table", "SELECT CASE WHEN event_id % 3 = 0 THEN 'a,b' ELSE 'a' END AS shape, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, d: E.shapes(load(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).otherwise(F.create_map(F.lit("a"), F.lit(1))).alias("m")), "m")
)
add("hot_index", "SELECT * FROM (VALUES ('n_name', 0), ('n_nationkey', 1), ('n_regionkey', 2)) t(name, ordinal)")(lambda spark, d: E.hot_index(load(spark, d, "nation")))


# -- JSON, text and binary forms ------------------------------------------------------------------------------------------

add("json_tagged", "SELECT o_orderkey, '{\"$type\":\"date\",\"$value\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"}' AS j, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders")(
    lambda spark, d: load(spark, d, "orders").select("o_orderkey", jsonio.tagged("date", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("j")).select("o_orderkey", "j", jsonio.untagged(F.parse_json("j"), "$", "date", "string").alias("back"))
)
add("text_parse", "SELECT n_nationkey, '{\"active\":true,\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"tags\":[1,2.5,null]}' AS value, CAST(NULL AS INTEGER) AS error_code FROM nation")(
    lambda spark, d: text.read(load(spark, d, "nation").select("n_nationkey", F.concat(F.lit("// a nation\n{ id: "), F.col("n_nationkey").cast("string"), F.lit(", name: \""), F.col("n_name"), F.lit("\", active: true, # note\n tags: [1, 2.5, null,], }")).alias("t")), "n_nationkey", "t").select("n_nationkey", "value", "error_code")
)
add("text_errors", "SELECT n_nationkey, CAST(1301 AS INTEGER) AS error_code, CASE WHEN n_nationkey % 2 = 0 THEN '1:8' ELSE '2:5' END AS error_path FROM nation")(
    lambda spark, d: text.read(load(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "{ a: 1 b: 2 }").otherwise("{\n  a ! 1 }").alias("t")), "n_nationkey", "t").select("n_nationkey", "error_code", "error_path")
)
add("text_format", "SELECT n_nationkey, '{' || chr(10) || '  id: ' || n_nationkey || ',' || chr(10) || '  name: \"' || n_name || '\",' || chr(10) || '}' AS value FROM nation")(
    lambda spark, d: text.write(load(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))).alias("j")), "n_nationkey", "j").select("n_nationkey", "value")
)


add("text_message", "SELECT o_orderkey, '{\"$type\":\"message\",\"$value\":{\"fields\":{\"at\":{\"$type\":\"date\",\"$value\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"},\"key\":' || o_orderkey || ',\"total\":{\"$type\":\"money\",\"$value\":{\"currency\":\"INR\",\"scale\":2,\"scaled\":' || CAST(floor(o_totalprice) AS BIGINT) * 100 + 25 || '}}},\"type\":\"OrderCreated\"}}' AS value FROM orders")(
    lambda spark, d: text.read(spread(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice").select("o_orderkey", F.concat(F.lit("message OrderCreated { key: "), F.col("o_orderkey").cast("string"), F.lit(', total: money("INR", "'), F.floor("o_totalprice").cast("string"), F.lit('.25", 2), at: date("'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('") }')).alias("t")), "o_orderkey", "t").select("o_orderkey", "value")
)
add("text_typed", "SELECT p_partkey, '{\"a\":{\"$type\":\"typed_array:u8\",\"$value\":[1,' || p_size || ']},\"b\":{\"$type\":\"bytes\",\"$value\":\"' || to_base64(encode(p_brand)) || '\"},\"d\":{\"$type\":\"decimal\",\"$value\":{\"scale\":3,\"scaled\":\"' || p_size * 1000 + 120 || '\"}},\"e\":\"' || p_type || '\",\"f\":{\"$type\":\"typed_array:f64\",\"$value\":[' || p_size || '.5]},\"u\":{\"$type\":\"uuid\",\"$value\":\"6f9619ff-8b86-d011-b42d-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '\"}}' AS value FROM part")(
    lambda spark, d: text.read(spread(spark, d, "part", "p_partkey", "p_size", "p_brand", "p_type").select("p_partkey", F.concat(F.lit("{ a: u8[1, "), F.col("p_size").cast("string"), F.lit('], b: bytes("'), F.base64(F.col("p_brand").cast("binary")), F.lit('"), d: decimal("'), F.col("p_size").cast("string"), F.lit('.1209", 3), e: enum("'), F.col("p_type"), F.lit('"), f: f64['), F.col("p_size").cast("string"), F.lit('.5], u: uuid("6F9619FF-8B86-D011-B42D-'), F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit('") }')).alias("t")), "p_partkey", "t").select("p_partkey", "value")
)


@add("text_table", "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row_no, n_nationkey AS key, n_name AS name, CAST(n_nationkey AS FLOAT) / 2 AS half FROM nation")
def text_table(spark, d):
    """A table a region in text form, and its rows."""
    own = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    listed = lambda f: F.array_join(F.transform("l", f), ", ")
    t = load(spark, d, "nation").groupBy("n_regionkey").agg(own.alias("l")).select("n_regionkey", F.concat(F.lit("table Nations { key: ["), listed(lambda x: x["n_nationkey"].cast("string")), F.lit("], name: ["), listed(lambda x: F.concat(F.lit('"'), x["n_name"], F.lit('"'))), F.lit("], half: f32["), listed(lambda x: (x["n_nationkey"] / 2).cast("string")), F.lit("] }")).alias("t"))
    return V.table_rows(text.read(t, "n_regionkey", "t"), "n_regionkey", "value", {"key": "int", "name": "string", "half": "float"})


add("text_delta", "SELECT n_nationkey, '{\"$type\":\"delta\",\"$value\":{\"from_hash\":\"h' || n_nationkey || '\",\"ops\":[{\"kind\":\"set\",\"path\":\"/users/' || n_nationkey || '/n\",\"value\":\"' || n_name || '\"},{\"kind\":\"increment\",\"path\":\"/c\",\"value\":' || n_regionkey || '},{\"index\":1,\"kind\":\"insert\",\"path\":\"/l\",\"value\":null},{\"from\":\"/a\",\"kind\":\"move\",\"path\":\"/b\"},{\"kind\":\"clear\",\"path\":\"/l\"}]}}' AS value FROM nation")(
    lambda spark, d: text.read(load(spark, d, "nation").select("n_nationkey", F.concat(F.lit('delta from hash("h'), F.col("n_nationkey").cast("string"), F.lit('") { set /users/'), F.col("n_nationkey").cast("string"), F.lit('/n = "'), F.col("n_name"), F.lit('" inc /c by '), F.col("n_regionkey").cast("string"), F.lit(" insert /l at 1 = null move /b from /a clear /l }")).alias("t")), "n_nationkey", "t").select("n_nationkey", "value")
)
add("text_schema", "SELECT n_nationkey, '{\"fields\":[{\"id\":1,\"name\":\"id\",\"optional\":false,\"type\":\"u32\"},{\"default\":\"' || n_name || '\",\"id\":2,\"name\":\"name\",\"optional\":true,\"type\":\"string\"}],\"name\":\"Nation\",\"version\":' || n_nationkey || '}' AS value FROM nation")(
    lambda spark, d: text.read(load(spark, d, "nation").select("n_nationkey", F.concat(F.lit("schema Nation v"), F.col("n_nationkey").cast("string"), F.lit(' { #1 id: u32 #2 name?: string = "'), F.col("n_name"), F.lit('" }')).alias("t")), "n_nationkey", "t").select("n_nationkey", "value")
)
add("json_tags", "SELECT o_orderkey, '{\"b\":{\"$type\":\"bytes\",\"$value\":\"' || to_base64(encode(o_orderstatus)) || '\"},\"d\":{\"$type\":\"duration\",\"$value\":\"P' || o_custkey || 'D\"},\"r\":{\"$type\":\"ref\",\"$value\":\"/x/' || o_orderkey || '\"},\"t\":{\"$type\":\"timestamp\",\"$value\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '\"},\"u\":18446744073709551615}' AS value, CAST(NULL AS INTEGER) AS error_code FROM orders")(
    lambda spark, d: container.there_and_back(spread(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").select("o_orderkey", F.concat(F.lit('{"u": 18446744073709551615, "t": '), jsonio.tagged("timestamp", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(', "r": '), jsonio.tagged("ref", F.concat(F.lit("/x/"), F.col("o_orderkey").cast("string"))), F.lit(', "d": '), jsonio.tagged("duration", F.concat(F.lit("P"), F.col("o_custkey").cast("string"), F.lit("D"))), F.lit(', "b": '), jsonio.tagged("bytes", F.base64(F.col("o_orderstatus").cast("binary"))), F.lit("}")).alias("j")), "o_orderkey", "j").select("o_orderkey", "value", "error_code")
)


@add("accessors", """
SELECT p_partkey, 'object' AS k0, 'int' AS k1, 'bytes' AS k2, 'unsigned' AS k3, 'array' AS k4, CAST(18446744073709551615 - p_partkey AS DECIMAL(20, 0)) AS big, p_brand AS b, strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d') AS day, 1102 AS wrong, 1203 AS missing FROM part
""")
def accessors(spark, d):
    doc = F.concat(F.lit('{"i": '), F.col("p_size").cast("string"), F.lit(', "l": [], "u": '), (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("p_partkey")).cast("decimal(20,0)").cast("string"), F.lit(', "b": '), jsonio.tagged("bytes", F.base64(F.col("p_brand").cast("binary"))), F.lit(', "d": '), jsonio.tagged("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string")), F.lit("}"))
    v = F.col("v")
    t = spread(spark, d, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", F.parse_json(doc).alias("v"))
    return t.select("p_partkey", *[V.kind_at(v, p).alias(f"k{i}") for i, p in enumerate(("/", "/i", "/b", "/u", "/l"))], V.get_strict(v, "/u", "unsigned")["value"].alias("big"), F.decode(V.get_strict(v, "/b", "bytes")["value"], "UTF-8").alias("b"), V.get_strict(v, "/d", "string")["value"].alias("day"), V.get_strict(v, "/d", "bytes")["error_code"].alias("wrong"), V.get_strict(v, "/none", "unsigned")["error_code"].alias("missing"))


def _batches(spark, d) -> DataFrame:
    """Event batches of hundreds of rows as containers: k with the number of the first row, b."""
    t = V.batches(load(spark, d, "events").select((F.col("user_id") % 4).alias("k"), "event_id", "event_type", "value"), "k", ["event_id", "event_type", "value"])
    return container.write(t.select(F.struct("k", "first").alias("k"), F.to_json("rows", {"ignoreNullFields": "false"}).alias("j")), "k", "j").select("k", F.col("value").alias("b"))


add("container_hot_values", "SELECT user_id % 4 AS k, CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS INTEGER) AS row_no, '\"' || event_type || '\"' AS value FROM events")(
    lambda spark, d: container.hot_values(_batches(spark, d), "k", "b", "event_type").select("k.k", (F.col("k.first") + F.col("row_no")).cast("int").alias("row_no"), F.nullif("value", F.lit("null")).alias("value"))
)


@add("container_batch_decode", "SELECT user_id % 4 AS k, event_id, event_type, value FROM events")
def container_batch_decode(spark, d):
    back = container.read(_batches(spark, d), "k", "b").select("k.k", F.from_json("value", "array<struct<event_id:bigint,event_type:string,value:double>>").alias("r"))
    return back.select("k", F.inline("r"))


@add("container_table_scan", "SELECT user_id % 4 AS k, count(*) FILTER (value > 25) AS n, CAST(NULL AS INTEGER) AS error_code FROM events GROUP BY 1")
def container_table_scan(spark, d):
    t = V.batches(load(spark, d, "events").select((F.col("user_id") % 4).alias("k"), "event_id", "value"), "k", ["event_id", "value"])
    j = F.concat(F.lit('{"$type":"table","$value":{"id":'), F.to_json(F.transform("rows", lambda x: x["event_id"])), F.lit(',"value":'), F.to_json(F.transform("rows", lambda x: x["value"])), F.lit("}}"))
    packed = container.write(t.select("k", j.alias("j")), "k", "j")
    counts = container.counts_above(packed, "k", "value", "value", 25.0).groupBy("k").agg(F.sum("n").alias("n"), F.max("error_code").alias("error_code"))
    return counts.withColumn("n", F.when(F.col("error_code").isNull(), F.col("n")))


@add("container_tables", "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row_no, CAST(n_nationkey AS INTEGER) AS key, n_name AS name FROM nation")
def container_tables(spark, d):
    """Short tables, kept row by row in the value segment."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    t = load(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("r"))
    j = F.concat(F.lit('{"$type":"table","$value":{"key":{"$type":"typed_array:i32","$value":'), F.to_json(F.transform("r", lambda x: x["n_nationkey"])), F.lit('},"name":'), F.to_json(F.transform("r", lambda x: x["n_name"])), F.lit("}}"))
    packed = container.write(t.select("n_regionkey", j.alias("j")), "n_regionkey", "j").select("n_regionkey", F.col("value").alias("b"))
    return V.table_rows(container.read(packed, "n_regionkey", "b"), "n_regionkey", "value", {"key": "int", "name": "string"})


@add("container_segments", """
SELECT n_nationkey, number, kind, CAST(0 AS INTEGER) AS codec, CAST(CASE kind WHEN 'hot_index' THEN 10 WHEN 'shape_table' THEN 8 WHEN 'dictionary' THEN 9 + length(n_name) ELSE 11 + length(n_name) END AS BIGINT) AS size
FROM nation, (VALUES (1, 'value_data'), (2, 'shape_table'), (3, 'dictionary'), (4, 'hot_index')) t(number, kind)
""")
def container_segments(spark, d):
    t = load(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name")).alias("j"))
    packed = container.write(t, "n_nationkey", "j").select("n_nationkey", F.col("value").alias("b"))
    return container.segments(packed, "n_nationkey", "b").drop("error_code")


@add("container_round_trip", "SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"key\":' || p_partkey || ',\"size\":' || p_size || '}' AS value, '535800' AS magic, CAST(NULL AS INTEGER) AS error_code FROM part")
def container_round_trip(spark, d):
    t = spread(spark, d, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))).alias("j"))
    packed = container.write(t, "p_partkey", "j").select(F.struct("p_partkey", F.hex(F.substr("value", F.lit(1), F.lit(3))).alias("magic")).alias("row"), F.col("value").alias("b"))
    return container.read(packed, "row", "b").select("row.p_partkey", "value", "row.magic", "error_code")


@add("container_malformed", "SELECT n_nationkey, CAST(CASE n_nationkey % 4 WHEN 0 THEN 1001 WHEN 1 THEN 1002 WHEN 2 THEN 1003 ELSE 1005 END AS INTEGER) AS error_code FROM nation")
def container_malformed(spark, d):
    t = load(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name")).alias("j"))
    packed = container.write(t, "n_nationkey", "j")
    b, k, n = F.col("value"), F.col("n_nationkey") % 4, F.length("value")
    bad = F.when(k == 0, F.concat(F.lit(b"XX"), b)).when(k == 1, F.concat(F.substr(b, F.lit(1), F.lit(3)), F.lit(b"\x09"), F.substr(b, F.lit(5)))).when(k == 2, F.substr(b, F.lit(1), n - 1)).otherwise(F.concat(F.substr(b, F.lit(1), n - 1), F.lit(b"\xff")))
    return container.read(packed.select("n_nationkey", bad.alias("b")), "n_nationkey", "b").select("n_nationkey", "error_code")
