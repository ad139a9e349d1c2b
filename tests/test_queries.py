import duckdb
import pytest

from tessera.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table.column(n).to_pylist() for n in names], strict=True)))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert rows(Q.QUERIES[name](spark, sf).toArrow()) == rows(duck.execute(Q.ORACLES[name]).to_arrow_table())


def test_entry_imports_without_the_corpus_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'scan_count_gt' in e.queries() and not any(k.startswith('op1') for k in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)})


def test_the_rest_passes_without_the_corpus_package(tmp_path):
    """As after both folders and the pipeline are deleted: the other tests, but the slow ones, on what is left."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder in ("tessera", "tests"):
        shutil.copytree(f"{root}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", "test_values or scan_count_gt or text_errors or frame_files"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-2000:]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_one_column_and_push_the_filter(spark, sf):
    text = plan(Q.QUERIES["scan_count_gt"](spark, sf))
    assert "GreaterThan(value,25.0)" in text and "ReadSchema: struct<value:double>" in text
    assert "ReadSchema: struct<event_type:string>" in plan(Q.QUERIES["hot_field"](spark, sf))
    assert "EqualNullSafe(o_orderstatus,P)" in plan(Q.QUERIES["filter_eq_str"](spark, sf))
