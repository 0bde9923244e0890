"""Each plain query against its DuckDB SQL, and the contract of the entry module without the training-data operators."""

import datetime
import decimal
import os
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT

import millrace.plans.more  # noqa: F401
import millrace.plans.proofs  # noqa: F401
from millrace.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    expect = duck.sql(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in expect)


def test_overlaps_against_plain_python(spark):
    import hashlib

    from test_operators import plain_merge

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["digest"] for r in QUERIES["merged_overlaps"](spark, SF).collect()}
    assert got == {i: hashlib.md5(plain_merge(t.split("\n")).encode()).hexdigest() for i, t in docs.items()}


def test_entry_works_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    subprocess.run(["cp", "-r", f"{ROOT}/millrace", f"{ROOT}/__spark_entry__.py", str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "millrace/llm")], check=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(QUERIES)


def test_nothing_else_imports_the_training_data_operators():
    for top, _, names in os.walk(os.path.join(ROOT, "millrace")):
        if "llm" not in top.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(top, name)) as source:
                        text = source.read()
                    assert "millrace.llm" not in text and "from ..llm" not in text and "from .llm" not in text
