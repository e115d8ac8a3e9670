"""Every registered query against its DuckDB twin on the smallest driver tables (rows, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from auralith.plans.registry import ORACLE_SQL, QUERIES
from auralith.plans.tables import TABLES
from conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "float": "FLOAT", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]", "array<float>": "FLOAT[]",
                 "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql()[name]
    cur = duck.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, srows) == _canon(dcols, drows)
    dtypes = dict(zip(duck.sql(sql).columns, [str(t) for t in duck.sql(sql).types]))
    for f in df.schema.fields:  # same column types on both sides
        spark_t = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(spark_t, spark_t) == dtypes[f.name], (f.name, spark_t, dtypes[f.name])


def test_every_query_runs(spark):
    missing = set(QUERIES) - set(ORACLE_SQL)
    assert missing == {"logmel"}  # log-mel features are the only rows-only query
    assert entry.queries()["logmel"](spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "wer_norm" in df.columns
