"""L3: every registered query with an oracle equals its DuckDB SQL on the sf0.001 tables."""

import datetime as dt
import math
from collections import Counter

import pytest

import __spark_entry__ as E
from pondflow.sources.tables import TABLES

duckdb = pytest.importorskip("duckdb")

# model fits with reference-size ensembles take minutes; covered by tests/test_models.py
SLOW = {"evaporation_forecast", "evaporation_forecast_after_last",
        "final_concentration_score", "recursive_forecast"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9))   # repr keeps the sign of zero
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


SPARK_TO_SQL = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, sf_small, con, name):
    sdf = E.queries()[name](spark, sf_small)
    srows = [tuple(r) for r in sdf.collect()]
    sql = E.oracle_sql()[name]
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: SPARK_TO_SQL.get(t, t) for c, t in sdf.dtypes} == types     # same schema
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _bag(sdf.columns, srows) == _bag(dcols, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    assert df.count() > 0


def test_entry_smoke(spark, sf_small):
    df = E.entry(spark)
    assert df.columns[:2] == ["site", "date"] and df.count() > 0
