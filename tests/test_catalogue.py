"""Every registered query of the model against its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tracemill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["fn_epoch_iso", "ing_get_or_create_dim"])
def test_against_sql_with_large_ids(spark, tmp_path, name):
    """Ids of larger tables: events beyond the year 9999 and users beyond 10,000."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT event_id + k * 3000000 AS event_id, ts, user_id + k * 9000 AS user_id, event_type, value, props FROM '{SF}/events.parquet', range(3) r(k)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.ORACLE_SQL[name])
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in want.description], want.fetchall())
