"""Every registered query with an oracle against DuckDB on the smallest tables, and the entry points."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from citelake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) < 1e-5
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"audit_risk"}))
def test_others_run_twice_alike(spark, name):
    rows = [sorted(map(str, registry.QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() == 40 and frame.columns == ["claim_no", "score", "verdict", "best_doc_id", "best_pos"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
