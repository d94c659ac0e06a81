"""Queries against their SQL on rows that only larger tables hold."""

import duckdb
import pytest

from citelake.plans import registry

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def against_sql(spark, path, query, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, which row DISTINCT ON keeps differs from run to run
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    frame = registry.QUERIES[query](spark, str(path))
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({registry.ORACLE_SQL[query]})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want) and want
    return want


@pytest.mark.parametrize("turn", [1, -1])
def test_block_order_of_parts_over_100000(spark, tmp_path, turn):
    """Line 1 of part 100011 and line 2 of part 11 have one block number; a block that is no text takes no other's place."""
    rows = [(1, 1, 100011, 7), (1, 2, 11, 30), (1, 3, 13, 20), (2, 1, 100013, 39), (2, 2, 13, 3), (2, 3, 18, 10), (2, 4, 23, 12)]
    assert len(against_sql(spark, tmp_path, "block_order", "lineitem", rows[::turn], LINE)) == 5


def test_html_title_reads_the_escapes_of_its_sql(spark, tmp_path):
    titles = ["a &amp; b", "cut &amp", "say &quot;x&quot;", " \n odd \n", "&amp;lt;", ""]
    rows = [(k, f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for k, t in enumerate(titles)] + [(9, "<p>none</p>")]
    against_sql(spark, tmp_path, "html_title", "pages", rows, "page_id long, html string")


def test_identifiers_of_parts_over_90000(spark, tmp_path):
    rows = [(k, "name", "Brand#1") for k in (5, 6, 89998, 90002, 90003, 1200002)]
    against_sql(spark, tmp_path, "identifiers", "part", rows, "p_partkey long, p_name string, p_brand string")
