"""Domain tables derived from the driver's tables, in SQL that Spark and DuckDB read alike.

The driver's tables hold no manuscripts, so entries, claims, flags, replies and annotations are made of
orders, line items, parts and events by fixed rules on their keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DERIVED = {
    "entries": """
        SELECT 'r' || CAST(o_custkey % 40 AS STRING) AS run_id, CAST(o_orderkey AS STRING) AS key,
          CASE o_orderkey % 7 WHEN 0 THEN 'supported' WHEN 1 THEN 'related' WHEN 2 THEN 'weak' WHEN 3 THEN 'unrelated'
            WHEN 4 THEN 'unverified' WHEN 5 THEN 'blocked' ELSE 'not_found' END AS verdict,
          CASE WHEN o_custkey % 40 = 7 THEN 'lexical' WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 < 3 THEN 'lexical' ELSE 'openai' END AS engine,
          o_orderkey % 37 = 0 AS retracted,
          CASE WHEN o_orderkey % 17 = 0 THEN 'reference' WHEN o_orderkey % 19 = 0 THEN 'claims' ELSE '' END AS reviewed_source,
          CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN 'related' ELSE '' END AS reviewed_verdict,
          o_orderkey % 29 = 0 AS rechecked, o_orderkey % 23 = 0 AS timed_out,
          CASE WHEN o_orderkey % 23 = 0 THEN 'stopped during lookup ' || CAST(o_orderkey % 50 AS STRING) ELSE '' END AS note,
          CASE o_orderkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'abstract' WHEN 3 THEN 'supplied pdf' WHEN 4 THEN 'fulltext-xml' ELSE '' END AS fetched_kind,
          CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1000 END AS text_chars,
          CASE o_orderkey % 9 WHEN 0 THEN 'not_found' WHEN 1 THEN 'unconfirmed' ELSE 'confirmed' END AS existence
        FROM {orders}""",
    "claim_verdicts": """
        SELECT 'r' || CAST(o_custkey % 40 AS STRING) AS run_id, CAST(l_orderkey AS STRING) AS key,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS claim_no,
          'claim about part ' || CAST(l_partkey % 200 AS STRING) AS claim,
          CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'related' WHEN 2 THEN 'weak' WHEN 3 THEN 'unrelated'
            WHEN 4 THEN 'blocked' ELSE 'unverified' END AS verdict,
          CASE WHEN l_suppkey % 13 = 0 THEN 'supported' ELSE '' END AS machine_verdict,
          CASE WHEN l_suppkey % 13 = 0 THEN 'set' END AS override
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "flags": """
        SELECT 'r' || CAST(o_custkey % 40 AS STRING) AS run_id, CAST(o_orderkey AS STRING) AS key, CAST(o_orderkey % 3 AS INT) AS flag_no,
          CASE WHEN o_orderkey % 8 = 0 THEN 'retracted-source' ELSE 'year-mismatch' END AS kind,
          CASE WHEN o_orderkey % 8 = 0 THEN 'high' ELSE 'medium' END AS severity,
          'flag message ' || CAST(o_orderkey % 20 AS STRING) AS message
        FROM {orders} WHERE o_orderkey % 4 = 0
        UNION ALL
        SELECT 'r' || CAST(o_custkey % 40 AS STRING), CAST(o_orderkey AS STRING), 9, 'reference-not-found', 'high',
          'second message ' || CAST(o_orderkey % 10 AS STRING)
        FROM {orders} WHERE o_orderkey % 12 = 0""",
    "actions": """
        SELECT event_id AS action_no, CASE event_type WHEN 'purchase' THEN 'clear' WHEN 'signup' THEN 'recheck' ELSE 'set' END AS kind,
          CAST(event_id % 1200 AS STRING) AS key, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 4 + 1 AS INT) END AS claim_no,
          CASE event_id % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'weak' WHEN 2 THEN 'unrelated' WHEN 3 THEN 'related' ELSE 'unverified' END AS verdict, ts AS at
        FROM {events}""",
    "replies": """
        SELECT 'r' || CAST(p_size % 10 AS STRING) AS run_id, CAST(p_partkey AS STRING) AS key, i.name AS index,
          CASE WHEN (p_partkey * 7 + i.no) % 11 = 0 THEN NULL WHEN (p_partkey + i.no) % 9 = 0 THEN 429 WHEN (p_partkey + i.no) % 10 = 1 THEN 503
            WHEN (p_partkey * 3 + i.no) % 4 = 0 THEN 404 ELSE 200 END AS status,
          (p_partkey * 3 + i.no) % 4 = 2 AND p_partkey % 3 = 0 AS found
        FROM {part} CROSS JOIN (SELECT 1 AS no, 'Crossref' AS name UNION ALL SELECT 2, 'OpenAlex' UNION ALL SELECT 3, 'Semantic Scholar'
          UNION ALL SELECT 4, 'arXiv' UNION ALL SELECT 5, 'Unpaywall' UNION ALL SELECT 6, 'Europe PMC') i""",
    "works": """
        SELECT 'r' || CAST(p_size % 10 AS STRING) AS run_id, CAST(p_partkey AS STRING) AS key, p_name AS title,
          p_brand || CASE WHEN p_partkey % 13 = 0 THEN ', MIT Press, thesis' ELSE ', Journal of Parts' END AS raw,
          CASE p_partkey % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'url' WHEN 2 THEN 'arxiv' ELSE '' END AS identifier_printed,
          CASE WHEN p_partkey % 31 = 0 THEN '10.1/wrong' ELSE '' END AS identifier_wrong, '' AS identifier_points_to,
          CAST(p_partkey % 100 AS DOUBLE) / 100 AS best_agreement, p_partkey % 8 = 1 AS loaded,
          CASE WHEN p_partkey % 8 = 5 THEN 'HTTP 404' ELSE '' END AS dead,
          '10.5/p' || CAST(p_partkey AS STRING) AS doi, p_partkey % 41 = 0 AS retracted, '' AS retraction_date,
          CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 5 = 1 THEN 100 END AS handle_code
        FROM {part}""",
    "manuscripts": """
        SELECT CAST(o_orderkey AS STRING) AS run_id,
          'The ' || o_orderpriority || ' order was studied in detail before now [' || CAST(o_orderkey % 40 + 1 AS STRING) || '], while later reports of customer '
          || CAST(o_custkey AS STRING) || ' disagree with the first account [' || CAST(o_custkey % 30 + 1 AS STRING) || ',' || CAST(o_custkey % 30 + 3 AS STRING)
          || '-' || CAST(o_custkey % 30 + 5 AS STRING) || '] and nothing else was found in status ' || o_orderstatus || '.' AS text
        FROM {orders}""",
    "bib": """
        SELECT 'r' || CAST(o_custkey % 40 AS STRING) AS run_id, CAST(o_orderkey AS INT) AS entry_no,
          CASE o_custkey % 5 WHEN 0 THEN 'smith' WHEN 1 THEN 'jones' WHEN 2 THEN 'li' WHEN 3 THEN 'osorio' ELSE 'vandijk' END
            || CAST(o_orderkey % 300 + 1700 AS STRING) || CASE WHEN o_orderkey % 6 = 0 THEN 'a' ELSE '' END AS key,
          CASE o_custkey % 5 WHEN 0 THEN 'smith' WHEN 1 THEN 'jones' WHEN 2 THEN 'li' WHEN 3 THEN 'osorio' ELSE 'van dijk' END AS names,
          CAST(o_orderkey % 300 + 1700 AS STRING) AS year, CASE WHEN o_orderkey % 6 = 0 THEN 'a' ELSE '' END AS letter,
          CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 90 AS INT) END AS number
        FROM {orders}""",
    "cited": """
        SELECT DISTINCT 'r' || CAST(l_suppkey % 40 AS STRING) AS run_id,
          CASE l_partkey % 7 WHEN 0 THEN 'smith' WHEN 1 THEN 'jones' WHEN 2 THEN 'li' WHEN 3 THEN 'osorio' WHEN 4 THEN 'dijk' WHEN 5 THEN 'vandijk' ELSE 'nobody' END
            || CAST(l_partkey % 300 + 1700 AS STRING) || CASE WHEN l_partkey % 4 = 0 THEN 'a' WHEN l_partkey % 4 = 1 THEN 'b' ELSE '' END AS key
        FROM {lineitem}""",
    "annotations": """
        SELECT 'r' || CAST(l_suppkey % 20 AS STRING) AS run_id, CAST(l_orderkey % 500 AS STRING) AS ref_key, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_no,
          CASE WHEN l_partkey % 10 = 0 THEN '' ELSE CAST(l_partkey % 50 AS STRING) END AS pred_key, CAST(l_linenumber AS STRING) AS page,
          'clause ' || CAST(l_partkey % 30 AS STRING) AS clause,
          CASE l_partkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'unconfirmed' WHEN 2 THEN 'confirmed' ELSE '' END AS pred_existence,
          CASE l_partkey % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'related' WHEN 2 THEN 'weak' WHEN 3 THEN 'unrelated' WHEN 4 THEN 'unverified' ELSE 'blocked' END AS pred_support,
          CASE l_linenumber % 3 WHEN 0 THEN 'full_text' WHEN 1 THEN 'html_page' ELSE 'abstract_only' END AS evidence,
          CASE l_suppkey % 5 WHEN 0 THEN 'n' WHEN 1 THEN '' ELSE 'y' END AS h_is_citation, CAST(l_partkey % 47 AS STRING) AS h_ref_key,
          CASE l_suppkey % 4 WHEN 0 THEN 'No' WHEN 1 THEN ' yes ' WHEN 2 THEN '' ELSE '1' END AS h_clause_ok,
          CASE l_suppkey % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE 'maybe' END AS h_exists,
          CASE (l_partkey + CAST(l_suppkey % 5 = 0 AS INT)) % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'related' WHEN 2 THEN 'weak' WHEN 3 THEN 'unrelated' WHEN 4 THEN 'unverified' ELSE '' END AS h_support
        FROM {lineitem}""",
    "fetches": """
        SELECT CAST(page_id % 50 AS STRING) AS run_id, CAST(page_id % 500 AS STRING) AS key, CAST(page_id AS INT) AS ordinal,
          CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 403 WHEN page_id % 7 = 2 THEN 404 WHEN page_id % 7 = 3 THEN 503 ELSE 200 END AS status,
          CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/xml' ELSE 'text/html' END AS content_type,
          page_id % 17 = 0 AS mitigated,
          CASE WHEN page_id % 11 = 0 THEN 'Just a moment, verify you are human' WHEN page_id % 7 = 3 AND page_id % 2 = 0 THEN '' WHEN page_id % 9 = 0 THEN 'Get access to read. ' || html
            WHEN page_id % 5 = 1 THEN '<article>' || html ELSE html END AS text,
          CASE WHEN page_id % 3 = 0 THEN '' ELSE 'An abstract of the work, number ' || CAST(page_id AS STRING) END AS abstract
        FROM {pages}""",
}
_NEEDS = {name: sorted(set(re.findall(r"\{(\w+)\}", sql))) for name, sql in DERIVED.items()}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(DERIVED[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _NEEDS[name]})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(names: str, sql: str) -> str:
    """DuckDB SQL with the named derived tables in front."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', DERIVED[n])})" for n in names.split()]
    rest = sql.strip()
    head = ",\n".join(parts)
    return f"WITH {head}{',' if rest.startswith('/*more*/') else ''}\n{rest}"


class Registry(dict):
    """Queries by name, with their oracles beside them."""

    def __init__(self) -> None:
        super().__init__()
        self.oracles: dict[str, str] = {}

    def add(self, oracle_sql: str | None = None) -> Callable:
        def register(f: Callable[[SparkSession, str], DataFrame]):
            self[f.__name__] = f
            if oracle_sql:
                self.oracles[f.__name__] = oracle_sql
            return f

        return register
