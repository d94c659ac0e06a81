"""All registered queries of the citation-audit operators, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citelake.plans import evaluation_queries, existence_queries, judging_queries, report_queries, stream_queries, text_queries

FLAGSHIP = "judge_claims"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (judging_queries, report_queries, existence_queries, evaluation_queries, text_queries, stream_queries):
    QUERIES |= _module.R
    ORACLE_SQL |= _module.R.oracles
