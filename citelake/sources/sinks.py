"""Sinks: report documents, annotation sheets, benchmark results, single entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.operators.evaluation import SHEET


def report_documents(papers: DataFrame, entries: DataFrame, claim_verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """One document a run: its paper's columns and its references in key order, each with claims and flags."""
    claims = claim_verdicts.groupBy("run_id", "key").agg(F.sort_array(F.collect_list(F.struct("claim_no", "claim", "verdict"))).alias("claim_verdicts"))
    found = flags.groupBy("run_id", "key").agg(F.sort_array(F.collect_list(F.struct("flag_no", "kind", "severity", "message"))).alias("flags"))
    rows = entries.join(claims, ["run_id", "key"], "left").join(found, ["run_id", "key"], "left")
    number = F.col("key").try_cast("int")
    order = F.struct(number.isNull().alias("other"), number.alias("number"), F.col("key"))
    each = F.struct(order.alias("order"), F.struct("key", "verdict", "engine", "claim_verdicts", "flags").alias("entry"))
    tagged = rows.select("run_id", each.alias("x")).select("run_id", "x.order", F.to_json("x.entry").alias("entry"))
    listed = tagged.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("order", "entry"))).alias("refs"))
    documents = papers.join(listed, "run_id", "left")
    return documents.select(*papers.columns, F.transform("refs", lambda y: y["entry"]).alias("references"))


def write_reports(documents: DataFrame, path: str) -> None:
    """One folder a run, of one JSON document each."""
    documents.write.mode("overwrite").partitionBy("run_id").json(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.select(*SHEET).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_levels(levels: DataFrame, path: str) -> None:
    levels.write.mode("overwrite").json(path)


def single_entry(documents: DataFrame, run_id: str, key: str) -> DataFrame:
    """One entry of one report, as a reply to a change of it."""
    rows = documents.where(F.col("run_id") == run_id).select("run_id", F.explode("references").alias("entry"))
    return rows.where(F.get_json_object("entry", "$.key") == key)
