"""Streaming queries over the event table, and the report document sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.functions.partitions import shared_dir
from citelake.plans.inputs import Registry, derive, oracle
from citelake.sources import sinks
from citelake.streaming import events as ev

R = Registry()
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of progress events: a user's events are a run's log."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", False).parquet(sf_dir)
    return raw.select(
        F.concat(F.lit("r"), F.col("user_id")).alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("value").alias("percent"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def _run(stream: DataFrame, mode: str) -> DataFrame:
    return ev.collect_into(stream, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}", mode)


@R.add(
    """SELECT 'r' || user_id AS run_id, count(*) AS n, arg_max(event_type, event_id) AS stage, arg_max(value, event_id) AS percent, bool_or(event_type = 'error') AS ended FROM events GROUP BY user_id"""
)
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(ev.progress(_stream(spark, sf_dir)), "complete")
    return out.select("run_id", "n", "last.stage", "last.percent", "ended")


@R.add("SELECT 'r' || user_id AS run_id, event_id AS seq, event_type AS stage FROM events")
def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, though each is sent twice."""
    stream = _stream(spark, sf_dir)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _run(ev.once(twice), "append").select("run_id", "seq", "stage")


@R.add("SELECT date_trunc('day', ts) AS start, event_type AS stage, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(ev.windowed(_stream(spark, sf_dir)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "stage", "n", F.round("total", 4).alias("total"))


@R.add(
    oracle(
        "entries claim_verdicts flags",
        """/*more*/ c AS (SELECT run_id, key, count(*) AS n FROM claim_verdicts GROUP BY ALL), f AS (SELECT run_id, key, count(*) AS n FROM flags GROUP BY ALL)
    SELECT e.run_id, CAST(row_number() OVER (PARTITION BY e.run_id ORDER BY CAST(e.key AS INT)) - 1 AS INT) AS place, e.key, e.verdict, CAST(coalesce(c.n, 0) AS INT) AS n_claims, CAST(coalesce(f.n, 0) AS INT) AS n_flags
    FROM entries e LEFT JOIN c ON c.run_id = e.run_id AND c.key = e.key LEFT JOIN f ON f.run_id = e.run_id AND f.key = e.key""",
    )
)
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report documents, read back entry by entry."""
    entries = derive(spark, sf_dir, "entries")
    papers = entries.select("run_id").distinct().withColumn("source_pdf", F.concat("run_id", F.lit(".pdf")))
    documents = sinks.report_documents(papers, entries, derive(spark, sf_dir, "claim_verdicts"), derive(spark, sf_dir, "flags"))
    rows = documents.select("run_id", F.posexplode("references").alias("place", "entry"))
    got = F.from_json("entry", "key string, verdict string, claim_verdicts array<string>, flags array<string>")
    size = lambda c: F.coalesce(F.size(F.col(f"g.{c}")), F.lit(0))
    return rows.select("run_id", "place", got.alias("g")).select("run_id", "place", "g.key", "g.verdict", F.greatest(size("claim_verdicts"), F.lit(0)).alias("n_claims"), F.greatest(size("flags"), F.lit(0)).alias("n_flags"))
