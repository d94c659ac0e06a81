"""Labelled-study metrics and benchmark statistics, all as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SUPPORT = ("supported", "related", "weak", "unrelated", "unverified")
# The columns of an annotation sheet, in their order.
SHEET = (
    "run_id", "ref_key", "pred_key", "label", "page", "group_size", "prose", "sentence", "clause", "pred_existence",
    "pred_support", "evidence", "h_is_citation", "h_ref_key", "h_clause_ok", "h_exists", "h_support", "notes",
)


def yes(value: Column | str) -> Column:
    """True, false, or null for a cell that says neither."""
    value = F.lower(F.trim(F.col(value) if isinstance(value, str) else value))
    return F.when(value.isin("y", "yes", "1", "true"), True).when(value.isin("n", "no", "0", "false"), False)


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole), 4)


def marker_metrics(rows: DataFrame) -> DataFrame:
    real, predicted = yes("h_is_citation"), F.coalesce("pred_key", F.lit("")) != ""
    out = rows.where(real.isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(predicted & real).alias("tp"), F.count_if(predicted & ~real).alias("fp"), F.count_if(~predicted & real).alias("fn")
    )
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def association_metrics(rows: DataFrame) -> DataFrame:
    usable = rows.where((F.col("pred_key") != "") & yes("h_is_citation") & (F.col("h_ref_key") != ""))
    out = usable.agg(F.count("*").alias("n"), F.count_if(F.col("pred_key") == F.col("h_ref_key")).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def clause_metrics(rows: DataFrame) -> DataFrame:
    out = rows.where(yes("h_clause_ok").isNotNull()).agg(F.count("*").alias("n"), F.count_if(yes("h_clause_ok")).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def existence_per_reference(rows: DataFrame) -> DataFrame:
    """One prediction and label a reference: its last labelled row's (by row_no)."""
    usable = rows.withColumn("real", yes("h_exists")).where(F.col("real").isNotNull() & (F.col("pred_existence") != ""))
    last = W.partitionBy("run_id", "ref_key").orderBy(F.desc("row_no"))
    return usable.withColumn("at", F.row_number().over(last)).where("at = 1").select("run_id", "ref_key", "pred_existence", "real")


def existence_confusion(rows: DataFrame) -> DataFrame:
    return existence_per_reference(rows).groupBy("pred_existence", "real").agg(F.count("*").alias("n"))


def existence_rates(rows: DataFrame) -> DataFrame:
    real, is_ = F.col("real"), lambda v: F.col("pred_existence") == v
    return existence_per_reference(rows).agg(
        F.count("*").alias("n"),
        ratio(F.count_if(real & is_("not_found")), F.count_if(real)).alias("false_no_match_rate"),
        ratio(F.count_if(real & is_("unconfirmed")), F.count_if(real)).alias("unconfirmed_rate_real"),
        ratio(F.count_if(~real & is_("not_found")), F.count_if(~real)).alias("fabrication_detection_rate"),
    )


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by.., n, accuracy, kappa of two labelings (a, b): agreement beyond what the marginals give."""
    whole = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s"))
    marginal = sides.groupBy(*by, "s.label").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"))
    chance = marginal.groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    joined = whole.join(chance, by) if by else whole.crossJoin(F.broadcast(chance))  # one row each
    observed, expected = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    value = F.when(F.col("n") == 0, F.lit(None)).when(expected == 1, F.when(observed == 1, 1.0).otherwise(0.0)).otherwise(
        F.round(F.try_divide(observed - expected, 1 - expected), 4)
    )
    return joined.select(*by, "n", ratio(F.col("same"), F.col("n")).alias("accuracy"), value.alias("kappa"))


def support_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy and kappa overall (evidence '(all)') and for each kind of evidence."""
    pairs = rows.where(F.col("pred_support").isin(*SUPPORT) & F.col("h_support").isin(*SUPPORT))
    pairs = pairs.select(F.col("pred_support").alias("a"), F.col("h_support").alias("b"), F.explode(F.array(F.lit("(all)"), F.coalesce("evidence", F.lit("")))).alias("evidence"))
    return kappa(pairs, ["evidence"])


def annotator_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Kappa of two annotators' support labels on the same rows; of repeated rows of the second the last counts."""
    key = ["run_id", "ref_key", "page", "clause"]
    last = W.partitionBy(*key).orderBy(F.desc("row_no"))
    other = second.withColumn("at", F.row_number().over(last)).where("at = 1").select(*key, F.col("h_support").alias("b"))
    pairs = first.select(*key, F.col("h_support").alias("a")).join(other, key).where(F.col("a").isin(*SUPPORT) & F.col("b").isin(*SUPPORT))
    return kappa(pairs, [])


def annotation_sheet(citations: DataFrame, entries: DataFrame, claim_verdicts: DataFrame, evidence: Column) -> DataFrame:
    """One row a citation with what the machine found; the labels are left empty.  Verdicts are looked up by clause text."""
    clause = F.trim(F.when(F.coalesce("claim", F.lit("")) != "", F.col("claim")).otherwise(F.col("sentence")))
    judged = claim_verdicts.select("run_id", "key", F.trim("claim").alias("clause"), F.coalesce(F.nullif("machine_verdict", F.lit("")), "verdict").alias("pred_support"), "claim_no")
    last = W.partitionBy("run_id", "key", "clause").orderBy(F.desc("claim_no"))
    judged = judged.withColumn("at", F.row_number().over(last)).where("at = 1").drop("at", "claim_no")
    rows = citations.withColumn("clause", clause).join(entries.select("run_id", "key", F.col("existence").alias("pred_existence"), evidence.alias("evidence")), ["run_id", "key"])
    rows = rows.join(judged, ["run_id", "key", "clause"], "left")
    filled = rows.withColumns({"ref_key": F.col("key"), "pred_key": F.col("key"), "prose": F.when(F.col("prose"), "y").otherwise("n"), "pred_support": F.coalesce("pred_support", F.lit(""))})
    blank = {c: F.lit("") for c in ("h_is_citation", "h_ref_key", "h_clause_ok", "h_exists", "h_support", "notes")}
    return filled.withColumns(blank).select(*SHEET)


def level_stats(runs: DataFrame) -> DataFrame:
    """Latency statistics of benchmark levels: wall time from first start to last end, median and longest run, failures."""
    seconds = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    done = F.when(~F.col("failed"), seconds)
    return runs.groupBy("level").agg(
        ((F.unix_micros(F.max("ended")) - F.unix_micros(F.min("started"))) / 1e6).alias("wall_s"),
        F.median(done).alias("median_s"), F.max(done).alias("longest_s"),
        F.count_if("failed").alias("failed"), F.sum("timed_out").alias("timed_out"),
    )
