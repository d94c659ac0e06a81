"""Queries of the labelled study and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.operators import evaluation, report
from citelake.plans.inputs import Registry, derive, oracle, table

R = Registry()
_YES = "CASE WHEN lower(trim({0})) IN ('y','yes','1','true') THEN TRUE WHEN lower(trim({0})) IN ('n','no','0','false') THEN FALSE END"
_RATIO = "CASE WHEN ({1}) > 0 THEN round(({0})::DOUBLE / ({1}), 4) END"
_SUPPORT = "('supported','related','weak','unrelated','unverified')"


@R.add(
    oracle(
        "annotations",
        f"""/*more*/ c AS (SELECT count(*) AS n, count(*) FILTER (pred_key <> '' AND y) AS tp, count(*) FILTER (pred_key <> '' AND NOT y) AS fp, count(*) FILTER (pred_key = '' AND y) AS fn
      FROM (SELECT *, {_YES.format('h_is_citation')} AS y FROM annotations) WHERE y IS NOT NULL) SELECT *, {_RATIO.format('tp', 'tp + fp')} AS precision, {_RATIO.format('tp', 'tp + fn')} AS recall FROM c""",
    )
)
def marker_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.marker_metrics(derive(spark, sf_dir, "annotations"))


@R.add(
    oracle(
        "annotations",
        f"""/*more*/ c AS (SELECT count(*) AS n, count(*) FILTER (pred_key = h_ref_key) AS correct FROM annotations WHERE pred_key <> '' AND h_ref_key <> '' AND {_YES.format('h_is_citation')})
    SELECT *, {_RATIO.format('correct', 'n')} AS accuracy FROM c""",
    )
)
def association_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.association_metrics(derive(spark, sf_dir, "annotations"))


@R.add(
    oracle(
        "annotations",
        f"""/*more*/ c AS (SELECT count(*) AS n, count(*) FILTER (y) AS correct FROM (SELECT {_YES.format('h_clause_ok')} AS y FROM annotations) WHERE y IS NOT NULL) SELECT *, {_RATIO.format('correct', 'n')} AS accuracy FROM c""",
    )
)
def clause_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.clause_metrics(derive(spark, sf_dir, "annotations"))


# rows of one line item may share row_no; the last one then isn't certain, so row numbers are made unique first
_UNIQUE = "/*more*/ u AS (SELECT * REPLACE (row_number() OVER (ORDER BY row_no, pred_key, h_ref_key, clause, pred_support, h_support, pred_existence, h_exists, run_id, ref_key) AS row_no) FROM annotations)"
_LAST = _UNIQUE + f", l AS (SELECT run_id, ref_key, arg_max(pred_existence, row_no) AS p, arg_max(y, row_no) AS real FROM (SELECT *, {_YES.format('h_exists')} AS y FROM u) WHERE y IS NOT NULL AND pred_existence <> '' GROUP BY ALL)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with a unique row number that follows the sheet's order."""
    rows = derive(spark, sf_dir, "annotations")
    order = F.struct("row_no", "pred_key", "h_ref_key", "clause", "pred_support", "h_support", "pred_existence", "h_exists", "run_id", "ref_key")
    return rows.withColumn("row_no", order)


@R.add(oracle("annotations", _LAST + " SELECT p AS pred_existence, real, count(*) AS n FROM l GROUP BY ALL"))
def existence_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.existence_confusion(_numbered(spark, sf_dir))


@R.add(
    oracle(
        "annotations",
        _LAST
        + f""", c AS (SELECT count(*) AS n, count(*) FILTER (real) AS r, count(*) FILTER (NOT real) AS f, count(*) FILTER (real AND p = 'not_found') AS a, count(*) FILTER (real AND p = 'unconfirmed') AS b, count(*) FILTER (NOT real AND p = 'not_found') AS c FROM l)
    SELECT n, {_RATIO.format('a', 'r')} AS false_no_match_rate, {_RATIO.format('b', 'r')} AS unconfirmed_rate_real, {_RATIO.format('c', 'f')} AS fabrication_detection_rate FROM c""",
    )
)
def existence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.existence_rates(_numbered(spark, sf_dir))


def _kappa_sql(pairs: str, by: str) -> str:
    return f"""{pairs}, w AS (SELECT {by} count(*) AS n, count(*) FILTER (a = b) AS same FROM pairs {'GROUP BY ' + by.rstrip(', ') if by else ''}),
    ma AS (SELECT {by} a AS l, count(*) AS x FROM pairs GROUP BY ALL), mb AS (SELECT {by} b AS l, count(*) AS y FROM pairs GROUP BY ALL),
    ch AS (SELECT {('ma.' + by) if by else ''} sum(x * y) AS chance FROM ma JOIN mb ON ma.l = mb.l {'AND ma.evidence = mb.evidence' if by else ''} {'GROUP BY ma.evidence' if by else ''}),
    k AS (SELECT w.*, same::DOUBLE / n AS o, coalesce(chance, 0)::DOUBLE / (n * n) AS e FROM w {'LEFT JOIN ch USING (evidence)' if by else 'CROSS JOIN ch'})
    SELECT {by} n, round(o, 4) AS accuracy, CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END ELSE round((o - e) / (1 - e), 4) END AS kappa FROM k"""


@R.add(
    oracle(
        "annotations",
        _kappa_sql(
            f"""/*more*/ pairs AS (SELECT pred_support AS a, h_support AS b, unnest(['(all)', evidence]) AS evidence FROM annotations WHERE pred_support IN {_SUPPORT} AND h_support IN {_SUPPORT})""",
            "evidence, ",
        ),
    )
)
def support_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.support_metrics(derive(spark, sf_dir, "annotations"))


@R.add(
    oracle(
        "annotations",
        _kappa_sql(
            _UNIQUE
            + f""", s AS (SELECT run_id, ref_key, page, clause, arg_max(CASE WHEN row_no % 7 = 0 THEN 'weak' ELSE h_support END, row_no) AS b FROM u GROUP BY ALL),
    pairs AS (SELECT u.h_support AS a, s.b FROM u JOIN s USING (run_id, ref_key, page, clause) WHERE u.h_support IN {_SUPPORT} AND s.b IN {_SUPPORT})""",
            "",
        ),
    )
)
def annotator_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators: the second is the first with every seventh label turned to weak."""
    rows = derive(spark, sf_dir, "annotations")
    order = ["row_no", "pred_key", "h_ref_key", "clause", "pred_support", "h_support", "pred_existence", "h_exists", "run_id", "ref_key"]
    from pyspark.sql import Window as W

    # one order over the sheet of one study, as its rows stand
    first = rows.withColumn("row_no", F.row_number().over(W.orderBy(*order)))
    second = first.withColumn("h_support", F.when(F.col("row_no") % 7 == 0, "weak").otherwise(F.col("h_support")))
    return evaluation.annotator_agreement(first, second)


@R.add(
    oracle(
        "entries claim_verdicts",
        """/*more*/ c AS (SELECT run_id, key, CAST(claim_no AS VARCHAR) AS page, claim AS clause FROM claim_verdicts WHERE claim_no <= 3),
    j AS (SELECT run_id, key, claim, arg_max(CASE WHEN machine_verdict <> '' THEN machine_verdict ELSE verdict END, claim_no) AS v FROM claim_verdicts GROUP BY ALL)
    SELECT c.run_id, c.key AS ref_key, c.key AS pred_key, c.page, c.clause, e.existence AS pred_existence, coalesce(j.v, '') AS pred_support,
      CASE WHEN text_chars = 0 THEN 'none' WHEN fetched_kind IN ('pdf','fulltext-xml') THEN 'full_text' WHEN fetched_kind = 'html' THEN 'html_page' WHEN fetched_kind = 'abstract' THEN 'abstract_only' WHEN fetched_kind LIKE 'supplied%' THEN 'supplied' ELSE 'none' END AS evidence
    FROM c JOIN entries e ON e.run_id = c.run_id AND e.key = c.key LEFT JOIN j ON j.run_id = c.run_id AND j.key = c.key AND j.claim = c.clause""",
    )
)
def annotation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = derive(spark, sf_dir, "claim_verdicts")
    cites = verdicts.where("claim_no <= 3").select(
        "run_id", "key", F.lit("[1]").alias("label"), F.col("claim_no").cast("string").alias("page"), F.lit(1).alias("group_size"), F.lit(True).alias("prose"), F.lit("").alias("sentence"), F.concat(F.lit(" "), "claim").alias("claim")
    )
    sheet = evaluation.annotation_sheet(cites, derive(spark, sf_dir, "entries"), verdicts, report.coverage_category())
    return sheet.select("run_id", "ref_key", "pred_key", "page", "clause", "pred_existence", "pred_support", "evidence")


@R.add(
    """WITH r AS (SELECT user_id % 4 AS level, user_id, min(ts) AS a, max(ts) AS b, bool_or(event_type = 'error' AND value > 95) AS failed, count(*) FILTER (event_type = 'purchase' AND value > 90) AS late FROM events GROUP BY user_id)
    SELECT level, (epoch_us(max(b)) - epoch_us(min(a))) / 1e6 AS wall_s, median(CASE WHEN NOT failed THEN (epoch_us(b) - epoch_us(a)) / 1e6 END) AS median_s,
      max(CASE WHEN NOT failed THEN (epoch_us(b) - epoch_us(a)) / 1e6 END) AS longest_s, count(*) FILTER (failed) AS failed, CAST(sum(late) AS BIGINT) AS timed_out FROM r GROUP BY level"""
)
def benchmark_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 90))
    failed = F.bool_or((F.col("event_type") == "error") & (F.col("value") > 95))
    runs = events.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), failed.alias("failed"), late.alias("timed_out"))
    return evaluation.level_stats(runs.withColumn("level", F.col("user_id") % 4))
