"""Queries over reports: tallies, coverage, engines, risk, order, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.operators import judging, report
from citelake.plans.inputs import Registry, derive, oracle

R = Registry()
CONCERN = "CASE verdict WHEN 'unrelated' THEN 5 WHEN 'not_found' THEN 5 WHEN 'weak' THEN 4 WHEN 'unverified' THEN 3 WHEN 'blocked' THEN 3 WHEN 'related' THEN 2 WHEN 'supported' THEN 1 ELSE 0 END"
HELD = """/*more*/ held AS (
    SELECT DISTINCT run_id, key, verdict FROM (
        SELECT run_id, key, verdict FROM claim_verdicts UNION ALL
        SELECT run_id, key, verdict FROM entries e WHERE reviewed_source = 'reference'
            OR NOT EXISTS (SELECT 1 FROM claim_verdicts c WHERE c.run_id = e.run_id AND c.key = e.key)) WHERE verdict <> '')"""


@R.add(oracle("entries", "SELECT run_id, verdict, count(*) AS n FROM entries GROUP BY ALL"))
def tally_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tally(derive(spark, sf_dir, "entries"))


@R.add(oracle("claim_verdicts", "SELECT run_id, verdict, count(*) AS n FROM claim_verdicts GROUP BY ALL"))
def tally_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tally(derive(spark, sf_dir, "claim_verdicts"))


@R.add(oracle("entries claim_verdicts", HELD + " SELECT run_id, verdict, count(*) AS n FROM held GROUP BY ALL"))
def references_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.references_with(derive(spark, sf_dir, "entries"), derive(spark, sf_dir, "claim_verdicts"))


@R.add(
    oracle(
        "entries claim_verdicts flags",
        """/*more*/ high AS (SELECT DISTINCT run_id, key FROM flags WHERE severity = 'high'),
    c AS (SELECT run_id, count(*) AS claims_judged, count(override) AS claims_reviewed FROM claim_verdicts GROUP BY run_id)
    SELECT e.run_id, count(*) AS references_checked, count(*) FILTER (retracted) AS retracted,
      count(*) FILTER (retracted AND reviewed_verdict = '') AS retracted_open, count(*) FILTER (verdict = 'not_found') AS not_found,
      count(*) FILTER (rechecked) AS rechecked, count(*) FILTER (reviewed_source <> '') AS reviewed, count(h.key) AS flagged,
      count(h.key) FILTER (reviewed_verdict = '') AS flagged_open, coalesce(max(claims_judged), 0) AS claims_judged, coalesce(max(claims_reviewed), 0) AS claims_reviewed
    FROM entries e LEFT JOIN high h ON e.run_id = h.run_id AND e.key = h.key LEFT JOIN c ON c.run_id = e.run_id GROUP BY e.run_id""",
    )
)
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counters(*(derive(spark, sf_dir, n) for n in ("entries", "claim_verdicts", "flags")))


@R.add(
    oracle(
        "entries",
        """/*more*/ cats AS (SELECT unnest(['full_text','html_page','abstract_only','supplied','none']) AS category),
    runs AS (SELECT DISTINCT run_id FROM entries),
    e AS (SELECT run_id, CASE WHEN text_chars = 0 THEN 'none' WHEN fetched_kind IN ('pdf','fulltext-xml') THEN 'full_text' WHEN fetched_kind = 'html' THEN 'html_page'
      WHEN fetched_kind = 'abstract' THEN 'abstract_only' WHEN fetched_kind LIKE 'supplied%' THEN 'supplied' ELSE 'none' END AS category FROM entries)
    SELECT r.run_id, c.category, count(e.category) AS n FROM runs r CROSS JOIN cats c LEFT JOIN e ON e.run_id = r.run_id AND e.category = c.category GROUP BY ALL""",
    )
)
def coverage_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage(derive(spark, sf_dir, "entries"))


@R.add(
    oracle(
        "claim_verdicts",
        f"""SELECT run_id, key, arg_max(verdict, {CONCERN} * 1000 - claim_no) AS worst, arg_min(verdict, {CONCERN} * 1000 + claim_no) AS mildest
    FROM claim_verdicts GROUP BY run_id, key""",
    )
)
def citation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.roll_up(derive(spark, sf_dir, "claim_verdicts"), ["run_id", "key"])


@R.add(
    oracle(
        "claim_verdicts",
        """/*more*/ t AS (SELECT run_id, key, verdict, count(*) AS n FROM claim_verdicts GROUP BY ALL)
    SELECT run_id, key, string_agg(verdict || '=' || n, ',' ORDER BY list_position(['supported','related','weak','unrelated','unverified','blocked','not_found'], verdict)) AS tally FROM t GROUP BY run_id, key""",
    )
)
def claim_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.claim_tally(derive(spark, sf_dir, "claim_verdicts"))
    shown = F.transform(F.map_entries("claim_tally"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("run_id", "key", F.array_join(shown, ",").alias("tally"))


@R.add(
    oracle(
        "entries",
        """/*more*/ t AS (SELECT run_id, arg_min(engine, CAST(key AS INT)) FILTER (engine NOT IN ('', 'lexical')) AS first,
      count(*) FILTER (engine NOT IN ('', 'lexical')) AS n, count(*) FILTER (engine <> '') AS m FROM entries GROUP BY run_id)
    SELECT run_id, coalesce(first, 'lexical') AS engine, n AS references_judged_by_model, m AS references_judgeable,
      CASE WHEN m = 0 THEN '' WHEN n = 0 THEN 'OpenAI judging was enabled but produced no verdicts; every result is lexical word overlap.'
        WHEN n < m THEN 'OpenAI judged ' || n || ' of ' || m || ' references with retrievable text; the rest is lexical word overlap.' ELSE '' END AS engine_note FROM t""",
    )
)
def engine_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.engine_outcome(derive(spark, sf_dir, "entries"))


def _risk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters made to reach every level: runs differ in what was found, read and judged."""
    return spark.sql(RISK_STATS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


RISK_STATS = """
    SELECT CAST(c_custkey AS STRING) AS run_id, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 50 + 1 END AS references_checked,
      CASE WHEN c_custkey % 18 = 0 THEN 0 ELSE 5 END AS citations_found, CASE WHEN c_custkey % 27 = 0 THEN 0 ELSE 5 END AS references_parsed,
      CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 30 + 1 END AS claims_judged, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 3 ELSE 0 END AS retracted_open,
      CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS not_found, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 ELSE 0 END AS n_unrelated,
      CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS n_weak, CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 3 + 1 ELSE 0 END AS flagged_open,
      CASE WHEN c_custkey % 3 = 0 THEN 40 ELSE 1 END AS n_unverified, CASE WHEN c_custkey % 11 = 0 THEN c_custkey % 2 + 1 ELSE 0 END AS reviewed
    FROM {customer}"""


@R.add(
    f"""WITH s AS ({RISK_STATS.replace("{customer}", "customer")}),
    t AS (SELECT *, greatest(1, CASE WHEN claims_judged > 0 THEN claims_judged ELSE references_checked END) AS checked,
      CASE WHEN claims_judged > 0 THEN 'citation' ELSE 'reference' END AS noun, n_unrelated + n_weak AS wrong FROM s),
    u AS (SELECT *, CASE WHEN checked = 1 THEN noun ELSE noun || 's' END AS nouns, CASE WHEN references_checked = 0 THEN 'review' WHEN retracted_open > 0 OR not_found > 0 THEN 'critical'
      WHEN wrong > 0 OR flagged_open > 0 THEN 'concern' WHEN n_unverified > 0.4 * checked THEN 'review' ELSE 'clear' END AS level FROM t),
    v AS (SELECT *, list_filter([
        CASE WHEN retracted_open = 1 THEN '1 reference is retracted' WHEN retracted_open > 1 THEN retracted_open || ' references are retracted' END,
        CASE WHEN not_found = 1 THEN '1 reference could not be found in any index' WHEN not_found > 1 THEN not_found || ' references could not be found in any index' END,
        CASE WHEN wrong > 0 THEN wrong || ' ' || noun || CASE WHEN wrong = 1 THEN '' ELSE 's' END || ' may not say what they are cited for' END,
        CASE WHEN flagged_open = 1 THEN '1 reference carries a high-severity flag' WHEN flagged_open > 1 THEN flagged_open || ' references carry a high-severity flag' END,
        CASE WHEN level = 'review' AND n_unverified > 0.4 * checked THEN n_unverified || ' of ' || checked || ' ' || nouns || ' could not be verified' END], lambda x: x IS NOT NULL) AS found FROM u)
    SELECT run_id, level, CASE WHEN references_checked = 0 THEN 'Nothing was checked: ' || CASE WHEN citations_found = 0 THEN 'no in-text citation markers were recognised in the body text'
        WHEN references_parsed = 0 THEN 'the bibliography could not be read, so no marker had anything to match against' ELSE 'none of the in-text markers matched an entry in the bibliography' END
        || '.|This is not a clean result: the paper was not screened.'
      ELSE CASE WHEN len(found) = 0 THEN 'No integrity problems were found in the ' || checked || ' ' || nouns || ' checked' ELSE array_to_string(found, '|') END
        || CASE WHEN reviewed = 1 THEN '|1 verdict was set by hand after review' WHEN reviewed > 1 THEN '|' || reviewed || ' verdicts were set by hand after review' ELSE '' END END AS headlines FROM v"""
)
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.risk(_risk_stats(spark, sf_dir))
    return out.select("run_id", "level", F.array_join("headlines", "|").alias("headlines"))


@R.add(
    oracle(
        "entries flags",
        """/*more*/ high AS (SELECT run_id, key, arg_min(message, flag_no) AS message FROM flags WHERE severity = 'high' GROUP BY run_id, key),
    m AS (SELECT DISTINCT run_id, 0 AS part, 0 AS k, 0 AS sub, 'base warning of ' || run_id AS message FROM entries
      UNION ALL SELECT run_id, 1, CAST(key AS INT), 0, '[' || key || '] ' || note FROM entries WHERE timed_out AND note <> ''
      UNION ALL SELECT e.run_id, 1, CAST(e.key AS INT), 1, '[' || e.key || '] ' || h.message || CASE WHEN rechecked THEN ' (re-checked since)' ELSE '' END
        FROM entries e JOIN high h ON e.run_id = h.run_id AND e.key = h.key WHERE reviewed_verdict = '')
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY part, k, sub) AS INT) AS place, message FROM m""",
    )
)
def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derive(spark, sf_dir, "entries")
    base = entries.select("run_id").distinct().select("run_id", F.lit(0).alias("place"), F.concat(F.lit("base warning of "), "run_id").alias("message"))
    return report.warnings(base, entries, derive(spark, sf_dir, "flags"))


@R.add(
    oracle(
        "entries claim_verdicts flags",
        HELD
        + f""", h AS (SELECT run_id, key, max(CASE WHEN verdict = 'not_found' THEN 6 ELSE {CONCERN} END) AS held FROM held GROUP BY run_id, key),
    f AS (SELECT DISTINCT run_id, key FROM flags WHERE severity = 'high'),
    u AS (SELECT e.run_id, e.key, CAST(greatest(coalesce(held, 0), CASE WHEN retracted THEN 6.5 ELSE 0 END, CASE WHEN f.key IS NULL THEN 0 ELSE 4.5 END) AS DOUBLE) AS urgency
      FROM entries e LEFT JOIN h ON e.run_id = h.run_id AND e.key = h.key LEFT JOIN f ON e.run_id = f.run_id AND e.key = f.key)
    SELECT run_id, key, urgency, CAST(row_number() OVER (PARTITION BY run_id ORDER BY urgency DESC, CAST(key AS INT)) AS INT) AS place FROM u""",
    )
)
def urgency_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.urgency(*(derive(spark, sf_dir, n) for n in ("entries", "claim_verdicts", "flags")))


@R.add(oracle("entries claim_verdicts", HELD + " SELECT e.run_id, e.key, e.verdict FROM entries e SEMI JOIN held h ON h.run_id = e.run_id AND h.key = e.key AND h.verdict = 'unrelated'"))
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.section(derive(spark, sf_dir, "entries"), derive(spark, sf_dir, "claim_verdicts"), "unrelated").select("run_id", "key", "verdict")


@R.add(oracle("entries", "SELECT run_id, key, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CAST(key AS INT)) AS INT) AS place FROM entries QUALIFY place <= 40"))
def reference_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.capped(derive(spark, sf_dir, "entries"), 40).select("run_id", "key", "place")


LADDER = """SELECT CAST(p_partkey AS STRING) AS key, CASE p_partkey % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'unconfirmed' ELSE 'confirmed' END AS existence,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'u' END AS url, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'a' END AS abstract, p_size % 3 = 0 AS fetch_ok,
    p_size % 4 = 1 AS dead, CASE WHEN p_size % 5 = 0 THEN 'url' ELSE 'doi' END AS identifier_printed, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 900 END AS text_chars, p_size % 6 = 0 AS blocked FROM {part}"""


@R.add(
    f"""SELECT key, CASE WHEN existence = 'not_found' THEN 'not_found' WHEN url = '' AND abstract = '' THEN 'unverified'
      WHEN NOT fetch_ok AND dead AND identifier_printed = 'url' THEN 'not_found' WHEN text_chars = 0 AND blocked THEN 'blocked' WHEN text_chars = 0 THEN 'unverified' ELSE 'judge' END AS step
    FROM ({LADDER.replace("{part}", "part")})"""
)
def check_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(LADDER, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return rows.select("key", report.check_ladder().alias("step"))


@R.add("SELECT p_partkey, greatest(180.0, 60.0 * p_size / greatest(1, p_partkey % 5)) AS budget FROM part")
def time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", report.time_budget(F.col("p_size"), F.col("p_partkey") % 5).alias("budget"))


@R.add(
    oracle(
        "entries",
        """SELECT run_id, key, CASE WHEN timed_out THEN 'unverified' ELSE verdict END AS verdict, timed_out,
      CASE WHEN timed_out THEN 'This reference was not finished in time (last step: lookup).' ELSE '' END AS note FROM entries""",
    )
)
def timed_out_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derive(spark, sf_dir, "entries")
    return report.with_stand_ins(entries.select("run_id", "key", F.lit("lookup").alias("stage")), entries.where("not timed_out"))


MACHINE = """/*more*/ a AS (SELECT e.run_id, a.* FROM actions a JOIN entries e ON a.key = e.key),
    last_e AS (SELECT run_id, key, arg_max(kind, action_no) AS kind, arg_max(verdict, action_no) AS v FROM a WHERE claim_no IS NULL AND kind IN ('set','clear') GROUP BY run_id, key),
    last_c AS (SELECT run_id, key, claim_no, arg_max(kind, action_no) AS kind, arg_max(verdict, action_no) AS v FROM a WHERE claim_no IS NOT NULL AND kind IN ('set','clear') GROUP BY run_id, key, claim_no),
    c AS (SELECT c.run_id, c.key, c.claim_no, l.v IS NOT NULL AS edited, coalesce(l.v, c.verdict) AS verdict FROM claim_verdicts c
      LEFT JOIN last_c l ON l.run_id = c.run_id AND l.key = c.key AND l.claim_no = c.claim_no AND l.kind = 'set')"""


@R.add(
    oracle(
        "entries claim_verdicts actions",
        MACHINE
        + f""", r AS (SELECT run_id, key, bool_or(edited) AS edited, arg_max(verdict, {CONCERN} * 1000 - claim_no) AS worst, arg_min(verdict, {CONCERN} * 1000 + claim_no) AS mildest FROM c GROUP BY run_id, key)
    SELECT e.run_id, e.key, e.verdict AS machine_verdict, CASE WHEN l.v IS NOT NULL THEN l.v WHEN r.edited THEN CASE WHEN e.engine NOT IN ('', 'lexical') THEN worst ELSE mildest END ELSE e.verdict END AS verdict,
      CASE WHEN l.v IS NOT NULL THEN 'reference' WHEN r.edited THEN 'claims' ELSE '' END AS reviewed_source
    FROM entries e LEFT JOIN r ON r.run_id = e.run_id AND r.key = e.key LEFT JOIN last_e l ON l.run_id = e.run_id AND l.key = e.key AND l.kind = 'set'""",
    )
)
def override_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derive(spark, sf_dir, "entries")
    actions = derive(spark, sf_dir, "actions").join(entries.select("run_id", "key"), "key")
    return report.settle(entries, derive(spark, sf_dir, "claim_verdicts"), actions)


@R.add(
    oracle(
        "entries actions",
        """/*more*/ n AS (SELECT key, arg_max(verdict, action_no) AS v, arg_max(CASE WHEN action_no % 3 = 0 THEN '' ELSE 'lexical' END, action_no) AS g FROM actions WHERE kind = 'recheck' GROUP BY key)
    SELECT run_id, e.key, CASE WHEN n.key IS NULL OR g = '' THEN e.verdict ELSE n.v END AS verdict, CASE WHEN n.key IS NULL OR g = '' THEN e.engine ELSE g END AS engine,
      CASE WHEN n.key IS NULL THEN '' WHEN g = '' THEN 'nothing_retrieved' ELSE 'replaced' END AS outcome FROM entries e LEFT JOIN n ON n.key = e.key""",
    )
)
def barren_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derive(spark, sf_dir, "entries")
    again = derive(spark, sf_dir, "actions").where("kind = 'recheck'").join(entries.select("run_id", "key"), "key")
    again = again.withColumn("engine", F.when(F.col("action_no") % 3 == 0, "").otherwise("lexical"))
    return report.recheck(entries, again)


@R.add(
    oracle(
        "claim_verdicts",
        """/*more*/ n AS (SELECT run_id, key, claim AS wanted, 'supported' AS v FROM claim_verdicts WHERE claim_no = 2 AND CAST(key AS INT) % 3 = 0),
    m AS (SELECT run_id, key, 1 AS claim_no, 'weak' AS v FROM claim_verdicts WHERE claim_no = 1 AND CAST(key AS INT) % 3 = 1)
    SELECT c.run_id, c.key, c.claim_no, coalesce(n.v, m.v, c.verdict) AS verdict FROM claim_verdicts c
      LEFT JOIN (SELECT DISTINCT * FROM n) n ON n.run_id = c.run_id AND n.key = c.key AND n.wanted = c.claim LEFT JOIN m ON m.run_id = c.run_id AND m.key = c.key AND m.claim_no = c.claim_no""",
    )
)
def claim_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derive(spark, sf_dir, "claim_verdicts")
    key = F.col("key").cast("int") % 3
    by_text = claims.where((F.col("claim_no") == 2) & (key == 0)).select("run_id", "key", "claim_no", F.concat(F.lit(" "), "claim").alias("text"), F.lit("supported").alias("verdict"))
    by_number = claims.where((F.col("claim_no") == 1) & (key == 1)).select("run_id", "key", "claim_no", F.lit("words of no claim").alias("text"), F.lit("weak").alias("verdict"))
    return report.recheck_claims(claims, by_text.unionByName(by_number)).select("run_id", "key", "claim_no", "verdict")


@R.add(oracle("entries", "SELECT run_id, key, CASE WHEN engine = 'openai' THEN 'openai' ELSE 'lexical' END AS engine FROM entries"))
def engine_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "entries").select("run_id", "key", report.engine_label(F.col("engine"), F.lit("lexical")).alias("engine"))


@R.add(
    """WITH r AS (SELECT CASE WHEN user_id % 7 = 0 THEN 'notes' ELSE '20240101-000000-' || lpad(CAST(user_id % 1000000 AS VARCHAR), 6, '0') END AS name, max(ts) AS mtime, bool_or(event_type = 'error' AND value > 90) AS running FROM events GROUP BY 1)
    SELECT name FROM r WHERE name <> 'notes' AND NOT running AND mtime < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 36 HOUR"""
)
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("user_id") % 7 == 0, "notes").otherwise(F.concat(F.lit("20240101-000000-"), F.lpad((F.col("user_id") % 1000000).cast("string"), 6, "0")))
    runs = events.select(name.alias("name"), F.col("ts").alias("mtime"), ((F.col("event_type") == "error") & (F.col("value") > 90)).alias("running"))
    return report.expired(runs, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 36)


@R.add("SELECT doc_id, substr(text, greatest(1, instr(text, 'the ') - 1200) , 2400) AS excerpt FROM documents WHERE instr(text, 'the ') > 0")
def quote_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.instr("text", "the ") > 0)
    return docs.select("doc_id", report.excerpt_around(F.col("text"), F.lit("the ")).alias("excerpt"))
