"""Queries that judge benchmark items as claims against the sentences of documents, and the model tier's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.audit import Audit, no_broadcasts
from citelake.functions.text import STOP_WORDS, SUFFIXES, tokens
from citelake.functions.partitions import spread, stage
from citelake.operators import judging
from citelake.plans.inputs import Registry, derive, oracle, table

R = Registry()

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _stem_sql(w: str) -> str:
    tests = " ".join(f"WHEN length({w}) > {len(s) + 3} AND suffix({w}, '{s}') THEN left({w}, length({w}) - {len(s)})" for s in SUFFIXES)
    return f"CASE {tests} ELSE {w} END"


def _tokens_sql(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z][a-z0-9\\-]+')"
    return f"list_transform(list_filter({words}, lambda w: length(w) > 2 AND w NOT IN ({_STOP})), lambda w: {_stem_sql('w')})"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_no"), "text")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of over 40 characters of every document."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.!?]\s+")).alias("pos", "text"))
    return split.where(F.length("text") > 40)


#: Tokens of claims and passages, document frequencies, and overlaps, written from the rules.
BASE = f"""WITH p AS (SELECT doc_id, pos - 1 AS pos, text FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '[.!?]\\s+'), 1) AS pos FROM documents) WHERE length(text) > 40),
    n AS (SELECT count(*) AS n FROM p),
    pt AS MATERIALIZED (SELECT DISTINCT doc_id, pos, token FROM (SELECT doc_id, pos, unnest({_tokens_sql('text')}) AS token FROM p)),
    ct AS MATERIALIZED (SELECT DISTINCT claim_no, token FROM (SELECT item_id AS claim_no, unnest({_tokens_sql('text')}) AS token FROM benchmark)),
    df AS (SELECT token, count(*) AS df FROM pt WHERE token IN (SELECT token FROM ct) GROUP BY token),
    w AS (SELECT ct.claim_no, ct.token, CASE WHEN df IS NULL THEN 1.0 ELSE ln(1 + n::DOUBLE / (1 + df)) END AS idf FROM ct CROSS JOIN n LEFT JOIN df ON df.token = ct.token),
    t AS (SELECT claim_no, sum(idf) AS total FROM w GROUP BY claim_no),
    h AS (SELECT claim_no, doc_id, pos, sum(idf) AS hit FROM w JOIN pt USING (token) GROUP BY ALL),
    s AS (SELECT claim_no, doc_id, pos, round(hit / total, 9) AS score FROM h JOIN t USING (claim_no)),
    r AS (SELECT *, row_number() OVER (PARTITION BY claim_no ORDER BY score DESC, doc_id, pos) AS rank FROM s),
    b AS (SELECT claim_no, max(score) AS best, sum(score) / least(3, max(n)) AS mean, max(CASE WHEN rank = 1 THEN doc_id END) AS doc_id, max(CASE WHEN rank = 1 THEN pos END) AS pos FROM r CROSS JOIN n WHERE rank <= 3 GROUP BY claim_no),
    j AS (SELECT t.claim_no, 0.72 * coalesce(best, 0) + 0.28 * coalesce(mean, 0) AS score, doc_id AS best_doc_id, CAST(pos AS INT) AS best_pos FROM t LEFT JOIN b USING (claim_no))"""
_VERDICT = "CASE WHEN score >= 0.52 THEN 'supported' WHEN score >= 0.34 THEN 'related' WHEN score >= 0.18 THEN 'weak' ELSE 'unverified' END"


@R.add(f"{BASE} SELECT claim_no, round(score, 4) AS score, {_VERDICT} AS verdict, best_doc_id, best_pos FROM j")
def judge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every claim against every passage of the corpus, blended over the three best, judged."""
    out = judging.lexical_support(_claims(spark, sf_dir), _passages(spark, sf_dir), [], ["claim_no"], ["doc_id", "pos"], phrase=False)
    return out.withColumn("score", F.round("score", 4))


@R.add(f"{BASE} SELECT token, df, round(ln(1 + n::DOUBLE / (1 + df)), 6) AS idf FROM df CROSS JOIN n")
def idf_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _passages(spark, sf_dir)
    wanted = _claims(spark, sf_dir).select(F.explode(tokens("text")).alias("token")).distinct()
    held = windows.select("doc_id", "pos", F.explode(F.array_distinct(tokens("text"))).alias("token")).join(wanted, "token")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    n = windows.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.ln(1 + F.col("n") / (1 + F.col("df"))), 6).alias("idf"))  # n is one row


@R.add(f"{BASE} SELECT claim_no, CAST(rank AS INT) AS rank, doc_id, CAST(pos AS INT) AS pos, round(score, 4) AS overlap FROM r WHERE rank <= 3")
def top_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    scored = judging.overlap_scores(_claims(spark, sf_dir), _passages(spark, sf_dir), [], ["claim_no"], ["doc_id", "pos"])
    order = W.partitionBy("claim_no").orderBy(F.round("overlap", 9).desc(), "doc_id", "pos")
    top = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    return top.select("claim_no", "rank", "doc_id", "pos", F.round("overlap", 4).alias("overlap"))


@R.add(
    f"""{BASE}, q AS (SELECT ct.claim_no, ct.token, df, row_number() OVER (PARTITION BY ct.claim_no ORDER BY df, ct.token) AS rank FROM ct JOIN df USING (token))
    SELECT claim_no, CAST(rank AS INT) AS rank, token FROM q WHERE rank <= 10"""
)
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _passages(spark, sf_dir).select(F.struct("doc_id", "pos").alias("passage_no"), "text")
    return judging.shared_terms(_claims(spark, sf_dir), windows, []).select("claim_no", "rank", "token")


@R.add(f"SELECT l_orderkey, l_linenumber, l_discount * 10 AS score, {_VERDICT} AS verdict FROM (SELECT *, l_discount * 10 AS score FROM lineitem)")
def verdict_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"), judging.verdict_of(score).alias("verdict"))


@R.add(f"SELECT doc_id, len({_tokens_sql('text')}) AS n_tokens, array_to_string({_tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("tokens"))


@R.add()
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed passages of every document (sequential packing: checked in the unit tests)."""
    return judging.passages(table(spark, sf_dir, "documents"), ["doc_id"])


@R.add()
def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's packed passages and header against the claim that its number links it to, with the fuzzy phrase term."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("").alias("abstract"), F.concat_ws(" ", "source", "lang").alias("title"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    n = items.agg(F.greatest(F.count("*"), F.lit(1))).first()[0]
    claims = docs.select("doc_id", (F.col("doc_id") % n).alias("item_id")).join(items, "item_id").select("doc_id", F.col("item_id").alias("claim_no"), F.col("claim").alias("text"))
    windows = judging.passages(spread(docs), ["doc_id"]).unionByName(judging.header_passage(docs, ["doc_id"]))
    return judging.lexical_support(claims, windows, ["doc_id"], ["claim_no"], ["passage_no"])


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    verdict = F.element_at(F.array(*(F.lit(v) for v in ("supported", "WEAK", "unrelated", "nonsense"))), (item % 4 + 1).cast("int"))
    reply = F.concat(F.lit('Sure: {"verdict": "'), verdict, F.lit('", "confidence": 0.5, "reason": "r", "evidence_quote": "q"} thanks'))
    return table(spark, sf_dir, "benchmark").select(
        (item % 10).cast("string").alias("run_id"), F.lit("k").alias("key"), item.alias("claim_no"), F.when((item % 10 == 3) | (item % 7 == 0), F.lit(None)).otherwise(reply).alias("reply")
    )


@R.add(
    """WITH c AS (SELECT CAST(item_id % 10 AS VARCHAR) AS run_id, item_id AS claim_no, CASE WHEN item_id % 10 = 3 OR item_id % 7 = 0 THEN NULL ELSE
        CASE item_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'weak' WHEN 2 THEN 'unrelated' ELSE 'unverified' END END AS v,
        row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) AS place FROM benchmark),
    a AS (SELECT *, count(v) OVER (PARTITION BY run_id) AS answered FROM c WHERE place <= 6)
    SELECT run_id, claim_no, CASE WHEN answered = 0 THEN 'related' ELSE coalesce(v, 'unverified') END AS verdict, CASE WHEN answered = 0 THEN 'lexical' ELSE 'openai' END AS engine FROM a"""
)
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = _replies(spark, sf_dir)
    claims = replies.select("run_id", "key", "claim_no")
    return judging.judge_replies(claims, replies, claims.withColumn("verdict", F.lit("related")), ["run_id", "key"]).drop("key")


@R.add(
    """SELECT item_id, CASE WHEN item_id % 3 < 2 AND length(text) >= 120 AND item_id % 2 = 0 THEN 'related' ELSE CASE item_id % 3 WHEN 0 THEN 'weak' WHEN 1 THEN 'unrelated' ELSE 'supported' END END AS verdict,
      item_id % 3 < 2 AND length(text) >= 120 AND item_id % 2 = 0 AS reconsidered FROM benchmark"""
)
def second_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    verdict = F.when(item % 3 == 0, "weak").when(item % 3 == 1, "unrelated").otherwise("supported")
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", verdict.alias("verdict"), F.col("text").alias("abstract"), F.lit("full text").alias("source_text"), F.when(item % 2 == 0, "related").otherwise("unrelated").alias("second_verdict")
    )
    return judging.second_look(rows).select("item_id", "verdict", "reconsidered")


@R.add(
    """SELECT item_id, CASE WHEN length(text) < 120 AND (item_id % 2 = 0) THEN NULL ELSE 'CLAIM: ' || text || chr(10) || CASE WHEN item_id % 3 > 0 THEN 'CITED TOGETHER WITH ' || (item_id % 3) || ' OTHERS' || chr(10) ELSE '' END
      || 'REFERENCE: ref' || chr(10) || 'TITLE: t' || CASE WHEN item_id % 2 = 1 THEN chr(10) || 'ABSTRACT: ' || repeat('a', 130) ELSE '' END || chr(10) || 'EXCERPT: ' || text END AS prompt FROM benchmark"""
)
def judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    abstract: Column = F.when(item % 2 == 1, F.repeat(F.lit("a"), 130)).otherwise("")
    rows = table(spark, sf_dir, "benchmark").withColumns({"context": F.lit(""), "co_cited": item % 3 + 1, "reference": F.lit("ref"), "title": F.lit("t")})
    return rows.select("item_id", judging.prompt(F.col("text"), abstract).alias("prompt"))


@R.add(
    """WITH s AS (SELECT l_orderkey AS key, l_linenumber AS n, round(l_discount * 10, 6) AS score FROM lineitem), b AS (SELECT key, max(score) AS m FROM s GROUP BY key)
    SELECT b.key, CAST(min(n) AS INT) AS claim_no, round(m, 3) AS score, CASE WHEN round(m, 3) >= 0.52 THEN 'supported' WHEN round(m, 3) >= 0.34 THEN 'related' WHEN round(m, 3) >= 0.18 THEN 'weak' ELSE 'unverified' END AS verdict FROM b JOIN s ON s.key = b.key AND s.score = m GROUP BY b.key, m"""
)
def best_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("claim_no"), F.round(F.col("l_discount") * 10, 6).alias("score"))
    return judging.best_claim(rows, ["key"])


@R.add()
def audit_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit over manuscripts made of parts: texts in, risk out (checked end to end in the unit tests)."""
    audit = audit_of_parts(spark, sf_dir)
    risk = audit.risk.select("run_id", "level", F.array_join("headlines", "|").alias("headlines"))
    with no_broadcasts(spark):
        out = stage(risk)
    audit.close()
    return out


def audit_of_parts(spark: SparkSession, sf_dir: str) -> Audit:
    """Manuscripts of ten numbered references each: the body cites them by number, sources hold the same words or others."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_name", "p_brand", "p_size", F.expr("cast(floor(p_partkey / 10) as string)").alias("run_id"), (F.col("p_partkey") % 10 + 1).alias("n"))
    sentence = F.concat(F.lit("It was shown at length that "), "p_name", F.lit(" improves the output of every plant in use ["), "n", F.lit("]."))
    entry = F.concat(F.lit("["), "n", F.lit("] J. Smith and A. Doe. A study of "), "p_name", F.lit(" in plants. Journal of "), "p_brand", F.lit(", 12(3):1-20, "), F.lit(1990) + F.col("p_size") % 30, F.lit("."))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", c.alias("x")))), lambda y: y["x"]), "\n")
    texts = part.groupBy("run_id").agg(listed(sentence).alias("body"), listed(entry).alias("refs"))
    texts = texts.select("run_id", F.concat("body", F.lit("\nReferences\n"), "refs").alias("text"))
    key = F.col("n").cast("string").alias("key")
    replies = part.select("run_id", key, F.explode(F.array(F.lit("Crossref"), F.lit("OpenAlex"))).alias("index"), F.when(F.col("p") % 9 == 0, F.lit(None)).otherwise(200).cast("int").alias("status"), (F.col("p") % 7 > 0).alias("found"))
    same = F.concat(F.lit("We show that "), "p_name", F.lit(" improves the output of every plant in use, at length and in all tests that were made."))
    sources = part.select(
        "run_id", key, F.when(F.col("p") % 7 == 0, "").otherwise(F.concat(F.lit("A study of "), "p_name", F.lit(" in plants"))).alias("title"),
        F.when(F.col("p") % 5 == 0, "").otherwise(same).alias("abstract"), F.when(F.col("p") % 5 == 0, "").otherwise(same).alias("text"), F.lit("html").alias("kind"), (F.col("p") % 97 == 0).alias("retracted"),
    )
    return Audit(texts, replies, sources)


_CONCERN = "CASE verdict WHEN 'unrelated' THEN 5 WHEN 'not_found' THEN 5 WHEN 'weak' THEN 4 WHEN 'unverified' THEN 3 WHEN 'blocked' THEN 3 WHEN 'related' THEN 2 ELSE 1 END"


@R.add(oracle("claim_verdicts", f"SELECT run_id, key, claim_no, CAST(row_number() OVER (PARTITION BY run_id, key ORDER BY {_CONCERN} DESC, claim_no) AS INT) AS place FROM claim_verdicts"))
def quote_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.quote_order(derive(spark, sf_dir, "claim_verdicts"), ["run_id", "key"]).select("run_id", "key", "claim_no", "place")


@R.add(
    oracle(
        "claim_verdicts",
        f"""/*more*/ c AS (SELECT run_id, key, verdict, {_CONCERN} AS k, count(*) AS n FROM claim_verdicts GROUP BY ALL)
    SELECT run_id, key, sum(n)::INT || CASE WHEN sum(n) = 1 THEN ' citing place: ' ELSE ' citing places: ' END || string_agg(n || ' ' || replace(verdict, '_', ' '), ', ' ORDER BY k DESC, verdict) || '.' AS reason FROM c GROUP BY run_id, key""",
    )
)
def roll_up_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.roll_up_reason(derive(spark, sf_dir, "claim_verdicts"), ["run_id", "key"])


@R.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.18 THEN 'Word overlap with the retrieved text was low (' || printf('%.2f', l_discount * 10) || '), which is not enough to judge either way.' ELSE 'Lexical overlap ' || printf('%.2f', l_discount * 10) || '; strongest shared terms: ' || CASE WHEN l_linenumber = 1 THEN 'no distinctive terms' ELSE 'a, b' END || '.' END AS reason FROM lineitem")
def lexical_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_discount") * 10
    terms = F.when(F.col("l_linenumber") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", judging.lexical_reason(score, judging.verdict_of(score), terms).alias("reason"))
