"""Queries about existence: agreement, candidates, index outcomes, settlement, records and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.operators import existence, flags
from citelake.plans.inputs import Registry, derive, oracle, table

R = Registry()
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'), lambda w: w NOT IN ('the','and','for','with','from','into','using')))"
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


@R.add(
    f"""WITH a AS (SELECT n1.n_name AS a, n2.n_name AS b, n1.n_name || ' and the trade of ' || r1.r_name AS ta, n2.n_name || ' with the trade in ' || r2.r_name AS tb
        FROM nation n1 JOIN region r1 ON n1.n_regionkey = r1.r_regionkey JOIN nation n2 ON TRUE JOIN region r2 ON n2.n_regionkey = r2.r_regionkey),
    t AS (SELECT a, b, {_TOKENS.format('ta')} AS x, {_TOKENS.format('tb')} AS y FROM a)
    SELECT a, b, round({_JACCARD.format('x', 'y')}, 6) AS agreement FROM t"""
)
def title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey)
    a = named.select(F.lit(1).alias("one"), F.col("n_name").alias("a"), F.concat("n_name", F.lit(" and the trade of "), "r_name").alias("ta"))
    b = named.select(F.lit(1).alias("one"), F.col("n_name").alias("b"), F.concat("n_name", F.lit(" with the trade in "), "r_name").alias("tb"))
    return a.join(b, "one").select("a", "b", F.round(existence.title_agreement("ta", "tb"), 6).alias("agreement"))


def _sentences(frame: DataFrame, *by: str) -> DataFrame:
    """by.., sentence_no, title: every sentence of each text; a line's end ends a sentence."""
    return frame.select(*by, F.posexplode(F.split("text", r"\n|(?<=[.!?])\s+")).alias("sentence_no", "title"))


@R.add()
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of the benchmark items looked up among all sentences of whole documents (checked against brute force in the unit tests).

    SQL would have to score every pair.
    """
    entries = _sentences(table(spark, sf_dir, "benchmark"), "item_id")
    candidates = _sentences(table(spark, sf_dir, "documents"), "doc_id").select(F.struct("doc_id", F.col("sentence_no").alias("doc_sentence")).alias("candidate_no"), "title")
    found = existence.best_candidates(entries, candidates, ["item_id", "sentence_no"]).where(F.col("score") >= existence.FABRICATED)
    return found.select("item_id", "sentence_no", "candidate_no.doc_id", "candidate_no.doc_sentence", F.round("score", 6).alias("score"))


AGREEMENT = """SELECT l_orderkey, l_linenumber, l_discount * 10 AS t, CASE l_partkey % 3 WHEN 0 THEN 'smith' WHEN 1 THEN 'jones' ELSE '' END AS printed,
    CASE l_suppkey % 3 WHEN 0 THEN 'smith' WHEN 1 THEN 'lee' ELSE '' END AS found, CAST(2000 + l_partkey % 3 AS STRING) AS y1, CAST(2000 + l_suppkey % 2 AS STRING) AS y2 FROM {lineitem}"""


@R.add(
    f"""SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, t + CASE WHEN printed <> '' AND found <> '' THEN CASE WHEN printed = found THEN CASE WHEN t >= 0.55 THEN 0.12 ELSE 0 END
        WHEN t < 0.95 THEN -0.3 ELSE 0 END ELSE 0 END + CASE WHEN t >= 0.55 AND y1 = y2 THEN 0.08 ELSE 0 END)), 6) AS score FROM ({AGREEMENT.replace('{lineitem}', 'lineitem')})"""
)
def agreement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(AGREEMENT, lineitem=table(spark, sf_dir, "lineitem"))
    names = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array(c))
    score = existence.agreement(F.col("t"), names("printed"), names("found"), F.col("y1"), F.col("y2"))
    return rows.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


_OUTCOME = "CASE WHEN status IS NULL OR status = 429 OR status >= 500 THEN 'errored' WHEN found THEN 'hit' ELSE 'missed' END"
_LISTS = f"""/*more*/ o AS (SELECT run_id, key, index, {_OUTCOME} AS outcome FROM replies),
    l AS (SELECT run_id, key, list_sort(list(index) FILTER (outcome = 'hit')) AS hits, list_sort(list(index) FILTER (outcome = 'missed')) AS misses,
      list_sort(list(index) FILTER (outcome = 'errored')) AS errors FROM o GROUP BY run_id, key)"""


@R.add(oracle("replies", f"SELECT index, {_OUTCOME} AS outcome, count(*) AS n FROM replies GROUP BY ALL"))
def index_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, "replies").select("index", existence.outcome(F.col("status"), F.col("found")).alias("outcome"))
    return rows.groupBy("index", "outcome").agg(F.count("*").alias("n"))


_UNINDEXED = "regexp_matches(raw, '(?i)\\b(standard|technical\\s+report|thesis|\\bpress,|publishers?\\b)')"
_SETTLED = f"""CASE WHEN len(hits) > 0 THEN 'confirmed' WHEN identifier_printed = 'url' THEN CASE WHEN loaded THEN 'confirmed' WHEN dead <> '' THEN 'not_found' ELSE 'unconfirmed' END
      WHEN identifier_printed IN ('doi','arxiv') THEN CASE WHEN len(misses) > 0 THEN 'not_found' ELSE 'unconfirmed' END
      WHEN len(misses) > 0 AND NOT {_UNINDEXED} AND best_agreement < 0.35 THEN 'not_found' ELSE 'unconfirmed' END"""


@R.add(
    oracle(
        "replies works",
        _LISTS
        + f""", e AS (SELECT w.* , coalesce(hits, []) AS hits, coalesce(misses, []) AS misses FROM works w JOIN l ON l.run_id = w.run_id AND l.key = w.key)
    SELECT run_id, key, {_SETTLED} AS existence, CASE WHEN len(hits) > 0 AND identifier_printed IN ('doi','arxiv') THEN identifier_wrong = '' WHEN identifier_printed = 'url' AND len(hits) = 0 THEN
      CASE WHEN loaded THEN TRUE WHEN dead <> '' THEN FALSE END WHEN identifier_printed IN ('doi','arxiv') AND len(misses) > 0 THEN FALSE END AS identifier_resolved FROM e""",
    )
)
def existence_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = existence.outcomes(derive(spark, sf_dir, "replies"), ["run_id", "key"])
    return existence.settle(derive(spark, sf_dir, "works").join(lists, ["run_id", "key"])).select("run_id", "key", "existence", "identifier_resolved")


@R.add(
    oracle(
        "replies works",
        _LISTS
        + """, e AS (SELECT w.run_id, w.key, handle_code, coalesce(hits, []) AS hits, coalesce(misses, []) AS misses FROM works w JOIN l ON l.run_id = w.run_id AND l.key = w.key),
    k AS (SELECT *, list_contains(misses, 'Crossref') AND coalesce(handle_code, 0) = 1 AS known FROM e)
    SELECT run_id, key, array_to_string(CASE WHEN known THEN list_append(hits, 'DOI registry') ELSE hits END, ',') AS hits,
      array_to_string(CASE WHEN known THEN list_filter(misses, lambda x: x <> 'Crossref') ELSE misses END, ',') AS misses FROM k""",
    )
)
def dead_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = existence.outcomes(derive(spark, sf_dir, "replies"), ["run_id", "key"])
    out = existence.dead_doi(derive(spark, sf_dir, "works").join(lists, ["run_id", "key"]))
    return out.select("run_id", "key", F.array_join("hits", ",").alias("hits"), F.array_join("misses", ",").alias("misses"))


@R.add(
    oracle(
        "works",
        """/*more*/ x AS (SELECT run_id, key, CASE WHEN retracted THEN 0 END AS a, CASE WHEN identifier_wrong <> '' THEN 1 END AS b, CASE WHEN best_agreement < 0.1 THEN 2 END AS c, identifier_printed AS p, identifier_wrong, doi FROM works),
    f AS (SELECT run_id, key, 'retracted-source' AS kind, 'This work was retracted.' AS message, 0 AS o FROM x WHERE a = 0
      UNION ALL SELECT run_id, key, 'identifier-mismatch', 'The printed DOI is not registered; the work exists as ' || doi, 1 FROM x WHERE b = 1
      UNION ALL SELECT run_id, key, 'reference-not-found', CASE WHEN p = 'url' THEN 'The printed address does not load, and no index has a record of it.'
        WHEN p IN ('doi','arxiv') THEN 'The printed ' || upper(p) || ' is not registered anywhere.' ELSE 'No index has any record of this reference, and no DOI or arXiv id was printed for it.' END, 2 FROM x WHERE c = 2)
    SELECT run_id, key, CAST(row_number() OVER (PARTITION BY run_id, key ORDER BY o) - 1 AS INT) AS flag_no, kind, 'high' AS severity, message FROM f""",
    )
)
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = derive(spark, sf_dir, "works").withColumn("existence", F.when(F.col("best_agreement") < 0.1, "not_found").otherwise("confirmed"))
    return flags.source_flags(works)


@R.add(
    """WITH d AS (SELECT 'r' AS run_id, CAST(doc_id AS VARCHAR) AS key, left(lower(strip_accents(text)), 80) AS print FROM documents),
    f AS (SELECT key, first_value(key) OVER (PARTITION BY print ORDER BY CAST(key AS INT)) AS duplicate_of FROM d WHERE length(print) >= 8)
    SELECT key, duplicate_of FROM f WHERE key <> duplicate_of"""
)
def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("r").alias("run_id"), F.col("doc_id").cast("string").alias("key"), F.lit("").alias("doi"), F.col("text").alias("title"))
    return flags.duplicates(docs).select("key", "duplicate_of")


CREDITS = """SELECT CAST(o_orderkey AS STRING) AS run_id, '7' AS key, CAST(o_orderkey AS INT) AS char_offset,
    CASE o_orderkey % 5 WHEN 0 THEN 'As Smith et al. [7] showed, it holds.' WHEN 1 THEN 'Jones and Lee [7] proposed a model.' WHEN 2 THEN 'Jones and Lee [7] are here.'
      WHEN 3 THEN 'Table et al. [7] is no name.' ELSE 'It was shown by Graph et al. [7].' END AS sentence FROM {orders}"""


@R.add(
    f"""SELECT run_id, key, CASE o % 5 WHEN 0 THEN 'Smith' WHEN 4 THEN 'Graph' ELSE 'Jones' END AS named FROM (SELECT *, CAST(run_id AS INT) AS o FROM ({CREDITS.replace('{orders}', 'orders')}))
    WHERE (o % 5 = 0 AND o % 3 <> 0) OR (o % 5 = 1 AND o % 3 <> 1) OR (o % 5 = 4 AND o % 2 = 0)"""
)
def author_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credited names that are neither authors' nor title words: authors vary by order, some titles hold 'graph'."""
    cites = spark.sql(CREDITS, orders=table(spark, sf_dir, "orders"))
    o = F.col("run_id").cast("int")
    entries = cites.select(
        "run_id", "key",
        F.when(o % 3 == 0, "Smith, J., Doe, A.").when(o % 3 == 1, "A. Jones and B. Lee").otherwise("Brown, C.").alias("authors"),
        F.when(o % 2 == 0, "A title").otherwise("On graph theory").alias("title"),
    )
    return flags.author_mismatch(cites, entries)


@R.add(
    """SELECT 'r' || (p_size % 10) AS run_id, CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 12 = 0 THEN 'record-mismatch' WHEN p_partkey % 4 = 0 THEN 'author-name-mismatch,year-mismatch' ELSE 'author-name-mismatch' END AS kinds FROM part"""
)
def metadata_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors and years of published records against entries."""
    works = derive(spark, sf_dir, "works")
    key = F.col("key").cast("int")
    year = F.when(key % 4 == 0, "2005").otherwise("2015")
    names = F.when(key % 3 == 0, F.array(F.lit("Kingma"), F.lit("Ba"))).otherwise(F.array(F.lit("Smith"), F.lit("Jones")))
    record = F.struct(F.lit("Crossref").alias("index"), F.lit(0.95).alias("title_agreement"), year.alias("year"), names.alias("surnames"), F.lit(False).alias("book"))
    rows = works.select(
        "run_id", "key", F.lit("confirmed").alias("existence"), F.concat(F.lit("Smith, J. and Jonse, B. "), "title", F.lit(". 2016.")).alias("raw"), "title",
        F.lit("Smith, J. and Jonse, B.").alias("authors"), F.lit("2016").alias("year"), F.array(record).alias("records"),
    )
    return flags.metadata_flags(rows).select("run_id", "key", F.array_join("flags.kind", ",").alias("kinds"))


LOOKUPS = """SELECT 'r' AS run_id, CAST(p_partkey AS STRING) AS key, CASE WHEN p_partkey % 3 = 0 THEN '10.1/x' ELSE '' END AS doi, CASE WHEN p_partkey % 5 = 1 THEN '1234.5678' ELSE '' END AS arxiv,
    CASE WHEN p_partkey % 7 = 0 THEN 'u' ELSE '' END AS url, p_name AS title, p_brand AS authors, '2020' AS year, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE '' END AS abstract,
    CASE WHEN p_partkey % 4 = 0 THEN 'o' ELSE '' END AS oa_url, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS hit, CASE WHEN p_size % 2 = 0 THEN 'e' ELSE '' END AS email FROM {part}"""


@R.add(
    f"""WITH e AS ({LOOKUPS.replace('{part}', 'part')}), l AS (
    SELECT run_id, key, 'Crossref' AS index, CASE WHEN doi <> '' THEN 'doi' WHEN url = '' AND length(title || ' ' || authors || ' ' || year) >= 12 THEN 'search' END AS how FROM e
    UNION ALL SELECT run_id, key, 'OpenAlex', CASE WHEN doi <> '' THEN 'doi' WHEN title <> '' THEN 'search' END FROM e
    UNION ALL SELECT run_id, key, 'Semantic Scholar', CASE WHEN abstract <> '' AND oa_url <> '' THEN NULL WHEN doi <> '' THEN 'doi' WHEN arxiv <> '' THEN 'arxiv' WHEN title <> '' THEN 'search' END FROM e
    UNION ALL SELECT run_id, key, 'arXiv', CASE WHEN arxiv <> '' THEN 'id' WHEN NOT coalesce(hit, FALSE) AND doi = '' AND url = '' THEN 'search' END FROM e
    UNION ALL SELECT run_id, key, 'Unpaywall', CASE WHEN doi <> '' AND oa_url = '' AND email <> '' THEN 'doi' END FROM e
    UNION ALL SELECT run_id, key, 'Europe PMC', CASE WHEN doi <> '' THEN 'doi' WHEN length(title) > 15 THEN 'search' END FROM e) SELECT * FROM l WHERE how IS NOT NULL"""
)
def index_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return existence.lookups(spark.sql(LOOKUPS, part=table(spark, sf_dir, "part")))


@R.add(
    """SELECT l_orderkey, bool_or(l_returnflag = 'R') AS retracted, array_to_string(list_sort(list(DISTINCT CASE l_returnflag WHEN 'R' THEN 'retraction' WHEN 'A' THEN 'correction' ELSE 'erratum' END)), ',') AS kinds FROM lineitem GROUP BY l_orderkey"""
)
def integrity_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "Retraction").when(F.col("l_returnflag") == "A", "correction").otherwise("erratum")
    out = existence.integrity(table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind")), ["l_orderkey"])
    return out.select("l_orderkey", "retracted", F.array_join("kinds", ",").alias("kinds"))


@R.add(
    oracle(
        "works",
        """/*more*/ n AS (SELECT run_id, key, 0.8 + CAST(CAST(key AS INT) % 3 AS DOUBLE) / 10 AS s, '10.9/new' || key AS d FROM works WHERE CAST(key AS INT) % 2 = 0)
    SELECT w.run_id, w.key, CASE WHEN s >= 0.85 AND identifier_printed = 'doi' THEN d ELSE doi END AS doi, CASE WHEN s >= 0.85 AND identifier_printed = 'doi' THEN 'new title' ELSE title END AS title,
      CASE WHEN s >= 0.85 AND identifier_printed = 'doi' THEN doi ELSE identifier_wrong END AS identifier_wrong FROM works w LEFT JOIN n ON n.run_id = w.run_id AND n.key = w.key""",
    )
)
def adopt_found_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = {c: F.lit("") for c in ("authors", "year", "venue", "abstract")}
    works = derive(spark, sf_dir, "works").withColumns(blank)
    key = F.col("key").cast("int")
    found = works.where(key % 2 == 0).select(
        "run_id", "key", F.lit("new title").alias("title"), "authors", "year", "venue", F.concat(F.lit("10.9/new"), "key").alias("doi"), "abstract", "retracted",
        (0.8 + (key % 3).cast("double") / 10).alias("search_agreement"),
    )
    return existence.adopt(works, found, ["run_id", "key"], F.col("identifier_printed") == "doi").select("run_id", "key", "doi", "title", "identifier_wrong")


@R.add("SELECT p_partkey, regexp_matches(p_type, '(?i)standard') AS unindexed FROM part")
def unindexed_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citelake.functions.text import is_unindexed_kind

    return table(spark, sf_dir, "part").select("p_partkey", is_unindexed_kind(F.col("p_type")).alias("unindexed"))


@R.add("SELECT doc_id, text FROM documents")
def inverted_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to positions and back: the text that an inverted index encodes, all words of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("inverted"))
    return index.select("doc_id", existence.abstract_of(F.col("inverted"), 2**31 - 1).alias("text")).unionByName(docs.where("text is null"))


@R.add(
    """WITH s AS (SELECT lower('10.5/P' || ps) AS d, min('record ' || l) AS record FROM (SELECT l_partkey AS ps, l_linenumber AS l FROM lineitem WHERE l_quantity > 45) GROUP BY 1)
    SELECT p_partkey, record, record IS NOT NULL AS found FROM part LEFT JOIN s ON s.d = '10.5/p' || p_partkey AND p_partkey % 5 > 0"""
)
def identifier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works looked up by DOI in a snapshot whose DOIs are spelled otherwise; every fifth work has none."""
    entries = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("10.5/p"), "p_partkey")).otherwise("").alias("doi"))
    snapshot = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("10.5/P"), "l_partkey").alias("doi"), F.concat(F.lit("record "), "l_linenumber").alias("record"))
    return existence.by_identifier(entries, snapshot.where("doi != ''")).select("p_partkey", "record", "found")


@R.add("SELECT c_custkey, CASE WHEN length(t) >= 12 THEN left(t, 350) END AS query FROM (SELECT c_custkey, trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END || ' ' || left(repeat(c_name || ' ', 30), 150) || ' ' || '1999') AS t FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'ab 1999' FROM customer WHERE c_custkey % 2 = 1)")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    title = F.when(c % 2 == 1, "ab").when(c % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    authors = F.when(c % 2 == 1, "").otherwise(F.repeat(F.concat("c_name", F.lit(" ")), 30))
    return table(spark, sf_dir, "customer").select("c_custkey", existence.search_text(title, authors, F.lit("1999")).alias("query"))
