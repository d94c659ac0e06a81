"""Registered queries of the corpus operators: thin, whole tables, production parameters.

``QUERIES`` maps names to functions of (spark, sf_dir); ``ORACLE_SQL`` has DuckDB SQL where SQL can express
the result.  Every query reads its tables with Spark's readers only.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm import chunk_dedup, decontaminate, language_id, ngram_join, piece_codec, secret_scan, suffix_dedup, token_count, toxicity, vantage_ann

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids and decoded text, as digests."""
    return piece_codec.encoded_digests(table(spark, sf_dir, "documents"), PIECES)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base patterns, a digest of their spans, and all spans in order."""
    found = secret_scan.scan_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN)

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), counts[3])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte strings of earlier documents remove from each document, and a digest of what stays."""
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), keep_bytes=False)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of each document."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of documents with 80 percent of their 5-word shingles in common."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).drop("text_mark")


#: The chain of the toxicity classifier: earlier categories help later ones.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probabilities along the chain, and the decision."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.score(docs, chain, ["doc_id"])
    return scored.withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's benchmark occurrences: the items found, the fewest edits, and the spans."""
    found = decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("spans") > 0).alias("contaminated"),
        F.array_join(F.array_sort(F.array_distinct("spans.item_id")), ",").alias("items"),
        F.array_min("spans.edits").alias("least_edits"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["item_id"], s["start"], s["end"], s["edits"])), ",").alias("spans"),
    )


def op8_vantage_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, exactly (factor 1)."""
    return vantage_ann.nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"), k=20, factor=1.0)


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What content-defined chunking removes from each document, and a digest of what stays."""
    out = chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.train(docs, ~held)
    found = language_id.identify(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return found.withColumn("languages", F.array_join("languages", ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_secret_scan": op2_secret_scan,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_count": op7_token_count,
    "op8_vantage_ann": op8_vantage_ann,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op8_vantage_ann": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
