"""Corpus pipeline: documents in, tokenised training documents out.

Five stages, each on all that its predecessor kept, written as Parquet and read again in between:

1. toxicity - documents that the classifier chain rejects go;
2. near duplicates - of each component of the n-gram join the document with the smallest doc_id stays; rows that
   share a doc_id are decided each by its own text, of rows that share both one stays;
3. decontamination - documents that hold a benchmark item go;
4. secrets - found secrets are masked in the text, the documents stay;
5. tokens - SentencePiece ids of each text, with the check that decoding gives the text back.

Null and empty texts pass every stage, and rows with a null doc_id stay, all of them, unless the toxicity or the
benchmark stage finds something in their text.  Empty tables give empty tables; without labels nothing is toxic,
without benchmark items nothing is contaminated.  Texts of any length are read whole.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citelake.llm import decontaminate, ngram_join, piece_codec, secret_scan, toxicity
from citelake.llm.common import map_arrow, quoted, schema_of, stage, unstage

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    return toxicity.without(docs, chain, "toxic", toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked_documents(docs, RANKS, public_tokenizers.PATTERN)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` without the text, then n_tokens, ids and round_trip: decoding gives the text back.

    Columns of ``docs`` with these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = piece_codec.codec(PIECES)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = [c.encode(t) for t in texts]
        same = [c.decode(x) == t for x, t in zip(ids, texts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)],
            names=[*names, "n_tokens", "ids", "round_trip"],
        )

    own = docs.select(*map(quoted, names), "text")
    return map_arrow(own, run, schema_of(docs, names, "n_tokens long, ids array<int>, round_trip boolean"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("piece_tokens", encode_pieces),
]

#: No stage but the masking of base patterns can be said in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
