"""Sources: reports, annotation sheets, supplied documents, layout tables, configuration."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.schemas import TABLES

REPORT = (
    "run_id string, source_pdf string, paper_title string, orphan_keys array<string>, out_of_range_keys array<string>, base_warnings array<string>, "
    "references array<struct<key:string,verdict:string,score:double,reason:string,engine:string,retracted:boolean,reviewed_source:string,"
    "claim_verdicts:array<struct<claim:string,verdict:string,score:double,machine_verdict:string,override:string>>,"
    "flags:array<struct<kind:string,severity:string,message:string>>>>"
)
DECODINGS = ("utf-8", "utf-16", "cp1252", "latin-1")
SHORTEST = 40


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report documents; fields they don't know are left out, missing ones are null."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def entries_of(reports: DataFrame) -> DataFrame:
    return reports.select("run_id", F.explode("references").alias("r")).select("run_id", "r.*")


def claim_verdicts_of(reports: DataFrame) -> DataFrame:
    rows = entries_of(reports).select("run_id", "key", F.posexplode("claim_verdicts").alias("claim_no", "c"))
    return rows.select("run_id", "key", "claim_no", "c.*")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An annotation sheet: cells trimmed, empty ones ''."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns))


def decode(name: str, data: bytes) -> str:
    """Text of a supplied file; only plain-text kinds, and not too little of it."""
    if not name.lower().endswith((".txt", ".text", ".md")) or data[:5] == b"%PDF-":
        raise ValueError(f"{name}: a page table is needed for PDF, otherwise only .txt, .text and .md are read")
    for encoding in DECODINGS:
        if encoding == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue  # without its mark almost any bytes pass for it
        try:
            text = data.decode(encoding)
            break
        except UnicodeError:
            continue
    if len(text.strip()) < SHORTEST:
        raise ValueError(f"{name}: fewer than {SHORTEST} characters")
    return text


def read_supplied(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of the files under ``path``; a file that can't be read has an error and no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((name, decode(name, bytes(data)), None))
                except ValueError as e:
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the model (``schemas.TABLES``) from Parquet, with its columns and types; missing columns are null."""
    return spark.read.schema(TABLES[name]).parquet(path)


def load_env(path: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file; what is set already wins."""
    into = os.environ if into is None else into
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, sep, value = line.strip().partition("=")
                if sep and name and not name.startswith("#"):
                    into.setdefault(name.strip(), value.strip().strip("'\""))
    return dict(into)
