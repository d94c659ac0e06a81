"""The whole audit as one plan over all manuscripts: texts and snapshots in, entries, claims, flags and risk out.

Live services are tables here: ``replies`` (how each index answered), ``sources`` (what was retrieved) and, where
there are any, ``records`` (published records of a work), ``found`` (works that a title search found), ``model_replies``
(a model's answers by claim, the second look's in ``second``) and ``unfinished`` (references that the time ran out on).
``sources`` may also say what became of retrieval: ``dead`` (why an address is gone), ``blocked``, ``handle_code`` (the
DOI registry's answer).  Every step works on all manuscripts at once, keyed by run_id.  What several steps read is
staged in the shared folder, so that plans stay short; ``close`` deletes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, _parse_datatype_string

from citelake.functions.partitions import stage, unstage
from citelake.operators import bibliography, existence, flags, judging, layout, markers, report, retrieval

KEY = ["run_id", "key"]


_ENTRIES = f"array<struct<{bibliography.COLUMNS.replace(' ', ':').replace(',:', ', ')}>>"


def split_texts(manuscripts: DataFrame) -> DataFrame:
    """run_id, body, entries: the bibliography found, parsed and blanked out of the body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [layout.split_bibliography(t or "", bibliography.parse) for t in batch.column("text").to_pylist()]
            entries = [[{"entry_no": k, **e} for k, e in enumerate(p[3])] for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), pa.array([p[0] for p in parts], pa.string()), pa.array(entries, kind)], names=["run_id", "body", "entries"])

    kind = to_arrow_type(_parse_datatype_string(_ENTRIES))
    return manuscripts.select("run_id", "text").mapInArrow(run, f"run_id string, body string, entries {_ENTRIES}")


@pandas_udf(ArrayType(StringType()))
def _first_author(authors: pd.Series) -> pd.Series:
    return authors.map(lambda a: bibliography.leading_name(a or "")[0])


def _with(frame: DataFrame, **usual: Column) -> DataFrame:
    """``frame`` with the columns it lacks, and nulls in those it has, set to what is usual."""
    return frame.withColumns({c: F.coalesce(c, v) if c in frame.columns else v for c, v in usual.items()})


@contextmanager
def no_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned meanwhile broadcast no side but those marked; the session's own setting comes back."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _merged(frame: DataFrame) -> DataFrame:
    """``frame`` as a side of merge joins only: by the size of its files, many times less than that of its rows, it would
    be broadcast, and the driver would have to hold all of it."""
    return frame.hint("merge")


@dataclass
class Audit:
    manuscripts: DataFrame  # run_id, text
    replies: DataFrame  # run_id, key, index, status, found
    sources: DataFrame  # run_id, key, title, abstract, text, kind, retracted
    reference_cap: int = 250
    records: DataFrame | None = None  # run_id, key, records (index, title_agreement, year, surnames, book)
    found: DataFrame | None = None  # run_id, key, search_agreement and the columns that ``existence.adopt`` takes over
    model_replies: DataFrame | None = None  # run_id, key, claim_no, reply, perhaps second
    unfinished: DataFrame | None = None  # run_id, key, stage
    claim_cap: int = 6
    held: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name in ("manuscripts", "replies", "sources", "records", "found", "model_replies", "unfinished"):
            frame = getattr(self, name)
            setattr(self, name, frame if frame is None else _merged(frame))

    def _hold(self, frame: DataFrame) -> DataFrame:
        with no_broadcasts(frame.sparkSession):
            self.held.append(stage(frame))
        return _merged(self.held[-1])

    def close(self) -> None:
        """Deletes what was staged; frames of this audit can't be read after that."""
        while self.held:
            unstage(self.held.pop())

    @cached_property
    def texts(self) -> DataFrame:
        return split_texts(self.manuscripts)

    @cached_property
    def bibliography(self) -> DataFrame:
        entries = self.texts.select("run_id", F.explode("entries").alias("e")).select("run_id", "e.*")
        head = F.when(F.col("authors") != "", F.col("authors")).otherwise(F.col("raw"))
        letter = F.regexp_extract("key", r"\d{4}([a-z])$", 1)
        people = F.filter(F.split("authors", r"\s*(?:;|\band\b|&)\s*|,\s+(?=[A-Z][a-z]|[A-Z]\.\s*[A-Z][a-z])"), lambda p: F.length(F.trim(p)) > 1)
        return self._hold(entries.withColumns({"names": _first_author(head), "letter": letter, "n_authors": F.size(people)}))

    @cached_property
    def marked(self) -> DataFrame:
        """The citations under the keys that the text prints."""
        read = markers.extract(self.texts.select("run_id", F.col("body").alias("text")))
        return self._hold(markers.is_number_list(read, self.bibliography.select("run_id", "number")))

    @cached_property
    def shared(self) -> DataFrame:
        """Markers of keys that several entries share, and the one entry that each fits."""
        return self._hold(bibliography.link_shared(self.marked, self.bibliography).withColumnRenamed("new_key", "own_key"))

    @cached_property
    def citations(self) -> DataFrame:
        own = self.shared.select(*KEY, "label", "own_key")
        rows = self.marked.join(own, [*KEY, "label"], "left").withColumn("key", F.coalesce("own_key", "key"))
        return self._hold(rows.drop("own_key"))

    @cached_property
    def links(self) -> DataFrame:
        told = self.shared.select("run_id", F.col("own_key").alias("key"), "entry_no", F.lit("shared").alias("how")).distinct()
        rest = self.citations.select(*KEY).distinct().join(told, KEY, "left_anti")
        return self._hold(bibliography.link(rest, self.bibliography).unionByName(told))

    @cached_property
    def unmatched(self) -> DataFrame:
        """run_id, key, status of cited keys without an entry."""
        return bibliography.out_of_range(bibliography.orphans(self.citations, self.links), self.bibliography)

    @cached_property
    def references(self) -> DataFrame:
        """The cited entries, under the key they are cited by."""
        own = self.bibliography.drop("key").join(self.links.where("entry_no is not null").select(*KEY, "entry_no"), ["run_id", "entry_no"])
        return self._hold(report.capped(own, self.reference_cap).drop("place"))

    @cached_property
    def claims(self) -> DataFrame:
        return self._hold(markers.claims_of(self.citations.join(self.references.select(*KEY), KEY, "left_semi")))

    @cached_property
    def retrieved(self) -> DataFrame:
        """What was retrieved of each reference, its abstract before it or in its place where the text is short."""
        known = _with(self.sources, dead=F.lit(""), blocked=F.lit(False), handle_code=F.lit(None).cast("int"))
        return retrieval.with_abstract(known.withColumn("plain_text", F.coalesce("text", F.lit(""))))

    @cached_property
    def settled(self) -> DataFrame:
        """The references with what the indexes make of them."""
        printed = F.when(F.col("arxiv") != "", "arxiv").when(F.col("doi") != "", "doi").when(F.col("url") != "", "url").otherwise("")
        lists = existence.outcomes(self.replies, KEY)
        record = self.retrieved.select(
            *KEY, F.col("title").alias("found_title"), "abstract", F.col("text").alias("source_text"), F.col("kind").alias("fetched_kind"), "retracted", "dead", "blocked",
            "handle_code", (F.trim("plain_text") != "").alias("loaded"),
        )
        rows = self.references.join(lists, KEY, "left").join(record, KEY, "left")
        none, empty, no = F.array().cast("array<string>"), F.lit(""), F.lit(False)
        rows = _with(rows, hits=none, misses=none, errors=none, found_title=empty, abstract=empty, source_text=empty, fetched_kind=empty, dead=empty, retracted=no, blocked=no, loaded=no)
        # pinned before anything is adopted
        rows = rows.withColumn("claimed", F.when(F.col("title") != "", F.substring("title", 1, 300)).otherwise(F.substring("raw", 1, 300)))
        rows = rows.withColumns(
            {
                "identifier_printed": printed,
                "best_agreement": F.round(existence.title_agreement("claimed", "found_title"), 3),
                "text_chars": F.length("source_text"),
                "retraction_date": F.lit(""),
            }
        )
        other = existence.is_other_work(F.col("found_title"), F.col("claimed"), F.col("raw")) & F.col("identifier_printed").isin("doi", "arxiv")
        wrong = F.when(F.col("doi") != "", F.col("doi")).otherwise(F.col("arxiv"))
        rows = rows.withColumns({"identifier_wrong": F.when(other, wrong).otherwise(""), "identifier_points_to": F.when(other, F.col("found_title")).otherwise("")})
        rows = existence.dead_doi(rows)
        if self.found is not None:
            search = self.found.select(*KEY, "search_agreement", *existence.ADOPTED)
            unregistered = (F.col("identifier_printed") == "doi") & F.array_contains("misses", "Crossref") & (F.size("hits") == 0) & F.coalesce(F.col("handle_code") == 100, F.lit(False))
            rows = existence.adopt(rows, search, KEY, unregistered | (F.col("identifier_points_to") != ""))
            adopted = (F.col("identifier_wrong") != "") & (F.col("identifier_points_to") == "")
            rows = rows.withColumn("hits", F.when(adopted, F.array_union("hits", F.array(F.lit("Crossref")))).otherwise(F.col("hits")))
        return self._hold(existence.settle(rows))

    @cached_property
    def passages(self) -> DataFrame:
        named = self.retrieved.select(*KEY, "title", "abstract", "text")
        return self._hold(judging.passages(named, KEY).unionByName(judging.header_passage(named, KEY)))

    @cached_property
    def claim_verdicts(self) -> DataFrame:
        """Every claim with its verdict: a model's where it answered, else the lexical one; unverified where nothing was retrieved."""
        scores = judging.lexical_support(self.claims, self.passages, KEY, ["claim_no"], ["passage_no"])
        rows = self.claims.join(scores, [*KEY, "claim_no"], "left").select(
            *KEY, "claim_no", F.col("text").alias("claim"), F.coalesce("verdict", F.lit("unverified")).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"),
            F.lit("lexical").alias("engine"), F.lit(False).alias("reconsidered"), F.lit(None).cast("string").alias("override"),
        )
        if self.model_replies is not None:
            judged = judging.judge_replies(self.claims, self.model_replies, rows, KEY, self.claim_cap)
            judged = judged.select(*KEY, "claim_no", F.col("verdict").alias("model_verdict"), F.col("engine").alias("model_engine"))
            rows = rows.join(judged, [*KEY, "claim_no"], "left")
            rows = rows.withColumns({"verdict": F.coalesce("model_verdict", "verdict"), "engine": F.coalesce("model_engine", "engine")}).drop("model_verdict", "model_engine")
            if "second" in self.model_replies.columns:
                second = self.model_replies.select(*KEY, "claim_no", judging.parse_reply(F.col("second"))["verdict"].alias("second_verdict"))
                texts = self.retrieved.select(*KEY, F.coalesce("abstract", F.lit("")).alias("abstract"), F.col("plain_text").alias("source_text"))
                rows = judging.second_look(rows.join(second, [*KEY, "claim_no"], "left").join(texts, KEY, "left")).drop("second_verdict", "abstract", "source_text")
                rows = rows.withColumn("reconsidered", F.coalesce("reconsidered", F.lit(False)))
        return self._hold(rows)

    @cached_property
    def flags(self) -> DataFrame:
        """Every flag, the entry's own first, then what published records say, then what the indexes said."""
        own = self.settled.withColumn("title", F.col("claimed"))
        low = flags.duplicates(own).select(
            *KEY, F.lit("duplicate-entry").alias("kind"), F.lit("low").alias("severity"), F.concat(F.lit("The same work is listed as ["), "duplicate_of", F.lit("].")).alias("message")
        )
        named = flags.author_mismatch(self.citations, own).select(
            *KEY, F.lit("author-mismatch").alias("kind"), F.lit("high").alias("severity"), F.concat(F.lit("The text credits "), "named", F.lit("; the entry names others.")).alias("message")
        )
        parts = [low, named]
        if self.records is not None:
            listed = flags.metadata_flags(own.join(self.records.select(*KEY, "records"), KEY))
            parts.append(listed.select(*KEY, F.explode("flags").alias("f")).select(*KEY, "f.*"))
        parts.append(flags.source_flags(self.settled).drop("flag_no"))
        numbered = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
        number = F.row_number().over(W.partitionBy(*KEY).orderBy("part", "kind", "message")) - 1
        return numbered.select(*KEY, number.alias("flag_no"), "kind", "severity", "message")

    @cached_property
    def entries(self) -> DataFrame:
        """The references with their headline verdicts: the check's ladder first, then the claims' roll-up, then the time limit."""
        engines = F.max_by("engine", (F.col("engine") != "lexical").cast("int")).alias("judged_by")
        rolled = judging.roll_up(self.claim_verdicts, KEY).join(self.claim_verdicts.groupBy(*KEY).agg(engines), KEY)
        rows = self.settled.join(rolled, KEY, "left")
        reached = (F.col("text_chars") > 0) | F.col("blocked") | (F.col("dead") != "")
        ladder = rows.withColumns({"own_url": F.col("url"), "own_dead": F.col("dead"), "url": F.when(reached, "reached").otherwise(F.col("url")), "dead": F.col("dead") != "", "fetch_ok": F.col("loaded")})
        ladder = ladder.withColumn("step", report.check_ladder()).drop("url", "dead", "fetch_ok")
        rows = ladder.withColumnsRenamed({"own_url": "url", "own_dead": "dead"})
        judge = F.col("step") == "judge"
        by_claims = judging.headline(F.col("worst"), F.col("mildest"), F.col("judged_by"))
        rows = rows.withColumns({"verdict": F.when(judge, by_claims).otherwise(F.col("step")), "engine": F.when(judge, F.coalesce("judged_by", F.lit("lexical"))).otherwise("")})
        rows = rows.withColumns({"reviewed_source": F.lit(""), "reviewed_verdict": F.lit(""), "rechecked": F.lit(False), "timed_out": F.lit(False), "note": F.lit("")})
        if self.unfinished is not None:
            late = self.unfinished.select(*KEY, "stage")
            stands = report.with_stand_ins(late, rows.limit(0)).select(*KEY, F.col("verdict").alias("late_verdict"), F.col("note").alias("late_note"))
            rows = rows.join(stands, KEY, "left")
            is_late = F.col("late_verdict").isNotNull()
            rows = rows.withColumns(
                {"verdict": F.coalesce("late_verdict", "verdict"), "engine": F.when(is_late, "").otherwise(F.col("engine")), "timed_out": is_late, "note": F.coalesce("late_note", "note")}
            ).drop("late_verdict", "late_note")
        return rows.drop("worst", "mildest", "judged_by", "step")

    @cached_property
    def found_counts(self) -> DataFrame:
        """run_id, citations_found, references_parsed of every manuscript."""
        cited = self.citations.groupBy("run_id").agg(F.count("*").alias("citations_found"))
        parsed = self.bibliography.groupBy("run_id").agg(F.count("*").alias("references_parsed"))
        return self.manuscripts.select("run_id").join(cited, "run_id", "left").join(parsed, "run_id", "left").na.fill(0)

    @cached_property
    def risk(self) -> DataFrame:
        """run_id, level, headlines, for every manuscript, also one in which nothing could be checked."""
        return report.risk(report.risk_stats(self.found_counts, self.entries, self.claim_verdicts, self.flags))

    def with_document(self, run_id: str, key: str, text: str) -> Audit:
        """The audit of one reference against a document that the reader supplies: it replaces lookup and retrieval."""
        spark = self.manuscripts.sparkSession
        one = (F.col("run_id") == run_id) & (F.col("key") == key)
        given = spark.createDataFrame([(run_id, key, text)], "run_id string, key string, text string")
        known = self.sources.where(one).select(*KEY, "title", "abstract", "retracted")
        source = given.join(known, KEY, "left").select(
            *KEY, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), "text", F.lit("supplied text").alias("kind"),
            F.coalesce("retracted", F.lit(False)).alias("retracted"),
        )
        answered = spark.createDataFrame([(run_id, key, "supplied document", 200, True)], "run_id string, key string, index string, status int, found boolean")
        return Audit(self.manuscripts.where(F.col("run_id") == run_id), answered, source, self.reference_cap)
