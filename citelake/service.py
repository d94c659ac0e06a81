"""Audits kept as tables: audit, read, overrule, re-check, delete, expire - the calls of a front end, as methods.

Machine results are written once; what readers do is appended to ``actions`` and replayed on every read, so no
call rewrites a report and taking a verdict back restores exactly what was there.
"""

from __future__ import annotations

import re
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.audit import Audit
from citelake.operators import judge_client, judging, report
from citelake.schemas import VERDICTS
from citelake.sources import sinks

ENTRIES = ("run_id", "key", "verdict", "engine", "retracted", "existence", "text_chars", "fetched_kind", "title", "authors", "year", "raw")
CLAIMS = ("run_id", "key", "claim_no", "claim", "verdict", "score")
FLAGS = ("run_id", "key", "flag_no", "kind", "severity", "message")
ACTIONS = "run_id string, action_no long, kind string, key string, claim_no int, verdict string, engine string, note string, at timestamp"
# Bounds and shapes of a front end's options.
BOUNDS = {"reference_cap": (250, 1, 500), "claim_cap": (6, 1, 20), "workers": (4, 1, 8)}
EMAIL, API_KEY, MODEL = re.compile(r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+"), re.compile(r"[!-~]{20,300}"), re.compile(r"[A-Za-z0-9][A-Za-z0-9._:/@+-]{0,119}")


def check_options(form: Mapping[str, str]) -> dict:
    """A front end's fields as options: numbers within their bounds, a complaint (never with the key in it) otherwise."""
    out: dict = {}
    for name, (usual, low, high) in BOUNDS.items():
        try:
            out[name] = max(low, min(high, int(form.get(name, usual))))
        except (TypeError, ValueError):
            out[name] = usual
    email = (form.get("contact_email") or "").strip()
    if email and (len(email) > 254 or not EMAIL.fullmatch(email)):
        raise ValueError("that is not an e-mail address")
    key, model, provider = ((form.get(n) or "").strip() for n in ("api_key", "model", "provider"))
    if provider and provider not in judge_client.PROVIDERS:
        raise ValueError("unknown provider")
    if key and not API_KEY.fullmatch(key):
        raise ValueError("that key can't be right")
    if model and not MODEL.fullmatch(model):
        raise ValueError("that model name can't be right")
    if provider == "custom":
        judge_client.check_endpoint((form.get("base_url") or "").strip())
    judge = judge_client.JudgeConfig(provider or "openai", key, model, (form.get("base_url") or "").strip() if provider == "custom" else "")
    return out | {"contact_email": email, "judge": judge}


class AuditService:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _append(self, table: str, frame: DataFrame) -> None:
        frame.write.mode("append").partitionBy("run_id").parquet(self._path(table))

    def _table(self, table: str, run_id: str | None = None) -> DataFrame:
        frame = self.spark.read.schema(_SCHEMAS[table]).option("basePath", self._path(table)).parquet(self._path(table))
        return frame if run_id is None else frame.where(F.col("run_id") == run_id)  # prunes partitions

    def audit(self, manuscripts: DataFrame, replies: DataFrame, sources: DataFrame, reference_cap: int = 250, **more: DataFrame) -> None:
        """Audits manuscripts and keeps entries, claims, flags, unmatched keys and what was found; ``more``: ``Audit``'s other tables."""
        done = Audit(manuscripts, replies, sources, reference_cap, **more)
        self._append("entries", done.entries.select(*ENTRIES))
        self._append("claims", done.claim_verdicts.select(*CLAIMS))
        self._append("flags", done.flags.select(*FLAGS))
        self._append("unmatched", done.unmatched)
        self._append("found", done.found_counts)
        self.spark.createDataFrame([], ACTIONS).write.mode("append").parquet(self._path("actions"))
        done.close()

    def _act(self, run_id: str, kind: str, key: str, claim_no: int | None, verdict: str | None, engine: str | None, note: str) -> None:
        entries = self._table("entries", run_id).where(F.col("key") == key)
        if entries.isEmpty():
            raise KeyError(f"no reference {key!r} in this report")
        if claim_no is not None and self._table("claims", run_id).where((F.col("key") == key) & (F.col("claim_no") == claim_no)).isEmpty():
            raise KeyError(f"reference {key!r} has no citation {claim_no + 1}")
        # the clock orders the actions of different drivers, and no action comes before one that it followed
        last = self.spark.read.schema(ACTIONS).parquet(self._path("actions")).where(F.col("run_id") == run_id).agg(F.max("action_no")).first()[0]
        row = [(run_id, max(time.time_ns(), (last or 0) + 1), kind, key, claim_no, verdict, engine, note.strip()[:2000])]
        frame = self.spark.createDataFrame(row, ACTIONS.rpartition(",")[0]).withColumn("at", F.current_timestamp())
        frame.write.mode("append").parquet(self._path("actions"))

    def set_verdict(self, run_id: str, key: str, verdict: str = "", note: str = "", clear: bool = False, claim_no: int | None = None) -> None:
        """The reader's own verdict of a reference, or of one of its claims; ``clear`` takes it back."""
        if not clear and verdict not in VERDICTS:
            raise ValueError(f"{verdict!r} is no verdict")
        self._act(run_id, "clear" if clear else "set", key, claim_no, None if clear else verdict, None, note)

    def recheck(self, run_id: str, key: str, verdict: str, engine: str) -> None:
        """What checking a reference again found; an empty engine says that nothing was retrieved."""
        self._act(run_id, "recheck", key, None, verdict, engine, "")

    def entries(self, run_id: str | None = None) -> DataFrame:
        """The entries as they stand: machine results, re-checks, and overrides on top."""
        machine, claims = self._table("entries", run_id), self._table("claims", run_id)
        actions = self.spark.read.schema(ACTIONS).parquet(self._path("actions"))
        actions = actions if run_id is None else actions.where(F.col("run_id") == run_id)
        again = report.recheck(machine, actions.where("kind = 'recheck'"))
        now = machine.drop("verdict", "engine").join(again, ["run_id", "key"])
        # a re-check that replaced the entry also takes back what was set by hand on the reference before it
        last = actions.where("kind = 'recheck' and engine != ''").groupBy("run_id", "key").agg(F.max("action_no").alias("since"))
        standing = actions.join(last, ["run_id", "key"], "left").where(F.col("since").isNull() | (F.col("action_no") > F.col("since")) | F.col("claim_no").isNotNull())
        settled = report.settle(now, claims, standing)
        rows = now.drop("verdict").join(settled, ["run_id", "key"])
        reviewed = F.when(F.col("reviewed_source") != "", F.col("verdict")).otherwise("")
        return rows.withColumns({"reviewed_verdict": reviewed, "rechecked": F.col("outcome") != "", "timed_out": F.lit(False), "note": F.lit("")})

    def claims(self, run_id: str | None = None) -> DataFrame:
        actions = self.spark.read.schema(ACTIONS).parquet(self._path("actions")).where("claim_no is not null")
        standing = report.replay(actions, ["run_id", "key", "claim_no"]).select("run_id", "key", "claim_no", "override")
        rows = self._table("claims", run_id).join(standing, ["run_id", "key", "claim_no"], "left")
        return rows.withColumnRenamed("verdict", "machine_verdict").withColumn("verdict", F.coalesce("override", "machine_verdict"))

    def recheck_claim(self, run_id: str, key: str, claim_no: int, verdict: str, engine: str) -> None:
        """What checking one claim again found; its siblings stay, and the engine's label is never weakened."""
        if engine:
            self._act(run_id, "set", key, claim_no, verdict, engine, "checked again")

    def recheck_document(self, run_id: str, key: str, text: str, manuscripts: DataFrame, sources: DataFrame) -> str:
        """Checks one reference against a document that the reader supplies, keeps the outcome, and returns its verdict."""
        none = self.spark.createDataFrame([], "run_id string, key string, index string, status int, found boolean")
        again = Audit(manuscripts, none, sources).with_document(run_id, key, text)
        row = again.entries.where(F.col("key") == key).select("verdict", "engine").first()
        again.close()
        verdict, engine = (row["verdict"], row["engine"]) if row else ("unverified", "")
        self.recheck(run_id, key, verdict, engine)
        return verdict

    def risk(self, run_id: str | None = None) -> DataFrame:
        stats = report.risk_stats(self._table("found", run_id), self.entries(run_id), self.claims(run_id), self._table("flags", run_id))
        return report.risk(stats)

    def filtered(self, run_id: str, verdict: str) -> tuple[str, DataFrame]:
        """The references with a citation of a verdict, for print, and the caption that says how many of all they are."""
        entries, claims = self.entries(run_id), self.claims(run_id)
        shown = report.section(entries, claims, verdict)
        n, of = shown.count(), entries.count()
        return f"{n} of {of} reference{'s' * (of != 1)} with a citation that is {verdict.replace('_', ' ')}", shown

    def documents(self, run_id: str | None = None) -> DataFrame:
        """Report documents of the runs as they stand now."""
        entries = self.entries(run_id)
        return sinks.report_documents(entries.select("run_id").distinct(), entries, self.claims(run_id), self._table("flags", run_id))

    def runs(self) -> DataFrame:
        return self._table("entries").groupBy("run_id").agg(F.count("*").alias("references"))

    def capabilities(self) -> dict:
        return {"verdicts": VERDICTS, "providers": sorted(judge_client.PROVIDERS), "bounds": BOUNDS, "lexical": judging.TOP > 0}


_SCHEMAS = {
    "entries": "key string, verdict string, engine string, retracted boolean, existence string, text_chars int, fetched_kind string, title string, authors string, year string, raw string, run_id string",
    "claims": "key string, claim_no int, claim string, verdict string, score double, run_id string",
    "flags": "key string, flag_no int, kind string, severity string, message string, run_id string",
    "unmatched": "key string, status string, run_id string",
    "found": "citations_found long, references_parsed long, run_id string",
}
