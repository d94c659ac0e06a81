"""Report derivations: tallies, coverage, engine outcome, risk, warnings, order, and the reader's overrides.

Everything is derived from ``entries``, ``claim_verdicts``, ``flags`` and the append-only ``actions``; nothing
derived is stored, so deriving twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citelake.operators.judging import concern_of, headline, roll_up
from citelake.schemas import COVERAGE, COVERAGE_OF_KIND, VERDICTS

# Fixed value: the form of a run's id.
RUN_ID = r"^[0-9]{8}-[0-9]{6}-[0-9a-f]{6}$"
SERIAL_SECONDS = 20
LEAST_SECONDS = 180


def key_order() -> list[Column]:
    """Numeric keys by number, then the others by text."""
    number = F.col("key").try_cast("int")
    return [number.isNull().asc(), number.asc(), F.col("key").asc()]


def tally(rows: DataFrame) -> DataFrame:
    """run_id, verdict, n: of headlines (entries) or of citations (claim_verdicts); the two never mix."""
    return rows.groupBy("run_id", "verdict").agg(F.count("*").alias("n"))


def claim_tally(claim_verdicts: DataFrame) -> DataFrame:
    """Counts of an entry's claim verdicts as a map in the fixed order of verdicts."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    wide = claim_verdicts.groupBy("run_id", "key").agg(*counts)
    held = F.filter(F.array(*(F.struct(F.lit(v).alias("key"), F.col(v).alias("value")) for v in VERDICTS)), lambda x: x["value"] > 0)
    return wide.select("run_id", "key", F.map_from_entries(held).alias("claim_tally"))


def verdicts_in(entries: DataFrame, claim_verdicts: DataFrame) -> DataFrame:
    """run_id, key, verdict: all verdicts an entry carries: its claims', and its headline if it has no claims or was set by hand."""
    of_claims = claim_verdicts.select("run_id", "key", "verdict").distinct()
    has = of_claims.select("run_id", "key").distinct().withColumn("has", F.lit(True))
    own = entries.join(has, ["run_id", "key"], "left").where(F.col("has").isNull() | (F.col("reviewed_source") == "reference"))
    return of_claims.unionByName(own.select("run_id", "key", "verdict")).where("verdict != ''").distinct()


def references_with(entries: DataFrame, claim_verdicts: DataFrame) -> DataFrame:
    """run_id, verdict, n: references that carry each verdict; the sum exceeds the number of references by design."""
    return verdicts_in(entries, claim_verdicts).groupBy("run_id", "verdict").agg(F.count("*").alias("n"))


def counters(entries: DataFrame, claim_verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """One row a run: judged, retracted, not_found, rechecked, reviewed and flagged, with their open twins."""
    high = flags.where("severity = 'high'").select("run_id", "key").distinct().withColumn("high", F.lit(True))
    claims = claim_verdicts.groupBy("run_id").agg(
        F.count("*").alias("claims_judged"), F.count_if(F.col("override").isNotNull()).alias("claims_reviewed")
    )
    is_open = F.coalesce(F.col("reviewed_verdict"), F.lit("")) == ""
    each = entries.join(high, ["run_id", "key"], "left")
    runs = each.groupBy("run_id").agg(
        F.count("*").alias("references_checked"),
        F.count_if("retracted").alias("retracted"),
        F.count_if(F.col("retracted") & is_open).alias("retracted_open"),
        F.count_if(F.col("verdict") == "not_found").alias("not_found"),
        F.count_if("rechecked").alias("rechecked"),
        F.count_if(F.col("reviewed_source") != "").alias("reviewed"),
        F.count_if("high").alias("flagged"),
        F.count_if(F.col("high") & is_open).alias("flagged_open"),
    )
    return runs.join(claims, "run_id", "left").na.fill(0, ["claims_judged", "claims_reviewed"])


def coverage_category() -> Column:
    """The evidence an entry's verdict rests on; none where no text came."""
    out = F.when(F.coalesce("text_chars", F.lit(0)) == 0, F.lit("none"))
    for kind, category in COVERAGE_OF_KIND.items():
        out = out.when(F.col("fetched_kind") == kind, category)
    return out.otherwise("none")


def coverage(entries: DataFrame) -> DataFrame:
    """run_id, category, n with every category of every run, also at 0."""
    counts = [F.count_if(coverage_category() == c).alias(c) for c in COVERAGE]
    wide = entries.groupBy("run_id").agg(*counts)
    return wide.unpivot("run_id", list(COVERAGE), "category", "n")


def engine_outcome(entries: DataFrame, planned: str = "openai", label: str = "OpenAI") -> DataFrame:
    """The engine that really judged: only references with a model verdict count as judged by it."""
    eligible = F.coalesce("engine", F.lit("")) != ""
    judged = eligible & (F.col("engine") != "lexical")
    order = F.struct(F.col("key").try_cast("int").isNull(), F.col("key").try_cast("int"), "key")
    out = entries.groupBy("run_id").agg(
        F.min_by(F.when(judged, F.col("engine")), F.when(judged, order)).alias("first"),
        F.count_if(judged).alias("references_judged_by_model"),
        F.count_if(eligible).alias("references_judgeable"),
    )
    n, m = F.col("references_judged_by_model"), F.col("references_judgeable")
    note = (
        F.when(F.lit(planned == "lexical") | (m == 0), "")
        .when(n == 0, f"{label} judging was enabled but produced no verdicts; every result is lexical word overlap.")
        .when(n < m, F.concat(F.lit(f"{label} judged "), n, F.lit(" of "), m, F.lit(" references with retrievable text; the rest is lexical word overlap.")))
        .otherwise("")
    )
    return out.select("run_id", F.coalesce("first", F.lit("lexical")).alias("engine"), n, m, note.alias("engine_note"))


def _count(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def risk_stats(found: DataFrame, entries: DataFrame, claim_verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """What ``risk`` reads, for every run of ``found`` (run_id, citations_found, references_parsed)."""
    tally = claim_verdicts.groupBy("run_id").agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("unrelated", "weak", "unverified")))
    return found.join(counters(entries, claim_verdicts, flags), "run_id", "left").join(tally, "run_id", "left").na.fill(0)


def risk(stats: DataFrame) -> DataFrame:
    """run_id, level, headlines.

    ``stats`` has the counters, references_checked, citations_found, references_parsed, and the numbers of
    unrelated, weak and unverified citations (of references where no citation was judged).  An empty run is
    never clear; unverified results lift nothing but clear.
    """
    c = F.col
    by_citation = c("claims_judged") > 0
    checked = F.greatest(F.lit(1), F.when(by_citation, c("claims_judged")).otherwise(c("references_checked")))
    noun = F.when(by_citation, "citation").otherwise("reference")
    plural = F.concat(noun, F.lit("s"))
    wrong = c("n_unrelated") + c("n_weak")
    critical = (c("retracted_open") > 0) | (c("not_found") > 0)
    many_unverified = c("n_unverified") > checked * 0.4
    level = (
        F.when(c("references_checked") == 0, "review")
        .when(critical, "critical")
        .when((wrong > 0) | (c("flagged_open") > 0), "concern")
        .when(many_unverified, "review")
        .otherwise("clear")
    )
    why = (
        F.when(c("citations_found") == 0, "no in-text citation markers were recognised in the body text")
        .when(c("references_parsed") == 0, "the bibliography could not be read, so no marker had anything to match against")
        .otherwise("none of the in-text markers matched an entry in the bibliography")
    )
    lines = F.array(
        F.when(c("retracted_open") > 0, _count(c("retracted_open"), " reference is retracted", " references are retracted")),
        F.when(c("not_found") > 0, F.concat(_count(c("not_found"), " reference", " references"), F.lit(" could not be found in any index"))),
        F.when(wrong > 0, F.concat(wrong, F.lit(" "), F.when(wrong == 1, noun).otherwise(plural), F.lit(" may not say what they are cited for"))),
        F.when(c("flagged_open") > 0, F.concat(_count(c("flagged_open"), " reference carries", " references carry"), F.lit(" a high-severity flag"))),
        F.when(
            (level == "review") & many_unverified,
            F.concat(c("n_unverified"), F.lit(" of "), checked, F.lit(" "), F.when(checked == 1, noun).otherwise(plural), F.lit(" could not be verified")),
        ),
    )
    found = F.array_compact(lines)
    clean = F.concat(F.lit("No integrity problems were found in the "), checked, F.lit(" "), F.when(checked == 1, noun).otherwise(plural), F.lit(" checked"))
    reviewed = F.array_compact(F.array(F.when(c("reviewed") > 0, F.concat(_count(c("reviewed"), " verdict was", " verdicts were"), F.lit(" set by hand after review")))))
    empty = F.array(F.concat(F.lit("Nothing was checked: "), why, F.lit(".")), F.lit("This is not a clean result: the paper was not screened."))
    headlines = F.when(c("references_checked") == 0, empty).otherwise(F.concat(F.when(F.size(found) == 0, F.array(clean)).otherwise(found), reviewed))
    return stats.select("run_id", level.alias("level"), headlines.alias("headlines"))


def warnings(base: DataFrame, entries: DataFrame, flags: DataFrame) -> DataFrame:
    """run_id, place, message: base warnings, then timed-out entries' first notes and open high flags in key order; each once."""
    first = W.partitionBy("run_id", "key").orderBy("flag_no")
    high = flags.where("severity = 'high'").withColumn("at", F.row_number().over(first)).where("at = 1")
    is_open = F.coalesce(F.col("reviewed_verdict"), F.lit("")) == ""
    marked = F.concat(F.lit("["), F.col("key"), F.lit("] "))
    key = F.struct(F.col("key").try_cast("int").isNull().alias("other"), F.col("key").try_cast("int").alias("number"), F.col("key").alias("key"))
    none = F.struct(F.lit(False).alias("other"), F.lit(None).cast("int").alias("number"), F.lit("").alias("key"))
    late = entries.where(F.col("timed_out") & (F.col("note") != "")).select("run_id", F.lit(1).alias("part"), key.alias("k"), F.lit(0).alias("sub"), F.concat(marked, F.col("note")).alias("message"))
    handled = F.when(F.col("rechecked"), F.lit(" (re-checked since)")).otherwise(F.lit(""))
    flagged = high.join(entries.where(is_open), ["run_id", "key"]).select("run_id", F.lit(1).alias("part"), key.alias("k"), F.lit(1).alias("sub"), F.concat(marked, F.col("message"), handled).alias("message"))
    given = base.select("run_id", F.lit(0).alias("part"), none.alias("k"), F.col("place").alias("sub"), "message")
    rows = given.unionByName(late).unionByName(flagged)
    order = [F.col("part"), F.col("k"), F.col("sub")]
    once = rows.withColumn("copy", F.row_number().over(W.partitionBy("run_id", "message").orderBy(*order))).where("copy = 1")
    return once.select("run_id", F.row_number().over(W.partitionBy("run_id").orderBy(*order)).alias("place"), "message")


def urgency(entries: DataFrame, claim_verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """Report order: the most urgent of the verdicts held; retractions and high flags lift it; not_found counts 6 here."""
    rank = F.when(F.col("verdict") == "not_found", 6).otherwise(concern_of(F.col("verdict"))).cast("double")
    held = verdicts_in(entries, claim_verdicts).groupBy("run_id", "key").agg(F.max(rank).alias("held"))
    high = flags.where("severity = 'high'").select("run_id", "key").distinct().withColumn("high", F.lit(4.5))
    joined = entries.join(held, ["run_id", "key"], "left").join(high, ["run_id", "key"], "left")
    score = F.greatest(F.coalesce("held", F.lit(0.0)), F.when(F.col("retracted"), 6.5).otherwise(0.0), F.coalesce("high", F.lit(0.0)))
    place = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("urgency"), *key_order()))
    return joined.withColumn("urgency", score).select("run_id", "key", "urgency").withColumn("place", place)


def section(entries: DataFrame, claim_verdicts: DataFrame, verdict: str) -> DataFrame:
    """The entries that belong in a verdict's section."""
    return entries.join(verdicts_in(entries, claim_verdicts).where(F.col("verdict") == verdict).select("run_id", "key"), ["run_id", "key"], "left_semi")


def capped(entries: DataFrame, most: int) -> DataFrame:
    """The first ``most`` references of each run in key order (between 1 and 500)."""
    place = F.row_number().over(W.partitionBy("run_id").orderBy(*key_order()))
    return entries.withColumn("place", place).where(F.col("place") <= max(1, min(500, most)))


def check_ladder() -> Column:
    """What becomes of a reference: the first condition that holds ends the check."""
    c = F.col
    return (
        F.when(c("existence") == "not_found", "not_found")
        .when((c("url") == "") & (c("abstract") == ""), "unverified")
        .when(~c("fetch_ok") & c("dead") & (c("identifier_printed") == "url"), "not_found")
        .when((c("text_chars") == 0) & c("blocked"), "blocked")
        .when(c("text_chars") == 0, "unverified")
        .otherwise("judge")
    )


def time_budget(count: Column, workers: Column) -> Column:
    """Seconds that the checking phase may take: three times the estimate, three minutes at least."""
    return F.greatest(F.lit(float(LEAST_SECONDS)), 3.0 * SERIAL_SECONDS * count / F.greatest(F.lit(1), workers))


def with_stand_ins(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Every planned reference: its result, or a stand-in that is unverified (never not_found) and says where it stopped."""
    joined = planned.join(results.select("run_id", "key", "verdict"), ["run_id", "key"], "left")
    late = F.col("verdict").isNull()
    note = F.concat(F.lit("This reference was not finished in time (last step: "), F.col("stage"), F.lit(")."))
    return joined.select("run_id", "key", F.coalesce("verdict", F.lit("unverified")).alias("verdict"), late.alias("timed_out"), F.when(late, note).otherwise("").alias("note"))


# --- the reader's actions, replayed ---------------------------------------------------------------


def replay(actions: DataFrame, by: list[str]) -> DataFrame:
    """The override that stands for each target: its last action, if that set a verdict."""
    last = actions.where("kind in ('set', 'clear')").groupBy(*by).agg(F.max_by(F.struct("kind", "verdict", "at"), "action_no").alias("last"))
    return last.where("last.kind = 'set'").select(*by, F.col("last.verdict").alias("override"), F.col("last.at").alias("at"))


def settle(entries: DataFrame, claims: DataFrame, actions: DataFrame) -> DataFrame:
    """run_id, key, verdict, reviewed_source: a headline set by hand, else the roll-up of edited claims, else the machine's.

    ``entries`` and ``claims`` hold the machine's verdicts, which actions displace but never change.
    """
    on_entry = replay(actions.where("claim_no is null"), ["run_id", "key"])
    on_claim = replay(actions.where("claim_no is not null"), ["run_id", "key", "claim_no"])
    edited = claims.select("run_id", "key", "claim_no", "verdict").join(on_claim, ["run_id", "key", "claim_no"], "left")
    now = edited.withColumn("verdict", F.coalesce("override", "verdict"))
    rolled = roll_up(now, ["run_id", "key"]).join(
        edited.groupBy("run_id", "key").agg(F.count("override").alias("edits")), ["run_id", "key"]
    )
    joined = entries.join(rolled, ["run_id", "key"], "left").join(on_entry.select("run_id", "key", "override"), ["run_id", "key"], "left")
    by_claims = headline(F.col("worst"), F.col("mildest"), F.col("engine"))
    has_edits = F.coalesce("edits", F.lit(0)) > 0
    verdict = F.when(F.col("override").isNotNull(), F.col("override")).when(has_edits, by_claims).otherwise(F.col("verdict"))
    source = F.when(F.col("override").isNotNull(), "reference").when(has_edits, "claims").otherwise("")
    return joined.select("run_id", "key", F.col("verdict").alias("machine_verdict"), verdict.alias("verdict"), source.alias("reviewed_source"))


def recheck(entries: DataFrame, rechecks: DataFrame) -> DataFrame:
    """Each entry after its latest re-check; one that retrieved nothing (no engine, not not_found) keeps the entry."""
    last = rechecks.groupBy("run_id", "key").agg(F.max_by(F.struct("verdict", "engine"), "action_no").alias("new"))
    joined = entries.join(last, ["run_id", "key"], "left")
    barren = (F.col("new.engine") == "") & (F.col("new.verdict") != "not_found")
    outcome = F.when(F.col("new").isNull(), "").when(barren, "nothing_retrieved").otherwise("replaced")
    took = outcome == "replaced"
    return joined.select(
        "run_id", "key",
        F.when(took, F.col("new.verdict")).otherwise(F.col("verdict")).alias("verdict"),
        F.when(took, F.col("new.engine")).otherwise(F.col("engine")).alias("engine"),
        outcome.alias("outcome"),
    )


def engine_label(old: Column, new: Column) -> Column:
    """A re-check of one claim never weakens the label: a model's stays over lexical, lexical over none."""
    rank = lambda e: F.when(F.coalesce(e, F.lit("")) == "", 0).when(e == "lexical", 1).otherwise(2)
    return F.when(rank(new) >= rank(old), new).otherwise(old)


def recheck_claims(claims: DataFrame, rechecked: DataFrame) -> DataFrame:
    """One claim's new machine verdict, found by its text, else by its number; siblings stay as they are."""
    by_text = rechecked.select("run_id", "key", F.trim("text").alias("wanted"), F.col("verdict").alias("by_text")).where("wanted != ''").dropDuplicates(["run_id", "key", "wanted"])
    by_number = rechecked.select("run_id", "key", "claim_no", F.col("verdict").alias("by_number"), F.trim("text").alias("sought"))
    known = claims.select("run_id", "key", F.trim("claim").alias("sought")).distinct().withColumn("known", F.lit(True))
    by_number = by_number.join(known, ["run_id", "key", "sought"], "left").where("known is null").drop("known", "sought")
    joined = claims.withColumn("wanted", F.trim("claim")).join(by_text, ["run_id", "key", "wanted"], "left").join(by_number, ["run_id", "key", "claim_no"], "left")
    return joined.withColumn("verdict", F.coalesce("by_text", "by_number", "verdict")).drop("wanted", "by_text", "by_number")


def excerpt_around(text: Column, quote: Column, width: int = 2400) -> Column:
    """``width`` characters of the text around a quote, from the start where the quote isn't in it."""
    at = F.when(F.coalesce(quote, F.lit("")) == "", 0).otherwise(F.instr(text, quote))
    start = F.when(at > 0, F.greatest(F.lit(1), at - width // 2)).otherwise(1)
    return F.substring(text, start, F.lit(width))


def expired(runs: DataFrame, now: Column, hours: float) -> DataFrame:
    """Finished runs whose latest file is older than ``hours``; names that are no run ids are never touched, 0 hours keeps all."""
    latest = runs.where(F.col("name").rlike(RUN_ID)).groupBy("name").agg(F.max("mtime").alias("mtime"), F.bool_or("running").alias("running"))
    return latest.where(F.lit(hours > 0) & ~F.col("running") & (F.unix_timestamp("mtime") < F.unix_timestamp(now) - int(hours * 3600))).select("name")
