"""Does a cited work exist?  Agreement of titles, candidates, index outcomes, and the settlement.

The rule everywhere: no answer is never a no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citelake.functions.text import and_list, is_unindexed_kind, jaccard, title_tokens

# Thresholds of agreement.
CONFIRM, SAME_WORK, FABRICATED, NOTE_BELOW, OTHER_WORK, MOSTLY_PRINTED = 0.55, 0.85, 0.35, 0.6, 0.3, 0.6
AUTHOR_BONUS, AUTHOR_PENALTY, SURE_TITLE, YEAR_BONUS = 0.12, 0.3, 0.95, 0.08


def title_agreement(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the title words of three letters or more without a few stop words."""
    return jaccard(title_tokens(a), title_tokens(b))


def agreement(title: Column, printed_names: Column, found_names: Column, printed_year: Column, found_year: Column) -> Column:
    """Title agreement, lifted by shared surnames and year only from ``CONFIRM`` on, lowered by disjoint surnames."""
    liftable = title >= CONFIRM
    both = (F.size(printed_names) > 0) & (F.size(found_names) > 0)
    meet = F.arrays_overlap(printed_names, found_names)
    names = F.when(both & meet & liftable, AUTHOR_BONUS).when(both & ~meet & (title < SURE_TITLE), -AUTHOR_PENALTY).otherwise(0.0)
    years = F.when(liftable & (printed_year != "") & (printed_year == found_year), YEAR_BONUS).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), title + F.coalesce(names, F.lit(0.0)) + F.coalesce(years, F.lit(0.0))))


def best_agreement(title: Column, score: Column) -> Column:
    """The unpenalised agreement that a candidate counts for, to three places."""
    return F.round(F.least(F.lit(1.0), F.greatest(title, score)), 3)


def best_candidates(entries: DataFrame, candidates: DataFrame, by: list[str], most_common: int = 1000) -> DataFrame:
    """by.., candidate_no, score: the candidate that agrees best with each entry's title, the first of equals.

    Only pairs that share a title word can agree at all.  Jaccard of at least ``FABRICATED`` needs a shared
    word among the rarest of the entry's words, so pairs meet on those only: an entry of n words looks under
    its n - ceil(FABRICATED * n) + 1 rarest.  ``entries`` and ``candidates`` have ``title``.
    """
    words = candidates.select("candidate_no", F.col("title").alias("found"), title_tokens("title").alias("words"))
    held = words.select("candidate_no", F.explode("words").alias("word"))
    frequency = held.groupBy("word").agg(F.count("*").alias("df"))
    wanted = entries.select(*by, "title", title_tokens("title").alias("printed"))
    looked = wanted.select(*by, F.size("printed").alias("n"), F.explode("printed").alias("word")).join(frequency, "word")
    rare = W.partitionBy(*by).orderBy("df", "word")
    looked = looked.withColumn("place", F.row_number().over(rare)).where(F.col("place") <= F.col("n") - F.ceil(FABRICATED * F.col("n")) + 1)
    pairs = looked.select(*by, "word").join(held, "word").select(*by, "candidate_no").distinct()
    scored = pairs.join(wanted, by).join(words, "candidate_no").withColumn("score", jaccard(F.col("printed"), F.col("words")))
    first = W.partitionBy(*by).orderBy(F.desc("score"), "candidate_no")
    top = scored.withColumn("at", F.row_number().over(first)).where("at = 1")
    return top.select(*by, "candidate_no", "found", "score")


def outcome(status: Column, found: Column) -> Column:
    """hit, missed or errored; no reply, throttling and server errors are no answers."""
    return F.when(status.isNull() | (status == 429) | (status >= 500), "errored").when(found, "hit").otherwise("missed")


def outcomes(replies: DataFrame, by: list[str]) -> DataFrame:
    """by.., hits, misses, errors: each index in one list, the best of its answers."""
    rank = F.when(F.col("outcome") == "hit", 3).when(F.col("outcome") == "missed", 2).otherwise(1)
    each = replies.withColumn("outcome", outcome(F.col("status"), F.col("found"))).groupBy(*by, "index").agg(F.max_by("outcome", rank).alias("outcome"))
    listed = lambda name: F.array_sort(F.collect_set(F.when(F.col("outcome") == name, F.col("index"))))
    return each.groupBy(*by).agg(listed("hit").alias("hits"), listed("missed").alias("misses"), listed("errored").alias("errors"))


def settle(entries: DataFrame) -> DataFrame:
    """existence, identifier_resolved and a note.

    ``entries`` has hits, misses, errors, identifier_printed, identifier_wrong, raw, best_agreement; web
    pages also loaded and dead.
    """
    c = F.col
    hit, missed = F.size("hits") > 0, F.size("misses") > 0
    identified = c("identifier_printed").isin("doi", "arxiv")
    web = c("identifier_printed") == "url"
    gone = F.coalesce(c("dead"), F.lit("")) != ""
    unindexed = is_unindexed_kind(c("raw"))
    existence = (
        F.when(hit, "confirmed")
        .when(web, F.when(c("loaded"), "confirmed").when(gone, "not_found").otherwise("unconfirmed"))
        .when(identified, F.when(missed, "not_found").otherwise("unconfirmed"))
        .when(missed & ~unindexed & (c("best_agreement") < FABRICATED), "not_found")
        .otherwise("unconfirmed")
    )
    resolved = (
        F.when(hit & identified, F.coalesce(c("identifier_wrong"), F.lit("")) == "")
        .when(web & ~hit, F.when(c("loaded"), True).when(gone, False))
        .when(identified & missed, False)
    )
    where = and_list(c("misses"))
    score = F.format_number("best_agreement", 2)
    note = (
        F.when(hit, "")
        .when(web, F.when(c("loaded"), "This reference is a web page: the printed address loads.").when(gone, F.concat(F.lit("The printed address does not load ("), c("dead"), F.lit(")."))).otherwise(""))
        .when(identified & missed, F.concat(F.lit("The "), F.upper("identifier_printed"), F.lit(" printed in this entry is not registered in "), where, F.lit(".")))
        .when(~missed, "None of the bibliographic indexes could be reached.")
        .when(unindexed, "The indexes list few works of this kind, so their silence says nothing.")
        .when(c("best_agreement") < FABRICATED, F.concat(F.lit("No record was found in "), where, F.lit("; the closest scored "), score, F.lit(".")))
        .otherwise(F.concat(F.lit("Not confidently matched (best agreement "), score, F.lit(").")))
    )
    return entries.withColumns({"existence": existence, "identifier_resolved": resolved, "existence_note": note})


def doi_anchored() -> Column:
    """The DOI goes back to what the entry printed, or to a search that found the work."""
    return F.col("identifier_printed").isin("doi", "arxiv") | (F.col("search_agreement") >= CONFIRM)


def is_other_work(record_title: Column, claimed: Column, raw: Column) -> Column:
    """A printed identifier leads to a title that neither agrees with the entry's nor is printed in it."""
    words = F.regexp_extract_all(F.lower(record_title), F.lit("([a-z0-9]{3,})"), 1)
    printed = F.size(F.filter(words, lambda w: F.contains(F.lower(raw), w)))
    mostly = (F.size(words) > 0) & (printed >= MOSTLY_PRINTED * F.size(words))
    return (record_title != "") & (F.length(claimed) >= 12) & (title_agreement(claimed, record_title) < OTHER_WORK) & ~mostly


ADOPTED = ("title", "authors", "year", "venue", "doi", "abstract", "retracted")


def adopt(entries: DataFrame, found: DataFrame, by: list[str], wrong: Column) -> DataFrame:
    """Where ``wrong`` holds and a title search found the work (``SAME_WORK`` at least), its columns replace the entry's."""
    better = found.where((F.col("search_agreement") >= SAME_WORK) & (F.col("doi") != ""))
    renamed = better.select(*by, *(F.col(c).alias(f"new_{c}") for c in ADOPTED), F.lit(True).alias("has_new"))
    joined = entries.join(renamed, by, "left")
    take = wrong & F.coalesce("has_new", F.lit(False)) & (F.lower("new_doi") != F.lower("doi"))
    out = {c: F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ADOPTED}
    out["identifier_wrong"] = F.when(take, F.col("doi")).otherwise(F.col("identifier_wrong"))
    return joined.withColumns(out).drop("has_new", *(f"new_{c}" for c in ADOPTED))


def registry(code: Column) -> Column:
    """The handle registry's answer: registered, not registered, or unknown."""
    return F.when(code == 1, True).when(code == 100, False)


def dead_doi(entries: DataFrame) -> DataFrame:
    """A DOI that Crossref misses but the registry knows is a hit of the registry."""
    known = F.array_contains("misses", "Crossref") & F.coalesce(registry(F.col("handle_code")), F.lit(False))
    return entries.withColumns(
        {
            "hits": F.when(known, F.array_append("hits", "DOI registry")).otherwise(F.col("hits")),
            "misses": F.when(known, F.array_remove("misses", "Crossref")).otherwise(F.col("misses")),
        }
    )


def lookups(entries: DataFrame) -> DataFrame:
    """Which indexes an entry is looked up in, and how: the plan of the conditional joins."""
    c = F.col
    has_doi, has_arxiv, long_title = c("doi") != "", c("arxiv") != "", F.length("title") > 15
    found, open_copy = F.coalesce(c("hit"), F.lit(False)), c("oa_url") != ""
    searchable = F.length(F.concat_ws(" ", "title", F.substring("authors", 1, 150), "year")) >= 12
    how = {
        "Crossref": F.when(has_doi, "doi").when((c("url") == "") & searchable, "search"),
        "OpenAlex": F.when(has_doi, "doi").when(c("title") != "", "search"),
        "Semantic Scholar": F.when((c("abstract") != "") & open_copy, None).when(has_doi, "doi").when(has_arxiv, "arxiv").when(c("title") != "", "search"),
        "arXiv": F.when(has_arxiv, "id").when(~found & ~has_doi & (c("url") == ""), "search"),
        "Unpaywall": F.when(has_doi & ~open_copy & (c("email") != ""), "doi"),
        "Europe PMC": F.when(has_doi, "doi").when(long_title, "search"),
    }
    each = F.array(*(F.struct(F.lit(k).alias("index"), v.alias("how")) for k, v in how.items()))
    return entries.select("run_id", "key", F.explode(F.filter(each, lambda x: x["how"].isNotNull())).alias("l")).select("run_id", "key", "l.index", "l.how")


def integrity(notices: DataFrame, by: list[str]) -> DataFrame:
    """by.., retracted, kinds: retractions, withdrawals and removals retract; corrections are kept but never flagged."""
    kind = F.lower("kind")
    bad = kind.isin("retraction", "withdrawal", "removal") | F.contains(kind, F.lit("retraction"))
    return notices.groupBy(*by).agg(F.bool_or(bad).alias("retracted"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def abstract_of(inverted: Column, most: int = 4000) -> Column:
    """Text of an inverted index (word to positions), in order of position."""
    places = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.substring(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), 1, most)


def by_identifier(entries: DataFrame, snapshot: DataFrame, identifier: str = "doi") -> DataFrame:
    """The entries with the snapshot's record of their identifier (compared in lower case); a miss keeps its row, found is false.

    ``snapshot`` has the identifier and ``record``; of several records of one identifier the least counts.
    """
    records = snapshot.groupBy(F.lower(identifier).alias("wanted")).agg(F.min("record").alias("record"))
    joined = entries.withColumn("wanted", F.nullif(F.lower(identifier), F.lit(""))).join(records, "wanted", "left")
    return joined.withColumn("found", F.col("record").isNotNull()).drop("wanted")


def search_text(title: Column, authors: Column, year: Column) -> Column:
    """What an index is searched for: title, authors and year in 350 characters; null where that is under 12."""
    text = F.trim(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (title, F.substring(authors, 1, 150), year))))
    return F.when(F.length(text) >= 12, F.substring(text, 1, 350))
