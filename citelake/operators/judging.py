"""Judging claims against passages: lexical scores, verdicts, roll-ups, and the model tier over stored replies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citelake.functions.similarity import token_set_ratio_udf
from citelake.functions.text import tokens
from citelake.schemas import CONCERN, VERDICTS

# Thresholds of the lexical tier, and weights of its scores.
SUPPORTED, RELATED, WEAK = 0.52, 0.34, 0.18
BEST, MEAN, OVERLAP, PHRASE = 0.72, 0.28, 0.68, 0.32
TOP = 3
UNSEEN = 1.0


def verdict_of(score: Column) -> Column:
    """Word overlap never proves a mismatch: the floor is unverified."""
    return F.when(score >= SUPPORTED, "supported").when(score >= RELATED, "related").when(score >= WEAK, "weak").otherwise("unverified")


def concern_of(verdict: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in CONCERN.items():
        out = out.when(verdict == name, rank)
    return out.otherwise(0)


# Characters that a packed passage reaches, that an unpacked paragraph may have, and that either must have.
PACKED, WHOLE, LEAST_PASSAGE = 320, 512, 40


def split_passages(text: str | None, target: int = PACKED) -> Iterator[tuple[int, str]]:
    """Passages with their offsets: paragraphs part at blank lines; long ones are packed by sentence up to ``target``.

    Offsets count in the text with its wrapped lines joined and runs of blanks squeezed.
    """
    joined = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n(?![ \t]*\n)", " ", re.sub(r"\n[ \t]*\n\s*", "\n\n", text or "")))
    starts = [0, *(m.end() for m in re.finditer("\n\n", joined))]
    for number, (begin, end) in enumerate(zip(starts, [*starts[1:], len(joined) + 2], strict=True)):
        paragraph = joined[begin : end - 2].strip()
        sizes = [len(s) for s in re.split(r"(?<=[.!?])\s+", paragraph)] if len(paragraph) > target * WHOLE / PACKED else [len(paragraph)]
        # a sentence opens a passage where the one before has reached the target
        held = list(accumulate(sizes, lambda so_far, size: size if so_far >= target else so_far + size))
        opens = [0, *(k + 1 for k, so_far in enumerate(held[:-1]) if so_far >= target)]
        places = [0, *accumulate(size + 1 for size in sizes)]
        for a, b in zip(opens, [*opens[1:], len(sizes)], strict=True):
            passage = paragraph[places[a] : places[b] - 1].strip()
            if len(passage) > LEAST_PASSAGE:
                yield begin - number + places[a], passage


def passages(sources: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by.., passage_no, offset, text: the passages of each source text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (*(row[c] for c in by), i, offset, chunk)
                for row in frame.to_dict("records")
                for i, (offset, chunk) in enumerate(split_passages(row[text]))
            ]
            yield pd.DataFrame(rows, columns=[*by, "passage_no", "offset", "text"])

    own = sources.select(*by, text)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInPandas(run, f"{kept}{', ' if by else ''}passage_no int, offset int, text string")


def header_passage(sources: DataFrame, by: list[str]) -> DataFrame:
    """Title and abstract as one passage at offset -1, at most 1200 characters, where there is any."""
    both = F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in ("title", "abstract")))
    return sources.where(both != "").select(*by, F.lit(-1).alias("passage_no"), F.lit(-1).alias("offset"), F.substring(both, 1, 1200).alias("text"))


def overlap_scores(claims: DataFrame, windows: DataFrame, by: list[str], claim: list[str], passage: list[str]) -> DataFrame:
    """by.., claim.., passage.., overlap: pairs that share a token.

    ``claims`` and ``windows`` have their keys and text.  Passage tokens that no claim has are dropped before
    anything is shuffled: they can't score, and only claims' tokens need document frequencies.
    """
    n = windows.groupBy(*by).agg(F.count("*").alias("n")) if by else windows.agg(F.count("*").alias("n"))
    wanted = claims.select(*by, *claim, F.explode(F.array_distinct(tokens("text"))).alias("token"))
    held = windows.select(*by, *passage, F.explode(F.array_distinct(tokens("text"))).alias("token"))
    held = held.join(wanted.select(*by, "token").distinct(), [*by, "token"])
    df = held.groupBy(*by, "token").agg(F.count("*").alias("df"))
    weights = wanted.select(*by, "token").distinct().join(df, [*by, "token"], "left")
    weights = weights.join(n, by) if by else weights.crossJoin(F.broadcast(n))  # one row
    weights = weights.select(*by, "token", F.when(F.col("df").isNull(), F.lit(UNSEEN)).otherwise(F.ln(1 + F.col("n") / (1 + F.col("df")))).alias("idf"))
    weighed = wanted.join(weights, [*by, "token"])
    total = weighed.groupBy(*by, *claim).agg(F.sum("idf").alias("total"))
    hit = held.join(weighed, [*by, "token"]).groupBy(*by, *claim, *passage).agg(F.sum("idf").alias("hit"))
    return hit.join(total, [*by, *claim]).select(*by, *claim, *passage, (F.col("hit") / F.col("total")).alias("overlap"))


def lexical_support(
    claims: DataFrame, windows: DataFrame, by: list[str], claim: list[str], passage: list[str], phrase: bool = True
) -> DataFrame:
    """by.., claim.., score, verdict and the best passage of every claim that has content words.

    The blend runs over the three best passages, passages without a shared token counting as 0.  ``phrase``
    adds the fuzzy phrase term; without it the score is the overlap alone.
    """
    scored = overlap_scores(claims, windows, by, claim, passage)
    if phrase:
        texts = scored.join(windows.select(*by, *passage, F.col("text").alias("passage_text")), [*by, *passage])
        texts = texts.join(claims.select(*by, *claim, F.array_join(tokens("text"), " ").alias("claim_words")), [*by, *claim])
        fuzz = token_set_ratio_udf("claim_words", F.lower("passage_text")) / 100.0
        scored = texts.select(*by, *claim, *passage, F.least(F.lit(1.0), OVERLAP * F.col("overlap") + PHRASE * fuzz).alias("score"))
    else:
        scored = scored.withColumnRenamed("overlap", "score")
    # sums of weights differ in the last bits with the order of rows, which must not decide the ranking
    scored = scored.withColumn("score", F.round("score", 9))
    order = W.partitionBy(*by, *claim).orderBy(F.desc("score"), *passage)
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    best = [F.max(F.when(F.col("rank") == 1, F.col(c))).alias(f"best_{c}") for c in passage]
    blended = top.groupBy(*by, *claim).agg(F.max("score").alias("best"), F.sum("score").alias("sum"), *best)
    n = windows.groupBy(*by).agg(F.count("*").alias("n")) if by else windows.agg(F.count("*").alias("n"))
    able = claims.where(F.size(tokens("text")) > 0).select(*by, *claim)
    joined = able.join(n, by) if by else able.crossJoin(F.broadcast(n))  # one row
    joined = joined.join(blended, [*by, *claim], "left")
    mean = F.coalesce("sum", F.lit(0.0)) / F.least(F.lit(TOP), F.col("n"))
    score = BEST * F.coalesce("best", F.lit(0.0)) + MEAN * mean
    return joined.select(*by, *claim, F.round(score, 6).alias("score"), verdict_of(score).alias("verdict"), *(f"best_{c}" for c in passage))


def best_claim(judged: DataFrame, by: list[str]) -> DataFrame:
    """The claim with the highest score, the first of equals, as the reference's headline."""
    top = judged.groupBy(*by).agg(F.max_by(F.struct("claim_no", "score"), F.struct("score", -F.col("claim_no"))).alias("top"))
    headline = F.round("top.score", 3)
    return top.select(*by, F.col("top.claim_no").alias("claim_no"), headline.alias("score"), verdict_of(headline).alias("verdict"))


def roll_up(claim_verdicts: DataFrame, by: list[str]) -> DataFrame:
    """One verdict from many: the model tier takes the most concerning, the lexical tier the least; first wins ties."""
    ranked = claim_verdicts.withColumn("rank", concern_of(F.col("verdict")))
    return ranked.groupBy(*by).agg(
        F.max_by("verdict", F.struct("rank", -F.col("claim_no"))).alias("worst"),
        F.min_by("verdict", F.struct("rank", "claim_no")).alias("mildest"),
    )


def headline(worst: Column, mildest: Column, engine: Column) -> Column:
    by_model = (F.coalesce(engine, F.lit("")) != "") & (engine != "lexical")
    return F.coalesce(F.when(by_model, worst).otherwise(mildest), F.lit("unverified"))


def shared_terms(claims: DataFrame, windows: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """The rarest tokens that each claim shares with any window: idf first, then by spelling."""
    wanted = claims.select(*by, "claim_no", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    held = windows.select(*by, "passage_no", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    df = held.join(wanted.select(*by, "token").distinct(), [*by, "token"]).groupBy(*by, "token").agg(F.count("*").alias("df"))
    order = W.partitionBy(*by, "claim_no").orderBy("df", "token")
    return wanted.join(df, [*by, "token"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def highlight_order(scored: DataFrame, by: list[str]) -> DataFrame:
    """Passages worth highlighting: real ones with a score, long ones first, then by score; equal texts once."""
    real = scored.where("offset >= 0 and score > 0")
    once = W.partitionBy(*by, "text").orderBy((F.length("text") < 120), F.desc("score"), "passage_no")
    place = W.partitionBy(*by).orderBy((F.length("text") < 120), F.desc("score"), "passage_no")
    return real.withColumn("copy", F.row_number().over(once)).where("copy = 1").drop("copy").withColumn("place", F.row_number().over(place))


def parse_reply(reply: Column) -> Column:
    """The first JSON object in a model's reply; unknown verdicts become unverified."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "verdict string, confidence double, reason string, evidence_quote string")
    verdict = F.lower(F.trim(got["verdict"]))
    return F.when(got.isNull(), F.lit(None)).otherwise(
        F.struct(
            F.when(verdict.isin(*VERDICTS), verdict).otherwise("unverified").alias("verdict"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(got["confidence"], F.lit(0.0)))).alias("score"),
            F.coalesce(got["reason"], F.lit("")).alias("reason"),
            F.coalesce(got["evidence_quote"], F.lit("")).alias("evidence_quote"),
        )
    )


def prompt(excerpt: Column, abstract: Column) -> Column:
    """What a judge is asked, or null where neither excerpt nor abstract has 120 characters (then none is asked)."""
    thin = (F.length(F.coalesce(excerpt, F.lit(""))) < 120) & (F.length(F.coalesce(abstract, F.lit(""))) < 120)
    parts = [
        F.concat(F.lit("CLAIM: "), F.col("text")),
        F.when((F.col("context") != "") & (F.col("context") != F.col("text")), F.concat(F.lit("FULL SENTENCE: "), F.col("context"))),
        F.when(F.col("co_cited") > 1, F.concat(F.lit("CITED TOGETHER WITH "), (F.col("co_cited") - 1).cast("string"), F.lit(" OTHERS"))),
        F.concat(F.lit("REFERENCE: "), F.col("reference")),
        F.when(F.col("title") != "", F.concat(F.lit("TITLE: "), F.col("title"))),
        F.when(abstract != "", F.concat(F.lit("ABSTRACT: "), abstract)),
        F.when(excerpt != "", F.concat(F.lit("EXCERPT: "), F.substring(excerpt, 1, 24000))),
    ]
    return F.when(~thin, F.concat_ws("\n", *parts))


def second_look(judged: DataFrame) -> DataFrame:
    """A weak or unrelated verdict gives way to a strictly milder one that the abstract alone earned."""
    harsh = F.col("verdict").isin("weak", "unrelated") & (F.length("abstract") >= 120) & (F.col("abstract") != F.col("source_text"))
    milder = harsh & F.col("second_verdict").isNotNull() & (concern_of(F.col("second_verdict")) < concern_of(F.col("verdict")))
    return judged.withColumn("reconsidered", milder).withColumn("verdict", F.when(milder, F.col("second_verdict")).otherwise(F.col("verdict")))


def judge_replies(claims: DataFrame, replies: DataFrame, lexical: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """Each claim's verdict by the model where a reply came, kept as unverified where a call failed.

    ``replies`` has by.., claim_no, reply (null: the call failed).  At most ``most`` claims of a reference are
    judged.  Where no call of a reference succeeded, the lexical verdicts stand.
    """
    order = W.partitionBy(*by).orderBy("claim_no")
    asked = claims.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
    parsed = replies.select(*by, "claim_no", parse_reply(F.col("reply")).alias("got"))
    whole = W.partitionBy(*by)
    joined = asked.select(*by, "claim_no").join(parsed, [*by, "claim_no"], "left")
    joined = joined.withColumn("answered", F.count("got").over(whole))
    joined = joined.join(lexical.select(*by, "claim_no", F.col("verdict").alias("lexical_verdict")), [*by, "claim_no"], "left")
    verdict = F.when(F.col("answered") == 0, F.col("lexical_verdict")).otherwise(F.coalesce("got.verdict", F.lit("unverified")))
    engine = F.when(F.col("answered") == 0, "lexical").otherwise("openai")
    return joined.select(*by, "claim_no", verdict.alias("verdict"), engine.alias("engine"))


def ask_model(prompts: DataFrame, by: list[str], client: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """Replies from a live judge: ``client()`` is made once a partition; a call that raises or returns None failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for frame in frames:
            replies = []
            for text in frame["prompt"]:
                try:
                    replies.append(ask(text) if isinstance(text, str) else None)
                except Exception:  # a failed call is a null reply, never a verdict
                    replies.append(None)
            yield frame[by].assign(reply=pd.Series(replies, dtype="object", index=frame.index))

    own = prompts.select(*by, "prompt")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInPandas(run, f"{kept}, reply string")


def lenient_json(reply: str) -> dict | None:
    """The object between the first and the last brace, if it is one."""
    start, end = reply.find("{"), reply.rfind("}")
    try:
        out = json.loads(reply[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def quote_order(claim_verdicts: DataFrame, by: list[str]) -> DataFrame:
    """place: the claims of a reference, the most concerning first, equals in their order."""
    order = W.partitionBy(*by).orderBy(concern_of(F.col("verdict")).desc(), "claim_no")
    return claim_verdicts.withColumn("place", F.row_number().over(order))


def roll_up_reason(claim_verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by.., reason: how many claims got which verdict, the most concerning first."""
    counts = claim_verdicts.groupBy(*by, "verdict").agg(F.count("*").alias("n"))
    rank = concern_of(F.col("verdict"))
    listed = F.sort_array(F.collect_list(F.struct((-rank).alias("rank"), "verdict", "n")))
    said = F.transform(listed, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), F.replace(x["verdict"], F.lit("_"), F.lit(" "))))
    total = F.sum("n")
    places = F.when(total == 1, " citing place: ").otherwise(" citing places: ")
    return counts.groupBy(*by).agg(F.concat(total.cast("string"), places, F.array_join(said, ", "), F.lit(".")).alias("reason"))


def lexical_reason(score: Column, verdict: Column, terms: Column) -> Column:
    """Why the lexical tier judged as it did."""
    shown = F.when(F.size(terms) == 0, "no distinctive terms").otherwise(F.array_join(F.slice(terms, 1, 6), ", "))
    number = F.format_number(score, 2)
    low = F.concat(F.lit("Word overlap with the retrieved text was low ("), number, F.lit("), which is not enough to judge either way."))
    return F.when(verdict == "unverified", low).otherwise(F.concat(F.lit("Lexical overlap "), number, F.lit("; strongest shared terms: "), shown, F.lit(".")))
