"""Language identification as multilingual mixture inference.

A document is cut into units of consecutive character n-grams (hashed 4-grams of the lower-cased UTF-8
bytes).  Each known language gives each unit a likelihood; expectation-maximisation estimates the
proportions in which the languages generate the document's units.  Which languages take part is chosen by
penalised likelihood: starting from the best single language, the one that raises the likelihood most joins
as long as the gain exceeds half the log of the number of units.  The predicted language is the one with the
largest proportion, which is also the score.

``und`` with score 0 is given where the text is null or has no letter.  Ties go to the language that comes
first in sorted order.  Whole texts are read, every row is kept.

Training reads the texts of about ``per_language`` documents of each language, a documented bound: those whose
hash of doc_id and text lies in the first ``per_language``/n of its range, n being the language's documents, so
nothing is sorted or ranked.  n-gram counts come back as at most ``BUCKETS`` numbers a language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import map_arrow, quoted, schema_of

GRAM = 4
BITS = 18
BUCKETS = 1 << BITS
#: n-grams in a unit of the mixture
UNIT = 64
#: most n-grams scored at once
BLOCK = 1 << 20
STEPS = 12
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages) float32


def buckets_of(text: str) -> np.ndarray:
    """Bucket of every 4-gram of the text, with a space at either end."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace").translate(_TO_SPACE), np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        b = np.concatenate([b, np.full(GRAM - len(b), 0x20, np.uint32)])
    word = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return (word * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def train(docs: DataFrame, learn: Column, per_language: int = 1000) -> LanguageModel:
    """Learn from text and lang of the rows where ``learn`` holds and both are non-null."""
    own = docs.select("doc_id", "text", "lang", learn.alias("learn")).where("learn and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    place = {lang: k for k, lang in enumerate(languages)}
    most = [-(1 << 63) + min((1 << 64) - 1, (per_language << 64) // sizes[lang]) for lang in languages]
    bounds = docs.sparkSession.createDataFrame(list(zip(languages, most, strict=True)), "lang string, most long")
    texts = own.select("lang", "text", F.xxhash64("doc_id", "text").alias("mark")).join(F.broadcast(bounds), "lang")  # one row a language
    texts = texts.where("mark <= most").select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if LETTER.search(text):
                row = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                row += np.bincount(buckets_of(text), minlength=BUCKETS)
        at = {k: np.flatnonzero(v) for k, v in sums.items()}
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, v in at.items() for _ in range(len(v))], pa.string()),
                pa.array(np.concatenate([np.zeros(0, np.int64), *at.values()]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(0, np.int64), *(sums[k][v] for k, v in at.items())])),
            ],
            names=["lang", "bucket", "n"],
        )

    counted = map_arrow(texts, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    which = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    counts[table["bucket"].to_numpy(), which] = table["n"].to_numpy()
    smooth = counts + 0.05
    return LanguageModel(languages, np.log(smooth / smooth.sum(0)).astype(np.float32))


def unit_likelihoods(text: str, log_p: np.ndarray) -> np.ndarray:
    """(units, languages): log-likelihood of each unit; long texts go through in blocks."""
    b = buckets_of(text)
    out = []
    for at in range(0, len(b), BLOCK):
        part = b[at : at + BLOCK]
        out.append(np.add.reduceat(log_p[part], np.arange(0, len(part), UNIT), axis=0, dtype=np.float64))
    return np.concatenate(out)


def mixtures(units: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents, languages) and the chosen sets, for documents whose units begin at ``starts``."""
    n_docs, n_lang = len(starts), units.shape[1]
    sizes = np.diff(np.append(starts, len(units)))
    top = units.max(1, keepdims=True)
    scaled = np.exp(np.maximum(units - top, -60.0))
    single = np.add.reduceat(units, starts, axis=0)
    chosen = np.zeros((n_docs, n_lang), bool)
    chosen[np.arange(n_docs), single.argmax(1)] = True
    # a floor on unit likelihoods keeps the single-language baseline comparable with the mixtures
    held = np.add.reduceat(np.log(scaled), starts, axis=0)[chosen]
    shares = chosen.astype(float)
    active = np.flatnonzero(sizes > 1)
    while len(active) and n_lang > 1:
        best, best_set, best_share = np.full(len(active), -np.inf), np.zeros((len(active), n_lang), bool), np.zeros((len(active), n_lang))
        rows = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in active])
        begin = np.concatenate([[0], np.cumsum(sizes[active])[:-1]])
        owner = np.repeat(np.arange(len(active)), sizes[active])
        part = scaled[rows]
        for lang in range(n_lang):
            able = ~chosen[active, lang]
            tried = chosen[active].copy()
            tried[:, lang] = True
            pi = tried / tried.sum(1, keepdims=True)
            for _ in range(STEPS):
                r = part * pi[owner]
                r /= r.sum(1, keepdims=True)
                pi = np.add.reduceat(r, begin, axis=0) / sizes[active][:, None]
            value = np.add.reduceat(np.log((part * pi[owner]).sum(1)), begin)
            better = able & (value > best)
            best[better], best_set[better], best_share[better] = value[better], tried[better], pi[better]
        gain = best - held[active] > 0.5 * np.log(sizes[active])
        joined = active[gain]
        held[joined], chosen[joined], shares[joined] = best[gain], best_set[gain], best_share[gain]
        active = joined[~chosen[joined].all(1)]
    return shares, chosen


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float], list[list[str]]]:
    """Predicted language, its proportion, and the languages of the chosen set, for each text."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    sets: list[list[str]] = [[] for _ in texts]
    if not model.languages:
        return langs, scores, sets
    waiting: list[int] = []
    units: list[np.ndarray] = []

    def settle() -> None:
        if not waiting:
            return
        sizes = np.array([len(u) for u in units])
        shares, chosen = mixtures(np.concatenate(units), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        first = shares.argmax(1)
        for k, i in enumerate(waiting):
            langs[i], scores[i] = model.languages[first[k]], float(min(1.0, shares[k, first[k]]))
            sets[i] = [model.languages[j] for j in np.flatnonzero(chosen[k])]
        waiting.clear()
        units.clear()

    for i, text in enumerate(texts):
        if text and LETTER.search(text):
            units.append(unit_likelihoods(text, model.log_p))
            waiting.append(i)
            if sum(map(len, units[-256:])) > 20_000 or len(units) >= 2000:
                settle()
    settle()
    return langs, scores, sets


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, then lang_pred, score and languages (the chosen set)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, sets = predict(batch.column("text").to_pylist(), sent.value)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
            names=[*keep, "lang_pred", "score", "languages"],
        )

    own = docs.select(*map(quoted, dict.fromkeys([*keep, "text"])))
    return map_arrow(own, run, schema_of(own, keep, "lang_pred string, score double, languages array<string>"))
