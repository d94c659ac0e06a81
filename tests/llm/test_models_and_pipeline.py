"""Toxicity, decontamination, language identification and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from citelake.llm import decontaminate, language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def prose(rng, k, words="the of and to in was is that for on with as by at from this be or are it".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "ing", "er", "tion", "ed", str(rng.randrange(50))]) for _ in range(k))


# --- decontamination --------------------------------------------------------------------------------


def plain_distance(item, region):
    """Fewest edits of the whole item within the region, by the full table."""
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(region, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=30).map(lambda b: bytes(97 + c % 3 for c in b)), st.binary(max_size=40).map(lambda b: bytes(97 + c % 3 for c in b)), st.integers(0, 6))
def test_banded_alignment_equals_the_full_table(item, region, k):
    best = plain_distance(item, region)
    got = decontaminate.align(item, region, k)
    if got is None:
        assert best > k or len(region) < len(item) - k
    else:
        assert got[2] == best <= k and plain_distance(item, region[got[0] : got[1]]) == best


def index(items, rate=decontaminate.RATE):
    folded = [decontaminate.fold(t)[0].tobytes() for t in items]
    return decontaminate.BenchmarkIndex(np.arange(len(items)), folded, rate)


@pytest.mark.parametrize("edits", [0, 1, 4, 10])
def test_items_within_the_budget_are_found_anywhere(edits):
    rng = random.Random(edits)
    items = [prose(rng, 45) for _ in range(12)]
    ix = index(items)
    for j, item in enumerate(items):
        chars = list(item)
        for _ in range(min(edits, ix.edits[j])):
            at = rng.randrange(len(chars))
            chars[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "zz"][: 2 if edits > 4 else 3])
        text = prose(rng, rng.randint(0, 300)) + "! " + "".join(chars).upper().replace(" ", " \n ") + " " + prose(rng, rng.randint(0, 90))
        found = {s["item_id"]: s for s in decontaminate.spans_of(text, ix)}
        assert j in found
        raw = text.lower().encode()
        folded = decontaminate.fold(raw[found[j]["start"] : found[j]["end"]].decode())[0].tobytes()
        assert plain_distance(ix.items[j], folded) == found[j]["edits"]


def test_shared_parts_are_no_leaks():
    rng = random.Random(3)
    items = [prose(rng, 45) for _ in range(10)]
    half = items[0][: len(items[0]) // 2]
    assert decontaminate.spans_of(prose(rng, 200) + half + prose(rng, 200), index(items)) == []
    assert decontaminate.spans_of("", index(items)) == [] and decontaminate.spans_of("x", index([])) == []


def test_op5_query_and_slices(spark, tmp_path):
    rng = random.Random(9)
    items = [prose(rng, 40) for _ in range(8)]
    docs = [(1, "a " + items[3] + " b", 0), (2, prose(rng, 80), 0), (3, None, 0), (4, "", 0), (5, items[1] + " " + items[2], 0), (5, items[1] + " " + items[2], 0), (None, items[0], 0)]
    spark.createDataFrame(docs, "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(k, t) for k, t in enumerate(items)] + [(50, None), (51, "short"), (None, items[4]), (3, items[3])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["contaminated"], [int(i) for i in r["items"].split(",") if i]) for r in queries.op5_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {1: (True, [3]), 2: (False, []), 3: (False, []), 4: (False, []), 5: (True, [1, 2]), None: (True, [0])}
    own, benchmark = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    sliced = decontaminate.contaminated_spans(own, benchmark, slice_bytes=400)
    assert sorted(map(str, sliced.collect())) == sorted(map(str, decontaminate.contaminated_spans(own, benchmark).collect()))
    clean = decontaminate.clean_documents(own, benchmark)
    assert clean.columns == own.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4]
    assert decontaminate.clean_documents(own, benchmark.limit(0)).count() == 7
    assert decontaminate.clean_documents(own.limit(0), benchmark).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng, path = random.Random(1), tmp_path_factory.mktemp("tox")
    docs, labels = [], []
    for k in range(400):
        toxic, low = k % 5 == 0, k % 7 == 0
        words = prose(rng, 80).split()
        if toxic:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(["moron", "idiot", "scum"])
        docs.append((k, " ".join(words) + (" ###" * 30 if low else ""), 0.5))
        if k % 2 == 0:
            labels.append((k, int(not low), int(toxic)))
    docs += [(1000, None, 0.1), (1001, "", 0.1), (None, "no id", 0.1), (2, docs[2][1], 0.5)]
    labels += [(3, None, 1), (None, 1, 0), (5000, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, p_toxic double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_op4_separates_toxic_documents(spark, labelled):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, labelled).collect()}
    held = [k for k in range(400) if k % 2]
    assert all(got[k]["toxic"] == (k % 5 == 0) for k in held)
    assert sum((got[k]["p_low_quality"] >= 0.5) == (k % 7 == 0) for k in held) >= 0.95 * len(held)
    assert got[1000]["p_toxic"] == got[1001]["p_toxic"] == 0.0 and not got[None]["toxic"]


def test_chain_feeds_earlier_probabilities_to_later_models(spark, labelled):
    docs, labels = (spark.read.parquet(f"{labelled}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels, queries.CATEGORIES)
    assert [len(m.v) for m in chain.models] == [toxicity.FORM, toxicity.FORM + 1]
    again = toxicity.train(docs.repartition(5), labels.repartition(2), queries.CATEGORIES)
    assert np.allclose(chain.probabilities(["you moron", "a fine day"]), again.probabilities(["you moron", "a fine day"]))


def test_chain_without_labels_or_classes(spark, labelled):
    docs, labels = (spark.read.parquet(f"{labelled}/{t}.parquet") for t in ("documents", "labels"))
    none = toxicity.train(docs, labels.limit(0), queries.CATEGORIES)
    assert toxicity.score(docs, none, ["doc_id"]).where("p_toxic > 0").count() == 0
    one = toxicity.train(docs, labels.where("toxic = 0"), queries.CATEGORIES)
    assert toxicity.without(docs, one, "toxic").count() == docs.count()
    assert toxicity.score(docs.limit(0), one, ["doc_id"]).count() == 0


# --- languages --------------------------------------------------------------------------------------


def test_op10_held_out_accuracy_and_und(spark):
    got = queries.op10_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixtures_name_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, F.lit(True), 200)
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = texts["en"][:2000] + "\n" + texts["de"][:1000]
    langs, scores, sets = language_id.predict([mixed, None, "", "123 !?", texts["fr"][:300]], model)
    assert langs == ["en", "und", "und", "und", "fr"] and {"en", "de"} <= set(sets[0]) and 0.5 < scores[0] < 0.85 and scores[1] == 0


def test_op10_edge_tables(spark, tmp_path):
    rows = [(1, "un texte court", "fr"), (2, None, "fr"), (3, "12", None), (None, "ohne id", "de"), (4, "the text", None), (4, "the text", None)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 6 and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3)} == {"und"}
    model = language_id.train(frame.where("lang is null"), F.lit(True))
    assert language_id.predict(["a text"], model)[0] == ["und"]
    assert language_id.identify(frame.limit(0), model, ["doc_id"]).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(6)
    items = [prose(rng, 45) for _ in range(5)]
    base = [prose(rng, 120) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(0, 60, 6):
        words = base[k].split()
        for _ in range(4):
            words[rng.randrange(len(words))] = "moron"
        rows[k] = (k, " ".join(words))
    rows += [(100, base[1]), (101, base[1] + " end"), (102, base[2] + " " + items[0]), (103, base[3] + ' x password = "hunter2hunter2" ' + prose(rng, 90)), (104, None), (105, ""), (None, prose(rng, 20)), (1, base[1])]
    docs = [(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [frame.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, frame, str(tmp_path))
        assert out.columns == frame.columns, name
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen.append(frame.count())
    kept = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert not any(k is not None and k < 60 and k % 6 == 0 for k in kept)  # toxic
    assert 1 in kept and 100 not in kept and 101 not in kept  # copies
    assert 102 not in kept and {104, 105, None} <= set(kept)  # leak; null and empty texts stay
    assert "hunter2" not in kept[103] and "[SECRET]" in kept[103]
    assert seen == [68, 58, 55, 54, 54]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in final) == sorted(map(str, kept)) and all(r["round_trip"] for r in final)
    assert all(r["n_tokens"] == len(r["ids"]) for r in final)
