"""The operators without SQL against plain programs: byte by byte, row by row, by full tables and full matrices."""

import random
import re

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from citelake.llm import chunk_dedup, decontaminate, language_id, ngram_join, queries, secret_scan, toxicity
from test_duplicates import plain_components, plain_sets
from test_models_and_pipeline import plain_distance, prose

# --- chunks -----------------------------------------------------------------------------------------


def plain_gear(data):
    out, h = [], 0
    for c in data:
        h = ((h << 1) + int(chunk_dedup._GEAR[c])) % (1 << 32)
        out.append(h)
    return out


def plain_cuts(data):
    """Ends of chunks by one loop over the bytes."""
    ends, at = [], 0
    for place, h in enumerate(plain_gear(data), 1):
        cut = h >> (32 - chunk_dedup.MASK_BITS) == 0 and place - at >= chunk_dedup.LEAST
        if cut:
            while place - at > chunk_dedup.MOST:
                at += chunk_dedup.MOST
                ends.append(at)
            if place - at >= chunk_dedup.LEAST:
                ends.append(place)
                at = place
    while len(data) - at > chunk_dedup.MOST:
        at += chunk_dedup.MOST
        ends.append(at)
    if ends and len(data) - at < chunk_dedup.LEAST:
        ends[-1] = len(data)
    elif at < len(data):
        ends.append(len(data))
    return ends


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=1500), st.integers(0, 3))
def test_gear_and_cuts_equal_a_loop_over_the_bytes(data, times):
    data = data * 4**times
    assert chunk_dedup.gear(np.frombuffer(data, np.uint8).copy()).tolist() == plain_gear(data)
    assert chunk_dedup.cuts(data) == plain_cuts(data)


def plain_chunk_dedup(rows, least_run):
    """doc_id, bytes, chunks, removed bytes of every row: whole chunks compared, in the order of doc_ids."""
    first = {}
    split = []
    for i, t in rows:
        data = (t or "").encode()
        ends = plain_cuts(data)
        split.append((i, data, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]))
        for c in split[-1][2] if i is not None else []:
            first[c] = min(first.get(c, i), i)
    out = []
    for i, data, chunks in split:
        seen, run, removed = set(), 0, 0
        for c in [*chunks, None]:
            if c is not None and (c in seen or (i is not None and first[c] < i)):
                run += len(c)
                continue
            removed += run if run >= max(1, least_run) else 0
            run = 0
            seen.add(c)
        out.append((i, len(data), len(chunks), removed))
    return sorted(out, key=str)


@pytest.mark.parametrize("least_run", [0, 96])
def test_op9_equals_whole_chunks_compared(spark, least_run):
    rng = random.Random(5)
    shared = [prose(rng, 60) for _ in range(5)]
    rows = [(k, " ".join([prose(rng, 40), shared[k % 5], prose(rng, 10)])) for k in range(40)]
    rows += [(7, rows[7][1]), (7, prose(rng, 50)), (None, rows[3][1]), (None, None), (50, ""), (51, None), (52, "ab" * 40_000), (53, "x" + "ab" * 30_000), (54, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = chunk_dedup.dedup_chunks(docs, least_run=least_run)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_chunks"], r["n_removed"]) for r in got.collect()), key=str) == plain_chunk_dedup(rows, least_run)
    assert chunk_dedup.dedup_chunks(docs.limit(0)).count() == 0


# --- languages --------------------------------------------------------------------------------------


def plain_mixture(units):
    """Proportions and chosen languages of one document: greedy sets, EM by loops."""
    n, langs = units.shape
    chosen = [int(units.sum(0).argmax())]
    scaled = np.exp(np.maximum(units - units.max(1, keepdims=True), -60.0))
    held, share = float(np.log(scaled[:, chosen[0]]).sum()), {chosen[0]: 1.0}
    while n > 1 and len(chosen) < langs:
        best = None
        for lang in sorted(set(range(langs)) - set(chosen)):
            tried = [*chosen, lang]
            pi = {x: 1 / len(tried) for x in tried}
            for _ in range(language_id.STEPS):
                total = dict.fromkeys(tried, 0.0)
                for row in scaled:
                    whole = sum(row[x] * pi[x] for x in tried)
                    for x in tried:
                        total[x] += row[x] * pi[x] / whole
                pi = {x: total[x] / n for x in tried}
            value = sum(np.log(sum(row[x] * pi[x] for x in tried)) for row in scaled)
            if best is None or value > best[0]:
                best = (value, tried, pi)
        if best[0] - held <= 0.5 * np.log(n):
            break
        held, chosen, share = best
    return share, set(chosen)


def test_mixtures_equal_plain_em():
    rng = np.random.default_rng(3)
    docs = []
    for n in (1, 2, 5, 30, 30, 30, 60):
        base = rng.normal(-200, 6, (n, 4))
        base[: n // 2, rng.integers(4)] += 25
        base[n // 2 :, rng.integers(4)] += rng.integers(1, 30)
        docs.append(base)
    starts = np.cumsum([0, *(len(d) for d in docs[:-1])])
    shares, chosen = language_id.mixtures(np.concatenate(docs), starts)
    for k, units in enumerate(docs):
        share, want = plain_mixture(units)
        assert set(np.flatnonzero(chosen[k]).tolist()) == want
        assert np.allclose([shares[k, x] for x in share], list(share.values()))


def test_training_takes_about_as_many_documents_of_a_hot_language(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, prose(rng, 12), "en") for k in range(3000)] + [(5000 + k, "ein Wort und das andere ist " * 3, "de") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True), per_language=300)
    again = language_id.train(docs.repartition(7), F.lit(True), per_language=300)
    assert model.languages == ["de", "en"] and np.array_equal(model.log_p, again.log_p)
    few = language_id.train(docs.where("lang = 'de'"), F.lit(True), per_language=300)
    assert np.allclose(few.log_p[:, 0], model.log_p[:, 0])  # a language under the bound is learnt whole


def test_op10_very_long_texts_and_clashing_columns(spark, tmp_path):
    rows = [(1, "der Hund und die Katze " * 60_000, "de", 1.0), (2, "the cat and the dog are here", "en", 1.0), (3, "und " * 3, "de", 2.0), (3, "the " * 3, "en", 2.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a b` double").withColumn("lang_pred", F.lit("x")).withColumn("languages", F.lit(1))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op10_language_id(spark, str(tmp_path)).count() == 4
    model = language_id.train(frame, F.lit(True))
    assert "a b" in language_id.identify(frame, model, ["doc_id", "a b"]).columns


# --- toxicity ---------------------------------------------------------------------------------------


def plain_fit(x, dense, y, ridge=2e-4, steps=150, rate=0.3):
    """Logistic regression by Adam on full matrices."""
    n, words = x.shape
    one = x[x > 0].mean()
    yes, no = x[y > 0].sum(0) / one + 1, x[y == 0].sum(0) / one + 1
    scale = np.log((yes / (y.sum() + 2)) / (no / (n - y.sum() + 2))) ** 2 / 4
    scale[scale < toxicity.LEAST_SCALE] = 0
    full = np.column_stack([x * scale, dense, np.ones(n)])
    theta = np.zeros(full.shape[1])
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = full.T @ (1 / (1 + np.exp(-full @ theta)) - y) / n
        grad[:-1] += ridge * theta[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return lambda x, dense: 1 / (1 + np.exp(-np.column_stack([x * scale, dense, np.ones(len(x))]) @ theta))


def test_chain_equals_plain_matrices(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(160):
        low, toxic = k % 3 == 0, k % 3 == 0 and k % 2 == 0
        words = prose(rng, 30).split() + ["junk"] * (3 * low) + ["scum"] * toxic
        docs.append((k, " ".join(words)))
        labels.append((k, int(not low), int(toxic)))
    chain = toxicity.train(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), queries.CATEGORIES
    )
    counts = [__import__("collections").Counter(f for w in toxicity.WORDS.findall(t.lower()) for f in toxicity.features_of(w)) for _, t in docs]
    held = {f: sum(f in c for c in counts) for f in set().union(*counts)}
    names = sorted((f for f, n in held.items() if n >= toxicity.LEAST_DOCS), key=lambda f: chain.words[f])
    assert len(names) == len(chain.words)
    idf = np.array([np.log((1 + len(docs)) / (1 + held[f])) + 1 for f in names])
    x = np.array([[np.sqrt(c[f]) for f in names] for c in counts]) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dense = np.array([toxicity.form(t, toxicity.WORDS.findall(t.lower())) for _, t in docs])
    low, toxic = np.array([1.0 - q for _, q, _ in labels]), np.array([float(t) for *_, t in labels])
    fold = np.array([((k * 0x9E3779B97F4A7C15) % (1 << 64) >> 40) % toxicity.FOLDS for k, _ in docs])
    before = np.zeros(len(docs))
    for f in range(toxicity.FOLDS):
        mine, rest = fold == f, fold != f
        before[mine] = plain_fit(x[rest], dense[rest], low[rest])(x[mine], dense[mine])
    first = plain_fit(x, dense, low)(x, dense)
    second = plain_fit(x, np.column_stack([dense, before]), toxic)(x, np.column_stack([dense, first]))
    got = chain.probabilities([t for _, t in docs])
    assert np.allclose(got[:, 0], first, atol=1e-6) and np.allclose(got[:, 1], second, atol=1e-6)


def test_op4_repeated_ids_long_texts_and_clashing_columns(spark, tmp_path):
    rows = [(k, ("fine words here " if k % 2 else "scum words here ") * 4) for k in range(60)]
    rows += [(1, "scum words here " * 4), (2, "fine words here " * 4), (70, "fine " * 400_000), (71, "scum " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p_toxic", F.lit("x")).withColumn("a b", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(3, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["doc_id"], r["toxic"]) for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
    assert {(1, True), (1, False), (2, True), (2, False), (70, False), (71, True)} <= got
    chain = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), queries.CATEGORIES)
    assert toxicity.score(docs, chain, ["doc_id", "a b"]).columns == ["doc_id", "a b", "p_low_quality", "p_toxic"]


# --- decontamination --------------------------------------------------------------------------------


def folded(text):
    return decontaminate.fold(text)[0].tobytes()


def plain_contaminated(text, items):
    """Item ids by the full table over the whole text; short items as they stand between word bounds."""
    out = set()
    for i, item in items:
        m = folded(item or "")
        if i is None or len(m) < decontaminate.Q:
            continue
        if len(m) < decontaminate.SHORTEST:
            words = [w.encode() for w in re.findall(r"[^\W_]+", (text or "").lower())]
            if any(b"".join(words[a:b]) == m for a in range(len(words)) for b in range(a + 1, min(len(words), a + decontaminate.SHORTEST) + 1)):
                out.add(i)
        elif plain_distance(m, folded(text or "")) <= decontaminate.budget(len(m), decontaminate.RATE):
            out.add(i)
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 20, 300, 60])
def test_op5_equals_the_full_table_for_every_slice_size(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "EXPANDED", 50)
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randint(7, 14))) for k in range(6)] + [(20, "who wrote it"), (21, "yes"), (22, None), (None, "no id here at all"), (3, "an item that shares an id")]
    rows = []
    for k in range(30):
        chars = list(items[k % 6][1])
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
        rows.append((k // 2, prose(rng, rng.randrange(12)) + " " + "".join(chars) + " " + prose(rng, rng.randrange(12))))
    rows += [(None, items[0][1]), (None, items[1][1]), (40, None), (41, ""), (42, "so: Who wrote it?"), (43, "anywho wrote item"), (44, "yes"), (45, "ab " * 3000)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, spans int, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), str(sorted(plain_contaminated(t, items)))) for i, t in rows)
    got = decontaminate.contaminated_spans(docs, bench, slice_bytes=slice_bytes).collect()
    assert sorted((str(r["doc_id"]), str(sorted({s["item_id"] for s in r["spans"]}))) for r in got) == want
    clean = decontaminate.clean_documents(docs, bench, slice_bytes=slice_bytes)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(i for i, x in want if x == "[]") and clean.columns == docs.columns


# --- secrets ----------------------------------------------------------------------------------------


def test_only_digests_uuids_numbers_and_names_are_left_out():
    enc = secret_scan.vocabulary(queries.RANKS, queries.PATTERN)

    def found(t):
        return [t[a:b] for a, k, b in secret_scan.spans_of(t, enc) if k == 3]

    letters, key, uuid = "qzxjvkwpfgmbhqzytrvxkjwqnzpl", "Zx8Kq0vB2mN5wR7tY1uJ4hG6fD3sA9pLcQeWiOjX", "123e4567-e89b-12d3-a456-426614174000"
    assert found(f"a {letters} b") == [letters]
    assert found(f"a {uuid}-{key} b") == [f"-{key}"] and found(f"a {uuid} b") == found(f"a {uuid}/{uuid} b") == []
    assert found("getUserAccountByNameAndPassword INTERNATIONALIZATION_OF_NAMES /usr/local/share/documents/archive") == []
    assert found("A" * 64 + " " + "0123456789" * 4) == []


def test_op2_long_empty_and_tied_spans(spark, tmp_path):
    text = ("word " * 100_000) + "secret = " + "a1" * 20 + " AKIA" + "B2" * 10
    rows = [(1, text), (1, None), (None, "token: " + "0" * 40), (2, "")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op2_secret_scan(spark, str(tmp_path)).collect(), key=str)
    assert len(got) == 4 and {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got} == {(1, 1, 1, 1), (1, 0, 0, 0), (None, 1, 0, 1), (2, 0, 0, 0)}
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op2_secret_scan(spark, f"{tmp_path}/none").count() == 0


# --- near duplicates and the pipeline ---------------------------------------------------------------


def plain_one_of_each(rows):
    """Rows that stay: sets of (doc_id, text) as nodes, since ids may repeat; the smallest id of a component, ties open."""
    nodes = sorted({(i, t) for i, t in rows if i is not None}, key=str)
    sets = {k: plain_sets([(k, t)])[k] for k, (_, t) in enumerate(nodes)}
    root = plain_components(sets)
    stay = [(i, t) for i, t in rows if i is None or not plain_sets([(0, t)])[0]]
    groups = {}
    for k, node in enumerate(nodes):
        if sets[k]:
            groups.setdefault(root[k], []).append(node)
    return stay, [min(g, key=lambda x: x[0])[0] for g in groups.values()], groups


def test_rows_that_share_a_doc_id_are_decided_by_their_own_text(spark):
    rng = random.Random(2)
    x, y = prose(rng, 60), prose(rng, 60)
    rows = [(2, x), (5, "a " + x), (5, y), (5, y), (7, y + " end"), (None, x), (None, None), (8, ""), (8, ""), (9, " \t"), (3, "two words"), (4, "two words")]
    docs = spark.createDataFrame([(*r, k, 0) for k, r in enumerate(rows)], "doc_id long, text string, text_mark int, component int")
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(2, x), (5, y), (None, x), (None, None), (8, ""), (8, ""), (9, " \t"), (3, "two words")], key=str)


def test_components_of_rows_that_share_a_doc_id_differ(spark):
    rng = random.Random(2)
    x, y = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(2, x), (5, "a " + x), (5, y), (7, y + " end")], "doc_id long, text string")
    found = ngram_join.similar_documents(docs).collect()
    assert len({r["component"] for r in found if r["doc_id"] == 5}) == 2
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(2, 2), (5, 2), (5, 5), (7, 5)]


def test_pipeline_equals_a_plain_program(spark, tmp_path):
    rng = random.Random(13)
    items = [(k, prose(rng, 20)) for k in range(4)] + [(9, None)]
    rows = [(k, prose(rng, 50)) for k in range(60)]
    for k in range(0, 60, 5):
        rows[k] = (k, rows[k][1] + " moron scum moron")
    rows += [(70, rows[1][1]), (71, rows[2][1] + " end"), (72, rows[3][1] + " " + items[1][1]), (73, prose(rng, 40) + " token = abcdefgh12 "), (4, prose(rng, 30)), (None, rows[6][1]), (None, None), (74, "")]
    docs = [(i, t, "en", "s", None if t is None else len(t), k, "r", 3) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, ids long, round_trip string, place int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in rows if not (t and "moron" in t)]
    stay, _, groups = plain_one_of_each(left)
    left = stay + [min(g, key=lambda x: x[0]) for g in groups.values()]
    left = [(i, t) for i, t in left if not plain_contaminated(t, items)]
    left = [(i, re.sub(r"(?:token) = [A-Za-z0-9]+", "[SECRET]", t) if t else t) for i, t in left]
    pieces = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    want = sorted(((i, pieces.encode(t or "")) for i, t in left), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r["doc_id"], list(r["ids"])) for r in out.collect()), key=str) == want
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "place", "n_tokens", "ids", "round_trip"]


def test_pipeline_of_empty_tables_and_a_very_long_text(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rng = random.Random(3)
    long = prose(rng, 60_000)
    spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", None)], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["round_trip"] in (True, False) and got[0]["n_tokens"] > 60_000
