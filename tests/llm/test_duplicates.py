"""N-gram join, suffix arrays, chunks and vantage-point trees against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelake.llm import chunk_dedup, ngram_join, queries, suffix_dedup, vantage_ann
from citelake.llm.components import components

WORDS = "Alpha beta gamma delta epsilon zeta Eta theta iota kappa lamda mu nu xi Omikron pi rho sigma tau ypsilon phi chi psi omega é ñandú 漢字".split()


def corpus(seed, n=90):
    """Texts with exact copies, near copies, a common passage, short, empty and null texts, odd spaces and repeated rows."""
    rng = random.Random(seed)

    def prose(k):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(k))

    passage, texts = prose(60), []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            words = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\t", "\n", "  "]).join(words))
        elif kind < 0.6:
            texts.append(prose(rng.randint(0, 80)) + " " + passage + "\n" + prose(rng.randint(0, 40)))
        elif kind < 0.7:
            texts.append(rng.choice(["", None, "one", "one two three", "ONE two three", " \n", "the the the the the the the"]))
        else:
            texts.append(prose(rng.randint(3, 150)))
    ids = rng.sample(range(10_000), n)
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[0], (None, texts[-1])]


def write(spark, path, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"cls": F.lit("x"), "token": F.lit(1), "batch": F.lit("b"), "n": F.lit(0)})
    frame.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


# --- n-gram join ------------------------------------------------------------------------------------


def plain_sets(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in rows:
        if i is None:
            continue
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_components(sets):
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed, short, block", [(1, 24, 4096), (2, 2, 5), (3, 3, 4096)])
def test_op3_equals_brute_force(spark, tmp_path, monkeypatch, seed, short, block):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block)
    rows = corpus(seed)
    got = queries.op3_ngram_join(spark, write(spark, tmp_path, rows)).collect()
    sets = plain_sets(rows)
    want = plain_components(sets)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_op3_group_of_diverging_copies(spark, tmp_path):
    """A chain of copies, each a little further from the first: one component by links, not by likeness to one."""
    rng = random.Random(8)
    words = [f"{rng.choice(WORDS)}{k}" for k in range(160)]
    rows = []
    for k in range(40):
        words[rng.randrange(160)] = f"new{k}"
        rows.append((100 - k, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in queries.op3_ngram_join(spark, write(spark, tmp_path, rows)).collect()}
    assert got == plain_components(plain_sets(rows))


def test_op3_makes_whole_sets_only_where_signatures_leave_a_pair(spark, tmp_path, monkeypatch):
    """Documents with one passage in common meet in lists, short and long ones; none comes near the similarity."""
    made, whole = [], ngram_join.class_sets
    monkeypatch.setattr(ngram_join, "class_sets", lambda docs, wanted, words: made.append(wanted.count()) or whole(docs, wanted, words))
    monkeypatch.setattr(ngram_join, "OFTEN", 1000)  # as with shingles that are common, but in no task
    rng = random.Random(6)
    prose = lambda k: " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(k))
    passage, other = prose(40), prose(40)
    rows = [(k, f"{prose(30)} {passage if k < 60 else other} {prose(30)}") for k in range(70)]
    copies = [(100, rows[0][1] + " end"), (101, rows[65][1] + " end")]
    got = {r["doc_id"]: r["component_id"] for r in queries.op3_ngram_join(spark, write(spark, tmp_path, rows + copies)).collect()}
    assert got == {k: {100: 0, 101: 65}.get(k, k) for k in got} and len(got) == 72
    assert 4 <= sum(made) <= 8


def test_op3_in_many_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHARE_PAIRS", 9)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    rows = corpus(5)
    got = {r["doc_id"]: r["component_id"] for r in queries.op3_ngram_join(spark, write(spark, tmp_path, rows)).where("doc_id is not null").collect()}
    assert got == plain_components(plain_sets(rows))


def test_op3_empty_table(spark, tmp_path):
    assert queries.op3_ngram_join(spark, write(spark, tmp_path, [(1, "a")][:0] or [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(range(12)), max_size=14, unique=True), min_size=2, max_size=14), st.lists(st.integers(0, 6), min_size=14, max_size=14))
def test_join_roots_connects_what_similarity_connects(lists, roots):
    sets = [np.sort(ngram_join.mix(np.array(x or [99], np.uint64))) for x in lists]
    roots = np.array(roots[: len(sets)])

    def groups(pairs):
        label = roots.copy()
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label.tolist())}

    every = [(a, b) for a in range(len(sets)) for b in range(a) if ngram_join.similar(sets[a], sets[b], 80)]
    assert groups(ngram_join.join_roots(sets, roots, 80, rows=3, columns=4)) == groups(every)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=60, unique=True))
def test_filters_never_drop_a_similar_pair(a, b):
    x, y = (np.sort(ngram_join.mix(np.array(v, np.uint64))) for v in (a, b))
    if ngram_join.similar(x, y, 80):
        assert ngram_join.passes_filters(x, y, 80)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 120), st.integers(0, 2)), min_size=2, max_size=8))
def test_signatures_never_drop_a_similar_pair(n, changes):
    """Sets without some of ``n`` tokens and with some of their own, over different numbers of buckets."""
    sets = [np.unique(ngram_join.mix(np.array([*range(min(cut, n - 1), n), *range(1000 * k, 1000 * k + more)], np.uint64))) for k, (cut, more, _) in enumerate(changes, 1)]
    signed, roots = [ngram_join.signature(s) for s in sets], np.array([root for *_, root in changes])
    partner = ngram_join.with_partner(signed, roots, 80)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if ngram_join.similar(x, y, 80):
                assert ngram_join.signatures_allow(signed[a], signed[b], 80)
                assert roots[a] == roots[b] or partner[a] and partner[b]
    allowed = [any(roots[a] != roots[b] and ngram_join.signatures_allow(signed[a], signed[b], 80) for b in range(len(sets))) for a in range(len(sets))]
    assert partner.tolist() == allowed


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(180)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    assert got == {x: find(x) for x in root}


# --- suffix arrays -----------------------------------------------------------------------------------


def plain_removal(rows):
    first, out = {}, {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if i is not None and first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.setdefault(i, []).append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed, piece", [(1, 1 << 19), (2, 64), (3, 200)])
def test_op6_equals_brute_force(spark, tmp_path, monkeypatch, seed, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = corpus(seed)
    got = queries.op6_suffix_dedup(spark, write(spark, tmp_path, rows)).collect()
    want = plain_removal(rows)
    assert sorted(map(tuple, got), key=str) == sorted(((i, *x) for i, each in want.items() for x in each), key=str)


def test_op6_periodic_and_binary_texts(spark, tmp_path):
    rows = [(1, "ab" * 100), (2, "ba" * 90), (3, "\x00" * 120), (4, "x" + "\x00" * 60), (5, "a" * 49), (6, "a" * 49), (7, "a" * 50), (8, "a" * 51), (9, ""), (10, None)]
    got = queries.op6_suffix_dedup(spark, write(spark, tmp_path, rows)).collect()
    want = plain_removal(rows)
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, each in want.items() for x in each)


def test_op6_empty_table_clashing_columns_and_long_texts(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9_000_000))
    rows = [(1, "x" * 80, 1, "k"), (None, "x" * 80, 2, "k"), (None, None, 3, "k"), (2, "x" * 80, 4, "k"), (2, "x" * 60, 5, "k"), (3, long, 6, "k"), (4, "y" + long[4_000_000:4_000_200], 7, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int, bucket string").withColumn("n_removed", F.lit("z"))
    got = suffix_dedup.dedup_substrings(docs).collect()
    want = sorted([(1, 80, 0, 0), (None, 80, 0, 0), (None, 0, 0, 0), (2, 80, 80, 1), (2, 60, 60, 1), (3, 9_000_000, 0, 0), (4, 201, 200, 1)], key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got), key=str) == want
    assert {bytes(r["kept"]) for r in got if r["doc_id"] == 4} == {b"y"}
    assert suffix_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_level_family_keeps_first_documents_and_geometric_sizes():
    rng, family, first = random.Random(0), suffix_dedup.LevelFamily(), {}
    for doc in range(60):
        words = [bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(20)]
        for w in words:
            first.setdefault(w, doc)
        got = family.add(np.array(words, "S50"), np.full(20, doc))
        assert got.tolist() == [first[w] for w in words]
    # a new batch only is scanned: known windows keep their first documents, and the levels stay as they are
    known, before = list(first), [a for a, _ in family.levels]
    new = [b"n%05d" % k for k in range(30)]
    got = family.scan(np.array(known + new, "S50"), np.full(len(known) + 30, 99))
    assert got.tolist() == [first[w] for w in known] + [99] * 30 and all(a is b for a, (b, _) in zip(before, family.levels, strict=True))
    sizes = [len(a) for a, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(first)


def test_windows_share_anchors():
    """Every window has one owner, and equal windows have anchors with equal hashes at equal places."""
    rng = random.Random(7)
    a = bytes(rng.choice(b"abcd") for _ in range(400))
    texts = [a, b"zz" + a[100:300] + b"yy", a[:49], b""]
    x = suffix_dedup.find_anchors(texts)
    seen = {}
    for r, low, high, place, key in zip(x.row, x.low, x.high, x.place, x.key, strict=True):
        for s in range(low, high + 1):
            assert (r, s) not in seen
            seen[r, s] = (place - s, key)
    assert len(seen) == sum(max(0, len(t) - 49) for t in texts)
    for s in range(100, 251):
        assert seen[0, s] == seen[1, s - 98]


# --- chunks -----------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.binary(max_size=40))
def test_cuts_cover_the_text_and_resist_shifts(data, more):
    ends = chunk_dedup.cuts(data)
    assert ends == sorted(set(ends)) and (ends[-1] == len(data) if data else not ends)
    assert all(b - a <= chunk_dedup.MOST + chunk_dedup.LEAST for a, b in zip([0, *ends], ends, strict=False))
    h, moved = chunk_dedup.gear(np.frombuffer(data, np.uint8)), chunk_dedup.gear(np.frombuffer(more + data, np.uint8))
    assert (h[31:] == moved[len(more) + 31 :]).all()


def test_op9_equals_a_plain_pass(spark, tmp_path):
    rows = [r for r in corpus(5) if r[0] is not None][:-1]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_chunk_dedup(spark, write(spark, tmp_path, rows)).collect()}
    held = set()
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        ends = chunk_dedup.cuts(data)
        digests = chunk_dedup._digests(data, ends)
        kept, n, removed, spans = chunk_dedup.kept_bytes(data, set(digests) & held)
        held |= set(digests)
        assert got[i] == (len(data), n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_op9_catches_shifted_passages_and_leaves_the_rest(spark, tmp_path):
    rng = random.Random(2)

    def prose(k):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(10_000)) for _ in range(k))

    passage = prose(80)
    rows = [(k, prose(30) + "x" * k + " " + passage + " " + prose(30)) for k in range(6)] + [(k, prose(120)) for k in range(6, 30)] + [(40, None), (41, "")]
    got = {r["doc_id"]: r["n_removed"] for r in queries.op9_chunk_dedup(spark, write(spark, tmp_path, rows)).collect()}
    assert got[0] == 0 and all(got[k] > 0.4 * len(passage) for k in range(1, 6))
    assert all(got[k] == 0 for k in (*range(6, 30), 40, 41))


# --- nearest neighbours -----------------------------------------------------------------------------


def test_op8_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vantage_ann, "LEAF", 16)
    rng = np.random.default_rng(0)
    vectors = {k: rng.normal(size=8).astype(np.float32).tolist() for k in range(400)}
    vectors |= {401: vectors[7], 402: vectors[7], 403: [0.0] * 8, 404: None, 405: [float("nan")] * 8, 406: [1.0, None, *[1.0] * 6], 420: [1.0, 2.0], 440: [0.5, 0.5, 0.5]}
    rows = [(k, v, k) for k, v in vectors.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    frame = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    usable = {k: np.array(v, np.float64) for k, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for shard_rows in (8192, 90):
        got = vantage_ann.nearest(frame, F.expr("vec_id % 20 = 0"), 20, 1.0, shard_rows).collect()
        by_query = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in (k for k in usable if k % 20 == 0):
            others = {k: float(np.cumsum(v * usable[q])[-1]) for k, v in usable.items() if k != q and len(v) == len(usable[q])}
            want = sorted(others.items(), key=lambda x: (-x[1], x[0]))[:20]
            assert by_query.get(q, []) == want
    assert queries.op8_vantage_ann(spark, str(tmp_path)).count() == len(got)


@pytest.mark.parametrize("pairs", [1 << 18, 500])
@pytest.mark.parametrize("kind", ["copies", "unit copies", "small integers"])
def test_op8_ties_over_many_leaves_go_to_smaller_ids(monkeypatch, kind, pairs):
    monkeypatch.setattr(vantage_ann, "LEAF", 16)
    monkeypatch.setattr(vantage_ann, "PAIRS", pairs, raising=False)
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, size=(900, 8)).astype(float) if kind == "small integers" else rng.normal(size=(900, 8))
    if kind != "small integers":
        x[rng.permutation(900)[:400]] = x[5]
    if kind == "unit copies":
        x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(900) * 7
    tree = vantage_ann.VantageTree(ids, x)
    found, scores = tree.search(ids[:300], x[:300], 20, 1.0)
    for q in range(300):
        exact = np.cumsum(x * x[q], axis=1)[:, -1]
        want = [i for i in np.lexsort((ids, -exact)) if i != q][:20]
        assert found[q].tolist() == ids[want].tolist() and scores[q].tolist() == exact[want].tolist()


def test_relaxed_factor_keeps_recall_and_skips_leaves():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32)) * 3
    x = np.concatenate([c + rng.normal(size=(100, 32)) for c in centres])
    tree = vantage_ann.VantageTree(np.arange(len(x)), x)
    q = np.arange(0, len(x), 20)
    exact, _ = tree.search(q, x[q], 20, 1.0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    assert [set(e.tolist()) for e in exact] == [set(np.argsort(-r, kind="stable")[:20].tolist()) for r in s]
    relaxed, _ = tree.search(q, x[q], 20, 1.5)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact, relaxed, strict=True)]) >= 0.9


def test_op8_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vantage_ann.nearest(frame, F.lit(True), 5, 1.0).count() == 0
