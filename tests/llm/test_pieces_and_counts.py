"""SentencePiece codec and count-only Viterbi against the library, secret scans against plain patterns."""

import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citelake.llm import piece_codec, queries, secret_scan, token_count

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
UNIGRAM = sentencepiece.SentencePieceProcessor(model_proto=token_count.rank_scores(PIECES))
BITS = [" ", "  ", "\n", "a", "th", "the", "▁", "é", "漢", "😀", "x", "\t", "<s>", "</s>", "<0x0A>", "00", "...", "-----", "   ", "\r", "\x00", "Wh", "ing", "tion"]
text = st.one_of(st.lists(st.sampled_from(BITS), max_size=20).map("".join), st.text(st.characters(codec="utf-8"), max_size=40))


@settings(max_examples=400, deadline=None)
@given(text)
def test_codec_equals_the_library(t):
    codec = piece_codec.codec(PIECES)
    ids = LIBRARY.encode(t)
    assert codec.encode(t) == ids
    assert codec.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_decoding_any_ids_equals_the_library(ids):
    assert piece_codec.codec(PIECES).decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(text)
def test_counts_equal_the_library(t):
    assert token_count.counter(PIECES).count(t) == len(UNIGRAM.encode(t))


def test_long_runs_of_spaces_and_letters():
    codec = piece_codec.codec(PIECES)
    for t in (" " * 1000 + "a", "a" * 3000, "ab " * 2000, "\n" * 50, " \n \n"):
        assert codec.encode(t) == LIBRARY.encode(t)
        assert token_count.counter(PIECES).count(t) == len(UNIGRAM.encode(t))


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(piece_codec, "MEMO_RUNS", 3)
    codec = piece_codec.PieceCodec(PIECES)
    t = "one two three four five six one two"
    assert codec.encode(t) == LIBRARY.encode(t)
    assert len(codec._after_space) <= 3


def test_models_with_other_rules_are_refused(tmp_path):
    other = tmp_path / "unigram.model"
    other.write_bytes(token_count.rank_scores(PIECES))
    with pytest.raises(ValueError):
        piece_codec.PieceCodec(str(other))


@pytest.fixture
def docs(spark, tmp_path):
    rows = [
        (1, "the cat sat\non  the mat", "x"),
        (2, None, None),
        (3, "", "y"),
        (None, "no id", "z"),
        (4, "word " * 30000, "long"),
        (4, "word " * 30000, "long"),
        (5, 'password="abcdefgh1" and AKIAABCDEFGHIJKL token=short ' + "0123456789abcdef" * 2, "s"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("lang", F.lit("en")).withColumn("decoded", F.lit(1))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_op1_query(spark, docs):
    got = queries.op1_piece_codec(spark, docs).collect()
    assert len(got) == 7
    by_id = {r["doc_id"]: r for r in got}
    ids = LIBRARY.encode("the cat sat\non  the mat")
    assert by_id[1]["n_tokens"] == len(ids)
    assert by_id[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert by_id[1]["decoded_sha256"] == hashlib.sha256(b"the cat sat\non  the mat").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert (by_id[2]["n_tokens"], by_id[2]["ids_sha256"], by_id[2]["decoded_sha256"]) == (0, empty, empty)
    assert by_id[4]["n_tokens"] == len(LIBRARY.encode("word " * 30000))


def test_encoded_documents_round_trip(spark, docs):
    rows = piece_codec.encode_documents(spark.read.parquet(f"{docs}/documents.parquet"), PIECES).collect()
    assert {r["decoded"] for r in rows if r["doc_id"] == 1} == {"the cat sat\non  the mat"}
    assert all(LIBRARY.decode(list(r["ids"])) == r["decoded"] for r in rows)


def test_op7_query(spark, docs):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op7_token_count(spark, docs).collect()}
    assert got[2] == got[3] == 0 and got[1] == len(UNIGRAM.encode("the cat sat\non  the mat")) and got[None] > 0


# --- secrets ---------------------------------------------------------------------------------------

SECRETS = st.lists(
    st.sampled_from(["password", "PassWd", "ſecret", "secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc", "12345678", "AKIA", "ABCDEFGHIJKL", "deadbeef", "0123456789abcdef", "\n", "é", "-", "."]),
    max_size=25,
).map("".join)


def plain_base(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(SECRETS)
def test_base_spans_equal_the_plain_patterns(t):
    assert secret_scan.base_spans(t) == plain_base(t)


def encoding():
    return secret_scan.vocabulary(queries.RANKS, queries.PATTERN)


def test_random_strings_are_found_and_known_ones_left():
    def found(t):
        return [t[a:b] for a, _, b in secret_scan.random_spans(t, encoding(), [])]

    assert found("key xK9q2LmZ8vR4tY7wB3nQ end") == ["xK9q2LmZ8vR4tY7wB3nQ"]
    assert found("sha d41d8cd98f00b204e9800998ecf8427e") == []  # the length of a digest
    assert found("id 123e4567-e89b-12d3-a456-426614174000") == []
    assert found("call getUserAccountByName2 or some_long_identifier_name_2") == []
    assert found("-" * 60 + "=" * 60) == []
    assert found("12345678901234567890123456") == []


def test_random_spans_never_overlap_base_spans():
    t = "token=xK9q2LmZ8vR4tY7wB3nQ"
    base = secret_scan.base_spans(t)
    assert base and secret_scan.random_spans(t, encoding(), base) == []


def test_overlaps_are_told_as_by_trying_every_base_span():
    rows = [f"token={i:016x} Q{i * 7919**3 % 2**64:016X}x9KqvR4tY \"secret: {i * 104729**3 % 2**64:016X}zK4mTq8W\"\n" for i in range(200)]
    t = "".join(rows)
    base = secret_scan.base_spans(t)
    alone = secret_scan.random_spans(t, encoding(), [])
    plain = [x for x in alone if not any(s < x[2] and x[0] < e for s, _, e in base)]
    got = secret_scan.random_spans(t, encoding(), base)
    assert 0 < len(got) < len(alone) and got == plain


def test_op2_query(spark, docs):
    by_id = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, docs).collect()}
    r = by_id[5]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert by_id[2]["spans"] == "" and by_id[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_masking_keeps_rows_and_other_columns(spark, docs):
    own = spark.read.parquet(f"{docs}/documents.parquet")
    got = secret_scan.masked_documents(own, queries.RANKS, queries.PATTERN)
    assert got.columns == own.columns and got.count() == 7
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[2] is None and texts[5] == '[SECRET]" and [SECRET] token=short [SECRET]'


def test_scan_documents_and_empty_table(spark, docs):
    own = spark.read.parquet(f"{docs}/documents.parquet")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.scan_documents(own, queries.RANKS, queries.PATTERN).collect()}
    assert kinds[5] == ["assign", "access", "hex"]
    assert secret_scan.scan_documents(own.limit(0), queries.RANKS, queries.PATTERN).count() == 0
    assert piece_codec.encoded_digests(own.limit(0), PIECES).count() == 0
