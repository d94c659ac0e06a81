"""Judging, existence, flags, layout, retrieval, report, evaluation, sources, streams, the whole audit."""

import json

import pytest
from pyspark.sql import functions as F

from citelake import audit
from citelake.functions import similarity
from citelake.operators import bibliography, existence, flags, highlights, judge_client, judging, layout, report, retrieval
from citelake.plans.judging_queries import audit_of_parts
from citelake.sources import files, sinks
from citelake.streaming import events


# --- judging ----------------------------------------------------------------------------------------


def test_passages_join_wraps_and_pack_sentences():
    wrapped = "A line that is wrapped\nonto the next line of the same paragraph."
    assert [p for _, p in judging.split_passages(wrapped)] == [wrapped.replace("\n", " ")]
    long = " ".join(f"Sentence number {k} has some words in it." for k in range(40))
    packed = list(judging.split_passages(long + "\n\nshort"))
    assert len(packed) > 3 and all(320 <= len(p) < 420 for _, p in packed[:-1]) and all(long[at:].startswith(p[:20]) for at, p in packed)
    assert list(judging.split_passages(None)) == []


def test_token_set_ratio_by_hand():
    assert similarity.token_set_ratio("a b c", "c b a") == 100.0
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert similarity.token_set_ratio("", "a") == 0.0
    # shared "new york"; rests "mets" and "yankees": best of the shared words against either side
    assert similarity.token_set_ratio("new york mets", "new york yankees") == pytest.approx(200 * 8 / (8 + 13))
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_lexical_support(spark):
    claims = spark.createDataFrame([("k", 0, "The farming of wheat improves soils"), ("k", 1, "Quantum chromodynamics predicts jets"), ("k", 2, "it is")], "key string, claim_no int, text string")
    text = "Farming wheat improved soils in every region that was observed over the years. Nothing else was found there at all."
    windows = judging.passages(spark.createDataFrame([("k", text)], "key string, text string"), ["key"])
    got = {r["claim_no"]: r for r in judging.lexical_support(claims, windows, ["key"], ["claim_no"], ["passage_no"]).collect()}
    assert got[0]["verdict"] == "supported" and got[1]["verdict"] == "unverified" and got[1]["score"] == 0 and 2 not in got


def test_roll_up_directions(spark):
    rows = spark.createDataFrame([("a", 0, "supported"), ("a", 1, "unrelated"), ("a", 2, "not_found")], "key string, claim_no int, verdict string")
    r = judging.roll_up(rows, ["key"]).first()
    assert (r["worst"], r["mildest"]) == ("unrelated", "supported")
    one = rows.limit(1)
    assert [x[0] for x in one.select(judging.headline(F.lit(None), F.lit(None), F.lit("openai"))).collect()] == ["unverified"]


def test_replies(spark):
    rows = spark.createDataFrame([('x {"verdict":"WEAK","confidence":2} y',), ("no json",), ('{"verdict":"odd"}',), (None,)], "reply string")
    got = [r["v"] for r in rows.select(judging.parse_reply(F.col("reply")).alias("p")).select(F.col("p.verdict").alias("v")).collect()]
    assert got == ["weak", None, "unverified", None]
    assert judging.lenient_json('a {"b": 1} c') == {"b": 1} and judging.lenient_json("}{") is None


def test_live_judge_failures_are_null(spark):
    def client():
        def ask(prompt):
            if "bad" in prompt:
                raise RuntimeError("refused")
            return prompt.upper()

        return ask

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "claim_no int, prompt string")
    assert {r["claim_no"]: r["reply"] for r in judging.ask_model(rows, ["claim_no"], client).collect()} == {1: "OK", 2: None, 3: None}


def test_judge_client():
    c = judge_client.JudgeConfig(api_key="secret-key-of-mine", model="m")
    assert "secret" not in repr(c) and "secret" not in str(judge_client.run_config(c, {"api_key": "secret", "cap": 5}))
    body = judge_client.request_body(c, "s", "p")
    assert body["seed"] == judge_client.SEED and body["response_format"]["type"] == "json_schema"
    assert judge_client.next_attempt("json_schema", True, "bad temperature") == ("json_schema", False)
    assert judge_client.next_attempt("json_schema", False, "x") == ("json_object", False) and judge_client.next_attempt("none", False, "x") is None
    assert judge_client.wait_seconds(429, "slow", None, 0) == 5 and judge_client.wait_seconds(429, "insufficient_quota", None, 0) is None
    assert judge_client.wait_seconds(500, "", None, 0) is None and judge_client.wait_seconds(429, "", 60, 60) is None
    assert judge_client.JudgeConfig().key({"OPENAI_API_KEY": "k"}) == "k"
    for url, addresses in (("http://a.org", ["8.8.8.8"]), ("https://a.org", ["10.0.0.1"]), ("https://", [])):
        with pytest.raises(ValueError):
            judge_client.check_endpoint(url, lambda h, a=addresses: a)
    judge_client.check_endpoint("https://a.org", lambda h: ["8.8.8.8"])


# --- existence and flags ----------------------------------------------------------------------------


def test_title_agreement_is_symmetric(spark):
    a, b = "A Scalable Location Service for Geographic Ad Hoc Routing", "A Scalable Security Service for Geographic Ad-Hoc Routing"
    row = spark.range(1).select(existence.title_agreement(F.lit(a), F.lit(b)), existence.title_agreement(F.lit(b), F.lit(a)), existence.title_agreement(F.lit(a), F.lit(""))).first()
    assert row[0] == row[1] == pytest.approx(5 / 7) and row[2] == 0


def test_no_answer_is_never_no(spark):
    rows = [("doi", None), ("doi", 429), ("doi", 503), ("", 500), ("doi", 404), ("", 404)]
    replies = spark.createDataFrame([("r", str(k), "Crossref", s, False) for k, (_, s) in enumerate(rows)], "run_id string, key string, index string, status int, found boolean")
    works = spark.createDataFrame([("r", str(k), p, "", "raw text", 0.1, False, "") for k, (p, _) in enumerate(rows)], "run_id string, key string, identifier_printed string, identifier_wrong string, raw string, best_agreement double, loaded boolean, dead string")
    got = existence.settle(works.join(existence.outcomes(replies, ["run_id", "key"]), ["run_id", "key"])).orderBy("key").collect()
    assert [r["existence"] for r in got] == ["unconfirmed"] * 4 + ["not_found"] * 2
    assert [r["identifier_resolved"] for r in got] == [None] * 4 + [False, None]


RECORD = {"index": "Crossref", "title_agreement": 0.95, "year": "2015", "surnames": ["Kingma", "Ba"], "book": False}


@pytest.mark.parametrize(
    "entry, record, kinds",
    [
        ({"authors": "Kingma, D. and Ba, J.", "year": "2015"}, {}, []),
        ({"authors": "Kingsma, D. and Ba, J.", "year": "2015"}, {"surnames": ["Kingma"]}, []),  # close enough
        ({"authors": "Kongmo, D. and Ba, J.", "year": "2015"}, {}, ["author-name-mismatch"]),
        ({"authors": "Kingma, D. and Ba, J.", "year": "2011"}, {}, ["year-mismatch"]),
        ({"authors": "Kingma, D. and Ba, J.", "year": "2013"}, {}, []),
        ({"authors": "Zhou, X. and Wu, Y.", "year": "2009"}, {}, ["record-mismatch"]),
        ({"authors": "Kingma, D. et al.", "year": "2015"}, {"surnames": ["Kingma", "Unseen"]}, []),
        ({"authors": "Kingma, D. and Ba, J.", "year": "2011"}, {"book": True}, []),
        ({"authors": "Kingma, D. and Ba, J.", "year": "2011", "existence": "unconfirmed"}, {}, []),
        ({"authors": "Zhou, X. and Wu, Y.", "year": "2009"}, {"title_agreement": 0.8}, []),
    ],
)
def test_metadata(spark, entry, record, kinds):
    entry = {"run_id": "r", "key": "1", "existence": "confirmed", "title": "Adam: a method for optimization", **entry, "records": [RECORD | record]}
    entry["raw"] = f"{entry['authors']} {entry['title']}. {entry['year']}."
    schema = "run_id string, key string, existence string, raw string, title string, authors string, year string, records array<struct<index:string,title_agreement:double,year:string,surnames:array<string>,book:boolean>>"
    got = flags.metadata_flags(spark.createDataFrame([entry], schema)).first()["flags"]
    assert [f["kind"] for f in got] == kinds


def test_credited_names(spark):
    rows = spark.createDataFrame([("Smith et al. [7] did.", "7"), ("Smith et al. [8] did.", "7"), ("Jones and Lee [7] proposed it.", "7"), ("Jones and Lee [7].", "7"), ("Figure et al. [7]", "7")], "s string, k string")
    assert [r[0] for r in rows.select(flags.credited(F.col("s"), F.col("k"))).collect()] == ["Smith", "", "Jones", "", ""]


# --- layout, retrieval, evidence ---------------------------------------------------------------------


REFS = [f"[{k}] J. Smith. A title of some work {k}. Journal of Things, {2000 + k}." for k in range(1, 7)]


def test_bibliography_is_found_and_blanked():
    lines = ["Title", "References are listed below", *["Body text line."] * 20, "References", *REFS, "Appendix", "More text"]
    body, refs, head, found = layout.split_bibliography("\n".join(lines), bibliography.parse)
    assert head == 22 and refs.splitlines() == REFS and len(body) == len("\n".join(lines)) and "J. Smith" not in body and "More text" in body
    assert [e["key"] for e in found] == [str(k) for k in range(1, 7)]
    bare = [f"{k} van der Berg, A. A title of some work {k}. Journal of Things, {2000 + k}." for k in range(1, 7)]  # particles before the surname
    _, refs, *_ = layout.split_bibliography("\n".join(["Text."] * 20 + bare), bibliography.parse)
    assert refs.splitlines() == bare


def test_unlabelled_and_resumed_lists():
    body, refs, *_ = layout.split_bibliography("\n".join(["Text."] * 20 + REFS), bibliography.parse)
    assert refs.splitlines() == REFS
    more = [f"[{k}] J. Smith. A title of some work {k}. Journal of Things, {2000 + k}." for k in (7, 8, 9)]
    lines = ["Text."] * 20 + ["References", *REFS, "Methods", "We did things."] + more
    _, refs, *_ = layout.split_bibliography("\n".join(lines), bibliography.parse)
    assert refs.splitlines() == REFS + more
    assert layout.split_bibliography("no list\nat all", bibliography.parse)[2] is None
    assert layout.split_bibliography("", bibliography.parse) == ("", "", None, [])


def test_columns_are_read_one_after_the_other(spark):
    rows = [("r", 1, k, x0, y, x1, y + 5, t, 0, 0.0, 600.0) for k, (x0, y, x1, t) in enumerate([(50, 10, 550, "title"), (50, 20, 290, "L1"), (320, 21, 550, "R1"), (50, 40, 290, "L2"), (320, 41, 550, "R2"), (50, 60, 550, "wide"), (320, 70, 550, "R3"), (50, 71, 290, "L3")])]
    blocks = spark.createDataFrame([(r, p, n, float(a), float(b), float(c), float(d), t, k, x, w) for r, p, n, a, b, c, d, t, k, x, w in rows], "run_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_x0 double, page_width double")
    assert layout.page_texts(blocks).first()["text"].split("\n\n") == ["title", "L1", "L2", "R1", "R2", "wide", "L3", "R3"]


def test_html_and_jats():
    title, text = retrieval.html_text("<title>T</title><body><nav>no</nav><p>outside</p><article><h1>H</h1><p>Some <b>bold</b> text</p><script>x</script></article></body>")
    assert title == "T" and text == "H\nSome\nbold\ntext"
    assert retrieval.html_text('<meta name="citation_title" content="C"><meta name="description" content="D"><div id="main-content">x</div><p>y</p>') == ("C", "x\n\nD")
    assert retrieval.html_text(None) == ("", "") and retrieval.html_text("<p>a<p>b")[1] == "a\nb"
    xml = "<article><front><article-title>T</article-title><abstract><p>A</p></abstract></front><body><sec><title>S</title><p>P <fig>F</fig>q</p></sec></body><back><p>B</p></back></article>"
    assert retrieval.jats_text(xml) == ("T", "A\n\nS\n\nP q") and retrieval.jats_text("<broken") == ("", "")
    assert retrieval.jats_text(xml.replace("<p>A</p>", "<p>A&nbsp;b &amp; c&mdash;d</p>")) == ("T", "A b & c—d\n\nS\n\nP q")
    assert retrieval.jats_text(xml.replace("</sec>", "")) == ("T", "A\n\nS\n\nP q")  # an element that never ends


def test_html_of_many_unclosed_tags():
    for tag in ("p", "div", "li"):
        title, text = retrieval.html_text("<title>T</title><body>" + f"<{tag}>x" * 100_000)
        assert title == "T" and text.count("x") == 100_000
    assert retrieval.html_text("<div>" * 50_000 + "<nav>no<p>no</nav>yes")[1] == "yes"


def test_bodies_are_capped_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_BYTES", 5)
    rows = spark.createDataFrame([(1, "abcdefgh"), (2, "éééé"), (3, None), (4, "ab")], "k int, body string")
    got = {r["k"]: r["t"] for r in rows.select("k", retrieval.capped_body(F.col("body").cast("binary")).alias("t")).collect()}
    assert got == {1: "abcde", 2: "éé\ufffd", 3: None, 4: "ab"}
    assert retrieval.classify(spark.createDataFrame([(200, "text/html", False, "abcdefgh")], "status int, content_type string, mitigated boolean, text string")).first()["text"] == "abcde"


def test_compose_accents():
    assert similarity.compose_accents("´Elite and ¨uber") == "Élite and über"
    assert similarity.compose_accents("Garc¸on ` 5") == "Garçon ` 5"
    assert similarity.compose_accents(None) == "" and similarity.compose_accents("´x") == "´x"


def test_phrases_are_found_across_hyphens(spark):
    words = [("r", p, n, w) for p, text in ((1, "nothing of note here"), (2, "the represen- tations of local data are good"), (3, "the representations of local data are good")) for n, w in enumerate(text.split())]
    tokens = highlights.word_tokens(spark.createDataFrame(words, "run_id string, page int, word_no int, text string"), ["run_id"])
    phrases = spark.createDataFrame([("r", 0, "absent words in this phrase"), ("r", 1, "Representations of local data"), ("r", 2, "too short")], "run_id string, candidate_no int, text string")
    r = highlights.find_phrases(phrases, tokens, ["run_id"]).collect()
    assert [tuple(x) for x in r] == [("r", 1, 2, 2)]
    hinted = highlights.find_phrases(phrases.withColumn("hint", F.lit(3)), tokens, ["run_id"], "hint").first()
    assert hinted["page"] == 3


def test_candidates_are_informative(spark):
    text = "Convolutional networks recognise handwritten digits very accurately. Et al., 2018a; it is. " + " ".join(f"longerword{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(40)) + "."
    rows = spark.createDataFrame([(1, "A claim about convolutional networks and digits.", [text, None, ""]), (2, None, None)], "k int, claim string, passages array<string>")
    found = highlights.candidate_rows(rows, ["k"]).orderBy("candidate_no").collect()
    got = [r["text"] for r in found]
    assert {r["k"] for r in found} == {1} and len(set(got)) == len(got) <= 40 and all(len(c) >= 24 for c in got)
    words = text.split(". ")[2].rstrip(".").split()
    assert got[0] == " ".join(words) and got[1].startswith("Convolutional networks") and got[-1].startswith("A claim about")
    assert [" ".join(words[k : k + 14]) for k in range(0, 27, 7)] == [c for c in got if len(c.split()) == 14]


# --- report, sources, streams ------------------------------------------------------------------------


def test_replay_is_lossless(spark):
    entries = spark.createDataFrame([("r", "1", "weak", "lexical"), ("r", "2", "weak", "openai")], "run_id string, key string, verdict string, engine string")
    claims = spark.createDataFrame([("r", k, n, v) for k in "12" for n, v in ((0, "weak"), (1, "unverified"))], "run_id string, key string, claim_no int, verdict string")
    rows = [("r", 1, "set", "1", 0, "supported"), ("r", 2, "set", "2", 0, "supported"), ("r", 3, "set", "1", None, "related"), ("r", 4, "clear", "1", None, None), ("r", 5, "clear", "2", 0, None)]

    def settled(n):
        actions = spark.createDataFrame(rows[:n], "run_id string, action_no long, kind string, key string, claim_no int, verdict string").withColumn("at", F.current_timestamp())
        return {r["key"]: (r["verdict"], r["reviewed_source"]) for r in report.settle(entries, claims, actions).collect()}

    assert settled(2) == {"1": ("supported", "claims"), "2": ("unverified", "claims")}
    assert settled(3)["1"] == ("related", "reference")
    assert settled(5) == {"1": ("supported", "claims"), "2": ("weak", "")}


def test_report_round_trip(spark, tmp_path):
    papers = spark.createDataFrame([("r1", "a.pdf"), ("r2", "b.pdf")], "run_id string, source_pdf string")
    entries = spark.createDataFrame([("r1", k, "weak", "lexical") for k in ("10", "2", "smith2019")], "run_id string, key string, verdict string, engine string")
    claims = spark.createDataFrame([("r1", "2", 0, "c", "weak")], "run_id string, key string, claim_no int, claim string, verdict string")
    none = spark.createDataFrame([], "run_id string, key string, flag_no int, kind string, severity string, message string")
    documents = sinks.report_documents(papers, entries, claims, none)
    got = {r["run_id"]: [json.loads(x)["key"] for x in r["references"] or []] for r in documents.collect()}
    assert got == {"r1": ["2", "10", "smith2019"], "r2": []}
    assert json.loads(sinks.single_entry(documents, "r1", "2").first()["entry"])["claim_verdicts"][0]["claim"] == "c"
    sinks.write_reports(documents, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Ein längerer Text, der in einer alten Kodierung steht.".encode("cp1252"))
    (tmp_path / "b.md").write_text("short")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 ...")
    got = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in files.read_supplied(spark, str(tmp_path)).collect()}
    assert got["a.txt"][0].startswith("Ein längerer") and got["b.md"][1] and got["c.pdf"][1]
    (tmp_path / "report.json").write_text(json.dumps({"run_id": "r", "unknown": 1, "references": [{"key": "1", "verdict": "weak", "extra": 2, "claim_verdicts": [{"claim": "c", "verdict": "weak"}]}]}, indent=2))
    reports = files.read_reports(spark, str(tmp_path / "report.json"))
    assert files.entries_of(reports).first()["verdict"] == "weak" and files.claim_verdicts_of(reports).first()["claim"] == "c"
    (tmp_path / "s.csv").write_text('run_id,clause\n r1 ,"a ""b"", c"\nr2,\n')
    assert [tuple(r) for r in files.read_sheet(spark, str(tmp_path / "s.csv")).collect()] == [("r1", 'a "b", c'), ("r2", "")]
    (tmp_path / ".env").write_text("A=1\n# no\nB='x'\n")
    assert files.load_env(str(tmp_path / ".env"), {"A": "0"}) == {"A": "0", "B": "x"}
    assert files.load_env(str(tmp_path / "absent"), {}) == {}


def test_override_stream_keeps_state(spark, tmp_path):
    schema = "run_id string, action_no long, kind string, key string, verdict string"
    batches = [[("r", 1, "set", "1", "weak"), ("r", 2, "set", "2", "related")], [("r", 4, "clear", "1", None)], [("r", 3, "set", "1", "supported"), ("r", 5, "set", "2", "weak")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = events.overrides(events.read_events(spark, str(tmp_path / "in"), schema, 1))
        rows = events.collect_into(stream, str(tmp_path / "out"), "update").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in sorted(rows, key=lambda r: r["action_no"]):
        last[r["key"]] = (r["action_no"], r["override"])
    assert last == {"1": (4, ""), "2": (5, "weak")}


def test_the_whole_audit(spark):
    a = audit_of_parts(spark, "/root/testdata/sf0.001")
    entries = {(r["run_id"], r["key"]): r for r in a.entries.collect()}
    assert len(entries) == 200
    found = {k: r["existence"] for k, r in entries.items()}
    assert found["1", "1"] == "confirmed"
    assert {r["existence"] for r in entries.values()} <= {"confirmed", "unconfirmed", "not_found"}
    judged = [r for r in entries.values() if r["text_chars"] and r["existence"] != "not_found"]
    assert judged and all(r["verdict"] in ("supported", "related") for r in judged)
    assert all(r["verdict"] == "unverified" for r in entries.values() if not r["text_chars"] and r["existence"] != "not_found")
    levels = {r["run_id"]: r["level"] for r in a.risk.collect()}
    assert len(levels) == 20 + (len(levels) > 20) and "critical" in levels.values()
    a.close()


def test_an_empty_manuscript_is_never_clear(spark):
    texts = spark.createDataFrame([("r", "nothing to see here"), ("s", None)], "run_id string, text string")
    replies = spark.createDataFrame([], "run_id string, key string, index string, status int, found boolean")
    sources = spark.createDataFrame([], "run_id string, key string, title string, abstract string, text string, kind string, retracted boolean")
    a = audit.Audit(texts, replies, sources)
    assert {r["run_id"]: r["level"] for r in a.risk.collect()} == {"r": "review", "s": "review"}
    a.close()


def test_the_audit_uses_all_that_is_known(spark):
    text = "\n".join(
        [
            "Convolutional networks recognise handwritten digits (Graves, 2013). Pairs do it well too (Graves and Wayne, 2013).",
            "A page said so (Kay, 2015). Another work agrees with it (Lee, 2016). It is late (Roe, 2017). It is closed (Poe, 2018).",
            "References",
            "Graves, A. (2013). A study of handwritten digits in networks. Journal of Things, 3, 1-9.",
            "Graves, A. and Wayne, G. (2013). Another study of pairs of networks. Journal of Things, 4, 1-9.",
            "Kay, B. (2015). A web page on things that was there. http://a.org/gone.",
            "Lee, C. (2016). A printed work with a dead number. doi:10.1234/dead.",
            "Roe, D. (2017). A work that took too long to find. Journal of Things, 5, 1-9.",
            "Poe, E. (2018). A work behind a wall of some kind. Journal of Things, 6, 1-9.",
        ]
    )
    keys = ["graves2013/1", "graves2013/2-wayne", "kay2015", "lee2016", "roe2017", "poe2018"]
    texts = spark.createDataFrame([("r", text)], "run_id string, text string")
    replies = [("r", k, "Crossref", 404 if k in ("kay2015", "lee2016") else 200, k not in ("kay2015", "lee2016")) for k in keys]
    body = "Convolutional networks recognise handwritten digits with great accuracy in many experiments of ours. " * 9
    sources = [("r", k, "", "", body if k.startswith("graves") else "", "html", False, "HTTP 404" if k == "kay2015" else "", k == "poe2018", 100 if k == "lee2016" else None) for k in keys]
    found = [("r", "lee2016", 0.9, "A printed work with a dead number", "Lee, C.", "2016", "J", "10.1234/alive", "", True)]
    records = [("r", "graves2013/1", [("Crossref", 0.95, "2005", ["Smith"], False)])]
    answers = [("r", "graves2013/1", 0, '{"verdict": "unrelated"}', '{"verdict": "related"}'), ("r", "graves2013/2-wayne", 0, '{"verdict": "supported"}', None)]
    a = audit.Audit(
        texts,
        spark.createDataFrame(replies, "run_id string, key string, index string, status int, found boolean"),
        spark.createDataFrame(sources, "run_id string, key string, title string, abstract string, text string, kind string, retracted boolean, dead string, blocked boolean, handle_code int"),
        found=spark.createDataFrame(found, "run_id string, key string, search_agreement double, title string, authors string, year string, venue string, doi string, abstract string, retracted boolean"),
        records=spark.createDataFrame(records, "run_id string, key string, records array<struct<index:string,title_agreement:double,year:string,surnames:array<string>,book:boolean>>"),
        model_replies=spark.createDataFrame(answers, "run_id string, key string, claim_no int, reply string, second string"),
        unfinished=spark.createDataFrame([("r", "roe2017", "lookup")], "run_id string, key string, stage string"),
    )
    got = {r["key"]: r for r in a.entries.collect()}
    assert set(got) == set(keys)
    assert (got["graves2013/1"]["verdict"], got["graves2013/1"]["engine"]) == ("unrelated", "openai")  # no abstract, so no second look
    assert got["graves2013/2-wayne"]["verdict"] == "supported"
    assert (got["kay2015"]["existence"], got["kay2015"]["verdict"]) == ("not_found", "not_found")
    assert (got["lee2016"]["existence"], got["lee2016"]["doi"], got["lee2016"]["identifier_wrong"], got["lee2016"]["retracted"]) == ("confirmed", "10.1234/alive", "10.1234/dead", True)
    assert (got["roe2017"]["verdict"], got["roe2017"]["timed_out"]) == ("unverified", True) and "lookup" in got["roe2017"]["note"]
    assert got["poe2018"]["verdict"] == "blocked"
    flagged = {(r["key"], r["kind"]) for r in a.flags.collect()}
    assert {("graves2013/1", "record-mismatch"), ("kay2015", "reference-not-found"), ("lee2016", "identifier-mismatch"), ("lee2016", "retracted-source")} <= flagged
    given = a.with_document("r", "roe2017", body)
    assert given.entries.where("key = 'roe2017'").first()["existence"] == "confirmed"
    given.close()
    a.close()
