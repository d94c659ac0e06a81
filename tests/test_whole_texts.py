"""Queries over whole texts and all rows, against brute force on small tables."""

import random
import re
import unicodedata

from citelake.plans import existence_queries, text_queries

SENTENCE = re.compile(r"\n|(?<=[.!?])\s+")
STOP = {"the", "and", "for", "with", "from", "into", "using"}


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta theta iota kappa lamda sigma omega".split()) + str(rng.randrange(60)) for _ in range(n))


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_title_search_looks_at_every_sentence(spark, tmp_path):
    rng = random.Random(3)
    titles = [words(rng, 8) for _ in range(12)]
    items = [(k, f"{titles[k]}\n{titles[k + 6]}") for k in range(6)]
    docs = [(k, "\n".join(words(rng, 12) for _ in range(rng.randrange(1, 30)))) for k in range(40)]
    docs += [(100 + k, "\n".join([words(rng, 60), *(words(rng, 10) for _ in range(25)), f"{titles[k]} and {words(rng, 2)}. {words(rng, 9)}", "", words(rng, 3)])) for k in range(12)]
    docs += [(7000, None), (7001, ""), (7002, "the of")]
    sf = write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    got = sorted(tuple(r) for r in existence_queries.title_search(spark, sf).collect())

    def tokens(s):
        return set(re.findall("[a-z0-9]{3,}", s.lower())) - STOP

    want = []
    for item, text in items:
        for no, title in enumerate(SENTENCE.split(text)):
            a, best = tokens(title), (0.0, None)
            for doc, body in docs:
                for at, sentence in enumerate(SENTENCE.split(body or "")):
                    b = tokens(sentence)
                    score = len(a & b) / len(a | b) if a and b else 0.0
                    if best[1] is None or score > best[0]:
                        best = (score, (doc, at))
            if best[0] >= 0.35:
                want.append((item, no, *best[1], round(best[0], 6)))
    assert got == sorted(want) and len(got) == 12 and all(r[2] >= 100 and r[3] == 26 for r in got)


def test_phrase_search_reaches_every_document_to_its_end(spark, tmp_path):
    rng = random.Random(5)
    items = [(k, words(rng, 30)) for k in range(4)] + [(4, "One two-part, well- known case: it ends"), (5, "never anywhere at all seen")]
    items.append((6, " ".join(items[0][1].split()[:8]) + " but then other words"))
    docs = [(k, words(rng, 40)) for k in range(30)]
    docs += [(d, f"{words(rng, n)} {items[i][1].upper()}. {words(rng, 5)}") for d, n, i in ((2999, 3, 0), (3050, 3, 0), (3051, 900, 1), (99999, 2500, 2), (4000, 0, 4))]
    docs += [(5000, f"{items[3][1]}\n{words(rng, 70)}\n{items[1][1]} {items[3][1]}"), (5001, " ".join(items[0][1].split()[:9])), (5002, None), (5003, "")]
    sf = write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    got = sorted(tuple(r) for r in text_queries.phrase_search(spark, sf).collect())

    def tokens(s):
        given, out = re.split(r"\s+", s), []
        while given:
            w = given.pop(0)
            while w.endswith("-") and given:
                w = w[:-1] + given.pop(0)
            out.append(re.sub("[^a-z0-9]", "", w.lower()))
        return [w for w in out if w]

    want = []
    for doc, body in docs:
        held = tokens(body or "")
        for item, phrase in items:
            n = tokens(phrase)
            starts = [k for k in range(len(held) - len(n) + 1) if held[k : k + len(n)] == n]
            want += [(doc, item, 0, starts[0] + 1)] if starts else []
    assert got == sorted(want) and {d for d, *_ in got} == {2999, 3050, 3051, 99999, 4000, 5000} and len(got) == 7


def test_accents_and_indexes_take_whole_texts_of_all_rows(spark, tmp_path):
    rng = random.Random(7)
    docs = [(k, f"{words(rng, n)} Straße ÜBER ´a ciónñ {words(rng, 3)}  end\nßa", lang) for k, (n, lang) in enumerate([(0, "de"), (80, None), (400, "es"), (25000, "de")])]
    docs += [(10, None, "en"), (11, "", "de")]
    sf = write(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string"))

    def plain(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()

    def composed(s):  # every a has its accent in front; another stands before the one of ´a
        return re.sub("´a", "á", s.replace("a", "´a"))

    assert {tuple(r) for r in text_queries.fold_accents(spark, sf).collect()} == {(k, plain(s)) for k, s, _ in docs}
    assert {tuple(r) for r in text_queries.compose_accents(spark, sf).collect()} == {(k, composed(s or "")) for k, s, _ in docs}
    assert {tuple(r) for r in existence_queries.inverted_abstract(spark, sf).collect()} == {(k, s) for k, s, _ in docs}


def test_awkward_rows_are_not_left_out(spark, tmp_path):
    rng = random.Random(9)
    items = [(k, 1 + k % 7, rng.randrange(2000), rng.randrange(600)) for k in range(1500)] + [(450, 1, 899, 60), (451, 2, 899, 5), (452, 3, 10, 65)]
    docs = [(1, "7 begins with a digit\nplain"), (2, " blank first\n22 lines"), (3, "one\ntwo"), (60, "a well- known and co- op- ted word-\nend trailing-")]
    sf = write(spark, tmp_path, documents=(docs, "doc_id long, text string"), lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"))

    want = set()
    for order, line, part, supp in items:
        low, span = part % 900 + 1, supp % 500 % 70
        # an end of four digits is no range: the low end alone counts
        numbers = range(low, low + span + 1) if 0 < span <= 60 and low + span < 1000 else [low]
        want.add((order, line, low, ",".join(map(str, [line, *numbers]))))
    assert {tuple(r) for r in text_queries.range_expand(spark, sf).collect()} == want

    hits = {}
    for order, line, part, _ in items:
        votes = hits.setdefault(str(order % 500), {})
        style = {0: "alpha", 1: "author-year"}.get(part % 4, "numeric")
        votes[style] = votes.get(style, 0) + line % 3 + 1
    best = {r: max(v.items(), key=lambda x: (x[1], ["alpha", "author-year", "numeric"].index(x[0]))) for r, v in hits.items()}
    voted = {tuple(r) for r in text_queries.style_vote(spark, sf).collect()}
    assert voted == {(r, *v) for r, v in best.items() if v[1] >= 5} and any(int(r) >= 400 for r, *_ in voted)

    lists = dict(tuple(r) for r in text_queries.list_markers(spark, sf).collect())
    marker = re.compile("(?m)^([ \\t]*\\d{1,3}[.)])[\u200b\u200c\u200d\u2060\ufeff\u00ad]+(?=[^\\d\\s])")  # the reference's rule
    assert lists == {k: marker.sub(r"\1 ", "1.\u200b" + s.replace("\n", "\n22)\ufeff\u200b")) for k, s in docs}
    assert lists[3] == "1. one\n22) two" and lists[1] == "1.\u200b7 begins with a digit\n22) plain"

    tokens = {}
    for r in sorted(map(tuple, text_queries.page_tokens(spark, sf).collect())):
        tokens.setdefault(r[:2], []).append(r[3])
    assert tokens[(10, 1)] == ["a", "wellknown", "and", "coopted", "wordend", "trailing"] and len(tokens) == 4
