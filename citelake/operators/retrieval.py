"""Retrieval: how replies are classified, which text a reference is judged on, and text out of HTML, JATS and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

# Phrases of paywalled pages and of pages for suspected programs; statuses; tags without content.
PAYWALL = (
    "access through your institution", "purchase pdf", "get access", "subscribe to view", "sign in to read", "buy article",
    "rent this article", "you do not have access", "institutional login", "please enable javascript",
    "checking your browser", "verify you are human", "captcha",
)
BOT = (
    "checking your browser", "verify you are human", "verifying you are human", "are you a robot", "captcha", "just a moment",
    "unusual traffic", "automated access", "access denied", "request blocked", "enable javascript and cookies",
    "pardon our interruption", "bot detection", "security check", "not a bot", "proof-of-work", "anubis",
)
REFUSED, CHALLENGE, GONE = (401, 403, 429, 451), (202, 503), (404, 410)
DROPPED_TAGS = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "button"}
JATS_DROPPED = {"ref-list", "table-wrap", "fig", "table", "back", "front-stub", "graphic", "inline-formula"}
DESCRIPTIONS = ("description", "citation_abstract", "og:description", "dc.Description", "twitter:description")
MOST_BYTES, MOST_PAGES = 12 * 1024 * 1024, 40
_PAGE = StructType().add("title", StringType()).add("text", StringType())


def printed_title(html: Column) -> Column:
    """What stands in the first plain title element, without markup's own escapes."""
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for escape, letter in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(escape), F.lit(letter))
    return F.btrim(title, F.lit(" \n"))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


def classify(replies: DataFrame) -> DataFrame:
    """kind, ok, blocked, paywalled, dead and the text that remains of each reply.

    ``replies`` has status, content_type, mitigated (the host's own mark), text, of which ``MOST_BYTES`` count.  A
    null status is a failed request: nothing is known.
    """
    c = F.col
    text = F.coalesce(capped_body(F.col("text").cast("binary")), F.lit(""))
    head = F.lower(F.substring(text, 1, 4000))
    status = c("status")
    challenged = status.isin(*REFUSED) | F.coalesce("mitigated", F.lit(False)) | (
        status.isin(*CHALLENGE) & ((F.trim(text) == "") | any_of(head, BOT))
    )
    failed = status.isNull()
    refused = ~failed & F.coalesce(challenged, F.lit(False))
    error = ~failed & ~refused & (status >= 400)
    kind = (
        F.when(failed | refused | error, "")
        .when(F.contains(F.lower("content_type"), F.lit("pdf")), "pdf")
        .when(F.contains(F.lower("content_type"), F.lit("xml")) & F.contains(F.substring(text, 1, 4000), F.lit("<article")), "fulltext-xml")
        .otherwise("html")
    )
    is_html = kind == "html"
    bot = is_html & (F.length(text) < 2500) & any_of(head, BOT)
    left = F.when(failed | refused | error | bot, F.lit("")).otherwise(text)
    out = replies.withColumns(
        {
            "kind": kind,
            "blocked": refused | bot,
            "paywalled": is_html & any_of(head, PAYWALL) & (F.length(text) < 6000),
            "dead": F.when(error & status.isin(*GONE), F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(""),
        }
    )
    return out.withColumn("text", left).withColumn("ok", F.trim("text") != "")


def preferred(classified: DataFrame, by: list[str]) -> DataFrame:
    """One reply a reference: the first good one by ordinal, else the longest; a block anywhere stays known."""
    good = F.col("ok") & (F.length("text") > 600) & ~F.col("paywalled") & ~F.col("blocked")
    order = W.partitionBy(*by).orderBy(good.desc(), F.when(good, F.col("ordinal")).otherwise(0), F.length("text").desc(), "ordinal")
    seen = W.partitionBy(*by)
    ranked = classified.withColumns({"place": F.row_number().over(order), "any_blocked": F.bool_or("blocked").over(seen), "good": good})
    return ranked.where("place = 1").withColumn("blocked", F.col("blocked") | (~F.col("good") & F.col("any_blocked"))).drop("place", "any_blocked", "good")


def candidate_urls(oa: Column, url: Column, landing: Column) -> Column:
    """The distinct addresses to try, in order."""
    return F.array_distinct(F.filter(F.array(oa, url, landing), lambda u: u.isNotNull() & (u != "")))


def with_abstract(fetched: DataFrame) -> DataFrame:
    """The abstract replaces text of under 400 characters, and leads text that doesn't hold its opening."""
    abstract, text = F.trim(F.coalesce("abstract", F.lit(""))), F.coalesce("text", F.lit(""))
    has, short = abstract != "", F.length(F.trim(text)) < 400
    opening = F.contains(F.lower(F.substring(text, 1, 6000)), F.lower(F.substring(abstract, 1, 120)))
    return fetched.withColumns(
        {
            "has_abstract": has,
            "kind": F.when(has & short, "abstract").otherwise(F.col("kind")),
            "text": F.when(~has, text).when(short, abstract).when(opening, text).otherwise(F.concat(abstract, F.lit("\n\n"), text)),
        }
    )


def capped_body(body: Column) -> Column:
    """The text of a body's first ``MOST_BYTES`` bytes; a character that the cut breaks, or that is none, is U+FFFD."""
    return F.make_valid_utf8(F.substring(body, 1, MOST_BYTES).cast("string"))


def joined_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """The text of a source's first pages, hyphens at line ends closed, blanks squeezed."""
    rows = pages.where(F.col("page") <= MOST_PAGES).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"), r"[ \t]+", " ")
    return rows.select(*by, F.trim(text).alias("text"))


class _Node:
    __slots__ = ("tag", "attrs", "at", "end", "hidden")

    def __init__(self, tag: str, attrs: dict[str, str], at: int, hidden: bool):
        self.tag, self.attrs, self.at, self.end, self.hidden = tag, attrs, at, at, hidden


class _Page(HTMLParser):
    """A page as two flat lists in document order: its nodes, each with the stretch of strings that it holds, and its strings.

    A node is hidden if it or a node around it is dropped.  Tags that never end end with their parent, and where
    the next of their kind begins, so nothing is nested deeper than the page nests it and nothing recurses.
    """

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    # Tags that end where one of these begins.
    ENDED_BY = {
        "p": {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"}, "li": {"li"}, "dt": {"dt", "dd"},
        "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
    }

    def __init__(self, dropped: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.nodes: list[_Node] = []
        self.strings: list[tuple[str, bool]] = []
        self.open = [_Node("", {}, 0, False)]
        self.n_open: dict[str, int] = {}

    def _end(self) -> None:
        node = self.open.pop()
        node.end = len(self.strings)
        self.n_open[node.tag] -= 1

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in self.ENDED_BY.get(self.open[-1].tag, ()):
            self._end()
        node = _Node(tag, {k: v or "" for k, v in attrs}, len(self.strings), self.open[-1].hidden or tag in self.dropped)
        self.nodes.append(node)
        if tag not in self.VOID:
            self.open.append(node)
            self.n_open[tag] = self.n_open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self._end()

    def handle_endtag(self, tag):
        if self.n_open.get(tag):
            while self.open[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if data.strip():
            self.strings.append((data.strip(), self.open[-1].hidden))

    def close(self) -> None:
        super().close()
        while len(self.open) > 1:
            self._end()
        self.open[0].end = len(self.strings)

    def within(self, node: _Node, shown_only: bool = True) -> list[str]:
        return [s for s, hidden in self.strings[node.at : node.end] if not (hidden and shown_only)]


# Where a page's content is: the first node that passes the first test that any passes.
_CONTENT = (
    lambda n: n.tag == "article",
    lambda n: re.search(r"article|content|main", n.attrs.get("id", ""), re.I),
    lambda n: re.search(r"article|fulltext|content-body", n.attrs.get("class", ""), re.I),
    lambda n: n.tag == "main",
    lambda n: n.tag == "body",
)


def html_text(html: str | None) -> tuple[str, str]:
    """(title, text) of a page: its content node without navigation, by line; a short text gets the description."""
    page = _Page(DROPPED_TAGS)
    page.feed(html or "")
    page.close()
    title = next((" ".join(page.within(n, shown_only=False)) for n in page.nodes if n.tag == "title"), "")
    shown = [n for n in page.nodes if not n.hidden]
    content = next((n for test in _CONTENT for n in shown if test(n)), page.open[0])
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(page.within(content))))
    metas: dict[str, str] = {}
    for n in shown:
        if n.tag == "meta" and n.attrs.get("content"):
            for name in filter(None, (n.attrs.get("name"), n.attrs.get("property"))):
                metas.setdefault(name, n.attrs["content"])
    if len(text) < 500:
        more = next((metas[d] for d in DESCRIPTIONS if d in metas), "")
        text = f"{text}\n\n{more}".strip() if more else text
    return (title or metas.get("citation_title", "")).strip(), text.strip()


class _LenientXml(HTMLParser):
    """An element tree out of markup that is no XML: unknown ends are passed over, open elements end with the text."""

    CDATA_CONTENT_ELEMENTS = RCDATA_CONTENT_ELEMENTS = ()
    DEEPEST = 200

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.builder, self.open = ElementTree.TreeBuilder(), ["root"]
        self.builder.start("root", {})

    def handle_starttag(self, tag, attrs):
        if len(self.open) < self.DEEPEST:
            self.builder.start(tag, {})
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.builder.start(tag, {})
        self.builder.end(tag)

    def handle_endtag(self, tag):
        if tag in self.open[1:]:
            while self.open[-1] != tag:
                self.builder.end(self.open.pop())
            self.builder.end(self.open.pop())

    def handle_data(self, data):
        self.builder.data(data)

    def tree(self, xml: str) -> ElementTree.Element:
        self.feed(xml)
        super().close()
        while self.open:
            self.builder.end(self.open.pop())
        return self.builder.close()


def _element(xml: str) -> ElementTree.Element:
    """The tree of an article; names of characters that XML doesn't know are resolved, broken markup is read leniently."""
    known = {"amp", "lt", "gt", "quot", "apos"}
    named = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if m[1] in known else html5.get(f"{m[1]};", " "), xml)
    try:
        return ElementTree.fromstring(named)
    except ElementTree.ParseError:
        return _LenientXml().tree(named)


def jats_text(xml: str | None) -> tuple[str, str]:
    """(title, text) of a JATS article: abstract, then titles and paragraphs of the body, without tables, figures and references."""
    root = _element(xml or "")
    bare = lambda n: re.split("[}:]", n.tag)[-1] if isinstance(n.tag, str) else ""

    def text_of(node) -> str:
        parts, waiting = [], [node]
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                parts.append(part)
                continue
            waiting += [x for child in reversed(part) for x in (child.tail or "", *([child] if bare(child) not in JATS_DROPPED else []))]
            parts.append(part.text or "")
        return " ".join(" ".join(parts).split())

    def within(node, tags: set[str]) -> Iterator:
        waiting = list(reversed(node))
        while waiting:
            child = waiting.pop()
            if bare(child) not in JATS_DROPPED:
                if bare(child) in tags:
                    yield child
                waiting += reversed(child)

    title = next((text_of(n) for n in root.iter() if bare(n) == "article-title"), "")
    abstract = next(within(root, {"abstract"}), None)
    body = next(within(root, {"body"}), None)
    parts = [text_of(abstract)] if abstract is not None else []
    parts += [text_of(n) for n in within(body, {"title", "p"})] if body is not None else []
    return title, "\n\n".join(p for p in parts if p)


@pandas_udf(_PAGE)
def html_text_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_text(x) for x in html], columns=["title", "text"])


@pandas_udf(_PAGE)
def jats_text_udf(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([jats_text(x) for x in xml], columns=["title", "text"])
