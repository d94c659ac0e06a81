"""Enumerations and table schemas of the citation-audit model, as constants."""

from __future__ import annotations

VERDICTS = ("supported", "related", "weak", "unrelated", "unverified", "blocked", "not_found")
# How much a verdict asks for a human look.
CONCERN = {"unrelated": 5, "not_found": 5, "weak": 4, "unverified": 3, "blocked": 3, "related": 2, "supported": 1}
EXISTENCE = ("confirmed", "unconfirmed", "not_found")
STYLES = ("numeric", "author-year", "alpha")
SEVERITIES = ("high", "medium", "low")
RISK_LEVELS = ("critical", "concern", "review", "clear")
COVERAGE = ("full_text", "html_page", "abstract_only", "supplied", "none")
# Evidence category of each kind of fetched text.
COVERAGE_OF_KIND = {
    "fulltext-xml": "full_text", "pdf": "full_text", "html": "html_page", "abstract": "abstract_only",
    "supplied pdf": "supplied", "supplied text": "supplied",
}
INDEXES = ("Crossref", "OpenAlex", "Semantic Scholar", "arXiv", "Unpaywall", "Europe PMC", "DOI registry")

TABLES = {
    "blocks": "run_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_x0 double, page_width double",
    "spans": "run_id string, page int, block int, line int, span int, text string, size double, flags int",
    "pages": "run_id string, page int, text string",
    "citations": "run_id string, key string, label string, style string, sentence string, claim string, line string, page int, char_offset int, group_size int, prose boolean, tentative boolean",
    "bib_entries": "run_id string, entry_no int, key string, raw string, number int, authors string, title string, year string, venue string, doi string, arxiv string, pmid string, url string",
    "index_replies": "run_id string, key string, index string, status int, found boolean",
    "index_candidates": "run_id string, key string, index string, candidate_no int, title string, authors string, year string, doi string",
    "claims": "run_id string, key string, claim_no int, text string, context string, co_cited int, page int",
    "passages": "run_id string, key string, passage_no int, offset int, text string",
    "claim_verdicts": "run_id string, key string, claim_no int, claim string, verdict string, score double, reason string, machine_verdict string, override string",
    "flags": "run_id string, key string, flag_no int, kind string, severity string, message string",
    "actions": "run_id string, action_no long, kind string, key string, claim_no int, verdict string, at timestamp",
    "events": "run_id string, seq long, stage string, message string, percent double, at timestamp",
    "annotations": "run_id string, ref_key string, pred_key string, page string, clause string, pred_existence string, pred_support string, evidence string, h_is_citation string, h_ref_key string, h_clause_ok string, h_exists string, h_support string",
}
