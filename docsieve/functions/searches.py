"""Search texts as rule tables, and search texts as tables of clauses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a kind of document is called in a search.
DOCUMENT_LABELS = (("annual_report", "annual report"), ("quarterly_report", "quarterly report"), ("investor_presentation", "investor presentation"))

# The searches for every company, with a term of its own language, and by region, in order. {fy} is the
# year before and the last two figures of the year, {native} the term for an annual report in the company's language.
SEARCHES = (
    ("all", 1, '"{name}" {doc} {year} filetype:pdf'),
    ("all", 2, '"{name}" {year} {doc} PDF'),
    ("all", 3, "{name} {year} AR PDF download"),
    ("all", 4, "{name} {doc} {fy} filetype:pdf"),
    ("all", 5, "{name} {year} {doc} site:sec.gov OR site:bseindia.com OR site:sedar.com"),
    ("all", 6, "{name} {year} {doc} archive PDF"),
    ("native", 7, "{name} {native} {year} filetype:pdf"),
    ("native", 8, "{name} {year} {native} PDF download"),
    ("india", 9, 'site:bseindia.com "{name}" {year}'),
    ("india", 10, 'site:nseindia.com "{name}" {year}'),
    ("india", 11, '"{name}" {fy} annual report filetype:pdf'),
    ("india", 12, '"{name}" BSE annual report {year} PDF download'),
    ("uae", 9, 'site:dfm.ae "{name}" {year}'),
    ("uae", 10, 'site:adx.ae "{name}" {year}'),
    ("uae", 11, '"{name}" PJSC "{year}" annual report filetype:pdf'),
    ("uae", 12, '"{name}" Emirates annual report {year} PDF'),
)
# The searches within a company's own site, strictest first; {yy} and {nyy} are the last two figures of the year and of the next.
SITE_SEARCHES = (
    ("site", 1, 'site:{site} "{doc}" {year} filetype:pdf'),
    ("site", 2, "site:{site} FY{yy} filetype:pdf"),
    ("site", 3, 'site:{site} "FY-{yy}" filetype:pdf'),
    ("site", 4, "site:{site} FY{nyy} filetype:pdf"),
    ("site", 5, "site:{site} {year} {doc} filetype:pdf"),
    ("site", 6, "site:{site} {year} filetype:pdf"),
)

#: A term of a search, or several with OR between them (as the sign \x01).
_TERM = r'(?:"[^"]*"|[^\s"\x01]+)'
GROUP = f"{_TERM}(?:\x01{_TERM})*"
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def document_label(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, label in DOCUMENT_LABELS:
        out = out.when(kind == k, label)
    return out.otherwise("annual report")


def groups(search: Column) -> Column:
    """The terms of a search in order, those with OR between them as one."""
    return F.regexp_extract_all(F.regexp_replace(search, r"\s+OR\s+", "\x01"), F.lit(GROUP), F.lit(0))


def term_kind(term: Column) -> Column:
    return F.when(F.startswith(F.lower(term), F.lit("site:")), "site").when(F.startswith(F.lower(term), F.lit("filetype:")), "filetype").otherwise("word")


def term_words(term: Column) -> Column:
    """What a term asks for: a site, an ending, or its words in a row."""
    value = F.lower(F.substring_index(F.replace(term, F.lit('"'), F.lit("")), ":", -1))
    return F.when(term_kind(term) != "word", F.filter(F.array(value), lambda v: v != "")).otherwise(words(term))


def term_required(term: Column) -> Column:
    """Sites, endings, phrases and terms with a figure must be met; other words only count."""
    return (term_kind(term) != "word") | F.startswith(term, F.lit('"')) | term.rlike(r"\p{N}")
