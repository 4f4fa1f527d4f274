"""What a free-text request says: year, document type, company, sector, region."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.functions.text import any_of, two_digits


def request_year(text: Column, as_of_year: int) -> Column:
    """The first year from 1900 to 2099, else the year before ``as_of_year``."""
    found = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(F.try_to_number(F.nullif(found, F.lit("")), F.lit("9999")).cast("int"), F.lit(as_of_year - 1))


def document_type(text: Column) -> Column:
    low = F.lower(text)
    chain = reduce(lambda c, kind: c.when(any_of(low, rules.REQUEST_TYPES[kind]), kind), rules.REQUEST_TYPES, F.when(F.lit(False), ""))
    return chain.otherwise("annual_report")


# Patterns in order of precedence with the document type and the filing form they stand for.
FILING_PATTERNS = (
    (r"\b10-?k\b", "annual", "10-K"), (r"\bannual\s+report\b", "annual", "10-K"), (r"\b10-?q\b", "quarterly", "10-Q"), (r"\bquarterly\s+report\b", "quarterly", "10-Q"),
    (r"\bquarterly\b", "quarterly", "10-Q"), (r"\bearnings\b", "quarterly", "10-Q"), (r"\binvestor\s+presentation\b", "investor-presentation", ""),
    (r"\bpresentation\b", "investor-presentation", ""), (r"\bproxy\b", "proxy", "DEF 14A"), (r"\b8-?k\b", "current", "8-K"), (r"\bannual\b", "annual", "10-K"),
)
# Words for the quarters.
QUARTERS = ((r"\bq1\b|\bfirst\s+quarter\b", 1), (r"\bq2\b|\bsecond\s+quarter\b", 2), (r"\bq3\b|\bthird\s+quarter\b", 3), (r"\bq4\b|\bfourth\s+quarter\b", 4))


def quarter(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda c, q: c.when(low.rlike(q[0]), q[1]), QUARTERS, F.when(F.lit(False), 0))


def without_quarter(text: Column) -> Column:
    """The text without the first quarter named in it."""
    low = F.lower(text)
    return reduce(lambda c, q: c.when(low.rlike(q[0]), F.regexp_replace(low, q[0], "")), QUARTERS, F.when(F.lit(False), "")).otherwise(low)


def filing(text: Column) -> Column:
    """Struct of type and form of the first pattern that occurs; the default is an annual report."""
    low = F.lower(text)
    pair = lambda kind, form: F.struct(F.lit(kind).alias("kind"), F.lit(form).alias("form"))
    chain = reduce(lambda c, p: c.when(low.rlike(p[0]), pair(p[1], p[2])), FILING_PATTERNS, F.when(F.lit(False), pair("", "")))
    return chain.otherwise(pair("annual", "10-K"))


def removal_order() -> list[str]:
    words = [w for kind in rules.REQUEST_TYPES.values() for w in kind]
    return sorted(words, key=len, reverse=True)


def company_name(text: Column) -> Column:
    """What is left of a request without years, document words and punctuation."""
    left = F.regexp_replace(text, r"\b(?:19|20)\d{2}\b", "")
    for word in removal_order():
        left = F.regexp_replace(left, "(?i)" + word.replace("-", r"\-"), "")
    left = F.regexp_replace(left, r"[^\w\s&.'-]", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(left, r"\s+", " ")), r"^[-•·|/\\—– ]+|[-•·|/\\—– ]+$", "")


def ticker(text: Column) -> Column:
    """The first word of one to five capitals, or null."""
    return F.nullif(F.regexp_extract(text, r"\b([A-Z]{1,5})\b", 1), F.lit(""))


def sector_hits(text: Column) -> Column:
    """An array of (sector, hits) in order of precedence; every keyword found counts once for each listing."""
    def counted(low: Column) -> Column:
        found = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))
        return F.array(*[F.struct(F.lit(name).alias("sector"), found(words).alias("hits")) for name, words in rules.SECTORS.items()])

    # As the element of an array the lower-case text is made once for all keywords.
    return F.get(F.transform(F.array(F.lower(text)), counted), F.lit(0))


def region(name: Column, country: Column) -> Column:
    low, code = F.lower(name), F.upper(country)
    return (
        F.when((code == "AE") | any_of(low, rules.REGION_WORDS["uae"]), "uae").when((code == "IN") | any_of(low, rules.REGION_WORDS["india"]), "india")
        .when((code == "TR") | any_of(low, rules.REGION_WORDS["turkey"]), "turkey").when(code == "GB", "uk").when(code == "US", "us").otherwise("global")
    )


def core_tokens(name: Column) -> Column:
    """Distinctive words of a name, in order, repeats kept."""
    drop = F.array(*[F.lit(w) for w in (*rules.LEGAL_SUFFIXES, *rules.COMMON_WORDS)])
    words = F.split(F.trim(F.lower(name)), r"\s+")
    return F.filter(words, lambda w: ~F.array_contains(drop, w) & (F.length(w) > 2))


def acronym(name: Column) -> Column:
    drop = F.array(*[F.lit(w) for w in rules.LEGAL_SUFFIXES])
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~F.array_contains(drop, F.lower(w)) & (F.length(w) >= 4))
    return F.array_join(F.transform(words, lambda w: F.lower(F.substring(w, 1, 1))), "")


# Ways to write a fiscal year; y, p, n are the year, the one before and after, yy, pp, nn their last digits.
YEAR_FORMS = (
    "{y}", "fy{y}", "fy{yy}", "fy-{yy}", "fy-{y}", "fy_{yy}", "{p}-{yy}", "{p}-{y}", "{y}-{nn}", "{y}-{n}", "fy{nn}", "fy{n}", "fy-{nn}", "fy-{n}", "fy{y}-{nn}", "fy{y}_{nn}",
    "ar{y}", "{y}ar", "ar{nn}", "ar-{nn}", "report{y}", "{y}report", "annual{y}", "{y}annual", "annual{nn}", "{p}_{yy}", "{y}_{nn}",
)
INDIAN_YEAR_FORMS = ("{y}", "{p}-{yy}", "{p}-{y}", "FY{y}", "FY{yy}", "{p}/{yy}", "{p}_{yy}", "{p}_{y}")


def year_forms(year: Column, forms: tuple[str, ...] = YEAR_FORMS) -> Column:
    """The ways to write a fiscal year, as an array in a fixed order."""
    parts = {"y": year.cast("string"), "p": (year - 1).cast("string"), "n": (year + 1).cast("string"), "yy": two_digits(year), "nn": two_digits(year + 1)}

    def fill(form: str) -> Column:
        pieces = []
        for i, piece in enumerate(form.replace("{", "|{").replace("}", "}|").split("|")):
            if piece:
                pieces.append(parts[piece[1:-1]] if piece[0] == "{" else F.lit(piece))
        return F.concat(*pieces)

    return F.array(*[fill(f) for f in forms])
