"""Links of crawled pages. HTML is dropped as soon as links are taken out, so it never reaches a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.functions.text import absolute, any_of, host
from docsieve.operators.ranking import first_by, top_n

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
SCRIPTED = r"""(?i)['"]([^'"]*\.pdf[^'"]*)['"]"""


def anchors(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page, base, pos, href, text, link`` of every anchor with a target."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("text"))
    rows = pages.select(page, F.col(url).alias("base"), F.posexplode(found).alias("pos", "a"))
    text = F.trim(F.regexp_replace("a.text", "<[^>]*>", ""))
    rows = rows.select(page, "base", "pos", F.trim("a.href").alias("href"), text.alias("text")).where("href <> ''")
    return rows.withColumn("link", absolute(F.col("base"), F.col("href")))


def anchor_list(html: Column | str) -> Column:
    """The same ``href, text`` as one array for each page."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("text"))
    trimmed = F.transform(found, lambda a: F.struct(F.trim(a["href"]).alias("href"), F.trim(F.regexp_replace(a["text"], "<[^>]*>", "")).alias("text")))
    return F.filter(trimmed, lambda a: a["href"] != "")


def wanted(href: Column, text: Column, words: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    low, said = F.lower(href), F.lower(text)
    loads = F.contains(low, F.lit("pdf")) | F.contains(low, F.lit("download"))
    return F.contains(low, F.lit("pdf")) | any_of(low, words) | any_of(said, phrases) | (F.contains(said, F.lit("report")) & loads)


def document_links(pages: DataFrame, *, page: str = "page_id", words=rules.ANNUAL_HREF, phrases=rules.ANNUAL_TEXT, **columns) -> DataFrame:
    """Anchors that lead to documents, each link of a page once, with the text it has first."""
    found = anchors(pages, page=page, **columns)
    return first_by(found.where(wanted(F.col("href"), F.col("text"), words, phrases)), [page, "link"], [F.asc("pos")])


def scripted_links(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Quoted texts with ``.pdf`` within onclick attributes, absolute, each link of a page once."""
    clicks = F.array_join(F.regexp_extract_all(html, F.lit(r"""(?is)onclick\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1)), " ")
    inner = F.regexp_replace(clicks, r"""^["']|["']$""", "")
    rows = pages.select(page, F.col(url).alias("base"), F.posexplode(F.regexp_extract_all(inner, F.lit(SCRIPTED), F.lit(1))).alias("pos", "href"))
    return first_by(rows.withColumn("link", absolute(F.col("base"), F.col("href"))), [page, "link"], [F.asc("pos")])


def subpages(pages: DataFrame, *, page: str = "page_id", most: int = 5, words=rules.FINANCE_PAGE, **columns) -> DataFrame:
    """The first pages of the same host whose link or text speaks of finance, other than the page itself."""
    found = anchors(pages, page=page, **columns)
    inside = (host(F.col("link")) == host(F.col("base"))) & (F.col("link") != F.col("base"))
    said = any_of(F.lower(F.concat_ws(" ", "link", "text")), words)
    one = first_by(found.where(inside & said), [page, "link"], [F.asc("pos")])
    return top_n(one, [page], [F.asc("pos")], most, "place")


def merged_channels(channels: list[DataFrame], *, page: str = "page_id") -> DataFrame:
    """Links of several channels in order of precedence; a link seen earlier keeps its text and channel."""
    rows = None
    for i, channel in enumerate(channels):
        part = channel.select(page, F.lit(i).alias("channel"), "pos", "link", *[c for c in ("text",) if c in channel.columns])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return first_by(rows, [page, "link"], [F.asc("channel"), F.asc("pos")])


def next_hop(pages: DataFrame, found: DataFrame, *, page: str = "page_id", **columns) -> DataFrame:
    """Subpages of only those pages that gave no document link."""
    return subpages(pages.join(found.select(page).distinct(), page, "left_anti"), page=page, **columns)
