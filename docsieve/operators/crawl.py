"""A crawl over stored pages: which pages are in reach of a start page within a number of hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import rules
from docsieve.functions.text import absolute, any_of, host
from docsieve.operators.links import anchor_list, anchors, wanted

# Standard paths of report pages and archives, in order.
ARCHIVE_PATHS = (
    "/annual-reports", "/investor-relations", "/financials", "/reports", "/investors", "/archive", "/annual-reports/archive", "/investor-relations/historical", "/financials/archive", "/reports/archive",
)
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def fetched(pages: DataFrame, *, url: str = "url", status: str = "status") -> DataFrame:
    """Pages that answered with status 200; a table without that column has only such pages. Files are no pages."""
    good = pages.where(F.col(status) == 200) if status in pages.columns else pages
    return good.where(~F.endswith(F.lower(url), F.lit(".pdf")))


def onward(pages: DataFrame, *, most: int = 12, most_linked: int = 5, url: str = "url", html: str = "html") -> DataFrame:
    """``src, origin, to``: the addresses to go on to from each page; none where the page gave a document link.

    A row is a page: all its rules are applied to its own list of anchors, so nothing is shuffled, and HTML is read once.
    """
    nothing = F.expr("cast(array() as array<string>)")
    read = pages.select(F.col(url).alias("src"), F.regexp_extract(url, ORIGIN, 1).alias("origin"), host(F.col(url)).alias("host"), anchor_list(html).alias("found"))
    # What asks for one word of many is asked of all anchors at once: no word has a line feed.
    said = lambda field: F.lower(F.array_join(F.transform("found", lambda a: a[field]), "\n"))
    hrefs, texts = said("href"), said("text")
    single = F.contains(texts, F.lit("report")) & F.contains(hrefs, F.lit("download")) & F.exists("found", lambda a: F.contains(F.lower(a["text"]), F.lit("report")) & F.contains(F.lower(a["href"]), F.lit("download")))
    documents = F.contains(hrefs, F.lit("pdf")) | any_of(hrefs, rules.ANNUAL_HREF) | any_of(texts, rules.ANNUAL_TEXT) | single
    link = F.transform("found", lambda a: F.struct(absolute(F.col("src"), a["href"]).alias("link"), a["text"].alias("text")))
    inside = F.filter(link, lambda a: (a["link"] != F.col("src")) & any_of(F.lower(F.concat_ws(" ", a["link"], a["text"])), rules.FINANCE_PAGE) & (host(a["link"]) == F.col("host")))
    linked = F.slice(F.array_distinct(F.transform(inside, lambda a: a["link"])), 1, most_linked)
    usual = F.filter(F.array(*[F.concat("origin", F.lit(p)) for p in ARCHIVE_PATHS]), lambda path: path != F.col("src"))
    to = F.when(F.coalesce(documents, F.lit(False)), nothing).otherwise(F.slice(F.array_distinct(F.concat(F.coalesce(linked, nothing), usual)), 1, most))
    return read.select("src", "origin", to.alias("to"))


def hops(pages: DataFrame, *, most: int = 12, most_linked: int = 5, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst``: where to go on from a page that gave no document link.

    First its links to finance pages of the same host, then the standard paths of that host; each address once, the page's own not, at
    most ``most``.
    """
    return onward(pages, most=most, most_linked=most_linked, url=url, html=html).select("src", F.explode("to").alias("dst")).distinct()


def live_hops(pages: DataFrame, *, page: str = "page_id", url: str = "url", **columns) -> DataFrame:
    """``src, dst``: the same, but of the standard paths only those that are pages; repeats are possible.

    Hosts have few of these pages, so they are found once for each host, not once for each page. The table is shuffled by ``dst``, so that
    Spark makes it once for all rounds that join it there.
    """
    archives = pages.select(F.col(url).alias("path"), F.regexp_extract(url, ORIGIN, 1).alias("origin"))
    archives = archives.where(F.substr("path", F.length("origin") + 1).isin(*ARCHIVE_PATHS)).groupBy("origin").agg(F.collect_set("path").alias("there"))
    paths = F.array(*[F.concat("origin", F.lit(p)) for p in ARCHIVE_PATHS])
    gone = F.array_except(paths, F.coalesce("there", F.expr("cast(array() as array<string>)")))
    return onward(pages, url=url, **columns).join(archives, "origin", "left").select("src", F.explode(F.array_except("to", gone)).alias("dst")).repartition("dst")


def surroundings(edges: DataFrame, own: DataFrame, depth: int) -> DataFrame:
    """``url, items, steps``: what the pages ``steps`` hops away from a page have, for all pages at once.

    ``own (url, items)`` are the pages' own items as arrays. Round by round each page takes over the lists of the pages it leads to, so
    a row is an edge and not a page in reach of a root. A list of pages has at most 12 addresses to the power of ``steps``.
    """
    nothing = F.expr("slice(items, 1, 0)")
    near = own.select("url", F.col("items").alias("items0"))
    for k in range(1, depth + 1):
        gathered = [F.array_distinct(F.flatten(F.collect_list(f"items{j}"))).alias(f"items{j + 1}") for j in range(k)]
        sent = edges.join(near.withColumnRenamed("url", "dst"), "dst").groupBy(F.col("src").alias("url")).agg(*gathered)
        mine = own.select("url", F.col("items").alias("items0"), *[nothing.alias(f"items{j}") for j in range(1, k + 1)])
        near = mine.unionByName(sent.withColumn("items0", F.slice("items1", 1, 0)))
    steps = F.array(*[F.struct(F.col(f"items{k}").alias("items"), F.lit(k).alias("steps")) for k in range(depth + 1)])
    return near.select("url", F.explode(steps).alias("at")).where(F.size("at.items") > 0).select("url", "at.items", "at.steps")


def in_reach(starts: DataFrame, pages: DataFrame, *, depth: int = 2, packed: int = 0, root: str = "root", url: str = "url", **columns) -> DataFrame:
    """``root, url, depth``: the fetched pages within ``depth`` hops of each start, with the fewest hops to each.

    ``starts (root, url)``. Every round joins the frontier with the hops of its pages and leaves out what the root has seen, so circles
    end. The table of hops is the same in all rounds, and Spark shuffles it once. The first ``packed`` hops, three at most, are taken for
    all pages at once and not for each start: less work when the starts are a large part of the pages, more when they are few.
    """
    have = fetched(pages, url=url)
    known = have.select(F.col(url).alias("url")).where("url is not null").distinct()
    edges, first = live_hops(have, url=url, **columns), min(packed, depth, 3)
    asked = starts.select(root, F.col("url")).distinct()
    if first > 0:
        near = surroundings(edges, known.select("url", F.array("url").alias("items")), first)
        rows = asked.join(near, "url").select(root, F.explode("items").alias("url"), "steps")
        seen = rows.groupBy(root, "url").agg(F.min("steps").alias("depth"))
    else:
        seen = asked.join(known, "url", "left_semi").select(root, "url", F.lit(0).alias("depth"))
    frontier = seen.where(F.col("depth") == first)
    if depth > first:
        edges = edges.distinct().join(known.withColumnRenamed("url", "dst"), "dst", "left_semi")
    for d in range(first + 1, depth + 1):
        further = frontier.select(root, F.col("url").alias("src")).join(edges, "src").select(root, F.col("dst").alias("url")).distinct()
        frontier = further.join(seen, [root, "url"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def page_documents(have: DataFrame, *, page: str, url: str, **columns) -> DataFrame:
    found = anchors(have, page=page, url=url, **columns)
    return found.where(wanted(F.col("href"), F.col("text"), rules.ANNUAL_HREF, rules.ANNUAL_TEXT)).select(F.col("base").alias("url"), "pos", "link", "text")


def nearest(found: DataFrame, root: str) -> DataFrame:
    """Each of a root's links once, from the nearest page (ties: the first address, then the first place)."""
    best = found.groupBy(root, "link").agg(F.min(F.struct("depth", "url", "pos", "text")).alias("best"))
    return best.select(root, "best.depth", "link", "best.text")


def documents_in_reach(reached: DataFrame, pages: DataFrame, *, root: str = "root", page: str = "page_id", url: str = "url", **columns) -> DataFrame:
    """``root, depth, link, text``: document links of the pages in reach, each of a root's links once, from the nearest page (ties: the first address)."""
    return nearest(reached.join(page_documents(fetched(pages, url=url), page=page, url=url, **columns), "url"), root)


def documents_within(starts: DataFrame, pages: DataFrame, *, depth: int = 2, root: str = "root", page: str = "page_id", url: str = "url", **columns) -> DataFrame:
    """The same as ``documents_in_reach`` of ``in_reach``, for at most three hops from many starts: documents are handed from page to page, so pages without any are never listed."""
    if depth > 3:
        return documents_in_reach(in_reach(starts, pages, depth=depth, packed=3, root=root, url=url, **columns), pages, root=root, page=page, url=url, **columns)
    have = fetched(pages, url=url)
    found = page_documents(have, page=page, url=url, **columns)
    own = found.groupBy("url").agg(F.collect_set(F.struct("url", "pos", "link", "text")).alias("items"))
    near = surroundings(live_hops(have, url=url, **columns), own, depth)
    rows = starts.select(root, F.col("url").alias("start")).distinct().join(near.withColumnRenamed("url", "start"), "start").select(root, F.explode("items").alias("d"), F.col("steps").alias("depth"))
    return nearest(rows.select(root, "depth", "d.url", "d.pos", "d.link", "d.text"), root)
