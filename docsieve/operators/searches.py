"""Searches over a table of hits: plans from rule tables, and their evaluation in a join of searches and hits by request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import requests as rq
from docsieve.functions import searches as sr
from docsieve.functions.text import host
from docsieve.operators.ranking import first_level


def filled(requests: DataFrame, rows, applies: Column) -> DataFrame:
    """``request_id, ord, query``: the searches that apply to a request, filled in; of equal texts the first. Requests without a name or year have none.

    ``applies`` is an array with the names of groups of searches; they are joined by equality with the rule table, which has a fixed size.
    """
    year = F.col("year")
    text = lambda y: y.cast("string")
    label = sr.document_label(F.col("doc_type")) if "doc_type" in requests.columns else F.lit("annual report")
    values = {
        "{name}": F.col("name"), "{doc}": label, "{year}": text(year), "{fy}": F.concat(text(year - 1), F.lit("-"), F.substring(text(year), 3, 2)), "{yy}": F.substring(text(year), 3, 2), "{nyy}": F.substring(text(year + 1), 3, 2),
        "{native}": F.coalesce("native_term", F.lit("")) if "native_term" in requests.columns else F.lit(""), "{site}": F.col("site") if "site" in requests.columns else F.lit(""),
    }
    table = requests.sparkSession.createDataFrame(list(rows), "for string, ord int, template string")
    joined = requests.withColumn("for", F.explode(applies)).join(F.broadcast(table), "for")
    query = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), values.items(), F.col("template"))
    return joined.withColumn("query", query).where("query is not null").groupBy("request_id", "query").agg(F.min("ord").alias("ord")).select("request_id", "ord", "query")


def plan(requests: DataFrame) -> DataFrame:
    """The searches of every request: six for all, two with its ``native_term`` if it has another one, four by region.

    Needs ``request_id, name, country, year``; ``doc_type`` and ``native_term`` are used where they are there.
    """
    native = F.lit("")
    if "native_term" in requests.columns:
        native = F.when(~F.lower(F.trim("native_term")).isin("", "annual report"), "native")
    return filled(requests, sr.SEARCHES, F.array(F.lit("all"), native, rq.region(F.col("name"), F.col("country"))))


def site_plan(requests: DataFrame, *, site: str = "ir_url") -> DataFrame:
    """The searches within the site of each request's address, strictest first; none without a host."""
    own = requests.withColumn("site", host(F.col(site))).where("site <> ''")
    return filled(own, sr.SITE_SEARCHES, F.array(F.lit("site")))


def clauses(plans: DataFrame) -> DataFrame:
    """``request_id, ord, needed, groups``: a row for each search that asks for something.

    A term is a site, a file ending, a quoted phrase or what stands between blanks; terms joined by OR are alternatives of one group.
    ``groups`` holds the alternatives of each group as ``required, kind, term``, words with single blanks around them;
    ``needed`` is the number of groups with a term that must be met.
    """
    # Each text is cut into terms once; exploding a single array keeps what follows from cutting it again.
    once = lambda df, value, name: df.select("request_id", "ord", F.explode(F.array(value)).alias(name))
    cut = lambda t: F.struct(sr.term_required(t).alias("required"), sr.term_kind(t).alias("kind"), sr.term_words(t).alias("words"))
    line = lambda t: F.when(t["kind"] == "word", F.concat(F.lit(" "), F.array_join(t["words"], " "), F.lit(" "))).otherwise(F.get(t["words"], F.lit(0)))
    full = lambda g: F.filter(F.transform(F.split(g, "\x01"), cut), lambda t: F.size(t["words"]) > 0)
    terms = F.transform(sr.groups(F.col("query")), lambda g: F.transform(full(g), lambda t: F.struct(t["required"].alias("required"), t["kind"].alias("kind"), line(t).alias("term"))))
    rows = once(plans, F.filter(terms, lambda g: F.size(g) > 0), "groups").where(F.size("groups") > 0)
    needed = F.size(F.filter("groups", lambda g: F.exists(g, lambda t: t["required"])))
    return rows.select("request_id", "ord", needed.alias("needed"), "groups")


def texts(hits: DataFrame, *, url: str = "url", text: str = "link_text") -> DataFrame:
    """``request_id, pos, said, site, ending``: the words of address and text in order with single blanks around them, the host after a dot, the file's ending."""
    ending = F.regexp_extract(F.lower(F.regexp_replace(url, "[?#].*$", "")), r"\.([a-z0-9]+)$", 1)
    said = F.concat(F.lit(" "), F.array_join(sr.words(F.concat_ws(" ", url, text)), " "), F.lit(" "))
    return hits.select("request_id", "pos", said.alias("said"), F.concat(F.lit("."), host(F.col(url))).alias("site"), ending.alias("ending"))


def met(term: Column) -> Column:
    """Whether a hit has the words of a term in a row, lies in its domain or has its ending."""
    kind, t = term["kind"], term["term"]
    return F.when(kind == "word", F.contains("said", t)).when(kind == "site", F.endswith("site", F.concat(F.lit("."), t))).otherwise(F.col("ending") == t)


def answers(plans: DataFrame, hits: DataFrame, **columns) -> DataFrame:
    """``request_id, ord, pos, n_words``: each request's hits that meet all that its first successful search requires.

    A phrase is met where its words stand in a row; a group if one of its alternatives is met. ``n_words`` is the number of the
    search's other words that the hit has; a search that requires nothing needs one at least. Plans and hits meet in one join by
    request, where each search is held against the hit's text at once: a word is never a row, so what is shuffled grows with
    requests and hits alone, and Spark splits a request with many hits.
    """
    both = clauses(plans).join(texts(hits, **columns), "request_id")
    state = F.transform("groups", lambda g: F.when(F.exists(g, lambda t: t["required"] & met(t)), 2).when(F.exists(g, met), 1).otherwise(0))
    tried = both.select("request_id", "ord", "pos", "needed", F.explode(F.array(state)).alias("state")).select("request_id", "ord", "pos", "needed", F.size(F.filter("state", lambda s: s == 2)).alias("n_required"), F.size(F.filter("state", lambda s: s == 1)).cast("long").alias("n_words"))
    good = tried.where("n_required = needed and n_required + n_words > 0")
    return first_level(good, ["request_id"], "ord").select("request_id", "ord", "pos", "n_words")
