"""Lookup joins between requests and company tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.containment import containing
from docsieve.operators.ranking import top_n


def exact(requests: DataFrame, master: DataFrame, *, text: str, key: str = "request_id", value: str = "company_id") -> DataFrame:
    """``key, value, by``: companies whose ticker, or else whose upper-case name, is the text; one hash join on both keys.

    The first company of each key is found before the join, so a name that many companies share meets a request once.
    """
    keys = master.select(F.upper("ticker").alias("k"), F.lit(0).alias("prio"), value, "name").unionByName(master.select(F.upper("name").alias("k"), F.lit(1).alias("prio"), value, "name"))
    first = keys.where("k is not null").groupBy("k").agg(F.min(F.struct("prio", "name", value)).alias("first"))
    found = requests.select(key, F.upper(F.trim(text)).alias("k")).join(first, "k")
    best = found.groupBy(key).agg(F.min("first").alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), F.when(F.col("b.prio") == 0, "ticker").otherwise("name").alias("by"))


def entries(master: DataFrame, *, value: str = "company_id") -> DataFrame:
    """``k, found, place``: upper-case tickers and names as keys, in the order of the companies, a ticker before its name.

    A key that occurs again keeps its first place and has its last company. A master without tickers has names alone.
    """
    key = lambda c, n: master.select(F.upper(c).alias("k"), F.struct(F.col(value), F.lit(n).alias("which")).alias("place"))
    keys = key("ticker", 0).unionByName(key("name", 1)) if "ticker" in master.columns else key("name", 1)
    return keys.where("k is not null").groupBy("k").agg(F.max("place")[value].alias("found"), F.min("place").alias("place"))


def fuzzy(requests: DataFrame, master: DataFrame, *, text: str, key: str = "request_id", value: str = "company_id") -> DataFrame:
    """``key, value``: the first entry that starts with the text's first word and has min(2, words) of its words.

    The text's words are those of more than two letters between blanks, in upper case, repeats included. The smallest
    entry of each first word, and of each first word with another word, is found before the join, so a text meets one
    entry per word and no frequent first word is expanded; each different list of words is resolved once.
    """
    # Each different text is cut into words once; exploding keeps conditions on them out of the joins below.
    long = lambda w: F.length(w) > 2
    cut = requests.select(F.col(text).alias("text")).distinct().select("text", F.explode(F.array(F.filter(F.split(F.upper("text"), r"\s+"), long))).alias("words"))
    asked = cut.where(F.size("words") > 0)
    texts = asked.select("words").distinct().withColumn("first", F.get("words", F.lit(0)))
    known = entries(master, value=value).withColumn("known", F.split("k", r"\s+")).withColumn("first", F.get("known", F.lit(0)))
    least = F.min(F.struct("place", "found")).alias("b")
    alone = (F.size("words") == 1) | (F.size(F.filter("words", lambda w: w == F.col("first"))) > 1)
    one = texts.where(alone).join(known.groupBy("first").agg(least), "first").select("words", "b")
    pairs = known.select("first", "place", "found", F.explode(F.array_distinct("known")).alias("other")).groupBy("first", "other").agg(least)
    two = texts.where(~alone).select("words", "first", F.explode(F.array_except("words", F.array("first"))).alias("other")).join(pairs, ["first", "other"]).select("words", "b")
    best = one.unionByName(two).groupBy("words").agg(F.min("b").alias("b"))
    answers = asked.join(best, "words").select("text", F.col("b.found").alias(value))
    return requests.select(key, F.col(text).alias("text")).join(answers, "text").select(key, value)


def lookup(requests: DataFrame, master: DataFrame, *, ticker: str, text: str, key: str = "request_id", value: str = "company_id") -> DataFrame:
    """``key, value, step``: the entry of the ticker (0), else of the whole text (1), else the first similar one (2)."""
    known = entries(master, value=value).select("k", "found")
    own, named = known.toDF("own_k", "own"), known.toDF("named_k", "named")
    like = fuzzy(requests.select(F.col(text).alias("asked")).distinct(), master, text="asked", key="asked", value=value).toDF("asked", "like")
    every = (
        requests.join(own, F.upper(ticker) == F.col("own_k"), "left").join(named, F.upper(text) == F.col("named_k"), "left").join(like, F.col(text) == F.col("asked"), "left")
    )
    step = F.when(F.col("own").isNotNull(), 0).when(F.col("named").isNotNull(), 1).when(F.col("like").isNotNull(), 2)
    return every.select(key, F.coalesce("own", "named", "like").alias(value), step.alias("step")).where("step is not null")


def contained(requests: DataFrame, master: DataFrame, *, text: str, key: str = "request_id", value: str = "company_id") -> DataFrame:
    """``key, value, step``: exact name (0), else the first name within the text (1), else the first that contains it (2).

    Compared in lower case; empty texts and names match nothing. Every different text and name is looked up once in an index of
    n-grams, and later steps only see the texts that earlier ones left open.
    """
    rows = requests.select(key, F.lower(F.trim(text)).alias("text")).where("text <> ''")
    asked = rows.select("text").distinct()
    names = master.groupBy(F.lower("name").alias("name")).agg(F.min(value).alias(value)).where("name <> ''")
    step = lambda hits, n: hits.groupBy("text").agg(F.min(value).alias(value)).withColumn("step", F.lit(n))
    left = lambda done: asked.join(done, "text", "left_anti")
    equal = asked.join(names, F.col("text") == F.col("name")).select("text", value, F.lit(0).alias("step"))
    within = step(containing(names.select(F.col("name").alias("pattern")), left(equal)).join(names, F.col("pattern") == F.col("name")), 1)
    around = containing(left(equal).join(within, "text", "left_anti").select(F.col("text").alias("pattern")), names.select(F.col("name").alias("text")))
    around = step(around.select(F.col("pattern"), F.col("text").alias("name")).join(names, "name").withColumnRenamed("pattern", "text"), 2)
    return rows.join(equal.unionByName(within).unionByName(around), "text").select(key, value, "step")


def most_overlap(requests: DataFrame, listing: DataFrame, *, text: str, key: str = "request_id", value: str = "company_id") -> DataFrame:
    """``key, value, score``: the listing whose name has most words of the text, ties to the smallest value; a ticker named in the text scores 999.

    Of listings with the same name or ticker the first stands for all, and different texts are resolved once. No word, however
    frequent, is expanded: the best listing of each single word and of each pair of words of a name is found before
    the join, which settles scores of one and two. Only a text with three known words or more can score higher. Its
    words are put in order, rarest first. A listing that shares s of the m words has two of the first m - s + 2, so
    candidates come from pairs of these; the rarest word's pairs first, and the others only as far as the score
    found by then leaves listings that can still win.
    """
    texts = requests.select(F.lower(F.trim(text)).alias("text")).distinct()
    words = texts.select("text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).where("w <> ''")
    names = listing.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min(value).alias("found"))
    names = names.select("found", F.array_remove(F.array_distinct(F.split("name", r"\s+")), "").alias("own"))
    single = names.select("found", F.explode("own").alias("w")).groupBy("w").agg(F.min("found").alias("found"), F.count("*").alias("df"))
    tickers = listing.groupBy(F.lower("ticker").alias("w")).agg(F.min(value).alias("found"))
    best = lambda hits, score: hits.groupBy("text").agg(F.min(F.struct((-score).alias("less"), "found")).alias("b"))
    named = best(words.join(tickers, "w"), F.lit(999))
    known = words.join(single, "w")
    one = best(known, F.lit(1))
    # the known words of a text, rarest first; "ws" is also the key that hits are checked with
    ordered = known.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda s: s["w"]).alias("ws")).where(F.size("ws") > 1)
    pairs = names.select("found", "own", F.explode(word_pairs("own")).alias("pair"))
    asked = ordered.select("text", "ws", F.explode(ranked_pairs("ws")).alias("p")).select("text", "ws", "p.first", "p.last", F.array_sort(F.array("p.a", "p.b")).alias("pair"))
    two = best(asked.join(pairs.groupBy("pair").agg(F.min("found").alias("found")), "pair"), F.lit(2))
    longer, wide = asked.where(F.size("ws") > 2), pairs.where(F.size("own") > 2)
    score = F.size(F.array_intersect("ws", "own"))
    more = lambda hits: best(hits.join(wide, "pair").withColumn("score", score).where("score > 2"), F.col("score"))
    rare = more(longer.where((F.col("first") == 0) & (F.col("last") < F.size("ws") - 1)))
    bound = longer.where("first > 0").join(rare.select("text", (-F.col("b.less")).alias("reached")), "text", "left")
    rest = more(bound.where(F.col("last") < F.size("ws") - F.coalesce("reached", F.lit(3)) + 2))
    every = named.unionByName(one).unionByName(two).unionByName(rare).unionByName(rest).groupBy("text").agg(F.min("b").alias("b"))
    answers = every.select("text", F.col("b.found").alias(value), (-F.col("b.less")).cast("long").alias("score"))
    return requests.select(key, F.lower(F.trim(text)).alias("text")).join(answers, "text").select(key, value, "score")


def word_pairs(words: str) -> Column:
    """Each two words of a list, in alphabetical order within the pair."""
    later = lambda i: F.slice(F.col(words), i + 2, F.size(words))
    return F.flatten(F.transform(words, lambda a, i: F.transform(later(i), lambda b: F.array_sort(F.array(a, b)))))


def ranked_pairs(words: str) -> Column:
    """Each two words of a list with their places."""
    later = lambda i: F.slice(F.col(words), i + 2, F.size(words))
    return F.flatten(F.transform(words, lambda a, i: F.transform(later(i), lambda b, j: F.struct(a.alias("a"), b.alias("b"), i.alias("first"), (i + j + 1).alias("last")))))


def first_fragment(rows: DataFrame, dim: DataFrame, *, text: str, fragment: str = "fragment", result: str = "mapped") -> DataFrame:
    """Adds the value of the first entry, in the order of ``ord``, whose fragment the lower-case text contains.

    ``dim (fragment, value, ord)`` of up to 1,000 entries is read to the driver and applied as one expression, so rows are
    neither shuffled nor joined; a larger one is matched with the different texts through an index of n-grams.
    """
    if dim.limit(1001).count() > 1000:
        entries = dim.groupBy(F.lower(fragment).alias("pattern")).agg(F.min(F.struct("ord", "value")).alias("entry"))
        texts = rows.select(F.lower(text).alias("text")).distinct()
        found = containing(entries, texts).join(entries, "pattern").groupBy("text").agg(F.min("entry").alias("entry"))
        return rows.join(found, F.lower(rows[text]) == found["text"], "left").select(*rows.columns, F.col("entry.value").alias(result))
    found = None
    for r in dim.orderBy("ord").collect():
        hit = F.contains(F.lower(text), F.lit(r[fragment].lower()))
        found = F.when(hit, r["value"]) if found is None else found.when(hit, r["value"])
    return rows.withColumn(result, found if found is not None else F.lit(None).cast("string"))


def routed(requests: DataFrame, routes: DataFrame, *, key: str = "request_id") -> DataFrame:
    """``key, route``: the first route, in order, for the request's exchange or else its country; two equi-joins."""
    by_mic = requests.join(routes.where("mic is not null").select("mic", "route", "ord"), "mic").select(key, "route", "ord")
    by_country = requests.join(routes.where("mic is null").select("country", "route", "ord"), "country").select(key, "route", "ord")
    return by_mic.unionByName(by_country).groupBy(key).agg(F.min_by("route", "ord").alias("route"))


def best_hits(hits: DataFrame, *, key: str = "request_id") -> DataFrame:
    """The first PDF hit of each request, else its first hit."""
    return top_n(hits, [key], [F.asc(~F.contains(F.lower("url"), F.lit(".pdf"))), F.asc("pos")])
