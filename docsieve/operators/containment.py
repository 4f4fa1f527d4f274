"""Which texts contain which: an inverted index of character n-grams, probed with each pattern's rarest gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram. Patterns of up to so many letters are grams themselves.
GRAM = 4


def grams(text: str, n: int) -> Column:
    """The different runs of n characters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.char_length(text) - n + 1)
    return F.array_distinct(F.when(F.char_length(text) >= n, F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def containing(patterns: DataFrame, texts: DataFrame, *, n: int = GRAM) -> DataFrame:
    """``pattern, text``: every pair of a different pattern and a different text that contains it.

    ``patterns (pattern)``, ``texts (text)``. Null and empty patterns are in no text. All joins are by equality: a pattern of
    up to n letters is looked up in the index as it is, a longer one by its gram that fewest texts have, and
    then compared with the texts of that gram. Patterns with a gram that no text has are dropped before.
    """
    asked = patterns.select("pattern").where("pattern <> ''").distinct()
    known = texts.select("text").where("text <> ''").distinct()
    short = asked.where(F.char_length("pattern") <= n)
    lookup = known.select("text", F.explode(F.array_distinct(F.concat(*[grams("text", size) for size in range(1, n + 1)]))).alias("pattern"))
    whole = lookup.join(short, "pattern").select("pattern", "text")
    postings = known.select("text", F.explode(grams("text", n)).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("n_texts"))
    own = asked.where(F.char_length("pattern") > n).select("pattern", grams("pattern", n).alias("grams"), F.explode(grams("pattern", n)).alias("gram"))
    rarest = own.join(counts, "gram").groupBy("pattern").agg(F.min(F.struct("n_texts", "gram")).alias("b"), F.count("*").alias("found"), F.first(F.size("grams")).alias("all"))
    probes = rarest.where("found = all").select("pattern", F.col("b.gram").alias("gram"))
    return whole.unionByName(probes.join(postings, "gram").where(F.contains("text", "pattern")).select("pattern", "text"))
