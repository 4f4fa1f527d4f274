"""Ranking operators: one row or a few rows per group, in an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.containment import containing

def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """All rows, with their place in their group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group. Spark drops the rest before the shuffle (window group limit)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn("place of row", place).where(F.col("place of row") <= n)
    return out.withColumnRenamed("place of row", rank) if rank else out.drop("place of row")


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Distinct by the keys, keeping the first row; unlike dropDuplicates the survivor is fixed."""
    return top_n(df, by, order, 1)


def first_level(df: DataFrame, by: Sequence[str], level: str) -> DataFrame:
    """Only the rows of each group's lowest level: later queries count only where earlier ones gave nothing."""
    lowest = F.min(level).over(Window.partitionBy(*by))
    return df.withColumn("lowest level", lowest).where(F.col(level) == F.col("lowest level")).drop("lowest level")


def kept_or_all(df: DataFrame, by: Sequence[str], keep: Column) -> DataFrame:
    """Rows to keep, but all rows of a group in which none is to be kept."""
    some = F.max(F.coalesce(keep, F.lit(False))).over(Window.partitionBy(*by))
    return df.withColumns({"some kept": some, "is kept": F.coalesce(keep, F.lit(False))}).where("`is kept` or not `some kept`").drop("some kept", "is kept")


def alive(url: Column, head: Column, content_type: Column, get: Column, magic: Column, trusted: Column) -> Column:
    """Whether a link answered: HEAD 200 or 403 unless it is a page; pages and HEAD 405 need a GET with a PDF in it.

    Trusted hosts and .htm files need the status alone; a link that was never looked up is not alive.
    """
    easy = trusted | F.lower(url).rlike(r"\.html?$")
    page = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("html"))
    good = head.isin(200, 403)
    body = (get == 200) & (magic == "%PDF-")
    return F.coalesce(F.when(easy, good).when(good & ~page, True).when((head == 405) | (good & page), body).otherwise(False), F.lit(False))


def best_alive(scored: DataFrame, *, request: str = "request_id", first: Sequence[str] = ()) -> DataFrame:
    """Each request's best passing and living candidate: score, then source tier, then source order, then url.

    Needs ``score, source, alive, source_tier, phase``. Web hits pass from 0.65, others from 0.80. Columns of ``first`` come before the score.
    """
    passing = F.col("score") >= F.when(F.col("source") == "web", 0.65).otherwise(0.80)
    return top_n(scored.where(passing & F.col("alive")), [request], [*[F.asc(c) for c in first], F.desc("score"), F.asc("source_tier"), F.asc("phase"), F.asc("url")])


def early_or_best(results: DataFrame, *, request: str = "request_id", line: float = 0.90) -> DataFrame:
    """The first result to complete with a score over the line that is alive (known patterns need not be); else the best."""
    quick = (F.col("score") >= line) & (F.col("alive") | (F.col("source") == "pattern"))
    order = [F.desc(quick.cast("int")), F.when(quick, F.col("completed_at")).asc_nulls_last(), F.desc("score"), F.asc("source_tier"), F.asc("phase"), F.asc("url")]
    passing = F.col("score") >= F.when(F.col("source") == "web", 0.65).otherwise(0.80)
    return top_n(results.where(quick | (passing & F.col("alive"))).withColumn("early", quick), [request], order)


def autocomplete(prefixes: DataFrame, master: DataFrame, *, limit: int = 10) -> DataFrame:
    """Companies for each prefix: ticker or name equal, starting with or containing it; best tickers first.

    Different prefixes are looked up once among the different names and tickers, in an index of n-grams. Blank prefixes find nothing.
    """
    asked = prefixes.withColumn("asked", F.upper(F.trim("prefix"))).where("asked <> ''")
    rows = master.select("ticker", "name", F.upper("ticker").alias("t"), F.upper("name").alias("n")).distinct()
    texts = rows.select(F.explode(F.array("t", "n")).alias("text"))
    found = containing(asked.select(F.col("asked").alias("pattern")), texts)
    hits = found.join(rows, F.col("text") == F.col("t")).unionByName(found.join(rows, F.col("text") == F.col("n")))
    p, t, n = F.col("pattern"), F.col("t"), F.col("n")
    rank = F.when(t == p, 100).when(n == p, 95).when(F.startswith(t, p), 80).when(F.startswith(n, p), 75).when(F.contains(t, p), 50).when(F.contains(n, p), 40)
    one = first_by(hits.withColumn("score", rank), ["pattern", "ticker"], [F.desc("score"), F.asc("name")])
    best = top_n(one, ["pattern"], [F.desc("score"), F.asc("name"), F.asc("ticker")], limit, "place")
    return asked.join(best.select("pattern", "ticker", "name", "score", "place"), F.col("asked") == F.col("pattern")).drop("asked", "pattern")


def progress(events: DataFrame) -> DataFrame:
    """Progress of each session event: the nth status gives 15, 30, 48, 62, 75, then 85; a result 95; the end 100."""
    order = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.when(F.col("kind") == "status", 1).otherwise(0)).over(order).cast("int")
    steps = F.array(*[F.lit(x) for x in (0, 15, 30, 48, 62, 75, 85)])
    percent = F.when(F.col("kind") == "status", F.element_at(steps, F.least(n, F.lit(6)) + 1)).when(F.col("kind") == "result", 95).otherwise(100)
    return events.withColumns({"n_status": n, "percent": percent, "message": F.least(F.floor(percent / 100 * 6), F.lit(5)).cast("int")})
