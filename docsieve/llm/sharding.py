"""Sharding by sampled splitters, with DataFrame functions only.

A sample of keys, each drawn with a chance in proportion to its row's size, gives quantile boundaries; rows are
dealt to the ranges between them, and ranges that came out too large (a hot key) are divided further. Exact
sizes of all ranges, a few hundred numbers, then fix where each shard begins, and a running sum within the ranges
that are cut finishes the job. So shard sizes differ by a document at most, not by the sampling error.

Scale: only ids, sizes and digests are shuffled, never texts; no window is larger than a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import cut

LAWS = ("bytes", "rows")


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"),
    )


def splitters(rows: DataFrame, weight: Column, total: int, ranges: int, per_range: int) -> list:
    """At most ``ranges - 1`` ids at the quantiles of a weighted sample of about ``ranges * per_range`` keys."""
    draw = F.pmod(F.xxhash64("id", "tie", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(F.col("id").isNotNull() & (draw < weight * F.lit(ranges * per_range / max(total, 1)))).select("id")
    tiles = sample.withColumn("tile", F.ntile(ranges).over(Window.orderBy("id"))).groupBy("tile").agg(F.min("id").alias("id"))
    return [r["id"] for r in tiles.where("tile > 1").select("id").distinct().orderBy("id").collect()]


def range_number(bounds: list, kind: str, width: int = 16) -> Column:
    """How many boundaries are at or below the id, found in two steps; a null id is in range 0."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    literal = lambda values: F.array(*[F.lit(v).cast(kind) for v in values])
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col("id")))
    coarse = F.greatest(below(literal([g[0] for g in groups])) - 1, F.lit(0))
    fine = F.element_at(F.array(*[literal(g) for g in groups]), coarse + 1)
    return F.when(F.col("id").isNull(), 0).otherwise(coarse * width + below(fine))


def shards(docs: DataFrame, *, n_shards: int = 16, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text",
           ranges: int = 256, per_range: int = 32, overfull: float = 2.0) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot`` for every row.

    ``size`` is the text's UTF-8 bytes plus 1. ``bytes``: ranges of ids follow each other, and a row belongs to
    the shard in which its first byte lies when the whole is cut into equal parts, so sizes differ by a row at most.
    ``rows``: the same with each row counted as one. ``slot`` numbers a shard's rows from 0 without gaps.
    A null text has size 1 and checksum 0; null ids come first; rows that repeat an id are told apart by their
    text's hash, and rows equal in both may take each other's places. An empty table gives an empty result.
    Other columns are ignored. ``ranges * per_range`` bounds the expected sample.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    rows = cut(described(docs, id_col, text_col))
    weight = F.col("size") if law == "bytes" else F.lit(1)
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long")).first()[0]
    bounds = splitters(rows, weight, total, ranges, per_range)
    kind = dict(rows.dtypes)["id"]
    dealt = rows.withColumn("range", range_number(bounds, kind))
    sizes = dealt.groupBy("range").agg(F.sum(weight).alias("weight")).collect()  # as many as ranges
    share = max(1.0, total / ranges)
    parts = {r["range"]: -(-int(r["weight"]) // int(share)) for r in sizes if r["weight"] > overfull * share}
    pieces = reduce(lambda c, x: c.when(F.col("range") == x[0], x[1]), parts.items(), F.when(F.lit(False), 1)).otherwise(1)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "tie", "size"), pieces))
    inside = dealt.groupBy("range", "part").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inside.select("range", "part", F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    run = Window.partitionBy("range", "part").orderBy("id", "tie", "size")
    start = F.col("weight_before") + F.sum(weight).over(run.rowsBetween(Window.unboundedPreceding, 0)) - weight
    placed = cut(
        dealt.join(F.broadcast(offsets), ["range", "part"])  # a row per range and part
        .withColumn("place", F.col("rows_before") + F.row_number().over(run) - 1)
        .withColumn("shard", F.least(F.floor(start * n_shards / F.lit(max(total, 1))), F.lit(n_shards - 1)).cast("int"))
        .select("id", "size", "text_crc32", "tie", "place", "shard")
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), "tie")


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the documents to one folder per shard; returns the assignment. Equal rows go to one shard."""
    found = shards(docs, id_col=id_col, text_col=text_col, **options)
    key = found.groupBy(F.col(id_col).alias("shard_id"), F.col("tie").alias("shard_tie")).agg(F.min("shard").alias("shard"))
    match = docs[id_col].eqNullSafe(key["shard_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == key["shard_tie"])
    docs.join(key, match).drop("shard_id", "shard_tie").write.partitionBy("shard").parquet(path)
    return found
