"""Hard-negative mining by BOND: a vertical scan that shrinks a bitmap of candidates.

A block of candidates is held by columns, with the least and the greatest value of each dimension. For an anchor the
dimensions are read in the order of its descending magnitudes. What the dimensions still to be read can add to a
partial inner product lies between two numbers that follow from those extremes, so after a few dimensions most
candidates are known to miss every window of wanted scores, or to fall behind k others that are surely inside; they
leave the bitmap. What is left after the last dimension has exact scores.

The same scan finds an anchor's positives (its best rows of the same label, one window without ends) and then its
negatives (the best rows of other labels within a window for each positive).

Scale: anchors are a stated set that is held against all rows in blocks: a grid of anchor blocks and candidate blocks
that Spark deals to its tasks, both of bounded size. Positives meet only cells of their own label. Labels of any
size are divided over several blocks. Vectors travel as the smallest kind of integer that holds them; a cell
sends on at most k rows for each anchor and window. Nothing but row counts passes the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import small, stored
from docsieve.llm.topk import LONG, by_length, flat, ranks

#: Sums below these are exact in single and in double precision.
EXACT_SINGLE, EXACT = 2**24, 2**53
#: Dimensions read between two looks at the bounds.
STEP = 16


def labelled(vectors: DataFrame, *, id_col: str, vec_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """``id, label, is_anchor, v array<long>`` of whole numbers ``floor(scale * x)``, held within a long.

    Rows with a null id, label or vector, or a null, NaN or infinite component take no part.
    """
    usable = F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    scaled = lambda x: F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(9.2e18)), F.lit(-9.2e18))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vec_col).isNotNull() & usable)
    return rows.select(F.col(id_col).alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), F.transform(vec_col, lambda x: F.floor(scaled(x)).cast("long")).alias("v"))


def narrow(rows: DataFrame) -> DataFrame:
    """The vectors as the smallest integers that hold all components."""
    most = rows.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0
    return rows.withColumn("v", F.col("v").cast(f"array<{'smallint' if most < 2**15 else 'int' if most < 2**31 else 'long'}>"))


class Columns:
    """A block of candidates of one length, by dimension."""

    def __init__(self, vectors: np.ndarray, rank: np.ndarray, labels: np.ndarray | None):
        self.rows, self.rank, self.labels = vectors, rank, labels
        self.repeated = len(np.unique(rank)) < len(rank)
        self.top = max((abs(int(f(vectors))) for f in (np.min, np.max)), default=0) if vectors.size else 0
        self.kept: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of_kind(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.kept:
            columns = np.ascontiguousarray(self.rows.T).astype(kind)
            self.kept[kind] = columns, columns.min(1), columns.max(1)
        return self.kept[kind]

    def best(self, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k by score and id; rows that share an id count once."""
        order = np.lexsort((self.rank[places], -1 - scores))  # -1 - s falls where s rises, also at the ends of a long
        if self.repeated:
            order = order[np.sort(np.unique(self.rank[places[order]], return_index=True)[1])]
        return places[order[:k]], scores[order[:k]]

    def scan(self, q: np.ndarray, usable: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores, both ends included: places and scores of its first k rows."""
        top = max((abs(int(f(q))) for f in (np.min, np.max)), default=0) * self.top * len(q) if q.size else 0
        if top >= EXACT:
            wide = np.array([min(max(sum(int(a) * int(b) for a, b in zip(q, row, strict=True)), -LONG), LONG - 1) for row in self.rows], np.int64)
            at = np.flatnonzero(usable)
            return self.inside(at, wide[at], windows, k)
        columns, least, greatest = self.of_kind(np.float32 if top < EXACT_SINGLE else np.float64)
        q = q.astype(columns.dtype)
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * least, q * greatest])[:, order]
        rest = [np.append(np.cumsum(e[::-1])[::-1], 0).astype(columns.dtype) for e in (ends.min(0), ends.max(0))]
        at, keep, partial = np.arange(len(usable)), usable.copy(), np.zeros(len(usable), columns.dtype)
        for j in range(0, len(q), STEP):
            dims = order[j : j + STEP]
            partial += q[dims] @ columns[dims]
            lowest, highest = (partial + r[min(j + STEP, len(q))] for r in rest)
            wanted = np.zeros(len(keep), bool)
            for low, high in windows:
                floor = low
                sure = lowest[keep & (lowest >= low) & (highest <= high)]
                if len(sure) >= k and not self.repeated:
                    floor = max(low, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
                wanted |= (highest >= floor) & (lowest <= high)
            keep &= wanted
            left = np.count_nonzero(keep)
            if not left:
                break
            if 2 * left < len(keep):
                columns, at, partial, keep = columns[:, keep], at[keep], partial[keep], np.ones(left, bool)
        return self.inside(at[keep], partial[keep].astype(np.int64), windows, k)

    def inside(self, at: np.ndarray, scores: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for low, high in windows:
            good = (scores >= low) & (scores <= high)
            out.append(self.best(at[good], scores[good], k))
        return out


def window_of(positive: int, least: int, most: int) -> tuple[int, int]:
    """Whole scores s with ``least * p <= 100 * s <= most * p``; empty where p is negative."""
    return -(-least * positive // 100), most * positive // 100


def positives_of_cell(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        who, what, scores = [], [], []
        if asked.num_rows and rows.num_rows:
            arank, xrank = ranks(asked["id"], rows["id"])
            blocks = by_length(flat(rows["v"]))
            for n, (aat, a) in by_length(flat(asked["v"])).items():
                if n in blocks:
                    xat, x = blocks[n]
                    block = Columns(x, xrank[xat], None)
                    for i, q in zip(aat.tolist(), a, strict=True):
                        for places, found in block.scan(q, block.rank != arank[i], [(-np.inf, np.inf)], k):
                            who.append(np.full(len(places), i))
                            what.append(xat[places])
                            scores.append(found)
        return pa.table({"anchor_id": taken(asked, who), "positive_id": taken(rows, what), "positive_score": pa.array(joined(scores))})

    return run


def negatives_of_cell(k: int, least: int, most: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        who, which, what, scores = [], [], [], []
        if asked.num_rows and rows.num_rows:
            arank, xrank = ranks(asked["id"], rows["id"])
            alabel, xlabel = ranks(asked["label"], rows["label"])
            lists = flat(asked["positives"])
            ends, wanted = np.asarray(lists.offsets), lists.values.field("positive_score").to_pylist()
            blocks = by_length(flat(rows["v"]))
            for n, (aat, a) in by_length(flat(asked["v"])).items():
                if n in blocks:
                    xat, x = blocks[n]
                    block = Columns(x, xrank[xat], xlabel[xat])
                    for i, q in zip(aat.tolist(), a, strict=True):
                        windows = [window_of(p, least, most) for p in wanted[ends[i] : ends[i + 1]]]
                        real = [(j, w) for j, w in enumerate(windows) if w[0] <= w[1]]
                        if real:
                            found = block.scan(q, (block.labels != alabel[i]) & (block.rank != arank[i]), [w for _, w in real], k)
                            for (j, _), (places, got) in zip(real, found, strict=True):
                                who.append(np.full(len(places), i))
                                which.append(np.full(len(places), ends[i] + j))
                                what.append(xat[places])
                                scores.append(got)
            pairs = lists.values.take(pa.array(joined(which)))
            own = {name: pairs.field(name) for name in ("positive_id", "positive_score")}
        else:
            own = {"positive_id": taken(rows, []), "positive_score": pa.array([], pa.int64())}
        return pa.table({"anchor_id": taken(asked, who), **own, "negative_id": taken(rows, what), "negative_score": pa.array(joined(scores))})

    return run


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


def taken(table: pa.Table, at: list[np.ndarray]) -> pa.Array:
    return flat(table["id"]).take(pa.array(joined(at)))


def parts(n: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / block)).cast("int")


def dealt(n: str) -> Column:
    return F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")


def every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, label: Column | None = None, k_positives: int = 5, k: int = 3, least: int = 50, most: int = 95, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", block: int = 16_384,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, ranks from 1.

    Positives are an anchor's first ``k_positives`` rows of its own label and another id; for each, the first ``k`` rows of other labels with
    ``least * positive <= 100 * negative <= most * positive`` are its negatives. First means higher integer inner
    product, then smaller id. ``label`` is the column ``label`` unless given. Ids and labels may be of any type with an order.

    Rows with a null id, label or vector, or with a null, NaN or infinite component take no part; vectors of another
    length than the anchor's are no candidates. Rows that repeat an id count once in a list, with the best of their scores;
    anchors that repeat an id pool theirs. Components and scores beyond a long count as its ends. Anchors without
    positives, and positives without negatives, have no rows. Empty input gives an empty result. Other columns are ignored.
    """
    kind = dict(vectors.dtypes)[id_col]
    rows = labelled(vectors, id_col=id_col, vec_col=vec_col, label=F.col("label") if label is None else label, anchor=anchor, scale=scale)
    rows = narrow(rows).select("id", "label", "is_anchor", "v")
    sizes = rows.groupBy("label").agg(parts(F.count("*"), block).alias("n"), parts(F.count_if("is_anchor"), block // 4).alias("m"))
    # toDF names the columns anew, so that both sides of a cogroup can come from one table
    anchors = lambda df: df.where("is_anchor").dropDuplicates(["id", "label", "v"]).toDF(*df.columns)
    placed = rows.join(small(sizes), "label")
    asked = anchors(placed).select("label", "id", "v", dealt("m").alias("down"), every("n").alias("across"))
    known = placed.select("label", "id", "v", dealt("n").alias("across"), every("m").alias("down"))
    cell = ["label", "down", "across"]
    near = asked.groupBy(*cell).cogroup(known.groupBy(*cell)).applyInArrow(positives_of_cell(k_positives), f"anchor_id {kind}, positive_id {kind}, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = near.groupBy("anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k_positives)
    # at most k_positives of an anchor are put together
    positives = stored(first.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))

    totals = rows.agg(parts(F.count("*"), block).alias("n"), parts(F.count_if("is_anchor"), block // 4).alias("m")).first()
    grid = lambda df: df.withColumns({"n": F.lit(totals["n"]), "m": F.lit(totals["m"])})
    asked = grid(anchors(rows).join(positives, F.col("id") == F.col("anchor_id"))).select("label", "id", "v", "positives", dealt("m").alias("down"), every("n").alias("across"))
    known = grid(rows).select("label", "id", "v", dealt("n").alias("across"), every("m").alias("down"))
    schema = f"anchor_id {kind}, positive_id {kind}, positive_score long, negative_id {kind}, negative_score long"
    found = asked.groupBy("down", "across").cogroup(known.groupBy("down", "across")).applyInArrow(negatives_of_cell(k, least, most), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    best = found.groupBy("anchor_id", "positive_id", "negative_id").agg(F.max("positive_score").alias("positive_score"), F.max("negative_score").alias("negative_score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
