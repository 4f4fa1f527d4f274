"""Exact top-k inner-product search by pivot-table elimination.

Inner products become distances: with M the largest norm in a block, ``x' = (x, sqrt(M^2-|x|^2))``
and ``q' = (q, 0)`` give ``2 q.x = |q|^2 + M^2 - |q'-x'|^2``. The distances of every candidate to
the pivots are computed once per block; the largest ``|d(q',p') - d(x',p')|`` over the pivots is a
lower bound on the distance, hence an upper bound on the score. Candidates are evaluated in the
order of that bound until the bound falls below the k-th best score found, which is exact.

Scale: one job over a grid of query blocks and candidate blocks, both of at most ``block`` rows, which
Spark shuffles to its tasks; no vectors but a bounded sample pass through the driver. The sample has the
pivots and gives each query a score that its k-th best cannot fall below, so that blocks send on only rows
that can still matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums below this are exact in double precision.
EXACT = 2**53
LONG = 2**63


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, v array<double>`` of whole numbers ``floor(scale * x)``, held within a long.

    Rows with a null id, a null vector, or a null, NaN or infinite component take no part.
    """
    usable = F.forall(
        vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    scaled = lambda x: F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(9.2e18)), F.lit(-9.2e18))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & usable).select(
        F.col(id_col).alias("id"), F.transform(vec_col, lambda x: F.floor(scaled(x)).cast("double")).alias("v"),
    )


def by_length(rows: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length as a matrix; only vectors of equal length have an inner product."""
    ends, flat = np.asarray(rows.offsets), np.asarray(rows.values)
    sizes = np.diff(ends)
    out = {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[int(n)] = at, flat[(ends[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of one query with the rows of x; beyond a long, its largest or smallest."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.size)
    if top < EXACT:
        return (x @ q).astype(np.int64)
    wide = [sum(int(a) * int(b) for a, b in zip(q, row, strict=True)) for row in x]
    return np.array([min(max(s, -LONG), LONG - 1) for s in wide], np.int64)


def lift(x: np.ndarray, radius2: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(radius2 - np.einsum("ij,ij->i", x, x), 0.0))
    return np.column_stack([x, extra])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def best_of_block(
    qrank: np.ndarray, q: np.ndarray, floor: np.ndarray, xrank: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: places and scores of at most k rows of the block that can be among its best.

    Ranks stand for ids: equal ones are one id, smaller ones go first at a tie. Of rows that share an id the best counts.
    """
    if not len(pivots):
        pivots = x[:1]
    norm2 = max(float((x * x).sum(1).max()), float((pivots * pivots).sum(1).max()))
    table = distances(lift(pivots, norm2), lift(x, norm2))
    to_pivot = distances(np.column_stack([q, np.zeros(len(q))]), lift(pivots, norm2))
    q2 = (q * q).sum(1)
    # Differences are taken in single precision, which the slack covers; so is the cancellation in the distances.
    coarse, near = table.astype(np.float32), np.empty(table.shape, np.float32)
    slack = 1.0 + 1e-5 * (norm2 + q2)
    repeated = len(np.unique(xrank)) < len(xrank)
    for i in range(len(q)):
        np.subtract(coarse, to_pivot[i].astype(np.float32)[:, None], out=near)
        np.abs(near, out=near)
        least = near.max(0).astype(np.float64)
        most = np.maximum((q2[i] + norm2 - least * least) / 2 + slack[i], float(-LONG))
        order = np.flatnonzero((most >= floor[i]) & (xrank != qrank[i]))
        order = order[np.argsort(-most[order], kind="stable")]
        at, scores, done, step = order[:0], np.zeros(0, np.int64), 0, 512
        while done < len(order) and (len(at) < k or most[order[done]] >= scores[-1]):
            part = order[done : done + step]
            at, scores = np.concatenate([at, part]), np.concatenate([scores, products(q[i], x[part])])
            best = np.lexsort((xrank[at], -1 - scores))  # -1 - s falls where s rises, also at the ends of a long
            if repeated:
                best = best[np.sort(np.unique(xrank[at[best]], return_index=True)[1])]
            at, scores, done, step = at[best[:k]], scores[best[:k]], done + step, step * 4
        good = scores >= floor[i]
        yield i, at[good], scores[good]


def ranks(*columns: pa.Array) -> list[np.ndarray]:
    """Numbers in the order of the ids, equal for equal ids, over several columns."""
    import pyarrow.compute as pc

    dense = np.asarray(pc.rank(pa.concat_arrays(list(map(flat, columns))), sort_keys="ascending", tiebreaker="min")).astype(np.int64)
    return np.split(dense, np.cumsum([len(c) for c in columns])[:-1])


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    out = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def floored(asked: DataFrame, shared, k: int, n_pivots: int) -> DataFrame:
    """The queries with the k-th best score that each has in the sample, or null if it has fewer."""
    kind = dict(asked.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        sample = by_length(vectors)
        for batch in batches:
            floor = [None] * batch.num_rows
            qrank, srank = ranks(batch["id"], ids)
            for n, (at, q) in by_length(batch["v"]).items():
                if n in sample:
                    place, x = sample[n]
                    for i, _, scores in best_of_block(qrank[at], q, np.full(len(q), -np.inf), srank[place], x, x[:n_pivots], k):
                        if len(scores) == k:
                            floor[at[i]] = float(scores[-1])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(floor, pa.float64())], ["id", "v", "floor"])

    return asked.mapInArrow(run, f"id {kind}, v array<double>, floor double")


def searcher(shared, k: int, n_pivots: int):
    """A cell of the grid: the best rows of a candidate block for a block of queries."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        sample = by_length(shared.value[1])
        who, what, scores = [], [], []
        if asked.num_rows and rows.num_rows:
            qrank, xrank = ranks(asked["id"], rows["id"])
            floors = np.asarray(flat(asked["floor"]).fill_null(-np.inf))
            blocks = by_length(flat(rows["v"]))
            for n, (qat, q) in by_length(flat(asked["v"])).items():
                if n not in blocks:
                    continue
                xat, x = blocks[n]
                pivots = sample[n][1][:n_pivots] if n in sample else x[:1]
                for i, at, found in best_of_block(qrank[qat], q, floors[qat], xrank[xat], x, pivots, k):
                    who.append(np.full(len(at), qat[i]))
                    what.append(xat[at])
                    scores.append(found)
        none = [np.zeros(0, np.int64)]
        take = lambda table, at: flat(table["id"]).take(pa.array(np.concatenate(none + at)))
        return pa.table({"query_id": take(asked, who), "vec_id": take(rows, what), "score": pa.array(np.concatenate(none + scores))})

    return run


def top_k(
    vectors: DataFrame, query_filter: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
    block: int = 16_384, n_pivots: int = 32, sample: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products.

    ``query_filter`` selects the query rows. Candidates are all rows with another id than the query's;
    ties go to the smaller id. Ids may be of any type that has an order. Vectors of another length than the query's
    are no candidates. Rows that repeat an id count once, with the best of their vectors; queries that repeat an id
    likewise. Components and scores beyond a long count as its largest or smallest value. Unusable vectors (see
    ``quantised``) take no part; a query without candidates has no rows. Empty input gives an empty result. Other
    columns are ignored. ``n_pivots`` and ``sample`` bound what the search is fitted on, ``block`` a side of a cell.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    rows = quantised(vectors, id_col, vec_col, scale)
    asked = quantised(vectors.where(query_filter), id_col, vec_col, scale).dropDuplicates()
    spread = F.xxhash64("id", "v")
    drawn = rows.orderBy(spread, "id").limit(sample).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((flat(drawn["id"]), flat(drawn["v"])))
    across, down = (max(1, -(-t.count() // block)) for t in (rows, asked))
    cell = lambda t, own, n, other, m: t.withColumns({own: F.pmod(spread, F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    queries = cell(floored(asked, shared, k, n_pivots), "down", down, "across", across)
    candidates = cell(rows, "across", across, "down", down)
    found = queries.groupBy("down", "across").cogroup(candidates.groupBy("down", "across")).applyInArrow(
        searcher(shared, k, n_pivots), f"query_id {kind}, vec_id {kind}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
