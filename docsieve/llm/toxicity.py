"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the beginnings of its words. They are hashed. Chosen are the terms that go with the label
by a significance test, and those that toxic texts have most often whether or not clean ones have them as often; a
factorization machine over them learns a weight for each term and a weight for each pair (by inner products of
factors), so that terms which are harmless alone can count together.

Scale: fitting takes a bounded sample of labelled rows (``max_rows``) whose chosen terms fit the driver easily;
scoring is map-only with a model of at most ``max_terms`` rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import Memory, alnum_words, forget, stored, tidy

BEGINNINGS = (4, 5, 6, 7, 8)


def hashed(word: bytes, bits: int) -> list[int]:
    """Numbers of the word and of its proper beginnings."""
    mask = (1 << bits) - 1
    return [zlib.crc32(b"w" + word) & mask, *(zlib.crc32(b"%d" % n + word[:n]) & mask for n in BEGINNINGS if len(word) > n)]


def terms(text: bytes | None, bits: int, cache: Memory, keep: dict[int, int] | None = None) -> Counter:
    """How often each hashed term occurs; with ``keep`` only those terms, by their place in the model."""
    out: Counter = Counter()
    cache.make_room()
    for word, n in Counter(alnum_words(text)).items():
        got = cache.get(word)
        if got is None:
            got = hashed(word, bits)
            got = got if keep is None else [keep[t] for t in got if t in keep]
            cache.keep(word, got)
        for t in got:
            out[t] += n
    return out


def value(count):
    return 1.0 + np.log(count)


class Machine:
    """score(x) = sigmoid(b + w.x + sum over pairs <v_i, v_j> x_i x_j), fitted by Adam on all rows at once."""

    def __init__(self, n: int, factors: int = 4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.05, (n, factors))

    def margin(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        xv = self.v[col] * x[:, None]
        sums = np.column_stack([np.bincount(row, xv[:, f], n) for f in range(xv.shape[1])])
        squares = np.bincount(row, (xv * xv).sum(1), n)
        return self.b + np.bincount(row, self.w[col] * x, n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> Machine:
        n, m = len(y), len(self.w)
        self.b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), self.w, self.v)]
        for step in range(1, rounds + 1):
            z, sums = self.margin(row, col, x, n)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
            e = error[row] * x
            inner = sums[row] - self.v[col] * x[:, None]
            grads = [np.array([error.sum()]), np.bincount(col, e, m) + ridge * self.w,
                     np.column_stack([np.bincount(col, e * inner[:, f], m) for f in range(inner.shape[1])]) + ridge * self.v]
            for k, g in enumerate(grads):
                one, two = moment[k]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                change = rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-9)
                if k == 0:
                    self.b -= float(change[0])
                elif k == 1:
                    self.w -= change
                else:
                    self.v -= change
        return self


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as a text's terms take many times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = 20_000, max_terms: int = 4096, bits: int = 20, least: int = 4, least_z: float = 5.0,
        neutral: int = 32, common: float = 0.6) -> tuple[dict[int, int], Machine]:
    """Chosen terms and the machine, from at most ``max_rows`` labelled documents (those of smallest id hash).

    Labels other than 0 and 1, null ids and ids without a document are left out. Several labels or documents of
    an id are all used. With no usable label the model is the constant 0.5. ``least_z`` is the test's limit;
    ``neutral`` further terms are those of most toxic texts among the ones that at most the share ``common`` of all have.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    drawn = usable.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sample = texts.join(F.broadcast(drawn), "id").select("y", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Memory()
        for batch in parts(batches):
            found = [terms(t, bits, cache) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["y"], pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                ["y", "term", "n"])

    rows = stored(sample.mapInArrow(tidy(gather), "y double, term array<int>, n array<int>"))
    base = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    rate = (base["p"] or 0.0) / max(base["n"], 1)
    if not 0 < rate < 1:
        machine = Machine(0)
        machine.b = 0.0 if not base["n"] else (4.0 if rate else -4.0)
        return {}, machine
    z = (F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    counted = stored(
        rows.select("y", F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
        .where(F.col("n") >= least).withColumn("z", F.abs(z))
    )
    telling = counted.where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(max_terms)
    others = counted.where((F.col("z") < least_z) & (F.col("p") >= least) & (F.col("n") <= common * base["n"])).orderBy(F.desc("p"), "term").limit(neutral)
    keep = {r["term"]: i for i, r in enumerate([*telling.select("term").collect(), *others.select("term").collect()])}
    forget(counted)
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[(shared.value[t], c) for t, c in zip(a, b, strict=True) if t in shared.value] for a, b in zip(batch["term"].to_pylist(), batch["n"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["y"], pa.array([[t for t, _ in p] for p in pairs], pa.list_(pa.int32())), pa.array([[c for _, c in p] for p in pairs], pa.list_(pa.int32()))],
                ["y", "term", "n"])

    table = rows.mapInArrow(tidy(slim), "y double, term array<int>, n array<int>").toArrow().combine_chunks()
    term, count, y = (table[c].combine_chunks() if hasattr(table[c], "combine_chunks") else table[c] for c in ("term", "n", "y"))
    row = np.repeat(np.arange(len(y)), np.diff(np.asarray(term.offsets)))
    col, x = np.asarray(term.flatten()), value(np.asarray(count.flatten()).astype(float))
    return keep, Machine(len(keep)).fit(row, col, x, np.asarray(y))


def toxicity(docs: DataFrame, model: tuple[dict[int, int], Machine], *, id_col: str = "doc_id", text_col: str = "text", bits: int = 20, limit: float = 0.7) -> DataFrame:
    """``id, score, predicted`` for every row: the score lies in 0 to 1, ``predicted`` is 1 from ``limit`` on.

    Null and empty texts have no terms and get the score of that. Repeated rows each have a row; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, machine = shared.value
        cache = Memory()
        for batch in parts(batches):
            scores = score_texts(batch["text"].to_pylist(), keep, machine, bits, cache)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores), pa.array((scores >= limit).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def score_texts(texts: list[bytes | None], keep: dict[int, int], machine: Machine, bits: int, cache: Memory) -> np.ndarray:
    found = [terms(t, bits, cache, keep) for t in texts]
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.array([t for f in found for t in f], np.int64)
    x = value(np.array([c for f in found for c in f.values()], float))
    z, _ = machine.margin(row, col, x, len(found))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def keep_clean(docs: DataFrame, model, *, text_col: str = "text", bits: int = 20, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below the limit, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, machine = shared.value
        cache = Memory()
        for batch in parts(batches):
            scores = score_texts(batch.column(place).cast(pa.binary()).to_pylist(), keep, machine, bits, cache)
            yield batch.filter(pa.array(scores < limit))

    return docs.mapInArrow(tidy(run), docs.schema)
