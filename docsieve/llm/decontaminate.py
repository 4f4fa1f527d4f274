"""Benchmark decontamination with an FM-index per shard of training text.

A task keeps, of its shard, the runs of words that the benchmark knows and that are as long as the shortest
window (no other place can match), indexes them (suffix array, Burrows-Wheeler transform, wavelet matrix,
sampled suffix positions), searches all windows backwards at once and locates their occurrences. Overlapping
occurrences merge into removal spans.

Scale: documents are never shuffled; a shard's index is bounded by ``shard_words``. The benchmark goes out in
blocks of at most ``block_bytes`` of text, each with a pass of its own, one block at a time; results of several blocks
are merged by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docsieve.llm.text import ALNUM_TABLE, alnum_words, stored, tidy

WINDOW = 10
WORD = re.compile(rb"[^ ]+")
RESULT = "n_words long, n_hit long, items array<{item}>, spans array<struct<first_word:long,last_word:long,byte_start:long,byte_end:long>>"
SPAN = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "byte_start", "byte_end")])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Sorts all suffixes by doubling the compared length; t ends with its only smallest symbol."""
    order = np.argsort(t, kind="stable")
    rank = np.zeros(len(t), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], t[order][1:] != t[order][:-1]]))
    step = 1
    while rank[order[-1]] < len(t) - 1:
        ahead = np.zeros(len(t), np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (len(t) + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(t), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        step *= 2
    return order


class FMIndex:
    """Symbols are 1 and up; 0 ends the text. Queries take and give arrays."""

    def __init__(self, symbols: np.ndarray, every: int = 16):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.bits = max(1, int(text.max()).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for bit in range(self.bits - 1, -1, -1):
            b = level >> bit & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]))
            self.zeros.append(self.n - int(b.sum()))
            level = np.concatenate([level[b == 0], level[b == 1]])
        sampled = order % every == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.places = order[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before row ``at`` of the transform."""
        start, end = np.zeros_like(at), at
        for ones, zeros, bit in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = symbol >> bit & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at + 1] > ones[at]
            out = out << 1 | one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each phrase (one per row, all of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        top = len(self.before) - 1
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            known = (c < top) & (low < high)
            c = np.where(known, c, 0)
            base = self.before[c]
            low, high = np.where(known, base + self.rank(c, low), 0), np.where(known, base + self.rank(c, high), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back through the text until a sampled position."""
        out, steps, todo = np.zeros_like(rows), 0, np.arange(len(rows))
        while len(todo):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            out[todo[hit]] = self.places[self.sampled[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self.symbol(rows)
            rows, steps = self.before[c] + self.rank(c, rows), steps + 1
        return out


class Windows:
    """A block of the benchmark: words by number (from 2; 1 separates runs), windows by length."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in alnum_words(text)]
            m = min(window, len(ids))
            for at in range(len(ids) - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(tuple(ids[at : at + m]), set()).add(item)
        self.by_length = {m: (np.array(list(w), np.int64), [sorted(s) for s in w.values()]) for m, w in found.items()}
        self.shortest = min(self.by_length, default=0)

    def find(self, texts: list[bytes | None], shard_words: int) -> list[tuple]:
        """n_words, n_hit, items and spans of each text."""
        counts, runs, kept, done = [], [], 0, {}
        for i, text in enumerate(texts):
            words = alnum_words(text)
            counts.append(len(words))
            if not self.shortest:
                continue
            ids = np.fromiter(map(self.words.get, words, _ones), np.int64, len(words))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 1).view(np.int8), [0]])))
            for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if end - start >= self.shortest:
                    runs.append((i, start, ids[start:end]))
                    kept += end - start + 1
            if kept >= shard_words:
                self._shard(runs, done)
                runs, kept = [], 0
        self._shard(runs, done)
        out = []
        for i, n in enumerate(counts):
            hit, items = done.get(i, (set(), set()))
            out.append((n, len(hit), sorted(items), spans(texts[i], hit) if hit else []))
        return out

    def _shard(self, runs: list[tuple[int, int, np.ndarray]], done: dict[int, tuple[set[int], set[int]]]) -> None:
        if not runs:
            return
        text = np.concatenate([np.append(ids, 1) for _, _, ids in runs])
        begin = np.cumsum([0, *(len(ids) + 1 for _, _, ids in runs[:-1])])
        symbols, dense = np.unique(text, return_inverse=True)
        index = FMIndex(dense + 1)
        for m, (phrases, items) in self.by_length.items():
            at = np.searchsorted(symbols, phrases)
            at = np.where(symbols[np.minimum(at, len(symbols) - 1)] == phrases, at + 1, len(symbols) + 1)
            low, high = index.search(at)
            n = np.maximum(high - low, 0)
            if not n.sum():
                continue
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            places = index.locate(rows)
            run = np.searchsorted(begin, places, "right") - 1
            for w, r, p in zip(which.tolist(), run.tolist(), places.tolist(), strict=True):
                doc, start, _ = runs[r]
                hit, found = done.setdefault(doc, (set(), set()))
                first = start + p - int(begin[r])
                hit.update(range(first, first + m))
                found.update(items[w])


class _Ones:
    def __iter__(self):
        return self

    def __next__(self) -> int:
        return 1


_ones = _Ones()


def spans(text: bytes, hit: set[int]) -> list[dict]:
    """Hit words in runs, with the bytes from the first word's start to the last word's end."""
    places = [m.span() for m in WORD.finditer(text.translate(ALNUM_TABLE))]
    out: list[dict] = []
    for word in sorted(hit):
        if out and out[-1]["last_word"] == word - 1:
            out[-1] |= {"last_word": word, "byte_end": places[word][1]}
        else:
            out.append({"first_word": word, "last_word": word, "byte_start": places[word][0], "byte_end": places[word][1]})
    return out


def without(text: bytes, cuts: list[dict]) -> bytes:
    at, parts = 0, []
    for c in cuts:
        parts.append(text[at : c["byte_start"]])
        at = c["byte_end"]
    return b"".join([*parts, text[at:]])


def usable(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))


def block_count(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> int:
    total = usable(benchmark, item_col, text_col).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-total // block_bytes))


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, parts: int) -> Iterator[Windows]:
    """The benchmark in blocks of about equal text, each read by the driver in turn."""
    rows = usable(benchmark, item_col, text_col)
    for part in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield Windows([(r["item"], bytes(r["text"])) for r in mine.toLocalIterator()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20, shard_words: int = 500_000) -> DataFrame:
    """Per row of ``docs``: ``id, n_words, n_hit, items, spans`` (merged runs of words inside some window's occurrence).

    A window is ``window`` consecutive words of an item; an item with fewer words, but some, is one window. Null
    and empty texts have no words and no hits; null or wordless items have no windows; an empty benchmark hits
    nothing. Items with equal text are all reported; their ids may be of any type that has an order. Repeated rows
    each have a result; other columns are ignored.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    item = benchmark.schema[item_col].dataType
    result = RESULT.format(item=item.simpleString())
    names = [x.split(" ")[0] for x in result.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(to_arrow_type(item)), pa.list_(SPAN)]

    def finder(shared, with_key: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(zip(*shared.value.find(batch["text"].to_pylist(), shard_words), strict=True)) or [[]] * 4
                key = [batch["key"]] if with_key else []
                yield pa.RecordBatch.from_arrays([batch["id"], *key, *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], ["id", *["key"] * with_key, *names])

        return run

    parts = block_count(benchmark, item_col, item_text_col, block_bytes)
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, parts)
    if parts == 1:
        return rows.mapInArrow(tidy(finder(spark.sparkContext.broadcast(next(blocks)), False)), f"id {kind}, {result}")
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    both = None
    for i, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        each = stored(keyed.mapInArrow(tidy(finder(shared, True)), f"id {kind}, key string, {result}").withColumn("block", F.lit(i)))
        shared.destroy()
        both = each if both is None else both.unionByName(each)
    merged = both.groupBy("id", "key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.count_if(F.col("block") == 0).alias("copies"))
    joined = F.aggregate("spans", F.expr("cast(array() as array<struct<first_word:bigint,last_word:bigint,byte_start:bigint,byte_end:bigint>>)"), merge_span)
    return (
        merged.withColumn("spans", joined).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last_word"] - s["first_word"] + 1))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("id", *names)
    )


def merge_span(done, s):
    """Appends a span to sorted spans, or joins it to the last where they touch."""
    last = F.try_element_at(done, F.lit(-1))
    longer = F.when(last["last_word"] >= s["last_word"], last).otherwise(
        F.struct(last["first_word"].alias("first_word"), s["last_word"].alias("last_word"), last["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end")))
    touches = F.coalesce(last["last_word"] >= s["first_word"] - 1, F.lit(False))
    return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 window: int = WINDOW, block_bytes: int = 4 << 20, shard_words: int = 500_000) -> DataFrame:
    """``docs`` with the removal spans cut out of the text; every row and all other columns stay.

    The hit words of each block of the benchmark are carried along in a last column of their own until all
    blocks are searched in the original text.
    """
    spark = docs.sparkSession
    place, schema = docs.columns.index(text_col), docs.schema
    rows = docs.withColumn("hit words", F.expr("cast(array() as array<long>)"))
    parts = block_count(benchmark, item_col, item_text_col, block_bytes)
    for i, block in enumerate(benchmark_blocks(benchmark, item_col, item_text_col, window, parts)):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.find(batch.column(place).cast(pa.binary()).to_pylist(), shard_words)
                hits = [sorted({*old, *(w for c in f[3] for w in range(c["first_word"], c["last_word"] + 1))})
                        for old, f in zip(batch.columns[-1].to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, pa.list_(pa.int64()))], names=batch.schema.names)

        rows = rows.mapInArrow(tidy(search), rows.schema)
        if i < parts - 1:
            rows = stored(rows)
            shared.destroy()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            clean = [without(t, spans(t, set(h))) if h else t for t, h in zip(texts, batch.columns[-1].to_pylist(), strict=True)]
            columns = [c if i != place else pa.array(clean, pa.binary()).cast(pa.string()) for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return rows.mapInArrow(tidy(remove), schema)
