"""Katz backoff language model of any order.

The counts of every order's n-grams are discounted by Good-Turing up to a count of ``k``. What a context loses
goes to the words not seen after it, in proportion to their probability after the next shorter context, with a
weight that makes the whole sum to one; so a token's probability is found by recursion over ever shorter contexts.
The recursion ends at add-one smoothed unigrams with one place for all unknown words, which sum to one as well.
Words are told apart by 64-bit hashes (a clash among 10^8 different words has a chance below 0.1 %).

Tables and their partitioning: texts are read once, as chunks of numbers. Words are numbered by falling count, so a
table of the different counts (at most the square root of twice the tokens) gives every word's count. N-grams are
dealt by the word before the last one, so that a bucket holds all contexts that end with a word, of every order, and
needs no other bucket to evaluate them. A word with more tokens than a bucket takes is spread by the last word over as
many buckets as it needs, and the sums of its contexts are added up over these. A chunk sends each n-gram once, packed.

Scale: buckets and chunks are bounded (``bucket_tokens``, ``chunk_bytes``). The driver gets the numbers of n-grams
with a count of 1 to k + 1, and the table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import blank_word_runs, forget, stored

#: No word has a blank, so this is no word.
END = b" end"
SUMS = ("total", "kept", "low")


@dataclass
class Vocabulary:
    words: DataFrame | None  # word, id: 64-bit hash and number, by falling count
    counts: np.ndarray  # the different counts, falling
    firsts: np.ndarray  # the number of the first word with each of them
    tokens: int
    types: int

    def bare(self) -> Vocabulary:
        """What tasks need of it."""
        return Vocabulary(None, self.counts, self.firsts, self.tokens, self.types)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by number; ``types`` stands for every unknown word."""
        if not len(self.counts):
            return np.zeros(len(ids), np.int64)
        return np.where(ids < self.types, self.counts[np.searchsorted(self.firsts, ids, "right") - 1], 0)


@dataclass
class Corpus:
    chunks: DataFrame  # chunk, lengths, learn, tokens (packed), ids
    words: Vocabulary
    rows: int
    tokens: int


@dataclass
class Deal:
    """Which bucket has an n-gram, by its last two words."""

    words: Vocabulary
    buckets: int
    most: int  # tokens of a word in one bucket
    begins: int

    def shares(self, last: np.ndarray) -> np.ndarray:
        """Over how many buckets a word is spread; unknown ones over all."""
        types = self.words.types
        n = np.where(last == types + 1, self.begins, self.words.count(last))
        return np.where(last == types, self.buckets, np.maximum(1, -(-n // self.most)))

    def bucket(self, names: np.ndarray, last: np.ndarray, word: np.ndarray) -> np.ndarray:
        """``last`` and ``word`` are places in ``names``, so that what depends on one word is worked out once for it."""
        hashes, shares = mixed(names), self.shares(names).astype(np.uint64)
        return (mixed(hashes[last] + hashes[word] % shares[last]) % np.uint64(self.buckets)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


@dataclass
class Model:
    corpus: Corpus
    order: int
    grams: DataFrame  # j, columns of n-grams and their counts (packed)
    sums: DataFrame  # contexts that end with a word of several buckets, and their sums
    factors: list[np.ndarray]  # of each order from 2, by count; past the end 1
    deal: Deal


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes as the largest needs, byte by byte, compressed."""
    import zstandard

    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encoded(docs: DataFrame, id_col: str, text_col: str, learn: Column, chunk_bytes: int) -> DataFrame:
    """Chunks of rows: tokens as places in the chunk's sorted list of word hashes."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        numbers, tokens, lengths, flags, ids, size = Numbers(), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in numbers], np.uint64)
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            t, n, learned = place[np.concatenate(tokens)], np.array(lengths), np.array(flags, bool)
            counts = np.bincount(t[np.repeat(learned, n)], minlength=len(order))
            columns = [packed(np.diff(hashes[order], prepend=np.uint64(0))), packed(counts), packed(t), packed(n), packed(learned)]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *[pa.array([c], pa.binary()) for c in columns], pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type))],
                                              ["chunk", "words", "counts", "tokens", "lengths", "learn", "ids"])

        for batch in batches:
            for i, (text, learned) in enumerate(zip(batch["text"], batch["learn"].to_pylist(), strict=True)):
                text = text.as_py()
                n = 0
                for words in (*blank_word_runs(text), [END]):
                    tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                lengths.append(n)
                flags.append(learned)
                ids.append(batch["id"].slice(i, 1))
                size += len(text or b"") + 8
                if size >= chunk_bytes:
                    yield flush()
                    chunk += 1
                    numbers, tokens, lengths, flags, ids, size = Numbers(), [], [], [], [], 0
        if lengths:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(run, f"chunk long, words binary, counts binary, tokens binary, lengths binary, learn binary, ids array<{kind}>")


def word_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64).view(np.int64)


def vocabulary(chunks: DataFrame) -> Vocabulary:
    """Words of the rows to learn from, numbered by falling count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch["words"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                n = unpacked(counts)
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words)[n > 0]), pa.array(n[n > 0])], ["word", "n"])

    found = chunks.select("words", "counts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))
    part, place = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    ranked = stored(found.orderBy(F.desc("c"), "word").select("word", "c", part, place))
    sizes = {r["part"]: r["count"] for r in ranked.groupBy("part").count().collect()}  # one row per partition
    before = np.concatenate([[0], np.cumsum([sizes[p] for p in sorted(sizes)])]).astype(int)
    start = F.create_map(*[x for p, n in zip(sorted(sizes), before[:-1].tolist(), strict=True) for x in (F.lit(p), F.lit(n))])[F.col("part")] if sizes else F.lit(0)
    table = ranked.groupBy("c").count().orderBy(F.desc("c")).toArrow()
    counts, n = table["c"].to_numpy().astype(np.int64), table["count"].to_numpy().astype(np.int64)
    words = ranked.select("word", (start + F.col("place")).cast("long").alias("id"))
    return Vocabulary(words, counts, np.cumsum(n) - n, int((counts * n).sum()), int(n.sum()))


def numbered(chunks: DataFrame, words: Vocabulary) -> DataFrame:
    """The chunks with tokens as the vocabulary's numbers."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch["chunk"].to_pylist(), batch["words"].to_pylist(), strict=True):
                hashes = word_hashes(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), chunk)), pa.array(np.arange(len(hashes), dtype=np.int32)), pa.array(hashes)], ["chunk", "at", "word"])

    asked = chunks.select("chunk", "words").mapInArrow(spread, "chunk long, at int, word long")
    answer = asked.join(words.words, "word", "left").select("chunk", "at", F.coalesce("id", F.lit(words.types).cast("long")).alias("number"))
    lists = answer.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "number")))["number"].alias("numbers"))  # a chunk's words, bounded
    kind = dict(chunks.dtypes)["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [packed(n.values.to_numpy()[unpacked(t)]) for n, t in zip(batch["numbers"], batch["tokens"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["lengths"], batch["learn"], pa.array(tokens, pa.binary()), batch["ids"]], ["chunk", "lengths", "learn", "tokens", "ids"])

    both = chunks.select("chunk", "tokens", "lengths", "learn", "ids").join(lists, "chunk")
    return stored(both.mapInArrow(run, f"chunk long, lengths binary, learn binary, tokens binary, ids {kind}"))


def corpus(docs: DataFrame, *, learn: Column | None = None, words: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20) -> Corpus:
    """All rows of ``docs`` as numbers, by the given vocabulary or by that of the rows for which ``learn`` holds (all, if none is given)."""
    first = stored(encoded(docs, id_col, text_col, F.lit(True) if learn is None else learn, chunk_bytes))
    words = words or vocabulary(first)
    chunks = numbered(first, words)
    forget(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [unpacked(x) for x in batch["lengths"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())], ["n", "t"])

    size = chunks.select("lengths").mapInArrow(run, "n long, t long").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    return Corpus(chunks, words, size["n"] or 0, size["t"] or 0)


def contexts(tokens: np.ndarray, lengths: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The words before each token, the nearest first; ``begin`` before a text's first."""
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return [np.where(at >= k, np.roll(tokens, k), begin) for k in range(1, order)]


def named(tokens: np.ndarray, lengths: np.ndarray, order: int, begin: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different words in order, ``begin`` last, and the n-grams' columns as places among them."""
    names, local = np.unique(tokens, return_inverse=True)
    return np.append(names, begin), [*contexts(local, lengths, order, len(names)), local]


def joined(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of numbers from 0 on, as few as 63 bits each allow, that sort as the given ones do."""
    out, bits = [], 64
    for c in columns:
        width = int(c.max(initial=0)).bit_length()
        if bits + width > 63:
            out.append(c.astype(np.int64))
            bits = width
        else:
            out[-1] = out[-1] << width | c
            bits += width
    return out


def changes(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Whether a row, in the order, differs from the one before; the first does."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    return new


def ordered(columns: list[np.ndarray]) -> np.ndarray:
    """The order by columns that come from ``joined``."""
    return np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])


def codes(*columns: np.ndarray) -> np.ndarray:
    """Equal rows of the columns get equal numbers from 0 on."""
    return nested([*columns, np.zeros(len(columns[0]), np.int64)])[1]


def nested(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on, in the columns' order: equal for rows that agree but for the last column, and for equal rows."""
    keys = joined(columns)
    order = ordered(keys)
    out = []
    for same in (joined(columns[:-1]), keys):
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.cumsum(changes(same, order)) - 1
        out.append(numbers)
    return out[0], out[1]


def sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by the columns, the first one first, and where runs of equal rows begin in it."""
    keys = joined(columns)
    order = ordered(keys)
    return order, np.flatnonzero(changes(keys, order))


def dealt(chunks: DataFrame, order: int, shared, asking: bool) -> DataFrame:
    """``j, chunk, grams, n, row``: a chunk's different n-grams by bucket with their counts; ``asking``: per row of the chunk, of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens, lengths, learn = unpacked(r["tokens"]), unpacked(r["lengths"]), unpacked(r["learn"]) > 0
                deal = shared.value
                names, columns = named(tokens, lengths, order, deal.words.types + 1)
                row = np.repeat(np.arange(len(lengths)), lengths)
                if not asking:
                    columns = [c[learn[row]] for c in columns]
                    row = np.zeros(0, np.int64)
                keys = [deal.bucket(names, columns[0], columns[-1]), *columns, *[row] * asking]
                by, first = sorted_runs(keys)
                n = np.diff(np.append(first, len(by)))
                keys = [names[k[by[first]]] if 0 < x <= order else k[by[first]] for x, k in enumerate(keys)]
                edge = np.flatnonzero(np.diff(keys[0], prepend=-1, append=-1))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    grams = [packed(np.diff(keys[1][a:b], prepend=0)), *[packed(k[a:b]) for k in keys[2 : order + 1]]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(keys[0][a])]), pa.array([r["chunk"]]), pa.array([grams], pa.list_(pa.binary())), pa.array([packed(n[a:b])], pa.binary()), pa.array([packed(keys[-1][a:b]) if asking else b""], pa.binary())],
                        ["j", "chunk", "grams", "n", "row"])

    return chunks.select("chunk", "tokens", "lengths", "learn").mapInArrow(run, "j long, chunk long, grams array<binary>, n binary, row binary")


def gathered(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the n-grams of several packed rows, the nearest context word first and the word last, and their counts."""
    none = np.zeros(0, np.int64)
    rows = [[np.cumsum(unpacked(g[0])), *map(unpacked, g[1:])] for g in table["grams"].to_pylist()]
    return [np.concatenate([none, *[r[i] for r in rows]]) for i in range(order)], np.concatenate([none, *map(unpacked, table["n"].to_pylist())])


def counted(order: int, k: int):
    """A bucket's n-grams with their sums; ``found``: how many of each order from 2 have a count of 1 to k + 1."""

    def run(table: pa.Table) -> pa.Table:
        columns, n = gathered(table, order)
        by, first = sorted_runs(columns)
        columns, n = [c[by[first]] for c in columns], np.add.reduceat(n[by], first)
        found = []
        for m in range(2, order + 1):
            sums = np.bincount(codes(*columns[: m - 1], columns[-1]), n).astype(np.int64) if m < order else n
            found += np.bincount(np.minimum(sums, k + 2), minlength=k + 3)[1 : k + 2].tolist()
        grams = [packed(np.diff(columns[0], prepend=0)), *map(packed, columns[1:])]
        return pa.table({"j": pa.array([table["j"][0].as_py()]), "grams": pa.array([grams], pa.list_(pa.binary())), "n": pa.array([packed(n)], pa.binary()), "found": pa.array([found], pa.list_(pa.int64()))})

    return run


def discounts(numbers: dict[int, int], k: int) -> dict[int, float]:
    """Good-Turing factors of the counts 1 to k; where the numbers give none in (0, 1), ``(r - 0.5) / r``."""
    one, past = numbers.get(1, 0), numbers.get(k + 1, 0)
    common = (k + 1) * past / one if one else 1.0
    out = {}
    for r in range(1, k + 1):
        d = -1.0
        if numbers.get(r) and common < 1:
            d = ((r + 1) * numbers.get(r + 1, 0) / (r * numbers[r]) - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Level:
    """The n-grams of one order among rows of n-grams (counts of 0: rows that only ask)."""

    def __init__(self, columns: list[np.ndarray], n: np.ndarray, order: int, factor: np.ndarray):
        self.context, self.gram = nested([*columns[: order - 1], columns[-1]])
        self.count = np.bincount(self.gram, n).astype(np.int64)
        self.mass = self.count * np.where(self.count < len(factor), factor[np.minimum(self.count, len(factor) - 1)], 1.0)

    def sums(self, low: np.ndarray) -> np.ndarray:
        """Per context: the counts after it, what discounts leave of them, and the shorter context's share of the words seen."""
        first = np.full(len(self.count), -1)
        first[self.gram[::-1]] = np.arange(len(self.gram) - 1, -1, -1)
        seen = self.count > 0
        at = first[seen]
        size = int(self.context.max(initial=-1)) + 1
        return np.stack([np.bincount(self.context[at], x, size) for x in (self.count[seen], self.mass[seen], low[at])])


def levels(columns: list[np.ndarray], n: np.ndarray, factors: list[np.ndarray], words: Vocabulary) -> Iterator[tuple[Level, np.ndarray]]:
    """Each order from 2 on and its sums. ``low`` is a numerator: of the unigrams, or of the order below."""
    low = words.count(columns[-1]) + 1.0
    for m, factor in enumerate(factors, 2):
        level = Level(columns, n, m, factor)
        yield level, level.sums(low)
        low = level.mass[level.gram]


def context_names(order: int) -> list[str]:
    return [f"c{i}" for i in range(1, order)]


def context_rows(columns: list[np.ndarray], order: int, at: np.ndarray) -> list[pa.Array]:
    """The contexts of an order at these places; -1 for the words that a shorter one does not have."""
    return [pa.array(c[at] if x < order - 1 else np.full(len(at), -1)) for x, c in enumerate(columns[:-1])]


def partial_sums(grams: DataFrame, order: int, factors: list[np.ndarray], shared) -> DataFrame:
    """Contexts that end with a word of several buckets, and each bucket's part of their sums."""
    names = context_names(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns, n = gathered(pa.Table.from_batches([batch.slice(i, 1)]), order)
                mine = shared.value.shares(columns[0]) > 1
                columns, n = [c[mine] for c in columns], n[mine]
                for m, (level, sums) in enumerate(levels(columns, n, factors, shared.value.words) if len(n) else (), 2):
                    at = np.unique(level.context, return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([*context_rows(columns, m, at), *map(pa.array, sums)], [*names, *SUMS])

    return grams.select("grams", "n").mapInArrow(run, ", ".join([*[f"{c} long" for c in names], *[f"{s} double" for s in SUMS]]))


def asked_contexts(chunks: DataFrame, order: int, shared) -> DataFrame:
    """``j`` and contexts that end with a known word of several buckets, as the chunks ask for them there."""
    names = context_names(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = shared.value
        for batch in batches:
            for t, n in zip(batch["tokens"].to_pylist(), batch["lengths"].to_pylist(), strict=True):
                tokens = unpacked(t)
                ids, columns = named(tokens, unpacked(n), order, deal.words.types + 1)
                mine = ((deal.shares(ids) > 1) & (ids != deal.words.types))[columns[0]]
                columns = [c[mine] for c in columns]
                j = deal.bucket(ids, columns[0], columns[-1])
                columns = [ids[c] for c in columns]
                for m in range(2, order + 1) if len(j) else ():
                    at = np.unique(codes(j, *columns[: m - 1]), return_index=True)[1]
                    yield pa.RecordBatch.from_arrays([pa.array(j[at]), *context_rows(columns, m, at)], ["j", *names])

    return chunks.select("tokens", "lengths").mapInArrow(run, ", ".join(["j long", *[f"{c} long" for c in names]])).distinct()


def train(read: Corpus, *, order: int = 3, k: int = 5, bucket_tokens: int = 1_000_000) -> Model:
    """Counts the n-grams of the rows to learn from; null and empty texts count as the end token alone."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    deal = Deal(read.words.bare(), max(1, -(-read.tokens // bucket_tokens)), bucket_tokens, read.rows)
    shared = read.chunks.sparkSession.sparkContext.broadcast(deal)  # the table of counts
    sent = dealt(read.chunks, order, shared, False)
    grams = stored(sent.groupBy("j").applyInArrow(counted(order, k), "j long, grams array<binary>, n binary, found array<long>"))
    found: dict[int, int] = {r["at"]: r["n"] for r in grams.select(F.posexplode("found").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()}
    factors = []
    for m in range(order - 1):
        d = discounts({r: found.get(m * (k + 1) + r - 1, 0) for r in range(1, k + 2)}, k)
        factors.append(np.array([0.0, *[d[r] for r in range(1, k + 1)], 1.0]))
    sums = stored(partial_sums(grams, order, factors, shared).groupBy(*context_names(order)).agg(*[F.sum(s).alias(s) for s in SUMS]))
    return Model(read, order, grams.select("j", "grams", "n"), sums, factors, deal)


def packed_sums(order: int):
    def run(table: pa.Table) -> pa.Table:
        contexts_ = [packed(table[c].to_numpy() + 1) for c in context_names(order)]
        return pa.table({"j": pa.array([table["j"][0].as_py()]), "contexts": pa.array([contexts_], pa.list_(pa.binary())), "sums": pa.array([[table[s].to_numpy().tobytes() for s in SUMS]], pa.list_(pa.binary()))})

    return run


def evaluator(order: int, factors: list[np.ndarray], deal):
    """``chunk, row, part``: what a bucket's n-grams add to the log10 probability of a chunk's rows (packed)."""

    def run(asks: pa.Table, model: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        words = deal.value.words
        known = model.filter(pc.is_valid(model["n"]))
        columns, n = gathered(known, order)
        asked, times = gathered(asks, order)
        shared, sums = [np.zeros(0, np.int64)] * (order - 1), [np.zeros(0)] * len(SUMS)
        for r in model.filter(pc.is_valid(model["sums"])).to_pylist():
            shared, sums = [unpacked(c) - 1 for c in r["contexts"]], [np.frombuffer(s) for s in r["sums"]]
        size = len(times)
        # Rows that ask, then the model's, then contexts whose sums come from several buckets.
        every = [np.concatenate([a, c, np.maximum(s, 0)]) for a, c, s in zip(asked, columns, [*shared, np.zeros(len(sums[0]), np.int64)], strict=True)]
        counts = np.concatenate([np.zeros(size, np.int64), n, np.zeros(len(sums[0]), np.int64)])
        whole = float(words.tokens + words.types + 1)
        steps, shorter, base_below = [], None, None
        for m, (level, found) in enumerate(levels(every, counts, factors, words), 2):
            mine = (shared[m - 2] >= 0) & (shared[m - 1] < 0 if m < order else shared[0] >= 0)
            at = level.context[len(counts) - len(mine) :][mine]
            found[:, at] = np.stack(sums)[:, mine]
            total, kept, low = found
            # A context all of whose n-grams exceed k loses nothing by discounts; one more count then leaves room.
            base = np.where(kept >= total, total + 1, total)
            first = np.zeros(len(total), np.int64)
            first[level.context[::-1]] = np.arange(len(counts) - 1, -1, -1)
            below = whole if shorter is None else base_below[shorter.context[first]]
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(total > 0, np.log10((1 - kept / base) / (1 - low / below)), 0.0)
                seen = np.log10(level.mass[level.gram[:size]] / base[level.context[:size]])
            steps.append((level.count[level.gram[:size]] > 0, seen, weight[level.context[:size]]))
            shorter, base_below = level, base
        p, open_ = np.zeros(size), np.ones(size, bool)
        for is_seen, seen, weight in reversed(steps):
            p += np.where(open_, np.where(is_seen, seen, weight), 0.0)
            open_ &= ~is_seen
        p += np.where(open_, np.log10((words.count(asked[-1]) + 1) / whole), 0.0)
        rows, parts, at = [], [], 0
        for data in asks["row"].to_pylist():
            row = unpacked(data)
            sums_ = np.bincount(row, (p * times)[at : at + len(row)])
            at += len(row)
            own = np.unique(row)
            rows.append(packed(np.diff(own, prepend=0)))
            parts.append(sums_[own].tobytes())
        return pa.table({"chunk": asks["chunk"], "row": pa.array(rows, pa.binary()), "part": pa.array(parts, pa.binary())})

    return run


def added(table: pa.Table) -> pa.Table:
    """A chunk's parts added up by row."""
    rows = [np.cumsum(unpacked(r)) for r in table["row"].to_pylist()]
    sums = np.bincount(np.concatenate(rows), np.concatenate([np.frombuffer(x) for x in table["part"].to_pylist()]))
    return pa.table({"chunk": pa.array(np.full(len(sums), table["chunk"][0].as_py())), "row": pa.array(np.arange(len(sums))), "score": pa.array(sums)})


def described(chunks: DataFrame, deal, kind: str) -> DataFrame:
    """``chunk, row, id, n_tokens, n_known, base_score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = deal.value.words
        whole = float(words.tokens + words.types + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, lengths = unpacked(batch["tokens"][i].as_py()), unpacked(batch["lengths"][i].as_py())
                c, row = words.count(tokens), np.repeat(np.arange(len(lengths)), lengths)
                base, known = np.bincount(row, np.log10((c + 1) / whole)), np.bincount(row, c > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lengths), batch["chunk"][i].as_py())), pa.array(np.arange(len(lengths))), batch["ids"][i].values, pa.array(lengths), pa.array(known), pa.array(base)],
                    ["chunk", "row", "id", "n_tokens", "n_known", "base_score"])

    return chunks.mapInArrow(run, f"chunk long, row long, id {kind}, n_tokens long, n_known long, base_score double")


def score(model: Model, docs: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` for every row of ``docs``, or of the corpus that the model has read.

    A null or empty text is its end token. ``base_score`` is the add-one unigram log10 probability, ``score`` the
    model's; after a context never seen, the next shorter one decides. Repeated rows each have a row. Other columns
    are ignored; a model of no rows gives every token the unigram probability of an unknown word.
    """
    read = model.corpus if docs is None else corpus(docs, words=model.corpus.words, id_col=id_col, text_col=text_col)
    shared = read.chunks.sparkSession.sparkContext.broadcast(model.deal)
    asks = dealt(read.chunks, model.order, shared, True)
    sums = asked_contexts(read.chunks, model.order, shared).join(model.sums, context_names(model.order)).groupBy("j").applyInArrow(packed_sums(model.order), "j long, contexts array<binary>, sums array<binary>")
    known = model.grams.unionByName(sums, allowMissingColumns=True)
    parts = asks.groupBy("j").cogroup(known.groupBy("j")).applyInArrow(evaluator(model.order, model.factors, shared), "chunk long, row binary, part binary")
    found = parts.groupBy("chunk").applyInArrow(added, "chunk long, row long, score double")
    kind = dict(read.chunks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return described(read.chunks, shared, kind).join(found, ["chunk", "row"]).select(F.col("id").alias(id_col), "n_tokens", "n_known", "base_score", "score")
