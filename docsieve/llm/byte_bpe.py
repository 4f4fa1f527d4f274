"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are cut into pieces without regular expressions. Every code point gets a class (letter, number, blank,
apostrophe and so on) by one look-up in an array; every class is a function from states to states of a small
automaton that knows where pieces begin. Functions are composed with an associative scan: the few hundred functions
that compositions can give are numbered once, so a composition is one look-up in a table of products, blocks of a
text are scanned side by side, and the states at the ends of the blocks come from a scan over the blocks. A code point
and the state before it tell whether a piece begins there, or one place earlier.

The slices between the boundaries are merged pair by pair, lowest rank first, with a memory of slices. The byte offset
of every token is kept, and decoding places each token's bytes at its offset.

Scale: no shuffle; rows are encoded where they are read. A task works on about ``WINDOW`` bytes at a time, also of
longer texts, besides the text itself and its ids.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 1 << 20
BLOCK = 64
#: Bytes that the memory of pieces takes, about, before it starts anew.
MEMORY = 96 << 20

# Classes of code points. The letters of the short forms 's 't 'm 'd, 're 've and 'll have their own.
STMD, RV, E, DOUBLE, LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, BREAK = range(11)
LETTERS = (STMD, RV, E, DOUBLE, LETTER)
# States: what the last code points were. A quote that begins a piece may open a short form.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, QUOTED_RV, QUOTED_L, SHORT_FORM, ONE_BLANK, BLANKS, ONE_SPACE, SPACES = range(12)
HERE, BEFORE = 1, 2

# Letters and numbers that the tokenizer library's Unicode version has and Python's has not.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Separators that Python counts as white space and Unicode does not.
NO_SPACE = range(0x1C, 0x20)


def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
        elif kind in "ZC" and chr(c).isspace() and c not in NO_SPACE:
            table[c] = SPACE
    for ranges, kind in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = kind
    for chars, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", DOUBLE), ("'", QUOTE), (" ", BLANK)):
        table[[ord(c) for c in chars]] = kind
    return table


def step(state: int, kind: int) -> tuple[int, int]:
    """The state after a code point, and whether a piece begins at it (``HERE``) or at the one before it (``BEFORE``)."""
    undecided = state in (QUOTED_RV, QUOTED_L)
    if kind == BREAK:
        return START, HERE | (BEFORE if undecided else 0)
    if kind in (BLANK, SPACE):
        if state in (ONE_BLANK, BLANKS, ONE_SPACE, SPACES):
            return (BLANKS if kind == BLANK else SPACES), 0
        return (ONE_BLANK if kind == BLANK else ONE_SPACE), HERE | (BEFORE if undecided else 0)
    if state == QUOTED and kind in (STMD, RV, DOUBLE):
        return {STMD: SHORT_FORM, RV: QUOTED_RV, DOUBLE: QUOTED_L}[kind], 0
    if (state, kind) in ((QUOTED_RV, E), (QUOTED_L, DOUBLE)):
        return SHORT_FORM, 0
    into = IN_LETTERS if kind in LETTERS else IN_NUMBERS if kind == NUMBER else IN_OTHERS
    if undecided:  # a quote and the first letter of a word after all
        return (into, BEFORE) if into == IN_LETTERS else (QUOTED if kind == QUOTE else into, HERE | BEFORE)
    if state in (ONE_BLANK, BLANKS):  # one blank belongs to what follows it
        return into, BEFORE if state == BLANKS else 0
    if state == into or (state == QUOTED and into == IN_OTHERS):
        return into, 0
    return (QUOTED if kind == QUOTE else into), HERE | (BEFORE if state == SPACES else 0)


class Cutter:
    """Finds where pieces begin, with an associative scan over the transition functions of the code points."""

    def __init__(self):
        self.classes = class_table()
        own = tuple(range(12))
        generators = [tuple(step(s, k)[0] for s in own) for k in range(11)]
        number = {own: 0}
        functions = [own]
        for f in functions:  # grows while it is read, until no product is new
            for g in generators:
                product = tuple(g[s] for s in f)
                if product not in number:
                    number[product] = len(functions)
                    functions.append(product)
        self.n = len(functions)
        self.functions = np.array(functions, np.uint8)
        self.of_class = np.array([number[g] for g in generators], np.int32)
        self.products = np.array([number[tuple(g[s] for s in f)] for f in functions for g in functions], np.int32)
        self.emits = np.array([step(s, k)[1] for s in own for k in range(11)], np.uint8)

    def states(self, numbers: np.ndarray) -> np.ndarray:
        """The state after each function of a row of them, from the start state."""
        rows = -(-len(numbers) // BLOCK)
        acc = np.zeros(rows * BLOCK, np.int32)
        acc[: len(numbers)] = numbers
        acc = np.ascontiguousarray(acc.reshape(rows, BLOCK).T)
        for j in range(1, BLOCK):
            acc[j] = self.products.take(acc[j - 1] * self.n + acc[j])
        entry = np.zeros(rows, np.uint8)
        if rows > 1:
            entry[1:] = self.states(acc[-1, :-1])
        return self.functions[acc, entry].T.ravel()[: len(numbers)]

    def begins(self, kinds: np.ndarray) -> np.ndarray:
        """Places where pieces begin, in order; a break begins a piece of its own."""
        before = np.zeros(len(kinds), np.intp)
        before[1:] = self.states(self.of_class[kinds])[:-1]
        emitted = self.emits.take(before * 11 + kinds)
        marks = (emitted & HERE).astype(bool)
        marks[:-1] |= (emitted[1:] & BEFORE).astype(bool)
        return np.flatnonzero(marks)

    def cut(self, data: bytes, ends: np.ndarray, closed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the pieces of texts that lie one after the other, and the number of each one's text.

        Unless ``closed``, the last text goes on after the data, and its last, undecided pieces are left out.
        """
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        last = np.searchsorted(at, ends)
        kinds = np.insert(self.classes[codes], last, BREAK)
        place = np.insert(at, last, ends)
        own = np.insert(np.zeros(len(at), bool), last, True)
        if not closed:
            kinds, place, own = kinds[:-1], place[:-1], own[:-1]
        begins = self.begins(kinds)
        left, right = begins[:-1], begins[1:]
        real = ~own[left]
        return place[left[real]], place[right[real]], (np.cumsum(own) - own)[left[real]]


class Merges:
    """The rank file in a task: pieces to ids by merging pairs, and ids to bytes."""

    def __init__(self, file: bytes):
        pairs = [line.split() for line in file.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([*map(len, tokens), 0], np.int64)  # the last is for ids that the file lacks
        self.firsts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.memory: dict[bytes, bytes] = {}
        self.size = 0

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece: of all neighbours that are a token together, those of the lowest rank are put together, the first ones first."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.merged_long(piece) if len(piece) > 64 else self.merged_short(piece)

    def merged_short(self, piece: bytes) -> list[int]:
        """With the rank of every pair in a list, which is searched for its least."""
        rank, never = self.ranks.get, len(self.lengths)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], never) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < never:
            i = pairs.index(least)
            del pairs[i]
            parts[i] += parts.pop(i + 1)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], never)
        return [self.ranks[p] for p in parts]

    def merged_long(self, piece: bytes) -> list[int]:
        """With a heap of pairs, so that the time for a piece of n bytes grows as n log n."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
        heapq.heapify(waiting)
        while waiting:
            _, i, end = heapq.heappop(waiting)
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end:  # one of the two has been merged since
                continue
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (pair := piece[i : after[end]]) in ranks:
                    heapq.heappush(waiting, (ranks[pair], i, after[end]))
            if i and (pair := piece[before[i] : end]) in ranks:
                heapq.heappush(waiting, (ranks[pair], before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        if self.size > MEMORY:
            self.memory.clear()
            self.size = 0
        memory = self.memory
        for piece in set(pieces).difference(memory):
            memory[piece] = packed = np.array(self.merged(piece), "<i4").tobytes()
            self.size += len(piece) + len(packed) + 200
        found = list(map(memory.__getitem__, pieces))
        return np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def known(self, ids: np.ndarray) -> np.ndarray:
        """The ids, with the place after the last one for those that the file lacks."""
        return np.where((ids >= 0) & (ids < len(self.lengths) - 1), ids, len(self.lengths) - 1)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of a row of ids, and where each id's bytes begin among them."""
        ids = self.known(ids)
        sizes = self.lengths[ids]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        where = np.arange(begins[-1]) + np.repeat(self.firsts[ids] - begins[:-1], sizes)
        return self.letters[where], begins


class Encoder:
    def __init__(self, file: bytes):
        self.cutter, self.merges = Cutter(), Merges(file)

    def short(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other, and how many each has."""
        left, right, own = self.cutter.cut(data, ends)
        ids, counts = self.merges.ids([data[a:b] for a, b in zip(left.tolist(), right.tolist(), strict=True)])
        return ids, np.bincount(own, counts, len(ends)).astype(np.int64)

    def long(self, data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long text, a window at a time; each begins where the last whole piece of the one before ends."""
        out, at, size = [], 0, window
        while at < len(data):
            end = min(at + size, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            part = data[at:end]
            left, right, _ = self.cutter.cut(part, np.array([len(part)]), end == len(data))
            if len(left):
                out.append(self.merges.ids([part[a:b] for a, b in zip(left.tolist(), right.tolist(), strict=True)])[0])
                at, size = at + int(right[-1]), window
            else:
                size *= 2  # a piece longer than the window
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])


def ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def rank_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, window: int = WINDOW) -> DataFrame:
    """``id, n_tokens long, ids array<int>, offsets array<int>``: every row's text as ids, and where each token's bytes begin in it.

    The ids are those of the public library for the same rank file and pattern, each piece separately, without special
    tokens. A null or empty text has empty lists. Each row has one row, repeated ids too; other columns are ignored.
    ``ranks`` names a public rank file, which is read on the driver and broadcast (a fixed file, < 1 MB).
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for a, b in ranges(np.diff(places), window):
                data = texts.buffers()[2][int(places[a]) : int(places[b])].to_pybytes() if places[b] > places[a] else b""
                ends = places[a + 1 : b + 1] - places[a]
                ids, counts = encoder.short(data, ends) if len(data) <= window else encoder.long(data, window)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                begins = np.concatenate([[0], np.cumsum(encoder.merges.lengths[ids])])
                begins = begins[:-1] - np.repeat(begins[cuts[:-1]], counts)
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begins)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), pa.array(counts, pa.int64()), *lists], ["id", "n_tokens", "ids", "offsets"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, offsets array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``id, packed binary, decoded binary``: the ids as little-endian 32-bit numbers, and the bytes that they stand for.

    A null list gives nulls, an empty one no bytes. Ids that the file lacks, and null ids, stand for no bytes.
    """
    kind = dict(encoded.dtypes)[id_col]
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(shared.value)
        for batch in batches:
            sizes = np.asarray(batch["ids"].value_lengths().fill_null(0))
            for a, b in ranges(sizes, WINDOW):
                part = batch["ids"].slice(a, b - a)
                ids = np.asarray(part.flatten().fill_null(-1)).astype("<i4")
                cuts = np.concatenate([[0], np.cumsum(sizes[a:b])])
                letters, begins = merges.bytes_of(ids)
                missing = pa.py_buffer(np.packbits(np.asarray(part.is_valid()), bitorder="little").tobytes())
                binary = lambda ends, data: pa.Array.from_buffers(pa.binary(), b - a, [missing, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), binary(cuts * 4, ids.tobytes()), binary(begins[cuts], letters.tobytes())], ["id", "packed", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, packed binary, decoded binary").withColumnRenamed("id", id_col)
