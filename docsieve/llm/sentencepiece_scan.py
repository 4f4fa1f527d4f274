"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The public model is of the BPE kind. A sequence of pieces is the BPE encoding of its text exactly if every two
neighbours, put together, encode to themselves; and there is one such sequence. So the encoding is the best
path through the lattice of pieces when a step weighs 0 for neighbours that fit and minus infinity otherwise; with
these two weights the max-plus product of matrices is a Boolean one.

A giant document is cut into chunks at fixed places. The state at a cut is the piece that holds the character
before it. Each chunk yields a transfer matrix between the states at its two cuts (its cells of weight 0); the
matrices are combined associatively, a fixed number at a time, in rounds; the states found are handed down again;
and every chunk then encodes its own pieces, independently of the others. Where a blank follows a non-blank no
piece crosses, so matrices only explore the words at the cuts, however long the chunk is.

Scale: ordinary documents are not shuffled. Chunks of giant ones are dealt by document and chunk number, so one
document's work is spread; matrices hold at most a few hundred numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import Memory, forget, stored, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
START = -1
FAN_IN = 64


def state(at: int, token: tuple[int, int]) -> int:
    """A piece's span as a number, relative to the cut."""
    return (at - token[0]) * 64 + token[1] - at


def end_of(code: int, at: int) -> int:
    return at if code == START else at + code % 64


class Pieces:
    """The model in a task. Texts are normalised: a blank mark in front and for every blank."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with the identity normaliser are supported")
        spec.add_dummy_prefix = False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        normal = [p.piece for p in proto.pieces if p.type == 1]
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("a piece crosses the start of a word")
        self.longest = max(map(len, normal))
        self.normal = set(normal)
        self.bytes = [
            bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(BLANK, " ").encode()
            for p in proto.pieces
        ]
        self.words, self.segments, self.pairs = Memory(12 << 20), Memory(6 << 20), Memory(6 << 20)

    def raw(self, text: str) -> list[int]:
        return self.processor.encode(text)

    def _known(self, cache: Memory, parts: list[str], lead: str) -> Memory:
        cache.make_room()
        new = [w for w in set(parts) if w not in cache]
        for word, ids in zip(new, self.processor.encode([lead + w for w in new], num_threads=1), strict=True):
            cache.keep(word, ids)
        return cache

    def encode(self, s: str) -> np.ndarray:
        """Ids of a normalised text, word by word with a memory of words."""
        if s[:1] == BLANK and s[-1:] != BLANK and BLANK * 2 not in s:
            parts = s[1:].split(BLANK)
            cache = self._known(self.words, parts, BLANK)
        else:
            parts = SEGMENT.findall(s)
            cache = self._known(self.segments, parts, "")
        return np.fromiter(chain.from_iterable(map(cache.__getitem__, parts)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def fits(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            self.pairs.make_room()
            got = self.raw(a + b) == self.raw(a) + self.raw(b)
            self.pairs.keep((a, b), got)
        return got

    def ends(self, s: str, at: int) -> list[int]:
        """Ends of the pieces that start at a place; a character that is no piece stands for itself."""
        out = [e for e in range(at + 1, min(len(s), at + self.longest) + 1) if s[at:e] in self.normal and len(self.raw(s[at:e])) == 1]
        return out if s[at] in self.normal else [at + 1]

    def transfer(self, s: str, begin: int, end: int, first: bool) -> list[tuple[int, int]]:
        """Cells of weight 0 between the states at two cuts of ``s``, which reaches past both by the longest piece."""
        reached: dict[int, dict[tuple[int, int] | None, set[int]]] = {}
        if first:
            reached[begin] = {None: {START}}
        else:
            for a in range(max(0, begin - self.longest), begin):
                for b in self.ends(s, a):
                    if b >= begin:
                        reached.setdefault(b, {})[a, b] = {state(begin, (a, b))}
        breaks = [p for p in range(max(1, begin), end) if s[p] == BLANK and s[p - 1] != BLANK]
        cells: set[tuple[int, int]] = set()
        for token in [t for tokens in reached.values() for t in tokens if t and t[0] < end <= t[1]]:
            cells.add((state(begin, token), state(end, token)))
        known = set(breaks)
        at = begin
        while at < end:
            here = reached.pop(at, None)
            if not here:
                at += 1
                continue
            if at in known:
                here = {None: set().union(*here.values())}
                if at < breaks[-1]:
                    reached = {breaks[-1]: here} if not reached else self._merge(reached, breaks[-1], here[None])
                    at += 1
                    continue
            for e in self.ends(s, at):
                piece = s[at:e]
                got = set().union(*(m for t, m in here.items() if t is None or self.fits(s[t[0] : t[1]], piece)))
                if not got:
                    continue
                if e >= end:
                    cells |= {(entry, state(end, (at, e))) for entry in got}
                if e < end:
                    reached.setdefault(e, {}).setdefault((at, e), set()).update(got)
            at += 1
        return sorted(cells)

    @staticmethod
    def _merge(reached: dict, at: int, entries: set[int]) -> dict:
        reached.setdefault(at, {}).setdefault(None, set()).update(entries)
        return reached


def combine(first: list[tuple[int, int]], second: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The product of two matrices: cells that some state between them joins."""
    onward: dict[int, set[int]] = {}
    for a, b in second:
        onward.setdefault(a, set()).add(b)
    return sorted({(a, c) for a, b in first for c in onward.get(b, ())})


def resolve(matrices: list[list[tuple[int, int]]], entry: int, exit_: int) -> list[tuple[int, int]]:
    """The states before and after each matrix on the path from entry to exit."""
    ahead = [{entry}]
    for m in matrices:
        ahead.append({b for a, b in m if a in ahead[-1]})
    out, after = [], exit_
    for i in range(len(matrices) - 1, -1, -1):
        before = min(a for a, b in matrices[i] if b == after and a in ahead[i])
        out.append((before, after))
        after = before
    return out[::-1]


def pack(cells: list[tuple[int, int]]) -> list[int]:
    return [x for c in cells for x in c]


def unpack(flat) -> list[tuple[int, int]]:
    flat = [int(x) for x in flat]
    return list(zip(flat[::2], flat[1::2], strict=True))


def composed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    cells = None
    for flat in pdf["cells"]:
        cells = unpack(flat) if cells is None else combine(cells, unpack(flat))
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "node": [int(pdf["node"].iloc[0]) // FAN_IN], "cells": [pack(cells)]})


def handed_down(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    path = resolve([unpack(c) for c in pdf["cells"]], int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0]))
    return pd.DataFrame({"key": pdf["key"], "node": pdf["node"], "entry": [a for a, _ in path], "exit": [b for _, b in path]})


def scan(matrices: DataFrame) -> DataFrame:
    """``key, node, entry, exit`` of every chunk from its ``key, node, cells``, in rounds of groups of 64."""
    levels = [matrices]
    top = matrices.agg(F.max("node")).first()[0] or 0
    while top > 0:
        group = ["key", F.expr(f"node div {FAN_IN}").alias("up")]
        levels.append(stored(levels[-1].groupBy(*group).applyInPandas(composed, "key string, node long, cells array<int>")))
        top //= FAN_IN
    path = levels[-1].select("key", "node", F.col("cells")[0].alias("entry"), F.col("cells")[1].alias("exit"))
    for level in levels[-2::-1]:
        parent = path.select("key", F.col("node").alias("up"), "entry", "exit")
        both = level.withColumn("up", F.expr(f"node div {FAN_IN}")).join(parent, ["key", "up"])
        path = stored(both.groupBy("key", "up").applyInPandas(handed_down, "key string, node long, entry int, exit int"))
    return path


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk_chars: int = 1 << 15) -> DataFrame:
    """``id, n_chars, n_chunks, n_pieces, ids array<int>, round_trip`` for every row.

    The ids are those of the SentencePiece library. ``round_trip`` tells whether the decoded ids give the text
    back; that holds but for texts with the blank mark itself. A null or empty text has no pieces. Repeated rows
    each have a row; giant texts that repeat are encoded once. Other columns are ignored. ``model`` is read on the
    driver and broadcast (a fixed file, < 1 MB).
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    with open(model, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    giant = F.char_length("text") >= chunk_chars
    result = "n_chars long, n_chunks long, n_pieces long, ids array<int>, round_trip boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part["text"].to_pylist()
                ids = [pieces.encode(BLANK + t.replace(" ", BLANK)) if t else np.zeros(0, np.int32) for t in texts]
                same = [pieces.decode(i)[1:] == t.encode() for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(list(map(len, texts)), pa.int64()), pa.array([1] * len(ids), pa.int64()), pa.array(list(map(len, ids)), pa.int64()), lists(ids), pa.array(same)],
                    ["id", "n_chars", "n_chunks", "n_pieces", "ids", "round_trip"])

    small = rows.where(~giant).mapInArrow(tidy(whole), f"id {kind}, {result}")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Pieces(shared.value).longest
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                s = BLANK + text.replace(" ", BLANK)
                cuts = [*range(0, len(s), chunk_chars), len(s)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    low = max(0, a - over)
                    yield pa.RecordBatch.from_pydict({"key": [key], "node": [k], "s": [s[low : b + over]], "begin": [a - low], "end": [b - low]})

    large = rows.where(giant).select("id", F.sha2("text", 256).alias("key"), "text")
    owners = large.select("id", "key")
    chunks = stored(large.select("key", "text").mapInArrow(tidy(sliced), "key string, node long, s string, begin long, end long").dropDuplicates(["key", "node"]))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            cells = [pack(pieces.transfer(r["s"], r["begin"], r["end"], r["node"] == 0)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["node"], pa.array(cells, pa.list_(pa.int32()))], ["key", "node", "cells"])

    path = scan(stored(chunks.mapInArrow(tidy(matrices), "key string, node long, cells array<int>")))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            ids, same, chars = [], [], []
            for r in batch.to_pylist():
                own = r["s"][end_of(r["entry"], r["begin"]) : end_of(r["exit"], r["end"])]
                ids.append(pieces.encode(own) if own else np.zeros(0, np.int32))
                same.append(pieces.decode(ids[-1]) == own.replace(BLANK, " ").encode())
                chars.append(len(own))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["node"], lists(ids), pa.array(same), pa.array(chars, pa.int64())], ["key", "node", "ids", "same", "chars"])

    pieces = chunks.join(path, ["key", "node"]).mapInArrow(tidy(traced), "key string, node long, ids array<int>, same boolean, chars long")
    texts = pieces.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("node", "ids"))).alias("parts"), F.bool_and("same").alias("round_trip"), F.sum("chars").alias("chars"))
    marked = large.groupBy("key").agg(F.bool_or(F.contains("text", F.lit(BLANK))).alias("marked"))
    joined = owners.join(texts, "key").join(marked, "key").select(
        "id", (F.col("chars") - 1).alias("n_chars"), F.size("parts").cast("long").alias("n_chunks"), F.flatten("parts.ids").alias("ids"), (F.col("round_trip") & ~F.col("marked")).alias("round_trip"))
    found = joined.select("id", "n_chars", "n_chunks", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
    return small.unionByName(found).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``id, text`` of lists of ids: the library's decoding, also of ids that no text encodes to.

    A null list gives a null text; bytes that form no UTF-8 become replacement characters.
    """
    with open(model, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            raw = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch["ids"].to_pylist()]
            texts = [None if t is None else (t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in raw]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(tidy(run), f"id {kind}, text string").withColumnRenamed("id", id_col)
