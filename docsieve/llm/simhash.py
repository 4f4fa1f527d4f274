"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect
[23,12,7] Golay code. A word's keys are the indices of the codewords that the word and its 23 neighbours
decode to: one or six. Two words at distance one or less share a key, for one's own codeword is among the
other's keys. At most three differing bits leave two segments with at most one each (pigeonhole), so
fingerprints that link meet under the keys of one of the three segment pairs.

Scale: rows are grouped by fingerprint first, so copies cost nothing. A bucket is first tied to its smallest
member, which needs one comparison per key; only buckets that still hold several components are then compared
member by member. So a group of thousands of near copies never has all its pairs emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.text import blank_words, cut

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0xAE3


def remainder(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


class Golay:
    def __init__(self) -> None:
        unit = np.array([remainder(1 << i) for i in range(23)], np.int64)
        self.bytes = [self._table(unit[i : i + 8]) for i in (0, 8, 16)]
        self.error = np.zeros(2048, np.int64)
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    flips = {a, b, c}  # one, two or three different places
                    self.error[int(np.bitwise_xor.reduce(unit[list(flips)]))] = sum(1 << i for i in flips)

    @staticmethod
    def _table(unit: np.ndarray) -> np.ndarray:
        table = np.zeros(256, np.int64)
        for i, u in enumerate(unit):
            table[np.arange(256) >> i & 1 == 1] ^= u
        return table

    def index(self, words: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the codeword within distance 3."""
        low, mid, high = self.bytes
        syndrome = low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16]
        return (words ^ self.error[syndrome]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of each word, and which of them are not repeats."""
        near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
        keys = np.sort(self.index(near), axis=1)
        return keys, np.column_stack([np.ones(len(words), bool), keys[:, 1:] != keys[:, :-1]])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Majority of the bits of the shingles' XXH64."""
    import xxhash

    words = blank_words(text)
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return majority(np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)], "<u8"))


def majority(hashed: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp long`` (the 64 bits as a signed long) for every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, width) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(got)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp.view(np.uint64) >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        fp = np.asarray(batch["fp"])
        own = [code.index(s) for s in segments(fp)]
        key = np.concatenate([p << 24 | own[i] << 12 | own[j] for p, (i, j) in enumerate(PAIRS)])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(fp, 3))], ["key", "fp"])


def probe_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = np.asarray(batch["fp"])[at : at + 4096]
            keys = [code.keys(s) for s in segments(fp)]
            for p, (i, j) in enumerate(PAIRS):
                both = keys[i][1][:, :, None] & keys[j][1][:, None, :]
                row, a, b = np.nonzero(both)
                key = p << 24 | keys[i][0][row, a] << 12 | keys[j][0][row, b]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root``: the smallest node reachable, for nodes of ``edges (a, b)`` of longs.

    Alternates two steps until nothing changes: every node's neighbours move to its smallest neighbour,
    first the larger ones, then the smaller ones, so the depth falls by a constant factor a round.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        after = cut(small.unionByName(down.select("a", F.col("low").alias("b"))).distinct())
        same = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (links, after)]
        links = after
        if same[0] == same[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(fps: DataFrame, roots: DataFrame) -> DataFrame:
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near(most: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most


def leads(fps: DataFrame) -> DataFrame:
    """``key, other, n``: the smallest fingerprint of each bucket, and how many it has."""
    return fps.select("fp").mapInArrow(own_keys, "key long, fp long").groupBy("key").agg(F.min("fp").alias("other"), F.count("*").alias("n"))


def ties(fps: DataFrame, lead: DataFrame, most: int) -> DataFrame:
    """``fp, other``: distinct fingerprints and the smallest ones of the buckets they ask, where they link."""
    probes = fps.select("fp").mapInArrow(probe_keys, "key long, fp long")
    return probes.join(lead, "key").where(near(most) & (F.col("fp") != F.col("other"))).select("fp", "other")


def links(fps: DataFrame, most: int) -> DataFrame:
    """``fp, root`` for distinct fingerprints: those joined by chains of links have one root."""
    own = fps.select("fp").mapInArrow(own_keys, "key long, fp long")
    probes = fps.select("fp").mapInArrow(probe_keys, "key long, fp long")
    lead = leads(fps)
    first = ties(fps, lead, most)
    found = labelled(fps, components(first.select(F.col("fp").alias("a"), F.col("other").alias("b"))))
    found = cut(found)
    # What is left: pairs in buckets of two or more fingerprints whose components still differ.
    crowd = lead.where("n > 1").select("key", F.col("other").alias("lead"))
    members = own.join(crowd, "key").join(found, "fp").select("key", "fp", "root", "lead")
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    asking = probes.join(mixed, "key").join(found, "fp").where("not (low = high and low = root)").select("key", "fp", "root")
    other = members.where("fp <> lead").select("key", F.col("fp").alias("other"), F.col("root").alias("other_root"))
    rest = asking.join(other, "key").where(near(most) & (F.col("root") != F.col("other_root")))
    more = components(rest.select(F.col("root").alias("a"), F.col("other_root").alias("b")))
    return (
        found.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        .select("fp", F.coalesce("top", "root").alias("root"))
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """``id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints link at ``most`` (3 at the highest) or fewer differing bits; ``component_id`` is the
    smallest id reachable over links. A null or empty text has fingerprint zero and links like any other.
    Rows that repeat an id each have a row. A null id is never a component id unless its whole component has
    null ids. Other columns are ignored; an empty table gives an empty result.
    """
    if most > 3:
        raise ValueError("the keys cover up to 3 differing bits")
    marks = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    fps = cut(marks.groupBy("fp").agg(F.min("id").alias("first")))
    roots = cut(links(fps, most))
    named = roots.join(fps, "fp").select("fp", "root", "first")
    tops = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(tops, "root").select("fp", "component_id")
    return marks.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is their component's smallest; of rows that repeat that id, all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
