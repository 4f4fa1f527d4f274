"""Spelling variants of a corpus vocabulary by permuterm rotations.

A word of L letters gets a terminator and is rotated to all its L + 1 beginnings. Two words that differ by one
replaced letter have rotations that are equal but for their last letter; where one has a letter more, its rotation
without the last letter is a whole rotation of the other. So a rotation is sorted in by what stands before its last
letter (the edited letter is skipped), and once more as a whole; all rotations with the same prefix are one group in
sorted order, with at most one word that has nothing at the skipped place and one for each letter of the alphabet that has.
Scanning a group gives each member the number of its neighbours there and the best of them, from the first two of the group:
time and output are linear in the group. A letter removed from a run of equal ones counts at the run's first place only, so
every pair of near words meets in exactly one group.

Scale: words are counted in the tasks that read the texts before they are shuffled; rotations carry their word's place in
the order of all words, not the word. Forms are followed to roots by doubling steps, of which there are few as
counts at least double from word to form. Every step is a join or a window over keys of bounded groups.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import forget, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
END = "$"
#: Longer prefixes are replaced by numbers that stand for them.
LONGEST = 64
PRIME, BASE = 2**127 - 1, 0x5BD1E995C2B2AE3D27D4EB2F165667C5
#: Kinds of entries: a whole rotation; one that skips its last letter, where that begins a run of equal letters, and elsewhere.
WHOLE, SKIPS, SKIPS_WITHIN = 0, 1, 2
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000


def words_of(text: str) -> Counter:
    """Runs of letters as they stand; very long texts are not cut into a list."""
    return Counter(RUN.findall(text)) if len(text) < 1 << 22 else Counter(m[0] for m in RUN.finditer(text))


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None, shortest: int = 5) -> DataFrame:
    """``word, n``: runs of Latin letters with A-Z in lower case, of at least ``shortest`` letters, and how often they occur.

    With ``drop_every`` a run loses a letter where that number divides ``crc32("<id>:<run>")``: the one at the crc
    modulo the run's length. A null id counts as the empty text; a null or empty text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                begun = zlib.crc32(f"{key}:".encode())
                for word, n in words_of(text.as_py()).items():
                    if len(word) < shortest:
                        continue
                    low = word.encode().lower()  # of bytes, which leaves other letters alone
                    if drop_every and not (h := zlib.crc32(low, begun)) % drop_every:
                        whole = low.decode()
                        at = h % len(whole)
                        low = (whole[:at] + whole[at + 1 :]).encode()
                        if len(whole) == shortest:
                            continue
                    counts[low] += n
                if len(counts) > FLUSH:
                    yield counted(counts)
                    counts.clear()
        yield counted(counts)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def rotations(word: str) -> Iterator[tuple[str, int]]:
    """The groups that a word is sorted into, and as what."""
    if len(word) < LONGEST:
        for i in range(len(word) + 1):
            yield f"{word[i:]}{END}{word[:i]}", WHOLE
            if i < len(word):
                yield f"{word[i + 1 :]}{END}{word[:i]}", SKIPS_WITHIN if i and word[i] == word[i - 1] else SKIPS
        return
    hashes, powers = [0], [1]
    for c in word:
        hashes.append((hashes[-1] * BASE + ord(c) + 1) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    n = len(word)
    after = lambda i: (hashes[n] - hashes[i] * powers[n - i]) % PRIME
    for i in range(n + 1):
        yield f"{n - i} {after(i):x} {i} {hashes[i]:x}", WHOLE
        if i < n:
            key = f"{n - i - 1} {after(i + 1):x} {i} {hashes[i]:x}" if n > LONGEST else f"{word[i + 1 :]}{END}{word[:i]}"
            yield key, SKIPS_WITHIN if i and word[i] == word[i - 1] else SKIPS


def entries(words: DataFrame) -> DataFrame:
    """``key, kind, n, place``: a row for each rotation of each word, whole and without its last letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, ns, places = [], [], [], []
            for word, n, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key, kind in rotations(word):
                    keys.append(key)
                    kinds.append(kind)
                    ns.append(n)
                    places.append(place)
                if len(keys) > 100_000:
                    yield listed(keys, kinds, ns, places)
                    keys, kinds, ns, places = [], [], [], []
            yield listed(keys, kinds, ns, places)

    return words.select("word", "n", "place").mapInArrow(run, "key string, kind int, n long, place long")


def listed(keys: list[str], kinds: list[int], ns: list[int], places: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), pa.array(ns, pa.int64()), pa.array(places, pa.int64())], ["key", "kind", "n", "place"])


def neighbours(words: DataFrame) -> DataFrame:
    """``place, n_near, best struct<less, place>``: of each word with near words, how many and the most frequent one.

    ``less`` is minus the count, so that the least struct is the best one, ties to the first word.
    """
    group = Window.partitionBy("key").orderBy("own")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, kind = F.col("own"), F.col("kind")
    skips, begins = F.when(kind != WHOLE, own), F.when(kind == SKIPS, own)
    first_two = lambda c: (F.first(c, ignorenulls=True).over(whole), F.nth_value(c, 2, ignoreNulls=True).over(whole))
    other = lambda c: F.when(first_two(c)[0] == own, first_two(c)[1]).otherwise(first_two(c)[0])
    size = lambda c: F.count(c).over(whole)
    scanned = entries(words).withColumn("own", F.struct((-F.col("n")).alias("less"), "place")).select(
        "place",
        F.when(kind == WHOLE, size(begins)).when(kind == SKIPS, size(own) - 1).otherwise(size(skips) - 1).alias("near"),
        F.when(kind == WHOLE, first_two(begins)[0]).when(kind == SKIPS, other(own)).otherwise(other(skips)).alias("best"),
    )
    return scanned.where("near > 0").groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``place, root``: the last word on the way from word to form, by doubling steps until no root has a form.

    Forms are at least twice as frequent as their words, so ways are short and have no circles.
    """
    found = stored(forms.select("place", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not found.where("moved").isEmpty():
        jump = found.select(F.col("place").alias("root"), F.col("root").alias("beyond"))
        further = stored(found.join(jump, "root", "left").select("place", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        forget(found)
        found = further
    return found.select("place", "root")


def variants(counts: DataFrame, *, least: int = 3, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word that occurs ``least`` times or more.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. The form is the near word with
    the largest count (ties: the first in code-point order) if that is at least ``ratio`` (2 or more) times the word's, else null;
    the root is found by following forms, and is the word itself without one. ``counts (word, n)`` with distinct
    words of letters; null words are left out, other columns are ignored, and no words give no rows. Prefixes of over ``LONGEST``
    letters are compared by 127-bit numbers in place of their letters.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2, forms need not lead to a root")
    known = counts.where(F.col("word").isNotNull() & (F.col("n") >= least)).select("word", "n")
    words = stored(known.repartitionByRange("word").sortWithinPartitions("word").withColumn("place", F.monotonically_increasing_id()))
    near = stored(neighbours(words).join(words, "place").select(
        "place", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")))
    ends = roots(near.where("best is not null").select("place", F.col("best.place").alias("form")))
    name = lambda c: words.select(F.col("place").alias(f"{c} place"), F.col("word").alias(c))
    every = words.join(near, "place", "left").join(ends.withColumnRenamed("root", "root place"), "place", "left").withColumn("form place", F.col("best.place"))
    return every.join(name("form"), "form place", "left").join(name("root"), "root place", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("form_n"))
