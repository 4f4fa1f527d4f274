"""Token counts by offset-mapped attribution.

A whole document is encoded once. The tokens' byte lengths give every token's span; the spans are
joined with the document's sections as intervals (both sides are sorted, so two binary searches per
section do it), and a token that crosses a section boundary is allocated by a named rule.

Scale: the join is within a document, so nothing is shuffled; a task holds one document at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenisation pattern that belongs to the public 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with runs that never give anything back; only blanks give back their last one.
POSSESSIVE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("start", "majority", "proportional")
SCHEMA = "section int, byte_start long, byte_end long, char_start long, char_end long, n_tokens double, n_crossing long"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def line_sections(text: bytes) -> np.ndarray:
    """Boundaries of the lines; a line feed belongs to the line it ends. An empty text is one section."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    bounds = np.concatenate([[0], ends, [len(text)]])
    return np.unique(bounds) if len(text) else np.array([0, 0])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of the tokens that touch it also touch another.

    ``ends``: end offsets of the tokens, which tile the text. ``bounds``: section boundaries.
    start: the section of a token's first byte has it. majority: the section with most of its bytes,
    the earlier one at a tie. proportional: each section has the fraction of its bytes.
    """
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    crossing = np.flatnonzero(last > first)
    touched = np.zeros(n, np.int64)
    weights = np.bincount(first[last == first], minlength=n).astype(float)[:n]
    for t in crossing:
        span = np.arange(first[t], last[t] + 1)
        share = np.minimum(bounds[span + 1], ends[t]) - np.maximum(bounds[span], starts[t])
        touched[span[share > 0]] += 1
        if rule == "start":
            weights[first[t]] += 1
        elif rule == "majority":
            weights[span[int(np.argmax(share))]] += 1
        else:
            weights[span] += share / share.sum()
    return weights, touched


def token_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    rule: str = "start", piece_bytes: int = 1 << 20,
) -> DataFrame:
    """A row per document and section: spans in bytes and characters, tokens, boundary-crossing tokens.

    Sections are the lines of the text. A null text has the single empty section 0 with no tokens, and
    so has an empty one. Repeated rows each have their sections. Columns of the input other than the id
    and the text are ignored, whatever they are called.
    ``vocabulary`` names a rank file on the driver; it is read once and broadcast (a fixed file, < 1 MB).
    ``piece_bytes`` only bounds how much text the encoder takes at a time: longer texts are cut where a
    line feed follows a letter and a letter follows it, where the pattern always ends a token. Texts with long runs
    without such a place or of blanks are cut by the pattern itself, run by run.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(counter(ranks, rule, piece_bytes), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def pieces(text: str, most: int) -> Iterator[str]:
    """The text in pieces that no token crosses: cut before a line feed between two letters."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind("\n", at + 1, at + most)
        while cut > at and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut = text.rfind("\n", at + 1, cut)
        if cut <= at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def long_runs(text: str, most: int = 2000) -> bool:
    """Whether a run of blanks or of other signs may be longer than the encoder's own pattern search can take."""
    if len(text) <= most:
        return False
    words = text.split()
    signs = sum(map(len, words))
    return max(map(len, words), default=0) > most or len(text) - signs - len(words) > most


def tokens(encoder, pattern, text: str, most: int) -> Iterator[int]:
    for part in pieces(text, most):
        if long_runs(part):
            for found in pattern.finditer(part):
                yield from encoder._encode_single_piece(found[0].encode())
        else:
            yield from encoder.encode_ordinary(part)


def counter(ranks, rule: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        pattern = regex.compile(POSSESSIVE)
        encoder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        width = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, i in ranks.value.items():
            width[i] = len(token)
        for batch in batches:
            owner, parts = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                text = text or b""
                bounds = line_sections(text)
                ids = list(tokens(encoder, pattern, text.decode("utf-8", "replace"), most))
                weights, touched = attribute(np.cumsum(width[ids]) if ids else np.zeros(0, np.int64), bounds, rule)
                lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                n = len(bounds) - 1
                owner += [i] * n
                parts.append((np.arange(n), bounds[:-1], bounds[1:], lead[bounds[:-1]], lead[bounds[1:]], weights, touched))
            if not owner:
                continue
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(owner)), *[pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)]],
                ["id", *[x.split()[0] for x in SCHEMA.split(", ")]],
            )

    return run
