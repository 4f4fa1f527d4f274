"""Shared text rules and small session helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that separate alphanumeric words: ASCII that is neither digit nor letter.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Lower-cases A-Z and turns separators into blanks; bytes above 127 belong to words.
ALNUM_TABLE = bytes.maketrans(
    SEPARATORS + UPPER.encode(), b" " * len(SEPARATORS) + UPPER.lower().encode()
)
#: Spark removes a statement's shuffle files when it ends if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.translate(ALNUM_TABLE).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return text.lower().split() if text else []


def blank_word_runs(text: bytes | None, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The same words in lists, each of about ``most`` bytes of text; a longer word is in one list."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + most
        if end < len(text):
            rest = text[end : end + most].split(None, 1)  # up to the end of the word that the cut would divide
            while text[end : end + 1].strip():
                end += len(rest[0]) if rest else 1
                rest = text[end : end + most].split(None, 1)
        yield text[at:end].lower().split()
        at = end


class Memory(dict):
    """What was found out about words, in about ``most`` bytes; it starts anew when they are full."""

    def __init__(self, most: int = 24 << 20):
        super().__init__()
        self.most, self.size = most, 0

    def keep(self, word, value) -> None:
        """Add a word; ``make_room`` is called before, when none is in use any more."""
        self[word] = value
        self.size += len(word) + 36 * (len(value) if hasattr(value, "__len__") else 1) + 250

    def make_room(self) -> None:
        if self.size > self.most:
            self.clear()
            self.size = 0


def tidy(run):
    """The same function over batches; when a task ends, the memory that it took goes back to the machine, as its worker stays for other stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return tidied


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, one of our own, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "docsieve-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; what was shuffled for it is removed at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: texts and arrays by their size, anything else as 16 bytes."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        known = F.octet_length if kind in ("string", "binary") else (lambda c: 16 * F.size(c)) if kind.startswith("array") else None
        size = size + (F.coalesce(known(F.col(f"`{name}`")), F.lit(0)) if known else 16)
    return size


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """The table with a broadcast hint if all its rows take at most so many bytes, else as it is."""
    total = df.agg(F.sum(broadcast_bytes(df))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
