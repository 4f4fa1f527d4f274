"""The registered corpus queries: their columns, one row per document, and their SQL where there is any."""

from pathlib import Path

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from docsieve.llm import queries, sentencepiece_scan, token_counts

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op4_line_dedup": "doc_id n_lines n_removed removed_lines text",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9_katz_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
}
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the tables are not here")


@pytest.mark.parametrize("name", list(COLUMNS))
def test_one_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    assert got.columns == COLUMNS[name].split()
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(ids) == list(range(200))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_token_counts_add_up(spark):
    """Each document's lines together have the tokens of the whole text."""
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=token_counts.read_ranks(token_counts.VOCABULARY), special_tokens={})
    got = queries.QUERIES["op1_token_counts"](spark, FOLDER).groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r["doc_id"]: round(r["tokens"]) for r in got} == {i: len(enc.encode_ordinary(t or "")) for i, t in texts.items()}


def test_pieces_are_those_of_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.QUERIES["op2_sentencepiece"](spark, FOLDER).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: library.encode(t or "") for i, t in texts.items()}


def test_held_out_folds(spark):
    import zlib

    rows = queries.QUERIES["op7_toxicity"](spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_better_than_unigrams_on_held_out_text(spark):
    rows = [r for r in queries.QUERIES["op9_katz_lm"](spark, FOLDER).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
