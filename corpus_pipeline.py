"""A corpus pipeline: each stage takes the documents that the one before kept, written as Parquet, and reads them again.

1. ``language``: documents whose language is rejected (no letter, or two languages encode them alike) go;
   dictionaries are learned from the stage's own rows, those that the language query learns from.
2. ``near_duplicates``: of each group of near copies (Jaccard of five-word shingles 0.8 or more, and what such pairs
   connect) the document with the smallest doc_id stays.  SimHash proposes candidates, an exact join adds what it misses.
3. ``benchmark``: documents with a passage of any benchmark item go (a run of eight words, or a shorter item whole).
4. ``secrets``: secrets in texts are replaced by a mark; all documents stay, and n_chars follows the text.
5. ``encode``: documents are encoded and decoded; returns doc_id, n_tokens, the packed ids and the decoded text's digest.

Null and empty texts have no letter and go in the first stage.  An empty table gives empty results.  Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltide.llm import bpe, decontam, langid, near_copies, secrets
from celltide.llm.shared import is_learning, pick, scratch_root, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    model = langid.fit(docs.where(is_learning(F.col("doc_id"), 3, 1)))
    return docs.where(~model.column(F.col("text"))["rejected"]).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (rows without one come last); see ``near_copies``."""
    return near_copies.firsts(_documents(docs)).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.Benchmark(table(spark, sf_dir, "benchmark")).with_hits(_documents(docs), "text", "_found")
    return found.where(F.size(F.col("_found.items")) == 0).select(*COLUMNS)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(docs), keep=["lang", "source"])
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = bpe.round_trip(docs, VOCABULARY)
    return made.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", no_secrets),
    ("encode", encode),
]

#: The stages are not expressible in SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs, root = table(spark, sf_dir, "documents"), scratch_root(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, root)
    return STAGES[-1][1](spark, docs, sf_dir)
