"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, licenses, quality_model, quality_rules, secrets, simhash, warc
from .oracles import ORACLE_SQL  # noqa: F401
from .shared import is_learning, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.look_up(warc.write(pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    made = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.read_back(chat.windows(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return read.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    learns = is_learning(F.col("doc_id"), 4, 2)
    scored = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learns)
    return scored.select("doc_id", (~learns).alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(is_learning(F.col("doc_id"), 3, 1)))
    return langid.classify(docs, model).select("doc_id", (~is_learning(F.col("doc_id"), 3, 1)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), decontam.Benchmark(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in secrets.RULES if r.base]
    return found.select(
        "doc_id",
        *[of_kind(k) for k in base],
        F.sha2(secrets.listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_rows")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_chat": op3_chat,
    "op4_quality_model": op4_quality_model,
    "op5_quality_rules": op5_quality_rules,
    "op6_licenses": op6_licenses,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
}
