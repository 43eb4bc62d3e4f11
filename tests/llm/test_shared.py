import pytest
from pyspark.sql import functions as F

from celltide.llm import shared


def test_join_by_key_with_hot_and_cold_groups(spark, monkeypatch):
    """Half of all rows have one key; each row gets its group's value, once."""
    monkeypatch.setattr(shared, "MAX_HOT_KEYS", 4)
    rows = [(i, "hot" if i % 2 else f"k{i % 50}") for i in range(1000)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, key string")
    groups = df.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    top = {}
    for i, k in rows:
        top[k] = max(top.get(k, i), i)
    out = shared.join_by_key(df, "key", groups, ["top"], "n", len(rows), "id").collect()
    assert sorted((r.id, repr(r.top)) for r in out) == sorted((i, repr(top[k] if k else None)) for i, k in rows)


def test_pick_among_clashing_names(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, "a", "b")], "id long, Text string, text string")
        assert tuple(shared.pick(df, t="text", i="id").first()) == ("b", 1)
        assert tuple(shared.pick(df.select("id", "Text"), t="text").first()) == ("a",)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert tuple(shared.pick(df, t="text").first()) == ("b",)
    twice = spark.range(1).select(F.lit(1).alias("x"), F.lit(2).alias("x"))
    assert shared.pick(twice, y="x").first().y == 1
    with pytest.raises(ValueError):
        shared.pick(df, t="nothing")


def test_scratch_follows_the_checkpoint_folder(spark, tmp_path):
    df = shared.written(spark.range(3), "t", f"file://{tmp_path}/r")
    assert df.count() == 3 and (tmp_path / "r" / "t").exists()
    shared.remove(spark, f"file://{tmp_path}/r")
    assert not (tmp_path / "r").exists()
    assert shared.scratch_root(spark) != shared.scratch_root(spark)


def test_learning_rows(spark):
    import zlib

    rows = spark.range(200).select("id", shared.is_learning(F.col("id"), 4, 2).alias("l")).collect()
    assert all(r.l == (zlib.crc32(str(r.id).encode()) % 4 != 2) for r in rows)


def test_workers_keep_the_models_of_one_operator(spark):
    """A worker that encoded has no vocabulary left once it is asked for languages."""
    import gc

    import pandas as pd
    import public_tokenizers

    from celltide.llm import bpe, langid

    docs = spark.range(8).repartition(8).select("id", F.lit("some words").alias("text"))
    assert bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), doc_id="id").count() == 8
    model = langid.LanguageModel({"a": b"some words", "b": b"other ones"})

    @F.pandas_udf("int")
    def vocabularies(texts: pd.Series) -> pd.Series:
        langid._coders(model.contents, model.level)
        gc.collect()
        return pd.Series([sum(isinstance(x, bpe.Tokenizer) for x in gc.get_objects())] * len(texts))

    bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), doc_id="id").select("ids").collect()
    assert {r.n for r in docs.select(vocabularies("text").alias("n")).collect()} == {0}
