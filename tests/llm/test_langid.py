import pytest

from celltide.llm import langid
from celltide.llm.shared import is_learning
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    return langid.fit(docs.where(is_learning(F.col("doc_id"), 3, 1)))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert sorted(model.contents) == ["de", "en", "es", "fr"]
    out = langid.classify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(~is_learning(F.col("doc_id"), 3, 1)).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert sum(r.rejected for r in out) <= 0.03 * len(out)


def test_the_fewest_bytes_win(model):
    """Against one-shot encodings with dictionaries made anew."""
    import zstandard

    for text in ("the quick thing of and the", "nicht und das ist der die", "EL QUE DE LA %%% cosa", "les de la et que un une", "les de la et que un une nicht " * 20):
        level = langid.LEVEL
        sizes = {}
        for lang, raw in model.contents.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(langid.normalised(text)))
        assert langid.judge(text, langid._coders(model.contents, model.level), 0.0)[0] == min(sorted(sizes), key=sizes.get)


def test_odd_rows(spark, model):
    schema = "doc_id long, text string"
    rows = [(1, None), (2, ""), (3, "123 $$ \n"), (None, "the and of"), (5, "the " * 50_000), (5, "the " * 50_000)]
    out = {repr(r.doc_id): r for r in langid.classify(spark.createDataFrame(rows, schema), model).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 and out[k].rejected for k in ("1", "2", "3"))
    assert out["None"].lang_pred == "en" and out["5"].lang_pred in model.contents
    assert langid.classify(spark.createDataFrame([], schema), model).collect() == []


def test_fit_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, Lang string, h int"
    assert langid.fit(spark.createDataFrame([], schema)).contents == {}
    rows = [(1, "one two", "en", "x", 1), (1, "one two", "en", "x", 1), (2, None, "en", "x", 1), (None, "uno dos", "es", "x", 1), (4, "text", None, "x", 1), (5, "$$", "xx", "x", 1)]
    model = langid.fit(spark.createDataFrame(rows, schema))
    assert model.contents == {"en": b"one two\n", "es": b"uno dos\n"}
    none = langid.LanguageModel({})
    assert langid.classify(spark.createDataFrame(rows, schema), none).first().lang_pred == "und"
    one = langid.LanguageModel({"en": b"one two"})
    assert langid.judge("one", langid._coders(one.contents, 3), 0.1) == ("en", 1.0, 1.0, False)


@pytest.mark.parametrize("text", ["½", "²", "Ⅷ", "12 _ 34", " \n", "\u0301", "", None])
def test_without_a_letter(text):
    coders = langid._coders({"en": b"the and of to", "de": b"und der die das"}, langid.LEVEL)
    assert langid.judge(text, coders, langid.MIN_MARGIN) == ("und", 0.0, 0.0, True)
    assert langid.judge("x" + (text or ""), coders, langid.MIN_MARGIN)[0] in ("en", "de")


def test_marks_stay_with_their_letters():
    assert langid.normalised("हिन्दी 1, भाषा!").decode() == "हिन्दी भाषा"


def test_every_language_is_learned(spark):
    """Three hundred languages, columns with clashing names."""
    rows = [(i, f"word{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} " * 5, f"l{i}", 1.0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Text double")
    model = langid.fit(docs)
    assert len(model.contents) == 300
    got = langid.classify(docs.limit(5), model).collect()
    assert [r.lang_pred for r in got] == [f"l{r.doc_id}" for r in got]
