import random

import pytest
from celltide.llm import langid
from celltide.llm.shared import is_learning
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def known(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs.where(is_learning(F.col("doc_id"), 3, 1)))
    words = {}
    for r in docs.where(~is_learning(F.col("doc_id"), 3, 1)).orderBy("doc_id").collect():
        words.setdefault(r.lang, []).extend((r.text or "").split())
    return langid._coders(model.contents, model.level), words


def judged(known, text):
    return langid.judge(text, known[0], langid.MIN_MARGIN)


def test_the_margin_does_not_fall_with_length(known):
    for lang in ("de", "en", "es", "fr"):
        rng = random.Random(3)
        text = " ".join(rng.choices(known[1][lang], k=400_000))
        of_all, of_some = judged(known, text), judged(known, text[:20_000])
        assert of_all[0] == lang and not of_all[3]
        assert of_all[2] > 0.7 * of_some[2]


def test_ambiguous_text_is_rejected(known):
    rng = random.Random(4)
    for n in (500, 1000, 5000, 50_000):
        letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n)) for _ in range(20)]
        assert all(judged(known, t)[3] for t in letters)


def test_every_piece_counts(known):
    rng = random.Random(5)
    little, much = (" ".join(rng.choices(known[1][x], k=n)) for x, n in (("en", 20_000), ("de", 60_000)))
    assert judged(known, f"{little} {much}")[0] == judged(known, f"{much} {little}")[0] == "de"
    assert judged(known, f"{little} {much}")[2] < judged(known, much)[2]
