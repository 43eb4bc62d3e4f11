import random

import public_tokenizers
import pytest
from array import array
from tokenizers import Tokenizer as Library

from celltide.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def mine():
    with open(PATH, "rb") as f:
        return bpe.Tokenizer(f.read())


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def same(mine, library, text):
    ids = mine.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert list(array("I", ids)) == want, repr(text[:80])
    assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


TEXTS = [
    "", " \n", "it's we'll I'D 'should", "<|endoftext|>x<|startoftext|> <|endoftext|>", "ΣΑΣ İstanbul ẞ ﬁ Å Ⱥ",
    "中文字符 日本語 हिन्दी ١٢٣ ½ ⅷ²", "\x00\x1c a\x85b​c　d﻿", "a" * 5000, "ab" * 3000, "!?" * 2000,
    "😀😀 👩‍👩‍👧 é", "“curly” – quotes… 5€",
]


@pytest.mark.parametrize("text", TEXTS)
def test_hard_texts(mine, library, text):
    same(mine, library, text)


def test_random_words(mine, library):
    rng = random.Random(4)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "abt", "aeinorst", "0123456789'x", "éèüñaes", "%$*&!.,"):
        same(mine, library, " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(800)))


def test_every_character(mine, library):
    rng = random.Random(5)
    chars = [chr(c) for c in [*range(0x500), *rng.sample(range(0x500, 0xD800), 2000), *rng.sample(range(0xE000, 0x110000), 2000)]]
    for c in chars:
        same(mine, library, f"a{c}a1{c}{c}")


def test_caches_forget(mine, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_ARCS", 5)
    same(mine, library, "one two three four five six seven one two three eleven thirteen")


def test_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "x y"), (-4, "x y")], docs.schema)
    rows = [tuple(r) for r in docs.union(extra).collect()]
    got = sorted((repr(r.doc_id), list(array("I", r.ids)), r.n_tokens, r.decoded) for r in bpe.round_trip(docs.union(extra), PATH).collect())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((repr(d), ids, len(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    empty = spark.createDataFrame([], "doc_id long, text string, ids int")
    assert bpe.round_trip(empty, PATH).collect() == []


def test_columns(spark):
    from pyspark.sql import functions as F

    with open(PATH, "rb") as f:
        content = f.read()
    df = spark.createDataFrame([("Hello there",), (None,)], "t string").select(bpe.encode_column(F.col("t"), content).alias("ids"))
    rows = df.select(bpe.n_tokens(F.col("ids")).alias("n"), bpe.decode_column(F.col("ids"), content).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(2, "hello</w> there</w>"), (0, "")]
