import hashlib
import importlib.util
from array import array

from tokenizers import Tokenizer as Library

import corpus_pipeline as cp
from celltide.llm import decontam, langid
from test_near_copies import brute as near_brute
from test_secrets import plain as plain_spans



def test_is_registered():
    spec = importlib.util.find_spec("__spark_entry__")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.queries()["pipeline"] is cp.run
    assert sorted(k.split("_")[0] for k in module.queries() if k.startswith("op")) == sorted(f"op{n}" for n in range(1, 11))


def brute(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cp.COLUMNS).collect()]
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").where(cp.is_learning(cp.F.col("doc_id"), 3, 1)))
    coders = langid._coders(model.contents, model.level)
    docs = [d for d in docs if not langid.judge(d[1], coders, langid.MIN_MARGIN)[3]]
    least = dict(near_brute([d[:2] for d in docs]))
    docs = [d for d in docs if least[d[0]] == d[0]]
    tests = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = decontam.words_of(r.text)
        for k in range(max(1, len(words) - 7) if words else 0):
            tests.setdefault(tuple(words[k : k + 8]), set()).add(r.item_id)
    kept = []
    for d in docs:
        words = decontam.words_of(d[1])
        items = set()
        for m in {len(t) for t in tests}:
            for k in range(len(words) - m + 1):
                items |= tests.get(tuple(words[k : k + m]), set())
        if not items:
            kept.append(d)
    library = Library.from_file(cp.VOCABULARY)
    out = {}
    for d in kept:
        text, at = "", 0
        for s, _, e, _ in plain_spans(d[1]):
            if s >= at:
                text += d[1][at:s] + "[secret]"
            at = max(at, e)
        text += d[1][at:]
        ids = library.encode(text, add_special_tokens=False).ids
        out[d[0]] = (ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_run_equals_brute_force(spark, sf_dir):
    out = {r.doc_id: (list(array("I", r.ids)), r.decoded_sha256) for r in cp.run(spark, sf_dir).collect()}
    assert out == brute(spark, sf_dir)


def test_stages_on_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Text int"
    word = "some words of a plain text that stays as it is "
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, word * 3, "en", "s", 1, 1), (3, word * 3, "en", "s", 1, 1), (None, "token=abcdefgh " + word, "fr", None, 9, 1)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert name == "encode" or docs.columns == cp.COLUMNS
            docs.collect()
    dup = cp.near_duplicates(spark, spark.createDataFrame(rows, schema), sf_dir).collect()
    assert sorted(repr(r.doc_id) for r in dup).count("3") == 1
