import corpus_pipeline as cp
from celltide.llm import decontam

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_item_is_enough(spark, sf_dir):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(2).collect()]
    passage = [" ".join(t.split()[:8]) for t in items]
    texts = [f"words before {items[0]} words after", f"before {passage[1]} after", " ".join(passage), "no passage of a benchmark is in this text", " ".join(passage[0].split()[:7]), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in cp.benchmark(spark, docs, sf_dir).collect()) == [3, 4, 5, 6]


def test_no_window_is_left_in_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    machines = decontam.compile_items([(str(r.item_id), r.text) for r in items])
    clean = [r.doc_id for r in docs.collect() if not decontam.search_text(r.text, machines)[2]]
    assert sorted(r.doc_id for r in cp.benchmark(spark, docs, sf_dir).collect()) == sorted(clean) != sorted(r.doc_id for r in docs.collect())
