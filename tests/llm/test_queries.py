"""The registered queries: SQL where there is some, else their columns worked out by hand."""

import collections
import hashlib
import re
import struct
import zlib

import duckdb
import pytest
import tokenizers
import xxhash

from celltide.llm import quality_rules, queries

KINDS = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_quality_model": "doc_id held_out score predicted",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_simhash": "doc_id fingerprint component_id",
}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(KINDS[name].split())] == KINDS[name].split()
    return df


def test_all_are_registered():
    assert list(queries.QUERIES) == list(KINDS) and set(queries.ORACLE_SQL) <= set(KINDS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = rows(spark, sf_dir, name), con.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert collections.Counter(tuple(r[c] for c in names) for r in df.collect()) == collections.Counter(tuple(row[i] for i in order) for row in want.fetchall())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe(spark, sf_dir, texts):
    plain = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    plain.no_truncation()
    plain.no_padding()
    want = {}
    for i, t in texts.items():
        ids = plain.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(plain.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: tuple(r)[1:4] for r in rows(spark, sf_dir, "op2_bpe").collect()} == want


def remainder(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_quality_model(spark, sf_dir, texts):
    out = rows(spark, sf_dir, "op4_quality_model").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_quality_rules(spark, sf_dir, texts):
    out = rows(spark, sf_dir, "op5_quality_rules").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= quality_rules.THRESHOLD)


def test_licenses(spark, sf_dir, texts):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    out = rows(spark, sf_dir, "op6_licenses").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = sorted((i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        base = sorted({k for _, k in at})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(base))
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r.score <= 1


def test_language_id(spark, sf_dir, texts):
    learned = {r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.lang and remainder(r.doc_id, 3) != 1}
    out = rows(spark, sf_dir, "op7_language_id").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert r.lang_pred in learned | {"und"} and (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))


def test_simhash(spark, sf_dir, texts):
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    first = {}
    for i in sorted(prints):
        if i in first:
            continue
        first[i], queue = i, [i]
        while queue:
            a = queue.pop()
            for b in prints:
                if b not in first and (prints[a] ^ prints[b]).bit_count() <= 4:
                    first[b] = i
                    queue.append(b)
    want = {i: (f"{prints[i]:016x}", first[i]) for i in prints}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf_dir, "op10_simhash").collect()} == want
