import itertools
import random

import pytest

from celltide.llm import licenses
from celltide.llm.decontam import words_of

TEMPLATE = 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> <<var;name="v";original="";match=".{1,2}">> e f'


def language(alphabet):
    """Every word sequence that TEMPLATE stands for, by listing them."""
    out = set()
    for opt in ([], ["b", "d"], ["b", "c", "d"]):
        for n in (1, 2):
            for var in itertools.product(alphabet, repeat=n):
                out.add(("a", *opt, *var, "e", "f"))
    return out


def test_automaton_equals_listing():
    accepted = language("abcdefx")
    automaton = licenses.TemplateAutomaton(TEMPLATE)
    rng = random.Random(1)
    for _ in range(5000):
        words = [rng.choice("abcdefx") for _ in range(rng.randrange(1, 12))]
        ends = [k for k in range(1, len(words) + 1) if tuple(words[:k]) in accepted]
        assert automaton.match([w.encode() for w in words], 0) == (max(ends) if ends else None)


def test_markup_errors():
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", '<<var;name="x";original="";match=".{0,3}">> a', "<<beginOptional>>a<<endOptional>>", ""):
        with pytest.raises(ValueError):
            licenses.TemplateAutomaton(bad)


def plain(text):
    words = [w.decode() for w in words_of(text)]
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


TEXTS = [
    None, "", "é MIT License", "Released under the MIT License.", "released UNDER the X11 expat mit license", "Released under the one two three MIT license",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "This work is licensed under the GNU General Public License, version 3.",
    "This a b c d e is licensed under the gnu general public license", "mit mit license license apache license " * 300, "Copyright (c) 2020 Me. All rights reserved.",
]


def test_scan(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "MIT license"), (3, TEXTS[3])]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out)
    assert [repr(x) for x in got] == [repr(x) for x in sorted(((repr(i), *plain(t)) for i, t in rows), key=lambda x: x[:3])]
    by = {r.doc_id: r for r in out}
    assert "mit-notice" in by[3].labels and by[3].score == 1.0 and by[3].matches[0].end == 5
    assert "mit-notice" in by[4].labels and "mit-notice" not in by[5].labels and by[5].score == 0.5
    assert "apache-2.0-notice" in by[6].labels and "gpl-notice" in by[7].labels and "gpl-notice" not in by[8].labels
    assert by[10].labels == ["all-rights-reserved"] and by[0].score == 0.0


def test_table_empty_and_extra(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()} == want
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert licenses.scan(spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, n_words string")).first().n_words == 1


def bare(template):
    """A template's own text: optional parts in, variable parts as they are in the original."""
    import re

    text = re.sub(r'<<var;name="[^"]*";original="([^"]*)";match="[^"]*">>', r"\1", template)
    return re.sub("<<(begin|end)Optional>>", " ", text)


WHOLE = sorted(k for k in licenses.TEMPLATES if k.endswith("-text"))


@pytest.mark.parametrize("label", WHOLE)
def test_all_mandatory_wording_is_asked_for(label):
    """Each license matches its own text only, and not with one word changed, left out, or the end cut off."""
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    words = [w.decode() for w in words_of(bare(licenses.TEMPLATES[label]))]
    assert [x for x in scanner.scan("before " + " ".join(words) + " after")[5] if x in WHOLE] == [label]
    kept = licenses.TemplateAutomaton(licenses.TEMPLATES[label])
    optional = 0
    for k in range(len(words)):
        changed = [w.encode() for w in words[:k] + ["qqq"] + words[k + 1 :]]
        optional += kept.match(changed, 0) is not None
    assert optional < 40 and optional < len(words) / 4
    for k in (1, len(words) // 2, len(words) - 15):
        assert kept.match([w.encode() for w in words[:k]], 0) is None


def test_a_clause_alone_is_no_license():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that you must pay us"
    assert scanner.scan(text)[5:7] == ([], 0.0)
