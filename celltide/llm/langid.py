"""Language identification by compression.

A text is encoded once per language with zstandard, each time with that language's raw-content dictionary.
The language whose dictionary gives the fewest bytes is the answer; where the runner-up comes too close the
document is rejected.  A dictionary helps only the beginning of what is encoded, so a long text is encoded in pieces, each
with the dictionary afresh, and the bytes of all pieces are added up: the margin does not depend on the length.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0 and rejected; equal sizes fall to the
alphabetically first language (margin 0, rejected); repeated rows get equal answers; an empty table gives
an empty result; with no language learned, every row is ``und``; extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, ready

UNKNOWN = "und"
#: Raw-content dictionary bytes per language; with CHARS_EACH this bounds what fitting gathers.
DICT_BYTES = 64 * 1024
#: Code points that one labelled document gives to its dictionary at most (fitting only; texts are judged whole).
CHARS_EACH = 1000
#: Labelled documents considered per language.
DOCS_EACH = 400
#: Bytes of all dictionaries together at most: every language is learned, from shorter dictionaries where they are very many.
ALL_BYTES = 16 * 1024 * 1024
#: The level of compression, the same for all texts: one that finds matches of three letters, as short texts need.
LEVEL = 12
#: Bytes that are encoded at a time; the pieces cover the text.
PIECE = 4096
#: A document is rejected if the runner-up needs less than this share of bytes more.  Held-out texts of one language have
#: more (0.036 at the first percentile), random letters less (0.028 at the 99th, of 300 letters).
MIN_MARGIN = 0.03

#: Marks belong to the letters before them.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def normalised(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    """Per language the raw content of its dictionary."""

    contents: dict[str, bytes]
    level: int = LEVEL

    def column(self, text: Column, min_margin: float = MIN_MARGIN) -> Column:
        """A struct column (lang_pred, score, margin, rejected) of a text column."""
        contents, level = self.contents, self.level

        @F.pandas_udf(RESULT)
        def judged(texts: pd.Series) -> pd.DataFrame:
            coders = _coders(contents, level)
            return pd.DataFrame([judge(t, coders, min_margin) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

        return judged(text)


def _coders(contents: dict[str, bytes], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """Compressors with digested dictionaries, made once per Python worker."""

    def make() -> list[tuple[str, zstandard.ZstdCompressor]]:
        made = []
        for lang, raw in sorted(contents.items()):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return made

    return ready(("langid", level, *((k, hash(v)) for k, v in sorted(contents.items()))), make)


def judge(text: str | None, coders, min_margin: float) -> tuple[str, float, float, bool]:
    if not text or not coders or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0, True
    data = normalised(text)
    pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
    sizes = sorted((sum(len(c.compress(x)) for x in pieces), lang) for lang, c in coders)
    best = sizes[0]
    if len(sizes) == 1:
        return best[1], 1.0, 1.0, False
    margin = (sizes[1][0] - best[0]) / best[0]
    return best[1], 0.5 + 0.5 * min(1.0, margin / 0.1), margin, margin < min_margin


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", dict_bytes: int = DICT_BYTES, chars_each: int = CHARS_EACH, docs_each: int = DOCS_EACH) -> LanguageModel:
    """Learn dictionaries from labelled rows.

    A bounded sample, the same for the same rows: per language the ``docs_each`` labelled texts with the least hash of
    ``order``, ``chars_each`` code points of each, up to ``dict_bytes``.  Every value of ``lang`` is learned.
    """
    rows = pick(docs, text=text, lang=lang, order=order).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    known = rows.groupBy("lang").count().collect()  # a row for each language
    dict_bytes = min(dict_bytes, ALL_BYTES // max(1, len(known)))
    sample = []
    if known:
        # a hash under the cut of its language leaves about twice the rows wanted, and only these are ranked
        cuts = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], min(1.0, 2.0 * docs_each / r["count"] + 1e-9))])
        share = F.shiftrightunsigned(F.xxhash64("order"), 11) / float(1 << 53)
        rows = rows.withColumn("h", share).where(F.col("h") < F.coalesce(cuts[F.col("lang")], F.lit(0.0)))
        at = Window.partitionBy("lang").orderBy("h", "part")
        ranked = rows.select("lang", "h", F.substring("text", 1, chars_each).alias("part")).withColumn("k", F.row_number().over(at))
        sample = ranked.where(F.col("k") <= docs_each).collect()
    contents: dict[str, bytes] = {}
    seen: set[tuple[str, str]] = set()
    for r in sorted(sample, key=lambda r: (r["lang"], r["k"])):
        if (r["lang"], r["part"]) in seen:
            continue
        seen.add((r["lang"], r["part"]))
        if len(contents.get(r["lang"], b"")) < dict_bytes:
            contents[r["lang"]] = contents.get(r["lang"], b"") + normalised(r["part"]) + b"\n"
    return LanguageModel({k: v[:dict_bytes] for k, v in contents.items() if v.strip()})


def classify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for every row."""
    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.select("doc_id", model.column(F.col("text"), min_margin).alias("r")).select("doc_id", "r.*")
