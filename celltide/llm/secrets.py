"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query is derived: the trigrams of lower-cased text that any match must
have, as alternatives of trigrams that occur together.  The index holds the postings (trigram, document) of all trigrams
that some query asks for, sorted by trigram.  The postings of each alternative's trigrams are looked up and intersected, and only
documents in such an intersection are searched with the expression itself.  A rule without mandatory trigrams is searched
for in every document.

Spans are found per rule, leftmost and without overlap, in code points with the end exclusive.  Base rules drop matches whose
value is too short, after they took their place.

Defined cases: null and empty texts have no spans; rows that share an id, or have none, share candidates but are searched
each for itself; repeated rows get equal spans; an empty table gives an empty result.  Texts are searched whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, scratch_root, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is understood alike by Java, RE2 and Python; ``least`` code points are asked of group ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


def _either(words: str) -> str:
    """Letters in either case, written out as classes."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


KEYWORDS = "password|passwd|secret|token|api_?key"
#: In the order of kinds at one start.
RULES: tuple[Rule, ...] = (
    Rule("assign", "(" + _either(KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# ---------------------------------------------------------------- queries of expressions

#: Strings that a part of an expression may stand for before they are only asked for by their trigrams.
MAX_EXACT = 24
ALL = ("all",)
#: Alternatives of a query, and trigrams of an alternative (bits of a long).
MAX_ALTERNATIVES, MAX_TOGETHER = 256, 62


def _and(a: tuple, b: tuple) -> tuple:
    if a == ALL or a == b:
        return b
    return a if b == ALL else ("and", a, b)


def _or(a: tuple, b: tuple) -> tuple:
    if ALL in (a, b):
        return ALL
    return a if a == b else ("or", a, b)


def _of_strings(strings: frozenset[str]) -> tuple:
    """One of these strings occurs."""
    query: tuple | None = None
    for s in sorted(strings):
        mine: tuple = ALL
        for i in range(len(s) - 2):
            mine = _and(mine, ("has", s[i : i + 3]))
        query = mine if query is None else _or(query, mine)
    return ALL if query is None else query


def _walk(items) -> tuple[frozenset[str] | None, tuple]:
    """(the strings it stands for, if few; the query that its matches pass) of a sequence of parsed items."""
    exact: frozenset[str] | None = frozenset([""])
    query: tuple = ALL
    held = frozenset([""])  # strings that end here, since the last part that was not exact

    for kind, value in items:
        strings, sub = _item(kind, value)
        if strings is not None and len(held) * len(strings) <= MAX_EXACT:
            held = frozenset(a + b for a in held for b in strings)
            continue
        exact = None
        query = _and(_and(query, _of_strings(held)), sub)
        held = strings if strings is not None else frozenset([""])
    if exact is not None:
        return held, ALL
    return None, _and(query, _of_strings(held))


def _item(kind, value) -> tuple[frozenset[str] | None, tuple]:
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), ALL
    if kind is op.IN:
        if all(k is op.LITERAL for k, _ in value):
            return frozenset(chr(v).lower() for _, v in value), ALL
        return None, ALL
    if kind is op.SUBPATTERN:
        strings, query = _walk(value[3])
        return strings, query
    if kind is op.BRANCH:
        all_exact: set[str] | None = set()
        query: tuple | None = None
        for branch in value[1]:
            strings, sub = _walk(branch)
            sub = _of_strings(strings) if strings is not None else sub
            query = sub if query is None else _or(query, sub)
            all_exact = None if all_exact is None or strings is None else all_exact | strings
        return (frozenset(all_exact), ALL) if all_exact is not None and len(all_exact) <= MAX_EXACT else (None, query or ALL)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, query = _walk(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if low == high == 1:
            return strings, query
        if low == 0:
            return None, ALL
        return None, _of_strings(strings) if strings is not None else query
    if kind is op.AT:
        return frozenset([""]), ALL
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """The Boolean query over trigrams of lower-cased text that every match of the pattern passes."""
    strings, query = _walk(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def trigrams_of(query: tuple) -> set[str]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(trigrams_of(q) for q in query[1:])) if query[0] in ("and", "or") else set()


def alternatives(query: tuple) -> list[frozenset[str]]:
    """The query as sets of trigrams, one of which a match has whole; an empty set asks for nothing.

    Where alternatives would multiply to over MAX_ALTERNATIVES, one side of the conjunction is left out, and of over MAX_TOGETHER
    trigrams the first are asked for: that lets more documents through to the search, and never fewer.
    """
    if query == ALL:
        return [frozenset()]
    if query[0] == "has":
        return [frozenset([query[1]])]
    a, b = (alternatives(q) for q in query[1:])
    if query[0] == "or":
        found = set(a) | set(b)
    elif len(a) * len(b) > MAX_ALTERNATIVES:
        found = set(min(a, b, key=len))
    else:
        found = {x | y for x in a for y in b}
    least = [x for x in found if not any(y < x for y in found)]
    return sorted({frozenset(sorted(x)[:MAX_TOGETHER]) for x in least}, key=sorted)


# ---------------------------------------------------------------- index, candidates, spans


def postings(rows: DataFrame, rules=RULES) -> DataFrame:
    """(trigram, id): the inverted index of the trigrams that the rules' queries ask for."""
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    lower = rows.select("id", F.lower("text").alias("lower"))
    present = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(g)), F.lit(g)) for g in wanted])) if wanted else F.expr("cast(array() AS array<string>)")
    return lower.select(F.explode(present).alias("trigram"), "id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(id, kinds): the rules for which a document is in the intersection of some alternative's postings.

    Each trigram's postings are met with the alternatives that ask for it (a table whose size depends on the rules only), and a
    document has a whole alternative once all its bits are there, however often an id is repeated.
    """
    asked = [(r.kind, n, trigram, 1 << bit, (1 << len(x)) - 1) for r in rules for n, x in enumerate(alternatives(trigram_query(r.pattern))) for bit, trigram in enumerate(sorted(x))]
    if not asked:
        return index.select("id", F.expr("cast(array() AS array<string>)").alias("kinds")).where("false")
    names = ("kind", "n", "asked", "bit", "whole")
    kept = [F.struct(*[F.lit(v).cast("long" if type(v) is int else "string").alias(c) for c, v in zip(names, row)]) for row in asked]
    wanted = index.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*kept)))
    found = index.where(F.col("trigram").isin(sorted({a[2] for a in asked})))
    met = found.join(F.broadcast(wanted), F.col("trigram") == F.col("asked")).groupBy("id", "kind", "n", "whole").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = whole").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


_NONE = "cast(array() AS array<struct<start: bigint, rank: int, end: bigint, kind: string>>)"


def _spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """The spans of one rule: text between matches and matches, laid end to end."""
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    each = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.arrays_zip(found.alias("all"), value.alias("part")), lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m["all"]).alias("len"), F.char_length(m["part"]).alias("part")))
    start = F.expr(f"struct(0L AS at, {_NONE} AS spans)")

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + m["gap"]
        end = begin + m["len"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(m["part"] >= rule.least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(each, start, step, lambda a: a["spans"])


def _may_match(rule: Rule, text: Column) -> Column:
    """Whether any match could be long enough: spares texts with short matches only the search for places."""
    long_enough = re.sub(r"\+$", "{%d,}" % (rule.least - 4 if rule.kind == "access" else rule.least), rule.pattern) if rule.least and not rule.group else rule.pattern
    return F.regexp_like(text, F.lit(long_enough))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, spans, and the columns in ``keep``) for every row; spans (start, rank, end, kind) in order."""
    keep = keep or []
    rows = pick(docs, id=doc_id, text=text, **{f"k{i}": c for i, c in enumerate(keep)})
    root = scratch_root(docs.sparkSession)
    index = written(postings(rows.select("id", "text"), rules).sortWithinPartitions("trigram"), "postings", root)
    found = written(candidates(index, rules), "candidates", root).withColumnRenamed("id", "cid")
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("cid")), "left")
    own = F.coalesce("text", F.lit(""))
    spans = []
    for rank, rule in enumerate(rules):
        search = F.lit(True) if trigram_query(rule.pattern) == ALL else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        spans.append(F.when(search & _may_match(rule, own), _spans_of(rule, rank, own)).otherwise(F.expr(_NONE)))
    return rows.select(F.col("id").alias("doc_id"), "text", F.sort_array(F.concat(*spans)).alias("spans"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by a mark."""
    start = F.expr("struct(cast(array() AS array<string>) AS parts, 0L AS at)")

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        parts = F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(gap, F.lit(mark)))).otherwise(a["parts"])
        return F.struct(parts.alias("parts"), F.greatest(a["at"], s["end"]).alias("at"))

    done = lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, (a["at"] + 1).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, done))
