"""Weak supervision of quality rules, with DataFrame functions only.

Each rule votes for or against a document, or abstains.  Votes are counted by pattern over all documents; there are
3^rules patterns at most (59,049), whatever the number of documents.  Expectation-maximisation over these
counts fits a mixture of good documents and of one kind of bad ones per rule: junk has one fault or another, so that a
single kind of bad ones would stand for the commonest fault only.  For every kind each rule's rates of votes for and
against are estimated, for good documents too, so that a rule which speaks alone against documents that are like good
ones to all others is found to raise false alarms.  A document's posterior probability to be good takes the place of a
filter that all rules must pass.  An abstention says nothing about quality.

One rule alone can't be told from a false alarm, so each fault is looked at from two sides at least.

Defined cases: null and empty texts have no words, fail the base rules, and get a posterior from the rules that vote (all may
abstain: the prior); repeated rows are judged alike and all counted; an empty table gives an empty
result; a posterior equal to the threshold keeps; extra columns are dropped, whatever their names.  Texts are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick, written

BLANK = r"[\x20\x09-\x0D]"
MIN_WORDS = 50
#: Percent of words in repeated three-word windows that fails the base rules.
MAX_REPEAT = 50
THRESHOLD = 0.5
ROUNDS, TOLERANCE = 1000, 1e-8
GOOD, BAD, ABSTAIN = 1, 0, 2

#: (name, value, votes for if, votes against if); a rule that neither holds for abstains.
RULES: list[tuple[str, str, str, str]] = [
    ("markup", "n_symbols / greatest(word_chars, 1)", "v < 0.01", "v > 0.04"),
    ("plain_words", "n_plain / greatest(n_words, 1)", "v > 0.80", "v < 0.50"),
    ("repetition", "n_repeat_words / greatest(n_words, 1)", "v < 0.10 AND n_words >= 20", "v > 0.30"),
    ("variety", "n_distinct / greatest(n_words, 1)", "v > 0.30 AND n_words >= 20", "v < 0.15"),
    ("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", "v < 0.10 AND n_lines >= 3", "v > 0.30 AND n_lines >= 3"),
    ("capitals", "n_upper / greatest(word_chars, 1)", "v < 0.15", "v > 0.40"),
    ("exclamation", "n_exclaims / greatest(n_words, 1)", "v < 0.05", "v > 0.30"),
    ("function_words", "n_short / greatest(n_words, 1)", "v BETWEEN 0.15 AND 0.70", "v > 0.95"),
    ("word_length", "word_chars / greatest(n_words, 1)", "v BETWEEN 3 AND 9", "v < 2 OR v > 14"),
    ("sentences", "n_stops / greatest(n_words, 1)", "v BETWEEN 0.02 AND 0.25", "v < 0.005 OR v > 0.50"),
]

#: A word of letters, with hyphens and apostrophes inside and at most one mark at each end.
PLAIN = r"""(?<![^\x20\x09-\x0D])["'(]?\p{L}[\p{L}\p{M}'\u2019-]*[.,;:!?]?["')]?(?![^\x20\x09-\x0D])"""


def _bind(value: Column, use) -> Column:
    """Use a value more than once while it is worked out once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that a text has twice or more.

    Windows are sorted with their positions, so that equal ones are neighbours; n log n in the length of the text.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    covered = F.aggregate(
        _bind(F.sort_array(windows), places),
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(covered)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every document that the rules look at."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", BLANK + "+", -1), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", BLANK + "+", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count("!").alias("n_exclaims"),
        count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])").alias("n_short"),
        count(PLAIN).alias("n_plain"),
        count(r"[.?!]+(?=[\x20\x09-\x0D]|$)").alias("n_stops"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def votes(rows: DataFrame, rules=RULES) -> DataFrame:
    """Add a vote column per rule: GOOD, BAD or ABSTAIN."""
    for name, value, good, bad in rules:
        v = f"({value})"
        rows = rows.withColumn(f"v_{name}", F.expr(f"CASE WHEN {good.replace('v ', v + ' ')} THEN {GOOD} WHEN {bad.replace('v ', v + ' ')} THEN {BAD} ELSE {ABSTAIN} END"))
    return rows


@dataclass(frozen=True)
class Accuracies:
    """Of each kind of documents (good ones first, then a kind of bad ones per rule) its share, and of each rule the chances
    of a vote against and of one for, where it votes: ``rates[kind][rule]`` is (against, for)."""

    names: tuple[str, ...]
    shares: tuple[float, ...]
    rates: tuple[tuple[tuple[float, float], ...], ...]

    @property
    def prior(self) -> float:
        return self.shares[0]

    def accuracy(self, name: str) -> tuple[float, float]:
        """The chance that a vote of this rule is right, about bad documents and about good ones."""
        k = self.names.index(name)
        bad = sum(self.shares[1:])
        return sum(s * r[k][BAD] for s, r in zip(self.shares[1:], self.rates[1:])) / bad, self.rates[0][k][GOOD]

    def posterior(self) -> Column:
        """The probability that a document is good, from its vote columns."""
        chances = []
        for share, rates in zip(self.shares, self.rates):
            log = F.lit(float(np.log(share)))
            for name, (against, in_favour) in zip(self.names, rates):
                v = F.col(f"v_{name}")
                log = log + F.when(v == BAD, float(np.log(against))).when(v == GOOD, float(np.log(in_favour))).otherwise(0.0)
            chances.append(log)
        others = lambda logs: F.aggregate(F.transform(F.slice(logs, 2, len(chances) - 1), lambda x: F.exp(F.least(x - logs[0], F.lit(700.0)))), F.lit(0.0), lambda a, x: a + x)
        return _bind(F.array(*chances), lambda logs: 1 / (1 + others(logs)))


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over counted vote patterns, from the share of votes that are for a document.

    What speaks against it is first dealt out among the kinds of the rules that vote so.  Shares and rates are smoothed by one
    document for each outcome; nothing else bounds them.
    """
    n = len(names)
    seen = np.array([p for p, _ in patterns], dtype=int).reshape(-1, n)
    count = np.array([c for _, c in patterns], dtype=float)
    against, in_favour = seen == BAD, seen == GOOD
    good = (in_favour.sum(1) + 1) / (against.sum(1) + in_favour.sum(1) + 2)
    of_rule = against + 1e-3
    belief = np.column_stack([good, (1 - good)[:, None] * of_rule / of_rule.sum(1, keepdims=True)])
    for _ in range(rounds):
        weight = belief * count[:, None]
        shares = (weight.sum(0) + 1) / (count.sum() + n + 1)
        bad, fine = weight.T @ against + 1, weight.T @ in_favour + 1
        rate = bad / (bad + fine)
        log = np.log(shares) + against @ np.log(rate).T + in_favour @ np.log(1 - rate).T
        chance = np.exp(log - log.max(1, keepdims=True, initial=-np.inf))
        before, belief = belief, chance / chance.sum(1, keepdims=True)
        if np.abs(belief - before).max(initial=0) < TOLERANCE:
            break
    return Accuracies(tuple(names), tuple(map(float, shares)), tuple(tuple((float(r), float(1 - r)) for r in kind) for kind in rate))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, counts, votes, base_failed, posterior, kept) for every row.

    The counts are worked out once and written; the votes and the posterior come from them.
    """
    names = [r[0] for r in rules]
    rows = votes(written(features(docs, doc_id, text), "features"), rules)
    columns = [f"v_{n}" for n in names]
    patterns = [(tuple(r[c] for c in columns), r["count"]) for r in rows.groupBy(*columns).count().collect()]
    found = estimate(sorted(patterns), names)
    rows = rows.withColumn("base_failed", base_failed()).withColumn("posterior", found.posterior())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
