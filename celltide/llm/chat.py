"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns have costs; their prefix sums choose spans of whole turns, each as long as the budget lets it be.  A
window is a span put into the template: the leading system turn comes first in every window, then the last turns
before the span as far as the history budget goes, then the span.  Repeated turns are context: the loss mask
covers the assistant texts of the span alone, so that each assistant text is a target exactly once.

Template: ``<|turn|>`` role, newline, text, ``<|end|>`` newline.  Inside roles and texts a backslash is doubled, and one is put
after the first character of every control string, which is undone by dropping one backslash before any character.

Defined cases: a null text or role is empty; a null turn number comes first; turns that share a number are kept, ordered by role and
text, repeated rows too; a turn over the budget is a span of its own; rows with a null conv_id are one conversation; an
empty table gives an empty result.  Turns are never cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick

#: LINE stands for a line break in a role.
TURN, END, LINE = "<|turn|>", "<|end|>", "<|line|>"
#: Strings that a text must not bring into the template: its own marks, and those of widespread templates.
CONTROLS = (TURN, END, LINE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens (words and marks) that a window holds at most, and that its repeated turns take of it at most.
BUDGET = 1024
HISTORY = 128
#: Tokens that the template adds to a turn.
OVERHEAD = 4
#: What a token is taken to be, here: a word or a single mark.
PIECES = r"[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]"
SYSTEM, ASSISTANT = "system", "assistant"


def _escape_pattern(controls: tuple[str, ...]) -> str:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(set(controls), key=len, reverse=True))
    return rf"\\|{heads}"


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.regexp_replace(text, F.lit(_escape_pattern(controls)), F.lit(r"$0\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def cost(text: Column) -> Column:
    """Words and single marks of a text, and the template's share."""
    return (F.regexp_count(text, F.lit(PIECES)) + OVERHEAD).cast("long")


def _bind(value: Column, use) -> Column:
    """Use a value more than once while it is worked out once."""
    return F.transform(F.array(value), use)[0]


def windows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row per window.

    (conv_id, window, first_turn, n_turns, n_repeated, n_tokens, formatted, loss_spans): positions of turns in the
    conversation from 0; the first ``n_repeated`` turns of ``formatted`` are context; ``loss_spans`` are (start, end) in
    its code points, end exclusive.
    """
    rows = pick(df, conv_id=conv_id, turn=turn, role=role, text=text)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("cost", cost(F.col("text")))
    inside = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("cost").over(inside))
    # the sums grow with every turn, as no turn is free: they give the order too
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("sum", "role", "text", "cost"))).alias("turns"))
    first = F.col("turns")[0]
    convs = convs.select(
        "conv_id",
        "turns",
        F.size("turns").alias("n"),
        F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda t: t["sum"])).alias("sums"),
        F.when(first["role"] == SYSTEM, 1).otherwise(0).alias("n_system"),
        F.when(first["role"] == SYSTEM, first["cost"]).otherwise(0).alias("system_cost"),
    )
    convs = convs.withColumn("ends", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _span_end(i, budget, history)))
    start = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("next"))
    convs = convs.withColumn("starts", F.aggregate("ends", start, _step, lambda a: a["at"]))
    convs = convs.select("conv_id", F.posexplode(F.transform("starts", lambda s: _window(s, budget, history))).alias("window", "w")).select("conv_id", "window", "w.*")
    convs = convs.withColumn("pieces", F.concat(F.transform("context", lambda t: _piece(t, False, controls)), F.transform("span", lambda t: _piece(t, True, controls))))
    return convs.select(
        "conv_id",
        "window",
        "first_turn",
        F.size("span").alias("n_turns"),
        F.size("context").alias("n_repeated"),
        (F.aggregate("context", F.lit(0).cast("long"), lambda a, t: a + t["cost"]) + F.aggregate("span", F.lit(0).cast("long"), lambda a, t: a + t["cost"])).alias("n_tokens"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.aggregate("pieces", F.expr("struct(0L AS at, cast(array() AS array<struct<start: bigint, end: bigint>>) AS spans)"), _mask, lambda a: a["spans"]).alias("loss_spans"),
    )


def _lower_bound(sums: Column, least: Column, high: Column) -> Column:
    """The first position below ``high`` whose prefix sum is ``least`` or more, else ``high``, by halving."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2((high + 1).cast("double"))).cast("int"))

    def halve(a: Column, _: Column) -> Column:
        lower = lambda mid: F.when(a["lo"] >= a["hi"], a).when(F.get(sums, mid) < least, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))
        return _bind(((a["lo"] + a["hi"]) / 2).cast("int"), lower)

    return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), high.cast("int").alias("hi")), halve, lambda a: a["lo"])


def _span_end(i: Column, budget: int, history: int) -> Column:
    """The end of a span that begins at turn i: as far as the budget goes, after one turn at least.

    Spans after the first leave room for the system turn and the history.
    """
    room = F.when(i == 0, F.lit(budget).cast("long")).otherwise(F.lit(budget - history) - F.col("system_cost"))
    over = _lower_bound(F.col("sums"), F.get(F.col("sums"), i) + room + 1, F.col("n") + 1)
    return F.greatest(i + 1, over - 1).cast("int")


def _step(a: Column, end: Column) -> Column:
    """Go over the turns; where a span begins, the next one begins at its end."""
    begins = a["i"] == a["next"]
    return F.struct(
        F.when(begins & (a["i"] > 0), F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"),
        (a["i"] + 1).alias("i"),
        F.when(begins, end).otherwise(a["next"]).alias("next"),
    )


def _window(s: Column, budget: int, history: int) -> Column:
    """The turns of the window whose span begins at turn s."""
    sums, end = F.col("sums"), F.get("ends", s)
    room = F.least(F.lit(history).cast("long"), F.lit(budget) - F.col("system_cost") - (F.get(sums, end) - F.get(sums, s)))
    # whole turns before the span, the system turn apart
    low = F.least(s, F.greatest(F.col("n_system"), _lower_bound(sums, F.get(sums, s) - room, F.col("n"))))
    history_turns = _bind(low, lambda h: F.slice("turns", h + 1, s - h))
    context = F.when(s == 0, F.slice("turns", 1, 0)).otherwise(F.concat(F.slice("turns", F.lit(1), F.col("n_system")), history_turns))
    return F.struct(s.alias("first_turn"), context.alias("context"), F.slice("turns", s + 1, end - s).alias("span"))


def _piece(t: Column, own: bool, controls: tuple[str, ...]) -> Column:
    role = F.replace(escaped(t["role"], controls), F.lit("\n"), F.lit(LINE))
    return F.struct(
        F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"),
        escaped(t["text"], controls).alias("body"),
        (F.lit(own) & (t["role"] == ASSISTANT)).alias("target"),
    )


def _mask(a: Column, p: Column) -> Column:
    """Go over the pieces of a window; add the place of a target's text."""
    start = a["at"] + F.char_length(p["head"])
    end = start + F.char_length(p["body"])
    more = F.when(p["target"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["spans"])
    return F.struct((end + len(END) + 1).alias("at"), more.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows hold, read from their text, mask and count of repeated turns.

    (conv_id, n_turns, turns, targets, formatted_chars): turns are (role, text) in order without repeated ones;
    targets are the texts under the loss mask.
    """
    parts = F.split("formatted", re.escape(END) + "\n", -1)
    turns = F.transform(parts, lambda p: _bind(F.substring_index(p, "\n", 1), lambda head: _turn(p, head)))
    own = F.slice(turns, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    targets = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = formatted.select("conv_id", "window", own.alias("turns"), targets.alias("targets"), F.char_length("formatted").cast("long").alias("chars"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns, targets = F.flatten(F.transform("w", lambda x: x["turns"])), F.flatten(F.transform("w", lambda x: x["targets"]))
    return convs.select("conv_id", F.size(turns).cast("long").alias("n_turns"), turns.alias("turns"), targets.alias("targets"), "formatted_chars")


def _turn(part: Column, head: Column) -> Column:
    role = F.replace(F.substr(head, F.lit(len(TURN) + 1)), F.lit(LINE), F.lit("\n"))
    return F.struct(unescaped(role).alias("role"), unescaped(F.substr(part, F.char_length(head) + 2)).alias("text"))
