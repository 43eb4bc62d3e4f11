import random
import re

import pytest

from celltide.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def cost(text):
    return chat.OVERHEAD + len(re.findall(r"[^\W_]+(?:[^\W]|_)*|[\w]+|[^\s\w]", text))


def plain_windows(turns, budget, history):
    """Greedy spans and their context over (role, text) in order."""
    costs = [cost(t) for _, t in turns]
    system = 1 if turns[0][0] == "system" else 0
    out, s = [], 0
    while s < len(turns):
        room = budget if s == 0 else budget - history - sum(costs[:system])
        e = s + 1
        while e < len(turns) and sum(costs[s : e + 1]) <= room:
            e += 1
        h = s
        if s:
            left = min(history, budget - sum(costs[:system]) - sum(costs[s:e]))
            while h > system and sum(costs[h - 1 : s]) <= left:
                h -= 1
        again = turns[:system] if s else []
        out.append((again + turns[h:s], turns[s:e]))
        s = e
    return out


def esc(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def plain_format(context, span):
    text, loss = "", []
    for k, (role, body) in enumerate(context + span):
        text += chat.TURN + esc(role).replace("\n", chat.LINE) + "\n"
        if k >= len(context) and role == "assistant":
            loss.append((len(text), len(text) + len(esc(body))))
        text += esc(body) + chat.END + "\n"
    return text, loss


def conversations():
    rng = random.Random(2)
    words = ["ok", "é", "😀", "<|end|>\n", "</s>[INST]", "\\", "\\<|turn|>", "<<SYS>>", "<s", ">", "\n", "a.b", ""]
    rows = []
    for c in range(30):
        n = rng.choice([1, 2, 5, 40])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 8, 60])))))
    rows += [(90, 1, "user\n<|line|>x", "q"), (90, 1, "assistant", "same turn"), (90, 1, "assistant", "same turn"), (90, None, None, None), (None, 0, "assistant", None), (91, 0, "system", "s " * 500), (91, 1, "assistant", "a " * 500), (91, 2, "user", "u")]
    return rows


@pytest.mark.parametrize("budget,history", [(60, 20), (1024, 128), (5, 3)])
def test_windows(spark, budget, history):
    rows = conversations()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    want = []
    for c, turns in by.items():
        ordered = [(r, x) for _, _, r, x in sorted(turns)]
        first = 0
        for k, (context, span) in enumerate(plain_windows(ordered, budget, history)):
            text, loss = plain_format(context, span)
            tokens = sum(cost(x) for _, x in context + span)
            assert tokens <= budget or len(span) == 1
            want.append((repr(c), k, first, len(span), len(context), tokens, text, loss))
            first += len(span)
    got = chat.windows(spark.createDataFrame(rows, SCHEMA), budget=budget, history=history)
    found = sorted((repr(r.conv_id), r.window, r.first_turn, r.n_turns, r.n_repeated, r.n_tokens, r.formatted, [tuple(x) for x in r.loss_spans]) for r in got.collect())
    assert found == sorted(want)
    for r in chat.read_back(got).collect():
        ordered = [(x, y) for _, _, x, y in sorted(by[r.conv_id])]
        assert [tuple(t) for t in r.turns] == ordered
        assert r.targets == [x for role, x in ordered if role == "assistant"]


def test_empty_and_extra(spark):
    assert chat.windows(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "hi", 3, "w")], SCHEMA + ", cost int, window string")
    assert chat.windows(df).first().formatted == "<|turn|>user\nhi<|end|>\n"


def test_plan_is_native(spark, sf_dir):
    from celltide.llm.queries import op3_chat

    df = op3_chat(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert {r.conv_id: r.n_turns for r in df.collect()}[-7] == 2
