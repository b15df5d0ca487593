"""Preference pairs against a plain rendering."""

import random

import pytest

from shopledger.llm import preferences


def render(turns):
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


def trained(turns):
    spans, at = [], 0
    for role, text in turns:
        begin = at + len(f"<|{role}|>\n")
        at = begin + len(text + "<|end|>\n")
        if role == "assistant":
            spans.append((begin, at))
    return spans


def clean(rows):
    kept = {
        (pair, -1 if turn is None else turn, role or "unknown", (text or "").replace("<|", "< |"))
        for pair, turn, role, text in rows
        if pair is not None
    }
    out = {}
    for pair, _, role, text in sorted(kept):
        out.setdefault(pair, []).append((role, text))
    return out


def expected(chosen, rejected):
    a, b = clean(chosen), clean(rejected)
    out = []
    for pair in a.keys() | b.keys():
        x, y = a.get(pair, []), b.get(pair, [])
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        out.append(
            (pair, n, render(x[:n]), render(x[n:]), render(y[n:]), trained(x[n:]), trained(y[n:]))
        )
    return sorted(out)


def found(spark, chosen, rejected):
    schema = "pair_id long, turn long, role string, text string"
    sides = [spark.createDataFrame(x, schema).selectExpr("*", "1 as side", "2 as n") for x in (chosen, rejected)]
    rows = preferences.preference_pairs(*sides).collect()
    return sorted(
        (*r[:5], *[[(s.start, s.end) for s in spans] for spans in r[5:]]) for r in rows
    )


def test_same_as_plain_rendering(spark):
    rng = random.Random(1)
    roles, texts = ["system", "user", "assistant"], ["yes", "no", "ünï", "", "a\nb", "<|end|>"]
    chosen, rejected = [], []
    for pair in range(60):
        turns = [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(0, 6))]
        other = [x if rng.random() < 0.8 else (x[0], rng.choice(roles), "no") for x in turns]
        chosen += [(pair, *x) for x in turns]
        rejected += [(pair, *x) for x in other[: rng.randint(0, 6)]]
    rng.shuffle(chosen)
    assert found(spark, chosen, rejected) == expected(chosen, rejected)


def test_edge_rows(spark):
    chosen = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, "x"),
        (2, 0, "user", "only chosen"), (None, 0, "user", "no pair"), (3, 0, "user", "same"),
        (4, 0, "user", "w" * 100_000), (4, 1, "assistant", "a"), (5, 1, "b", "tie"), (5, 1, "a", "tie"),
    ]
    rejected = [
        (1, None, None, "x"), (1, 0, "user", "hi"), (1, 1, "assistant", "other"), (3, 0, "user", "same"),
        (4, 0, "user", "w" * 100_000), (4, 2, "assistant", "b"), (6, 0, "assistant", "only rejected"),
        (5, 1, "a", "tie"),
    ]
    rows = found(spark, chosen, rejected)
    assert rows == expected(chosen, rejected)
    assert rows[0][1] == 2 and rows[2][3:5] == ("", "")
    assert found(spark, [], []) == []


def test_one_hot_pair(spark):
    turns = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    other = [*turns[:2500], *[(1, t, "user", "else") for t in range(2500, 2600)]]
    row = found(spark, turns, other)[0]
    assert row[1] == 2500 and len(row[5]) == 250


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = preferences.preference_pairs(*preferences.swapped_replies(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def plain_swaps(rows):
    """Chosen and rejected turns by a sorted list of all conversations with replies."""
    replies = {}
    for conv in sorted({r[0] for r in rows if r[0] is not None}):
        mine = sorted({(r[1], r[3] or "") for r in rows if r[0] == conv and r[2] == "assistant" and r[1] is not None})
        if mine:
            replies[conv] = mine[conv % len(mine)]
    order = sorted(replies)
    chosen = [r for r in rows if r[0] in replies]
    rejected = []
    for at, conv in enumerate(order):
        turn, other = replies[conv][0], replies[order[(at + 1) % len(order)]][1]
        rejected += [r for r in rows if r[0] == conv and (r[1] is None or r[1] < turn)]
        rejected.append((conv, turn, "assistant", other))
    return chosen, rejected


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_swapped_replies(spark, parts):
    rng = random.Random(6)
    rows = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "thanks"), (2, 0, "user", "alone"),
        (3, 0, "assistant", "a3"), (-7, 4, "assistant", None), (None, 0, "assistant", "n"),
        (8, None, "assistant", "no number"), (9, None, "user", "first"), (9, 1, "assistant", "a9"),
        (10**12, 1, "assistant", "far"), (10**12, 1, "assistant", "tie"),
    ]
    for conv in rng.sample(range(20, 5000), 60):
        rows += [
            (conv, t, "assistant" if t % 2 else "user", f"{conv} {t}") for t in range(rng.randint(1, 9))
        ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = [sorted(map(str, map(tuple, x.collect()))) for x in preferences.swapped_replies(df)]
        prompts = preferences.preference_pairs(*preferences.swapped_replies(df)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == [sorted(map(str, x)) for x in plain_swaps(rows)]
    with_reply = {r[0] for r in rows if r[0] is not None and r[2] == "assistant" and r[1] is not None}
    assert {r.pair_id for r in prompts} == with_reply
    assert len({r.prompt_turns for r in prompts}) >= 5


def test_one_conversation_swaps_with_itself(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = preferences.preference_pairs(*preferences.swapped_replies(df)).first()
    assert (row.prompt_turns, row.rejected) == (2, "") and "more" in row.chosen
    assert preferences.preference_pairs(*preferences.swapped_replies(df.limit(0))).collect() == []
