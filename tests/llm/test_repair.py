"""Repair of conversations against an exhaustive and a best-first search."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shopledger.llm import repair

SPACE = " \t\n\v\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = text.rstrip(SPACE)
        fault = (
            "blank" if not kept
            else "duplicate" if (role, text) in seen
            else "truncated" if kept[-1] not in ".!?"
            else ""
        )
        seen.add((role, text))
        out.append(fault)
    return out


def best_first(rows, faults):
    """Cheapest edits, least audit among them: paths are taken up by cost, then audit."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, last, out = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (at, last) in seen:
            continue
        seen.add((at, last))
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in ("user", "assistant"):
            if role[0] in after:
                heapq.heappush(queue, (cost + 3, audit + "I", at, role[0], (*out, f"{role}:")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, last, out))
            if faults[at] in ("blank", "duplicate"):
                continue
            more = 3 if faults[at] == "truncated" else 0
            if role[:1] and role[:1] in after:
                kept = (*out, f"{role}:{text}")
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, role[0], kept))
            for new in ("user", "assistant"):
                if new[0] in after:
                    made = (*out, f"{new}:{text}")
                    heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, new[0], made))


def exhaustive(rows, faults):
    """Every way to edit, with up to two inserts at each place."""
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    best = None
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for k, (gap, edit) in enumerate(itertools.zip_longest(gaps, edits)):
                cost, audit, roles = cost + 3 * len(gap), audit + "I" * len(gap), roles + "".join(gap)
                if edit is None:
                    continue
                audit += edit[0]
                if edit == "D":
                    cost += 4
                    continue
                cost += 3 * (edit != "K") + 3 * (faults[k] == "truncated")
                if faults[k] in ("blank", "duplicate"):
                    cost += 1000
                roles += rows[k][2][:1] if edit == "K" else edit[1]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def order(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3])


def expected(original, rows):
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        faults = faults_of(mine)
        cost, audit, kept = best_first(mine, faults)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        counted = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append(str((conv, gaps, *counted, illegal, cost, audit, digest)))
    return sorted(out)


COLUMNS = [
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
]
TEXTS = ["Hi.", "Hi", "What? ", "", " \n", "So it is!", "Well", "Yes.\n", "Ünd.", "No…"]


def rows_of(rng, conv, n, most=12):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "U", None]
    return [
        (conv, rng.choice([*range(most), None]), rng.choice(roles), rng.choice([*TEXTS, None, f"T{k}."]))
        for k in range(n)
    ]


def case(seed):
    rng = random.Random(seed)
    rows = [r for conv in range(40) for r in rows_of(rng, conv, rng.randint(1, 9))]
    rows += rows_of(rng, None, 7) + rows_of(rng, 900, 150, 60) + rows_of(rng, 901, 60, 300)
    rows += [(902, 5, "user", "Same.")] * 40 + [(903, 2**40, "user", "Far."), (903, 1, "user", "Near.")]
    return rows + rows[:30]


@pytest.mark.parametrize("most", [repair.BLOCK_TURNS, 5])
def test_same_as_best_first_search(spark, most):
    rows = case(3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as copies", "2 as fault", "'x' as digest").repartition(5)
    turns = repair.damaged(df)
    assert sorted(str(tuple(r)) for r in turns.collect()) == sorted(map(str, plain_damage(rows)))
    found = repair.report(turns, df, most).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in found) == expected(rows, plain_damage(rows))
    # Undamaged input as well: one interface for any turns.
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = repair.report(df, df, most).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in found) == expected(rows, whole)


def test_same_as_every_repair():
    rng = random.Random(8)
    names = {"": 0, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATION}
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3):
        roles = [rng.choice(["user", "assistant", "system", "tool"]) for _ in range(n)]
        faults = [rng.choice(["", "", "", *names]) for _ in range(n)]
        rows = [(0, k, role, "x") for k, role in enumerate(roles)]
        kinds = [names[f] for f in faults]
        steps = repair.steps_of(roles, kinds)
        content = ([0] * n, roles, ["x"] * n, [1] * n, kinds)
        audit, cost, _ = repair.repaired_block(*content, 0, repair.last_state(steps), True)
        assert (cost, audit) == exhaustive(rows, faults) == best_first(rows, faults)[:2]


def test_tables_of_blocks_say_the_same_as_turns():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(2, 60)
        roles = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(n)]
        kinds = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        steps = repair.steps_of(roles, kinds)
        cuts = [0, *sorted(rng.sample(range(1, n), min(n - 1, 4))), n]
        tables = [repair.moves_of(repair.table_of(steps[a:b])) for a, b in zip(cuts, cuts[1:])]
        last = repair.last_state(steps)
        assert repair.last_state(tables) == last
        at = repair.crossings(steps, repair.START, last)
        assert repair.crossings(tables, repair.START, last) == [at[c] for c in cuts]


def test_repaired_turns_are_whole(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(200)]
    rows = [r for r in rows if r[1] not in (0, 77)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repaired_turns(repair.with_faults(df), most=16)
    made = found.orderBy("part", "seq", "place").collect()
    assert [r.turn for r in made] == [None, *range(1, 77), None, *range(78, 200)]
    assert re.fullmatch("(ua)+", "".join(r.role[0] for r in made))
    assert all(r.text == (f"Turn {r.turn}." if r.turn is not None else "") for r in made)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(df, df).collect() == []
    one = spark.createDataFrame([(4, 1, "user", "A.")], df.schema)
    row = repair.report(one.limit(0), one).select(*COLUMNS).first()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_a_hot_conversation_lies_in_several_blocks(spark):
    rows = [(7, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = repair.blocks(repair.with_faults(df), most=100)
    assert blocks.where("not whole").count() >= 30
    assert blocks.select(F.max(F.size("roles"))).first()[0] == 100
