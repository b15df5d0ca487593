"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's turns, in order, become one whose roles read ``(s?(ua)+)?`` (initials: system,
user, assistant) by the cheapest edits: Keep costs 0, Rerole to user or assistant 3, Delete 4,
Insert of an empty turn of user or assistant 3; a truncated turn that stays costs 3 more. Blank
and duplicate turns must go. The audit is the initials of the edits in order; of equally cheap
repairs the one whose audit is least as ASCII counts.

The grammar has four states: the role that was last, or none. In each only one of user and
assistant can follow, so a state and an edit give the next state, and a path is known by its audit.
A vector has, for each state, the least cost to get there and the rank of the least audit
among the four. A forward vector and a backward one meet in the middle; of the states whose
costs add up to the least, the one whose audit so far is least is the crossing. Both halves
are then repaired between known states in the same way, in space of the length alone. (Audits that
end with the same turn never begin with one another, so what follows cannot change their order.)

A long conversation is never in one task. Rows are sorted by range, conversation and turn, so
that a conversation may lie in several partitions; each partition cuts its conversations into
blocks of bounded size, and a block's turns become a table of costs and ranks from each state
to each other. The same divide and conquer over these tables (one task has the tables of a
conversation, 32 numbers for up to 4,096 turns) gives the states between blocks; then each
block is repaired by itself. Only the digest of a repaired text reads it in order, block by
block, packed, in constant memory.

Turns are ordered by turn (nulls first), then role and text. Equal turns of one number stand side
by side; they are kept as one row with their count, since all but the first are duplicates.
Nulls in role or text are one space. A null id is one conversation. Initials other than
s, u and a, or none, cannot be kept. Blank: nothing but ASCII white space. Duplicate:
role and text stood earlier. Truncated: the last character that is no ASCII white space is not
one of ``.!?``. Only a turn's first fault counts, in this order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from shopledger.llm.common import map_batches, stored

BLOCK_TURNS, BLOCK_CHARS = 4096, 4 << 20
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
# The state that a user's or an assistant's turn leads to: only one of them can follow.
FOLLOW = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Turns to be inserted behind the last one until a conversation may end.
MISSING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60

BLANK, DUPLICATE, TRUNCATION = 1, 2, 3  # faults; 0 is none

# From each state to each that can be reached: the cost, and what orders the ways there.
Moves = list[dict[int, tuple[int, object]]]
Vector = tuple[list[int], list[int]]  # costs and ranks of the four states


def _moves(initial: int, fault: int) -> Moves:
    """The best edits of one turn, with inserts before it, from each state to each other."""
    extra = TRUNCATED if fault == TRUNCATION else 0
    moves: Moves = []
    for begin in STATES:
        best: dict[int, tuple[int, object]] = {}
        state, cost, letters = begin, 0, ""
        for _ in range(3):  # after three inserts a state comes again
            found = [(state, cost + DELETE, letters + "D")]
            if fault not in (BLANK, DUPLICATE):
                if initial and initial == (SYSTEM if initial == SYSTEM else FOLLOW[state]):
                    if initial != SYSTEM or state == START:
                        found.append((initial, cost + extra, letters + "K"))
                found.append((FOLLOW[state], cost + REROLE + extra, letters + "R"))
            for end, price, edits in found:
                best[end] = min(best.get(end, (FAR, "")), (price, edits))
            state, cost, letters = FOLLOW[state], cost + INSERT, letters + "I"
        moves.append(best)
    return moves


# All kinds of turns: initial (0: none of the three) and fault.
TURN_MOVES = {(i, f): _moves(i, f) for i in range(4) for f in range(4)}


def at_state(state: int) -> Vector:
    return [0 if s == state else FAR for s in STATES], [0] * 4


def forward(steps: list[Moves], vector: Vector) -> Vector:
    """Least costs behind the steps, and the order of the least audits."""
    costs, ranks = vector
    for moves in steps:
        best: list = [None] * 4
        for begin in STATES:
            cost = costs[begin]
            if cost < FAR:
                rank = ranks[begin]
                for end, (price, order) in moves[begin].items():
                    found = (cost + price, rank, order)
                    if best[end] is None or found < best[end]:
                        best[end] = found
        costs = [FAR if b is None else b[0] for b in best]
        ranks = [0] * 4
        reached = [(b[1], b[2], end) for end, b in enumerate(best) if b is not None]
        for rank, (_, _, end) in enumerate(sorted(reached)):
            ranks[end] = rank
    return costs, ranks


def backward(steps: list[Moves], costs: list[int]) -> list[int]:
    """Least costs from each state before the steps, given those behind them."""
    for moves in reversed(steps):
        costs = [min((p + costs[end] for end, (p, _) in m.items()), default=FAR) for m in moves]
    return costs


def crossings(steps: list[Moves], begin: int, end: int) -> list[int]:
    """The states before, between and behind the steps on the cheapest, audit-least way."""
    if len(steps) < 2:
        return [begin, end] if steps else [begin]
    middle = len(steps) // 2
    costs, ranks = forward(steps[:middle], at_state(begin))
    rest = backward(steps[middle:], at_state(end)[0])
    meet = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
    left = crossings(steps[:middle], begin, meet)
    return left + crossings(steps[middle:], meet, end)[1:]


def last_state(steps: list[Moves]) -> int:
    """The state behind the last turn of a whole conversation."""
    costs, ranks = forward(steps, at_state(START))
    return min(STATES, key=lambda s: (costs[s] + INSERT * MISSING[s], ranks[s]))


def table_of(steps: list[Moves]) -> list[int]:
    """Costs and ranks from each state to each other over a block, as 32 numbers."""
    out: list[int] = []
    for begin in STATES:
        costs, ranks = forward(steps, at_state(begin))
        out += costs + ranks
    return out


def moves_of(table: list[int]) -> Moves:
    """A block's table as moves; what can not be reached is left out."""
    rows = [(table[k : k + 4], table[k + 4 : k + 8]) for k in range(0, 32, 8)]
    return [{s: (c[s], r[s]) for s in STATES if c[s] < FAR} for c, r in rows]


def _kept_whole(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str):
    space = F.lit(" ")
    return df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"),
    )


def damaged(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Turns damaged by ``crc32(conv_id:turn) % 20`` (nulls: one space), for trials of the repair.

    0 drops the row, 1 empties the text, 2 takes its full stops, exclamation and question
    marks, 3 repeats the row, 4 makes the role user.
    """
    rows = _kept_whole(df, conv_col, turn_col, role_col, text_col)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return (
        rows.withColumn("kind", kind)
        .where("kind != 0")
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
        .withColumn("times", F.explode(F.sequence(F.lit(1), "times")))
        .drop("times")
    )


def with_faults(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Distinct turns with ``copies`` (how often each stands there) and ``fault`` of the first copy."""
    rows = _kept_whole(df, conv_col, turn_col, role_col, text_col)
    turns = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    turns = turns.withColumn("digest", F.sha2("text", 256))
    # The first turn that a conversation has a text of a role in; structs order nulls first.
    first = turns.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct("turn")).alias("first")
    )
    t, f = turns.alias("t"), first.alias("f")
    same = (
        F.col("t.conv_id").eqNullSafe(F.col("f.conv_id"))
        & (F.col("t.role") == F.col("f.role"))
        & (F.col("t.digest") == F.col("f.digest"))
    )
    earlier = ~F.col("t.turn").eqNullSafe(F.col("f.first.turn"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(earlier, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATION)
        .otherwise(0)
    )
    return t.join(f, same).select(
        "t.conv_id", "t.turn", "t.role", "t.text", "t.copies", fault.alias("fault")
    )


def counts(turns: DataFrame) -> DataFrame:
    """Of ``with_faults``: gaps between turn numbers, and turns by their first fault."""

    def of(fault: int):
        first = F.when(F.col("fault") == fault, 1).otherwise(0)
        if fault == DUPLICATE:  # copies beyond the first, unless they are blank
            first = F.when(F.col("fault") == BLANK, 0).otherwise(first + F.col("copies") - 1)
        elif fault == BLANK:
            first = first * F.col("copies")
        return F.sum(first)

    names = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATION}
    numbers = turns.groupBy("conv_id", "turn").agg(*[of(f).alias(n) for n, f in names.items()])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return numbers.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(n).alias(n) for n in names]
    )


BLOCK_SCHEMA = (
    "conv_id long, part int, seq int, whole boolean, table array<long>, illegal long, "
    "first string, last string, turns array<long>, roles array<string>, texts array<string>, "
    "copies array<long>, faults array<int>"
)
BLOCK_KINDS = [
    pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.int64(),
    pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()),
    pa.list_(pa.int64()), pa.list_(pa.int32()),
]


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def steps_of(roles: list[str], faults: list[int]) -> list[Moves]:
    return [TURN_MOVES[INITIALS.get(r[:1], 0), f] for r, f in zip(roles, faults)]


def _illegal(initials: list[str], copies: list[int]) -> int:
    """Neighbours that may not be; the copies of a turn never may."""
    pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return pairs + sum(copies) - len(copies)


def blocks(turns: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """Turns in order as blocks; ``whole`` if a block is known to be all of its conversation."""

    def cut(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        block, size = [], 0
        for row in rows:
            if block and (len(block) == most or size + len(row[3]) > BLOCK_CHARS):
                yield block
                block, size = [], 0
            block.append(row)
            size += len(row[3])
        yield block

    def row_of(part: int, seq: int, block: list[tuple], whole: bool) -> tuple:
        conv_id, turns, roles, texts, copies, faults = (list(c) for c in zip(*block))
        initials = [role[:1] for role in roles]
        table = None if whole else table_of(steps_of(roles, faults))
        return (
            conv_id[0], part, seq, whole, table, _illegal(initials, copies), initials[0],
            initials[-1], turns, roles, texts, copies, faults,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        out, size, before = [], 0, None
        for number, (_, mine) in enumerate(groupby(rows, key=lambda row: row[0])):
            # The last conversation so far: not the last of the partition, as another began.
            if before is not None:
                out.append(row_of(part, 0, before, number > 1))
                before = None
            previous = None
            for seq, block in enumerate(cut(mine)):
                if previous is not None:
                    out.append(row_of(part, seq - 1, previous, False))
                previous = block
                size += sum(len(row[3]) for row in block)
                if len(out) >= 256 or size > BLOCK_CHARS:
                    yield _batch(out, BLOCK_KINDS, names)
                    out, size = [], 0
            if seq:
                out.append(row_of(part, seq, previous, False))
            else:
                before = previous
        if before is not None:
            out.append(row_of(part, 0, before, False))
        yield _batch(out, BLOCK_KINDS, names)

    names = _names(BLOCK_SCHEMA)
    order = ["conv_id", "turn", "role", "text"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return map_batches(placed.select(*order, "copies", "fault"), run, BLOCK_SCHEMA)


STATE_SCHEMA = "conv_id long, part int, seq int, begin int, end int, final boolean, between long"


def states(open_blocks: DataFrame) -> DataFrame:
    """States before and behind each block of conversations of several blocks.

    ``between`` counts an illegal neighbourhood with the block before.
    """
    kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        for conv_id, mine in groupby(rows, key=lambda row: row[0]):
            mine = list(mine)
            steps = [moves_of(row[3]) for row in mine]
            at = crossings(steps, START, last_state(steps))
            out, last = [], None
            for k, (_, part, seq, _, first, final) in enumerate(mine):
                between = int(last is not None and last + first not in LEGAL)
                out.append((conv_id, part, seq, at[k], at[k + 1], k + 1 == len(mine), between))
                last = final
            yield _batch(out, kinds, _names(STATE_SCHEMA))

    slim = open_blocks.select("conv_id", "part", "seq", "table", "first", "last")
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return map_batches(ordered, run, STATE_SCHEMA)


PIECE_SCHEMA = (
    "conv_id long, part int, seq int, whole boolean, audit string, cost long, illegal long, "
    "repaired array<struct<turn:long,role:string,text:string>>"
)
PIECE_KINDS = [
    pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(),
    pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])),
]


def repaired_block(
    turns: list, roles: list, texts: list, copies: list, faults: list,
    begin: int, end: int, final: bool,
) -> tuple[str, int, list[dict]]:
    """Audit, cost and repaired turns of a block between known states."""
    steps = steps_of(roles, faults)
    at = crossings(steps, begin, end)
    audit, cost, out = [], 0, []

    def add(turn, role: str, text: str) -> None:
        out.append({"turn": turn, "role": role, "text": text})

    for k, moves in enumerate(steps):
        price, edits = moves[at[k]][at[k + 1]]
        state = at[k]
        for _ in edits[:-1]:
            state = FOLLOW[state]
            add(None, ROLES[state], "")
        if edits[-1] != "D":
            add(turns[k], roles[k] if edits[-1] == "K" else ROLES[at[k + 1]], texts[k])
        audit.append(edits + "D" * (copies[k] - 1))
        cost += price + DELETE * (copies[k] - 1)
    if final:
        state = end
        for _ in range(MISSING[end]):
            state = FOLLOW[state]
            add(None, ROLES[state], "")
            audit.append("I")
            cost += INSERT
    return "".join(audit), cost, out


def repairs(turns: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """Of ``with_faults``: audit, cost and repaired turns of every block, in ``part`` and ``seq`` order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                begin, end, final = row["begin"], row["end"], row["final"]
                if row["whole"]:
                    steps = steps_of(row["roles"], row["faults"])
                    begin, end, final = START, last_state(steps), True
                content = [row[c] for c in ("turns", "roles", "texts", "copies", "faults")]
                audit, cost, repaired = repaired_block(*content, begin, end, final)
                place = (row["conv_id"], row["part"], row["seq"], row["whole"])
                out.append((*place, audit, cost, row["illegal"] + row["between"], repaired))
            yield _batch(out, PIECE_KINDS, _names(PIECE_SCHEMA))

    held = stored(blocks(turns, most), "blocks")
    opened, place = held.where("not whole"), ["conv_id", "part", "seq"]
    found = states(opened)
    same = (
        F.col("b.conv_id").eqNullSafe(F.col("s.conv_id"))
        & (F.col("b.part") == F.col("s.part"))
        & (F.col("b.seq") == F.col("s.seq"))
    )
    content = ["illegal", "turns", "roles", "texts", "copies", "faults"]
    known = opened.alias("b").join(found.alias("s"), same).select(
        *[f"b.{c}" for c in [*place, "whole", *content]], "begin", "end", "final", "between"
    )
    whole = held.where("whole").select(
        *place, "whole", *content, F.lit(0).alias("begin"), F.lit(0).alias("end"),
        F.lit(True).alias("final"), F.lit(0).cast("long").alias("between"),
    )
    return map_batches(whole.unionByName(known), run, PIECE_SCHEMA)


def repaired_turns(turns: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """The repaired conversations: ``conv_id``, the place, ``turn`` (null: inserted), ``role``, ``text``."""
    pieces = repairs(turns, most)
    return pieces.select(
        "conv_id", "part", "seq", F.posexplode("repaired").alias("place", "made")
    ).select("conv_id", "part", "seq", "place", "made.*")


AUDIT_SCHEMA = "conv_id long, audit string, cost long, illegal long, repaired_sha256 string"


def audits(pieces: DataFrame) -> DataFrame:
    """Of ``repairs``: audit, cost, illegal neighbours and digest of every conversation with turns.

    The digest is of the repaired ``role:text`` lines, joined by line breaks.
    """
    packed_schema = (
        "conv_id long, part int, seq int, whole boolean, audit string, cost long, illegal long, "
        "packed binary"
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            lines = [
                b"".join([f"{t['role']}:{t['text']}\n".encode() for t in row])
                for row in batch.column(7).to_pylist()
            ]
            packed = pa.array([work(x) for x in lines], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], packed], _names(packed_schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        rows = (row for b in batches for row in zip(*[b.column(k) for k in (0, 4, 5, 6, 7)]))
        out = []
        for conv_id, mine in groupby(rows, key=lambda row: row[0].as_py()):
            audit, cost, illegal, digest, held = [], 0, 0, hashlib.sha256(), b""
            for _, letters, price, pairs, packed in mine:
                audit.append(letters.as_py())
                cost, illegal = cost + price.as_py(), illegal + pairs.as_py()
                lines = unpack(packed.as_py())
                if lines:  # the last line break waits for another line
                    digest.update(held)
                    digest.update(memoryview(lines)[:-1])
                    held = b"\n"
            out.append((conv_id, "".join(audit), cost, illegal, digest.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, kinds, _names(AUDIT_SCHEMA))
                out = []
        yield _batch(out, kinds, _names(AUDIT_SCHEMA))

    packed = stored(map_batches(pieces, pack, packed_schema), "repaired")
    order = ["conv_id", "part", "seq"]
    opened = packed.where("not whole").repartition("conv_id").sortWithinPartitions(*order)
    return map_batches(packed.where("whole"), run, AUDIT_SCHEMA).unionByName(
        map_batches(opened, run, AUDIT_SCHEMA)
    )


def report(df: DataFrame, conversations: DataFrame, most: int = BLOCK_TURNS) -> DataFrame:
    """A row for every id of ``conversations``: faults and repair of its turns in ``df``.

    Both have columns ``conv_id``, ``turn``, ``role`` and ``text``. An id without turns in
    ``df`` has zeros, an empty audit and the digest of nothing.
    """
    turns = stored(with_faults(df), "turns")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("c")
    found, repair = counts(turns).alias("f"), audits(repairs(turns, most)).alias("r")
    same = lambda other: F.col("c.conv_id").eqNullSafe(F.col(f"{other}.conv_id"))
    rows = ids.join(found, same("f"), "left").join(repair, same("r"), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select(
        "c.conv_id",
        *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
