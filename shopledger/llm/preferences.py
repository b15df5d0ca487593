"""Preference pairs from chosen and rejected conversations, with DataFrame functions only.

Both conversations of a pair are put in turn order. The longest run of turns from the
start that is equal in both is the prompt and is rendered once; what follows in each is
its completion. Trained are the assistant's words and the end mark after them; headers
and everybody else's turns in a completion are masked.

A pair is one training example and one row of the result, so its turns, and no others,
meet in one row: one shuffle by pair.

Rows without pair are left out; rows that are equal in all columns count once; turns with
one number are ordered by role and text; null turns come first; a null role is
``unknown`` and a null text is empty. A pair of which one conversation is missing has an
empty prompt, and of two equal ones both completions are empty. Text that spells a mark
gets a space into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _turns(side: int) -> Column:
    turn = F.struct("turn", "role", "text")
    return F.sort_array(F.collect_set(F.when(F.col("side") == side, turn)))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _trained_spans(turns: Column) -> Column:
    """Start and end, in characters of the rendered turns, of what is trained on."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(turn["role"]) + len(OPEN) + len(CLOSE)
        end = begin + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        trained = turn["role"] == TRAINED_ROLE
        spans = F.when(trained, F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def _rows(conversations: DataFrame, side: int, pair_col: str) -> DataFrame:
    return conversations.where(F.col(pair_col).isNotNull()).select(
        F.col(pair_col).cast("long").alias("pair_id"),
        F.lit(side).alias("side"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(OPEN), F.lit("< |")).alias("text"),
    )


def preference_pairs(
    chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id"
) -> DataFrame:
    """One row per pair, from two tables of turns (``pair_id``, ``turn``, ``role``, ``text``).

    ``prompt``, ``chosen`` and ``rejected`` are rendered texts; ``chosen_spans`` and
    ``rejected_spans`` say which characters of a completion are trained on.
    """
    rows = _rows(chosen, 0, pair_col).unionByName(_rows(rejected, 1, pair_col))
    sides = rows.groupBy("pair_id").agg(_turns(0).alias("a"), _turns(1).alias("b"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False))

    # The shorter side is filled up with nulls, which are equal to nothing.
    first_difference = F.array_position(F.zip_with("a", "b", same), False)
    n = F.when(first_difference == 0, F.size("a")).otherwise(first_difference - 1).cast("int")
    cut = sides.withColumn("n", n).select(
        "pair_id",
        "n",
        F.slice("a", F.lit(1), F.col("n")).alias("shared"),
        F.slice("a", F.col("n") + 1, F.size("a")).alias("a"),
        F.slice("b", F.col("n") + 1, F.size("b")).alias("b"),
    )
    return cut.select(
        "pair_id",
        F.col("n").alias("prompt_turns"),
        _text(F.col("shared")).alias("prompt"),
        _text(F.col("a")).alias("chosen"),
        _text(F.col("b")).alias("rejected"),
        _trained_spans(F.col("a")).alias("chosen_spans"),
        _trained_spans(F.col("b")).alias("rejected_spans"),
    )


def _next_replies(replies: DataFrame) -> DataFrame:
    """``pair_id`` and ``swapped``: the reply of the next conversation that has one, of the last the first's.

    Ids are cut at quantiles into parts of about equal size. Within a part the next row is told
    by a window over the part; the last row of a part takes the first of the next part that has
    rows, so no window goes over all conversations, and gaps between ids do not matter.
    """
    parts = int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    quantiles = replies.agg(F.percentile_approx("pair_id", shares, 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(quantiles))]).cast("array<long>")
    placed = replies.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.col("pair_id"))))
    within = Window.partitionBy("part").orderBy("pair_id")
    # One row for each part reaches the unpartitioned windows.
    firsts = placed.groupBy("part").agg(F.min(F.struct("pair_id", "reply"))["reply"].alias("first"))
    by_part = Window.orderBy("part")
    carried = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(by_part), F.first("first").over(by_part)).alias("carried"),
    )
    rows = placed.withColumn("following", F.lead("reply").over(within)).join(carried, "part")
    return rows.select("pair_id", F.coalesce("following", "carried").alias("swapped"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns out of plain conversations (``conv_id`` becomes ``pair_id``).

    Every conversation with an assistant's turn that has a number gives a pair. Chosen is all of
    it. Rejected is the same up to one of these turns, whose text comes from the next conversation,
    and ends there. Which turn it is depends on the id, the number of replies being the divisor, so
    prefixes end at different depths; of equal turn numbers the replies are ordered by text.
    A conversation that has no other to swap with has two sides that differ in their end alone.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text",
    ).where("pair_id is not null")
    reply = F.struct("turn", F.coalesce("text", F.lit("")).alias("reply"))
    replies = (
        turns.where((F.col("role") == TRAINED_ROLE) & F.col("turn").isNotNull())
        .groupBy("pair_id")
        .agg(F.sort_array(F.collect_set(reply)).alias("all"))
        .withColumn("one", F.get("all", F.pmod("pair_id", F.size("all")).cast("int")))
        .select("pair_id", F.col("one.turn").alias("swap_turn"), F.col("one.reply").alias("reply"))
    )
    swaps = replies.select("pair_id", "swap_turn").join(_next_replies(replies), "pair_id")
    placed = turns.join(swaps, "pair_id")
    columns = ["pair_id", "turn", "role", "text"]
    before = placed.where(F.col("turn").isNull() | (F.col("turn") < F.col("swap_turn")))
    swapped = swaps.select(
        "pair_id",
        F.col("swap_turn").alias("turn"),
        F.lit(TRAINED_ROLE).alias("role"),
        F.col("swapped").alias("text"),
    )
    return placed.select(*columns), before.select(*columns).unionByName(swapped)


def spans_as_text(spans: Column) -> Column:
    """Spans as ``start-end`` joined by commas."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )
