"""Which nodes stay if a node goes behind an earlier linked one that stays.

Taken in order, a node goes if any earlier node it is linked to stays, else it stays. Along a chain
of links each node waits for the one before, so rounds that decide what no longer waits take as
many rounds as the chain is long. Here chains are contracted instead: a node that waits for one
other only is the opposite of it, and pointers along such nodes are doubled until they end at a
node that waits for several, or none. What waits for a contracted node waits for the end of its
chain from then on, or for the opposite of that. A chain of n links takes about log2(n) doublings,
each a join; a tree about log2(n) contractions of that kind. Nothing but a count reaches the
driver, until at most ``at_once`` links are left, which it decides itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shopledger.llm.common import stored

NODE = ["high", "low"]


def _gone_at_once(
    links: np.ndarray, opposite: np.ndarray, early_gone: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links, and whether each goes; rows are a node and an earlier one."""
    n = len(links)
    nodes, at = np.unique(links.reshape(-1, 2), axis=0, return_inverse=True)
    late, early = at.reshape(n, 2).T
    order = np.argsort(early, kind="stable")
    later, turned = late[order].tolist(), opposite[order].tolist()
    bounds = np.searchsorted(early[order], np.arange(len(nodes) + 1)).tolist()
    waiting = np.bincount(late, minlength=len(nodes)).tolist()
    told = np.zeros(len(nodes), bool)
    told[early[early_gone]] = True
    gone = told.tolist()
    ready = [k for k, left in enumerate(waiting) if not left]
    while ready:
        now = ready.pop()
        for at_link in range(bounds[now], bounds[now + 1]):
            k = later[at_link]
            gone[k] = gone[k] or gone[now] == turned[at_link]
            waiting[k] -= 1
            if not waiting[k]:
                ready.append(k)
    return nodes, np.array(gone, bool)


def _ends(pointers: DataFrame) -> DataFrame:
    """Pointers (``node``, ``end``, ``flips``) doubled until they end outside the nodes."""
    while True:
        ahead = pointers.select(
            F.col("node").alias("end"), F.col("end").alias("next"), F.col("flips").alias("more")
        )
        joined = pointers.join(ahead, "end", "left")
        doubled = joined.select(
            "node",
            F.coalesce("next", "end").alias("end"),
            (F.col("flips") != F.coalesce("more", F.lit(False))).alias("flips"),
            F.col("next").isNotNull().alias("moved"),
        )
        pointers = stored(doubled, "chain-pointers")
        if pointers.where("moved").isEmpty():
            return pointers.select("node", "end", "flips")
        pointers = pointers.select("node", "end", "flips")


def _marked(links: DataFrame, gone_now: DataFrame | None) -> DataFrame:
    """Links with ``early_gone``: whether the earlier node is known to go."""
    if gone_now is None:
        return links.withColumn("early_gone", F.lit(False))
    told = gone_now.select(F.col("node").alias("early"), F.lit(True).alias("told"))
    marked = links.join(told, "early", "left")
    return marked.withColumn("early_gone", F.coalesce("told", F.lit(False))).drop("told")


def _at_once(links: DataFrame) -> DataFrame:
    """Nodes that go, decided by the driver."""
    sides = ["late.high", "late.low", "early.high", "early.low"]
    rows = links.select(*sides, "opposite", "early_gone").toArrow()
    columns = [c.to_numpy() for c in rows.columns]
    nodes, gone_here = _gone_at_once(
        np.column_stack(columns[:4]), *[c.astype(bool) for c in columns[4:]]
    )
    table = pa.table({name: nodes[gone_here, k] for k, name in enumerate(NODE)})
    made = links.sparkSession.createDataFrame(table)
    return stored(made.select(F.struct(*NODE).alias("node")), "chain-rest")


def gone(links: DataFrame, at_once: int) -> DataFrame:
    """``high`` and ``low`` of the nodes that go.

    ``links``: ``high``, ``low``, ``other_high``, ``other_low``, the other node being earlier.
    In a round a link may also be ``opposite``: then its node goes if the earlier one goes.
    """
    late = F.struct("high", "low").alias("late")
    early = F.struct(F.col("other_high").alias("high"), F.col("other_low").alias("low")).alias("early")
    left = stored(links.select(late, early, F.lit(False).alias("opposite")).distinct(), "chain-left")
    going: DataFrame | None = None  # nodes found to go in the last round
    found, contracted = [], []
    while (n := left.count()) > at_once:
        # What waits for nothing is known: it went in the last round, or it stays.
        waiting = left.select(F.col("late").alias("early")).distinct().withColumn("waits", F.lit(True))
        marked = _marked(left, going).join(waiting, "early", "left")
        marked = stored(marked, "chain-marked")
        known = F.col("waits").isNull()
        behind = marked.where(known & (F.col("early_gone") == F.col("opposite"))).select("late")
        # What waits for a node and for its opposite goes as well.
        rest = marked.where(~known).select("late", "early", "opposite")
        both = rest.groupBy("late", "early").agg(F.count_distinct("opposite").alias("n")).where("n > 1")
        going = stored(
            behind.unionByName(both.select("late")).distinct().withColumnRenamed("late", "node"),
            "chain-going",
        )
        found.append(going)
        rest = rest.join(going.select(F.col("node").alias("late")), "late", "left_anti")
        rest = stored(rest, "chain-open")
        # Chains: nodes that wait for one other.
        one = rest.groupBy("late").agg(
            F.count("*").alias("n"), F.first("early").alias("end"), F.first("opposite").alias("o")
        )
        pointers = one.where("n = 1").select(F.col("late").alias("node"), "end", (~F.col("o")).alias("flips"))
        ends = _ends(stored(pointers, "chain-pointers"))
        contracted.append(ends)
        others = rest.join(ends.select(F.col("node").alias("late")), "late", "left_anti")
        moved = others.join(ends.withColumnRenamed("node", "early"), "early", "left").select(
            "late",
            F.coalesce("end", "early").alias("early"),
            (F.col("opposite") != F.coalesce("flips", F.lit(False))).alias("opposite"),
        )
        left = stored(moved.distinct(), "chain-left")
        if left.isEmpty():
            n = 0
            break
    if n:
        found.append(_at_once(_marked(left, going)))
    if not found:
        return links.select("high", "low").limit(0)
    fates = reduce(DataFrame.unionByName, found).distinct()
    # Ends that are not known to go stay; chains are resolved from the last contraction on.
    for ends in reversed(contracted):
        end = fates.select(F.col("node").alias("end"), F.lit(True).alias("gone"))
        resolved = ends.join(end, "end", "left")
        more = resolved.where(F.col("flips") != F.coalesce("gone", F.lit(False))).select("node")
        fates = stored(fates.unionByName(more).distinct(), "chain-fates")
    return fates.select("node.high", "node.low")
