"""Exact search for the largest inner products with a paged M-tree, best first.

Vectors become integers, ``floor(256 * x)`` of each component. The inner product is no metric, so
vectors are lifted: with M the largest squared length, x gets one more component
``sqrt(M - |x|^2)`` and a query gets 0 there. Then ``d(q, x)^2 = |q|^2 + M - 2 q.x``: the nearest
lifted vectors are those of the largest products, and distances obey the triangle inequality.

The index is an M-tree in pages, stored as rows. Its top level is a bounded number of routing
vectors (a sample by hash); every vector belongs to the nearest one. Vectors of one routing
vector are one tree, or several by hash if there are many, so that a tree always fits a task.
Within a tree, an inner page has routing vectors with the covering radius of what is below and the
distance to the page's own routing vector; a leaf page has vectors with that distance.

A search takes the page of the highest bound first. What lies in a ball of radius r around c is
at least ``d(q, c) - r`` away. Before ``d(q, c)`` is computed, ``|d(q, p) - d(p, c)| - r`` with the
stored distance to the parent p often rules c out, and so with vectors in a leaf. It ends when
no bound reaches the score of the last place. Pruning never drops equal scores, which
the smaller id decides.

Queries run in two rounds. In the first, each is asked in the tree it belongs to, which gives a
last place to be beaten; in the second, in each tree whose ball may hold a better one. Queries move to
trees in blocks, vectors never move again; a tree that very many ask is given to several tasks.
Equal vectors are indexed once, with the smallest ids that can be in a result, and equal queries
are asked once, so a very common vector is one entry. With vectors in random directions no ball
can be ruled out: every query then looks at every vector, in blocks.

A vector that is null, or has a null, NaN or infinite component, takes no part. Shorter vectors count
as padded with zeros; an empty one has only zeros. A vector without id is a candidate, behind
all others of its score, and never a query. Rows of one id are rows of their own: a query's own
row is left out once, another row with its id and vector is a candidate. A vector whose squared
length does not fit a 64-bit integer raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shopledger.llm.common import map_batches, stored

SCALE = 256
PAGE, FANOUT = 128, 32
TREE_ROWS, MAX_ROUTES = 4096, 256
BLOCK_QUERIES, TREE_QUERIES = 256, 4096
# Up to this squared length all sums of products are exact as doubles.
EXACT = 1 << 53
NO_FLOOR = -(1 << 63)
SLICE_AT = 20


class Space:
    """Lifted distances for vectors of up to ``dims`` components and squared length ``longest``."""

    def __init__(self, dims: int, longest: int):
        self.dims, self.longest = dims, longest
        self.kind = np.float64 if longest < EXACT else np.int64
        # Rounding of distances and bounds is far below this.
        self.slack = 0.25 + longest * 1e-11

    def matrix(self, vectors: list[list[int]]) -> np.ndarray:
        """Vectors as rows, padded with zeros."""
        out = np.zeros((len(vectors), self.dims), np.int64)
        for row, vector in zip(out, vectors):
            row[: len(vector)] = vector
        return out

    def lengths(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lengths and lifted components."""
        squares = (vectors * vectors).sum(1)
        return squares, np.sqrt((self.longest - squares).astype(np.float64))

    def distances(self, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Lifted distances of each of some to each of the others."""
        (a, lift_a), (b, lift_b) = self.lengths(some), self.lengths(others)
        products = some.astype(self.kind) @ others.astype(self.kind).T
        squares = a[:, None] + b[None, :] - 2.0 * products
        return np.sqrt(np.maximum(squares + (lift_a[:, None] - lift_b[None, :]) ** 2, 0))

    def query_distances(self, square: int, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(float(square + self.longest) - 2.0 * products, 0))

    def bounds(self, square: int, distances: np.ndarray) -> np.ndarray:
        """The largest product with a vector at least so far away."""
        return (float(square + self.longest) - np.maximum(distances, 0) ** 2) / 2 + self.slack


class Page:
    """Entries of a node: vectors, distances to the node's own, and what is below."""

    def __init__(self, leaf: bool, vectors, parents, radii, children):
        self.leaf, self.vectors = leaf, vectors
        self.parents, self.radii, self.children = parents, radii, children


def build(space: Space, vectors: np.ndarray) -> list[Page]:
    """Pages of a tree, the root first; ``children`` are page numbers, in leaves rows of ``vectors``."""
    pages: list[Page | None] = []

    def parts_of(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """A routing row and the rows nearest to it, for each part."""
        n = min(FANOUT, -(-len(rows) // PAGE))
        routes = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
        nearest = space.distances(vectors[rows], vectors[routes]).argmin(1)
        if np.bincount(nearest).max() > len(rows) * 0.9:  # hardly a split: cut by number
            nearest = np.arange(len(rows)) * n // len(rows)
        parts = [rows[nearest == k] for k in range(n)]
        # A routing row that its own part does not have (an equal distance) is no loss.
        return [(int(routes[k]), part) for k, part in enumerate(parts) if len(part)]

    def add(rows: np.ndarray, own: int | None) -> int:
        number = len(pages)
        pages.append(None)

        def to_own(of: np.ndarray) -> np.ndarray:
            if own is None:
                return np.zeros(len(of))
            return space.distances(vectors[of], vectors[own : own + 1])[:, 0]

        if len(rows) <= PAGE:
            pages[number] = Page(True, vectors[rows], to_own(rows), np.zeros(len(rows)), rows)
            return number
        parts = parts_of(rows)
        routes = np.array([route for route, _ in parts])
        radii = [space.distances(vectors[p], vectors[r : r + 1]).max() for r, p in parts]
        children = [add(part, route) for route, part in parts]
        pages[number] = Page(
            False, vectors[routes], to_own(routes), np.array(radii), np.array(children)
        )
        return number

    add(np.arange(len(vectors)), None)
    return pages


class Best:
    """The best few (-score, id is null, id) of a query."""

    def __init__(self, keep: int, floor: int):
        self.keep, self.floor, self.rows = keep, floor, []

    def lowest(self) -> int:
        """The score that a further one must reach at least."""
        return max(self.floor, -self.rows[-1][0]) if len(self.rows) == self.keep else self.floor

    def add(self, score: int, ids: list[int | None]) -> None:
        new = [(-score, i is None, i or 0) for i in ids]
        self.rows = sorted(self.rows + new)[: self.keep]


def search(
    space: Space, pages: list[Page], ids: list, query: np.ndarray, best: Best
) -> int:
    """Put a tree's best into ``best``; how many products were computed. ``ids`` is by row."""
    square, one = int((query * query).sum()), query.astype(space.kind)
    queue: list[tuple[float, int, float | None]] = [(-np.inf, 0, None)]
    computed = 0
    while queue:
        bound, number, distance = heappop(queue)
        if -bound < best.lowest():
            break
        page = pages[number]
        if distance is None:
            alive = np.arange(len(page.vectors))
        else:
            least = np.abs(distance - page.parents) - page.radii
            alive = np.flatnonzero(space.bounds(square, least) >= best.lowest())
        if not len(alive):
            continue
        products = page.vectors[alive] @ one
        computed += len(alive)
        if page.leaf:
            for at in np.flatnonzero(products >= best.lowest()).tolist():
                if products[at] >= best.lowest():
                    best.add(int(products[at]), ids[page.children[alive[at]]])
        else:
            away = space.query_distances(square, products)
            bounds = space.bounds(square, away - page.radii[alive])
            for at in np.flatnonzero(bounds >= best.lowest()).tolist():
                child = int(page.children[alive[at]])
                heappush(queue, (-float(bounds[at]), child, float(away[at])))
    return computed


def integers(embedding: Column) -> Column:
    """Components as integers; null where the vector takes no part."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(finite, whole)


def _square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0).cast("long"), lambda s, x: s + x * x)


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """Each vector once, with its ``keep`` smallest ids; a null is the largest."""
    order = F.asc_nulls_last("vec_id")
    # Spark applies the limit in every task before rows move, so a common vector stays small.
    place = F.row_number().over(Window.partitionBy("vector").orderBy(order))
    key = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    ids = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["vec_id"])
    return few.groupBy("vector").agg(ids.alias("ids"))


def _routed(vectors: DataFrame, space: Space, routes: np.ndarray) -> DataFrame:
    """Vectors with the number of and the distance to the nearest routing vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = space.distances(space.matrix(batch.column(0).to_pylist()), sent.value)
            nearest = found.argmin(1)
            columns = [pa.array(nearest, pa.int32()), pa.array(found[np.arange(len(found)), nearest])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, "route", "away"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return map_batches(vectors, run, f"{schema}, route int, away double")


PAGE_SCHEMA = (
    "tree long, node int, leaf boolean, vectors binary, parents array<double>, "
    "radii array<double>, children array<int>, ids array<array<long>>"
)
PAGE_KINDS = [
    pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.float64()),
    pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())),
]
PAGE_NAMES = [field.split()[0] for field in PAGE_SCHEMA.split(", ")]


def index_pages(placed: DataFrame, space: Space) -> DataFrame:
    """The pages of all trees; ``children`` of a leaf count its own entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        for tree, mine in groupby(rows, key=lambda row: row[0]):
            vectors, ids = zip(*[(vector, found) for _, vector, found in mine])
            out = []
            for node, page in enumerate(build(space, space.matrix(vectors))):
                children = range(len(page.vectors)) if page.leaf else page.children.tolist()
                own = [ids[k] for k in page.children.tolist()] if page.leaf else None
                packed = page.vectors.astype("<i8").tobytes()
                out.append((tree, node, page.leaf, packed, page.parents, page.radii, children, own))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), PAGE_KINDS)]
            yield pa.RecordBatch.from_arrays(columns, PAGE_NAMES)

    ordered = placed.select("tree", "vector", "ids").repartition("tree").sortWithinPartitions("tree")
    return map_batches(ordered, run, PAGE_SCHEMA)


class Index:
    """A stored M-tree: its space, routing vectors with their balls, and pages.

    ``routes`` has for each routing vector its number, the radius of its ball and of how many
    trees its vectors are; there are at most ``MAX_ROUTES`` of them.
    """

    def __init__(self, vectors: DataFrame, tree_rows: int = TREE_ROWS):
        """Of ``vector`` and ``ids``; there must be a row."""
        spark = vectors.sparkSession
        n, dims, longest = vectors.agg(
            F.count("*"), F.max(F.size("vector")), F.max(_square(F.col("vector")))
        ).first()
        self.space = Space(dims, longest)
        n_routes = max(1, min(MAX_ROUTES, n // tree_rows))
        sample = vectors.orderBy(F.xxhash64("vector"), "vector").limit(n_routes).collect()
        self.vectors = self.space.matrix([row.vector for row in sample])
        routed = stored(_routed(vectors, self.space, self.vectors), "routed")
        balls = routed.groupBy("route").agg(F.max("away"), F.count("*")).collect()
        self.routes = [
            (route, radius, -(-size // tree_rows) if size > 2 * tree_rows else 1)
            for route, radius, size in sorted(balls)
        ]
        slices = spark.createDataFrame([(r, s) for r, _, s in self.routes], "route int, slices int")
        tree = F.shiftleft(F.col("route").cast("long"), SLICE_AT) + F.pmod(
            F.xxhash64("vector"), F.col("slices")
        )
        placed = routed.join(F.broadcast(slices), "route").withColumn("tree", tree)
        self.pages = stored(index_pages(placed, self.space), "pages")


ASK_SCHEMA = "tree long, asked array<long>, floors array<long>, vectors binary"
ASK_NAMES = ["tree", "asked", "floors", "vectors"]
ASK_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _asks(queries: DataFrame, index: Index, home: bool) -> DataFrame:
    """Blocks of queries (``query``, ``vector``, ``floor``) for each tree that they are asked in.

    ``home``: only the tree of the nearest routing vector; else all others whose ball may hold
    a vector that reaches the floor.
    """
    space = index.space
    sent = queries.sparkSession.sparkContext.broadcast((index.vectors, index.routes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, routes = sent.value
        numbers = np.array([route for route, _, _ in routes])
        radii = np.array([radius for _, radius, _ in routes])
        for batch in batches:
            mine = space.matrix(batch.column(1).to_pylist())
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            floors = batch.column(2).to_numpy(zero_copy_only=False)
            squares = (mine * mine).sum(1)
            products = mine.astype(space.kind) @ vectors[numbers].astype(space.kind).T
            away = np.sqrt(np.maximum((squares + space.longest)[:, None] - 2.0 * products, 0))
            nearest = away.argmin(1)
            least = np.maximum(away - radii, 0)
            bounds = ((squares + space.longest)[:, None] - least**2) / 2 + space.slack
            out = []
            for at, (route, _, slices) in enumerate(routes):
                here = nearest == at
                for number in range(slices):
                    first = here & (asked % slices == number)  # the tree of the first round
                    rows = np.flatnonzero(first if home else ~first & (bounds[:, at] >= floors))
                    for some in np.array_split(rows, -(-len(rows) // BLOCK_QUERIES) or 1):
                        if len(some):
                            packed = mine[some].astype("<i8").tobytes()
                            tree = route << SLICE_AT | number
                            out.append((tree, asked[some], floors[some], packed))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 4, ASK_KINDS)]
            yield pa.RecordBatch.from_arrays(columns, ASK_NAMES)

    return map_batches(queries.select("query", "vector", "floor"), run, ASK_SCHEMA)


FOUND_SCHEMA = "query long, score long, vec_id long"


def _answers(asks: DataFrame, index: Index, keep: int, tree_queries: int) -> DataFrame:
    """The best of each tree for each query asked there: ``query``, ``score``, ``vec_id``."""
    space = index.space

    def loaded(row: dict) -> tuple[Page, list | None]:
        vectors = np.frombuffer(row["vectors"], "<i8").reshape(-1, space.dims)
        content = [np.array(row[c]) for c in ("parents", "radii", "children")]
        return Page(row["leaf"], vectors.astype(space.kind), *content), row["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, mine in groupby(rows, key=lambda row: (row["tree"], row["copy"])):
            pages, ids = [], []
            for row in mine:
                if row["asked"] is None:
                    page, own = loaded(row)
                    if page.leaf:  # entries of all leaves in one list
                        page.children = page.children + len(ids)
                        ids += own
                    pages.append(page)
                    continue
                queries = np.frombuffer(row["vectors"], "<i8").reshape(-1, space.dims)
                out = []
                for query, floor, vector in zip(row["asked"], row["floors"], queries):
                    best = Best(keep, floor)
                    search(space, pages, ids, vector, best)
                    out += [(query, -s, None if none else i) for s, none, i in best.rows]
                columns = zip(*out) if out else [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["query", "score", "vec_id"]
                )

    held = stored(asks, "asks")
    copies = held.groupBy("tree").agg(
        F.ceil(F.sum(F.size("asked")) / F.lit(tree_queries)).cast("int").alias("copies")
    )
    none = {c: F.lit(None).cast(index.pages.schema[c].dataType) for c in PAGE_NAMES[1:] if c != "vectors"}
    empty = F.lit(None).cast("array<long>")
    pages = (
        index.pages.join(copies, "tree")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select("tree", "copy", *PAGE_NAMES[1:], empty.alias("asked"), empty.alias("floors"))
    )
    spread = F.pmod(F.xxhash64("asked"), F.col("copies")).cast("int")
    asking = held.join(copies, "tree").withColumns({**none, "copy": spread})
    both = pages.unionByName(asking.select(pages.columns))
    ordered = both.repartition("tree", "copy").sortWithinPartitions(
        "tree", "copy", F.asc_nulls_last("node")
    )
    return map_batches(ordered, run, FOUND_SCHEMA)


def _few(found: DataFrame, keep: int) -> DataFrame:
    place = F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    )
    return found.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def nearest(
    df: DataFrame,
    every: int = 50,
    top: int = 5,
    id_col: str = "vec_id",
    embedding_col: str = "embedding",
    tree_rows: int = TREE_ROWS,
    tree_queries: int = TREE_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``top`` largest inner products.

    Queries are the rows whose id is divisible by ``every``, candidates all other rows.
    """
    spark, keep = df.sparkSession, top + 1
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), integers(F.col(embedding_col)).alias("vector")
    ).where(F.col("vector").isNotNull())
    vectors = stored(_distinct(rows, keep), "vectors")
    if vectors.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = Index(vectors, tree_rows)
    asking = rows.where(F.col("vec_id") % every == 0)
    queries = stored(
        asking.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()),
        "queries",
    )
    first = queries.withColumn("floor", F.lit(NO_FLOOR))
    found = stored(_answers(_asks(first, index, True), index, keep, tree_queries), "found")
    floors = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.coalesce(F.when(F.col("n") == keep, F.col("least")), F.lit(NO_FLOOR))
    second = queries.join(floors, "query", "left").withColumn("floor", floor)
    more = _answers(_asks(second, index, False), index, keep, tree_queries)
    # A query's best, its own row among them; that is left out of them for each of its rows.
    key = F.struct(-F.col("score"), F.col("vec_id").isNull(), "vec_id", "score")
    lists = (
        _few(found.unionByName(more), keep)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(key)).alias("best"))
        .select("query", F.transform("best", lambda x: F.struct(x["vec_id"], x["score"])).alias("best"))
    )
    answered = asking.join(queries, "vector").join(lists, "query")
    own = F.array_position("best", F.struct(F.col("vec_id").alias("vec_id"), _square(F.col("vector")).alias("score")))
    others = F.filter("best", lambda x, at: at != F.col("own") - 1)
    return (
        answered.withColumn("own", own)
        .select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, top)).alias("at", "one"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("one.vec_id").alias("vec_id"),
            F.col("one.score").alias("score"),
        )
    )
