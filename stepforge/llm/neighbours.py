"""Approximate nearest neighbours by inner product, with collision counting.

Index. A vector is told by its direction and its norm; norms are cut into classes of ratio
``NORM_RATIO``, so that one long vector doesn't flatten the differences of all others.
Directions are laid on ``ROUTES`` random projections; these ranges of projections are cut at
medians, always along the projection in which a range is widest, into cells of about
``CELL_VECTORS``, a tree whose cuts are fitted on ``SAMPLE_ROWS`` vectors at most. Every row is
indexed. Class and cell make a block; a cell with more is dealt out over several by hash.
In a block each of ``PROJECTIONS`` further random directions has an array of the block's
vectors sorted by their projection.

Search. A query is first answered by the block it falls into itself, of every class. What
its best k reach there bounds the distance that better ones can have: the query goes on
only to the cells that its windows about its own projections touch, ``ROUTE_REACH`` times that
distance wide, and to no class whose norms can't reach the bound. In a block a window
about the query's projection is opened in every array; a vector collects a collision for
each window it is in, and those with ``THRESHOLD`` of all are verified with inner products in
double precision. Windows widen (virtual rehashing: no second index) until they reach
``REACH`` times the distance of the k-th best that is known by then. So the verified share
follows from the data: on isotropic random vectors, where all distances are alike, about
half of a block; far less where vectors are clustered. ``verified_share`` reports it.

Each vector is sent to its block once; queries are sent after them and streamed past the
index, so a task holds one block and ``QUERY_ROWS`` queries. Of equal vectors the k + 1 smallest
ids are indexed: no other can be among the best k, and copies can't crowd out others.

Defined results: null, empty or all-zero vectors, those with null or non-finite components
and those without id take no part; vectors of different lengths don't meet; ties go to the
smaller id; repeated rows count once; products are scaled, so components up to 1e150 are
right; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.llm.common import dropped, mapped, table, written

PROJECTIONS, ROUTES = 64, 16
#: Share of the arrays a vector must collide in.
THRESHOLD = 0.66
#: Widths of windows in multiples of the distance to be found: in a block, and for cells.
REACH, ROUTE_REACH = 1.15, 2.0
FIRST_WINDOW, WIDER = 0.25, 1.3
#: The largest norm of a range over its least, at most, unless it has so few vectors that
#: all are verified.
NORM_RATIO, WHOLE = 1.1, 512
#: Queries whose windows are laid out together.
QUERY_ROWS = 256
#: Vectors of a cell, as many as the tree aims at, and of a block; the tree's sample and
#: the least part of it in a cell.
CELL_VECTORS, BLOCK_VECTORS = 8192, 16_384
SAMPLE_ROWS, SAMPLE_CELL = 50_000, 8


def norms_of(vectors: np.ndarray) -> np.ndarray:
    """Norms, without overflow of the squares."""
    most = np.abs(vectors).max(1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


def directions(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(1)[:, None]
    return unit / np.sqrt((unit**2).sum(1))[:, None]


def radius(score: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the direction of a vector can be from a query's to reach ``score``, where
    no product exceeds ``most``."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.sqrt(np.clip(2 - 2 * np.clip(score / most, -1, 1), 0, 4))


class CollisionIndex:
    """Sorted projection arrays over the directions of some vectors."""

    def __init__(self, units: np.ndarray, projections: int = PROJECTIONS, seed: int = 7):
        self.n, dim = units.shape
        self.axes = np.random.default_rng(seed).standard_normal((dim, projections))
        at = np.ascontiguousarray((units @ self.axes).T)
        self.order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, self.order, 1)

    def collided(self, units: np.ndarray, reach: np.ndarray, threshold: float = THRESHOLD) -> Iterator[np.ndarray]:
        """For each direction the vectors in enough of its windows, ``reach`` to each side."""
        at = units @ self.axes
        low, high = (np.empty(at.shape, np.int64) for _ in range(2))
        for j, s in enumerate(self.sorted):
            low[:, j] = np.searchsorted(s, at[:, j] - reach)
            high[:, j] = np.searchsorted(s, at[:, j] + reach, "right")
        m = at.shape[1]
        least = int(np.ceil(threshold * m))
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            if sum(b) - sum(a) <= m * self.n // 2:
                inside = [o[x:y] for o, x, y in zip(self.order, a, b, strict=True)]
                yield np.flatnonzero(np.bincount(np.concatenate(inside), minlength=self.n) >= least)
            else:  # What is outside is less to count.
                outside = [part for o, x, y in zip(self.order, a, b, strict=True) for part in (o[:x], o[y:])]
                yield np.flatnonzero(np.bincount(np.concatenate(outside), minlength=self.n) <= m - least)


def norm_ranges(norms: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors by range of norm, from the longest range down."""
    order = np.argsort(-norms, kind="stable")
    logs = np.log(norms[order])
    out, first = [], 0
    while first < len(order):
        # As many as one ratio spans, or as are verified whole.
        last = int(np.searchsorted(-logs, -(logs[first] - np.log(NORM_RATIO)), "right"))
        last = max(last, min(first + WHOLE, len(order)))
        out.append(order[first:last])
        first = last
    return out


class Block:
    """The different vectors of a block, by range of norm."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((ids, which))
        self.ids, self.bounds = ids[order], np.searchsorted(which[order], np.arange(len(self.vectors) + 1))
        self.norms, units = norms_of(self.vectors), directions(self.vectors)
        self.single = units.astype(np.float32)
        self.ranges = [(at, CollisionIndex(units[at]) if len(at) > WHOLE else None, float(self.norms[at[0]])) for at in norm_ranges(self.norms)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """(query id, number of verified vectors, (id, score) of its best k) of each query;
        ``floor`` is what its best k reach elsewhere."""
        lengths, units = norms_of(queries), directions(queries)
        single = units.astype(np.float32)
        found = [(np.empty(0, np.int64), np.empty(0), np.empty(0))] * len(queries)
        last = np.full(len(queries), -np.inf) if floor is None else np.asarray(floor, float)
        bounded, verified = last.copy(), np.zeros(len(queries), np.int64)

        def verify(i: int, new: np.ndarray) -> None:
            verified[i] += len(new)
            rough = (self.single[new] @ single[i]).astype(float)
            scale = self.norms[new] * lengths[i]
            at, low, high = (np.concatenate(x) for x in zip(found[i], (new, (rough - 1e-5) * scale, (rough + 1e-5) * scale), strict=True))
            # The query itself may be among them, hence the best k + 1.
            least = float(np.partition(low, len(at) - k - 1)[len(at) - k - 1]) if len(at) > k else -np.inf
            last[i] = max(bounded[i], least)
            stays = high >= last[i]
            found[i] = at[stays], low[stays], high[stays]

        for at, index, largest in self.ranges:
            most = largest * lengths
            # No product of this range or a later one exceeds the product of the norms.
            live = np.flatnonzero(most * (1 + 1e-9) >= last)
            if not len(live):
                break
            if index is None:
                for i in live.tolist():
                    verify(i, at)
                continue
            seen = {i: np.zeros(len(at), bool) for i in live.tolist()}
            reach = np.where(np.isfinite(last), REACH * radius(last, most), FIRST_WINDOW)
            while len(live):
                for i, hit in zip(live.tolist(), index.collided(units[live], reach[live]), strict=True):
                    new = hit[~seen[i][hit]]
                    seen[i][new] = True
                    if len(new):
                        verify(i, at[new])
                wanted = np.where(np.isfinite(last), REACH * radius(last, most), np.inf)
                live = live[(reach[live] < wanted[live]) & np.array([not seen[i].all() for i in live.tolist()])]
                reach = np.minimum(reach * WIDER, np.maximum(wanted, reach))
        for i, q in enumerate(query_ids.tolist()):
            yield q, int(verified[i]), self.best(q, queries[i], found[i][0], k)

    def best(self, q: int, query: np.ndarray, at: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The best k ids of the candidates of one query, verified."""
        score = (self.vectors[at] * query).sum(1)
        # The best k + 1 vectors, with all that tie with the last, hold the best k ids.
        if len(at) > k + 1:
            last = np.partition(score, len(at) - k - 1)[len(at) - k - 1]
            at, score = at[score >= last], score[score >= last]
        # The k + 1 smallest ids of a vector are all that it can bring.
        got = [(-s, i, s) for a, s in zip(at.tolist(), score.tolist(), strict=True) for i in self.ids[self.bounds[a] : self.bounds[a + 1]][: k + 1].tolist() if i != q]
        return [(i, s) for _, i, s in sorted(got)[:k]]


def block_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query id, id, score) of the best k of a block, for each query."""
    block = Block(ids, vectors)
    for first in range(0, len(queries), QUERY_ROWS):
        for q, _, best in block.search(query_ids[first : first + QUERY_ROWS], queries[first : first + QUERY_ROWS], k):
            yield from ((q, i, s) for i, s in best)


class Cells:
    """A tree of cuts of projections; its leaves are cells. Fitted on a sample of directions."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 13):
        self.axes = np.random.default_rng(seed).standard_normal((sample.shape[1], ROUTES))
        #: (projection, cut, left, right); a leaf has its number and no children.
        self.nodes: list[tuple[int, float, int, int]] = []
        self.leaves = 0
        self._cut(sample @ self.axes, max(1, min(cells, len(sample) // SAMPLE_CELL)))

    def _cut(self, at: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1))
        j = int(np.argmax(at.std(0))) if len(at) else 0
        cut = float(np.median(at[:, j])) if len(at) else 0.0
        left = at[:, j] <= cut if len(at) else np.zeros(0, bool)
        if cells <= 1 or left.all() or not left.any():
            self.nodes[me] = (-1, float(self.leaves), -1, -1)
            self.leaves += 1
        else:
            a = self._cut(at[left], (cells + 1) // 2)
            self.nodes[me] = (j, cut, a, self._cut(at[~left], cells // 2))
        return me

    def touched(self, units: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, directions whose windows reach it); with no reach, each one's own."""
        at = units @ self.axes
        todo = [(0, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            j, cut, a, b = self.nodes[node]
            if not len(rows):
                continue
            if j < 0:
                yield int(cut), rows
                continue
            x, w = at[rows, j], reach[rows]
            todo.append((a, rows[x - w <= cut]))
            todo.append((b, rows[x + w > cut]))


def _matrices(ids: pa.Array, v: pa.Array, *more: pa.Array) -> Iterator[tuple[int, list]]:
    """(length, [ids, matrix, further arrays]) of the vectors of each length in a batch."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    n = np.diff(v.offsets.to_numpy())
    flat = [x.to_numpy(zero_copy_only=False) for x in (ids, *more)]
    for d in np.unique(n).tolist():
        here = n == d
        yield d, [flat[0][here], v.filter(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d), *(x[here] for x in flat[1:])]


def _lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).ravel()))


def norm_class(norms: np.ndarray) -> np.ndarray:
    return np.floor(np.log(norms) / np.log(NORM_RATIO)).astype(np.int64)


class Plan:
    """Which blocks there are: for each length and class of norm the largest norm, and of
    each cell the first of its blocks and their number."""

    def __init__(self, trees: dict[int, Cells], rows: list):
        self.trees, self.classes, self.blocks = trees, {}, 0
        for dim, kind, cell, n, largest in sorted(rows):
            most, cells = self.classes.setdefault(dim, {}).setdefault(kind, [0.0, {}])
            parts = -(-n // BLOCK_VECTORS)
            cells[cell] = (self.blocks, parts)
            self.classes[dim][kind][0] = max(most, largest)
            self.blocks += parts

    def homes(self, ids: np.ndarray, queries: np.ndarray) -> dict[int, list[np.ndarray]]:
        """By block the queries that fall into it themselves."""
        out: dict[int, list[np.ndarray]] = {}
        units, none = directions(queries), np.zeros(len(queries))
        own = list(self.trees[queries.shape[1]].touched(units, none))
        for _, cells in self.classes[queries.shape[1]].values():
            for cell, rows in own if len(cells) > 1 or 0 not in cells else [(0, np.arange(len(ids)))]:
                if cell in cells:
                    first, parts = cells[cell]
                    part = ids[rows] % parts
                    for p in np.unique(part).tolist():
                        out.setdefault(first + p, []).append(rows[part == p])
        return out

    def routes(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(block, queries that have to go there beside their homes)."""
        homes = {b: np.concatenate(rows) for b, rows in self.homes(ids, queries).items()}
        units, lengths = directions(queries), norms_of(queries)
        for largest, cells in self.classes[queries.shape[1]].values():
            most = largest * lengths
            live = np.flatnonzero(most * (1 + 1e-9) >= floor)
            reach = np.where(np.isfinite(floor[live]), ROUTE_REACH * radius(floor[live], most[live]), np.inf)
            whole = len(cells) == 1 and 0 in cells
            for cell, rows in [(0, np.arange(len(live)))] if whole else self.trees[queries.shape[1]].touched(units[live], reach):
                first, parts = cells.get(cell, (0, 0))
                for p in range(parts):
                    rest = np.setdiff1d(live[rows], homes.get(first + p, np.empty(0, np.int64)))
                    if len(rest):
                        yield first + p, rest


def _searched(vectors: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, verified): the best k of every query in every block it is
    sent to, and for each a row without vec_id that has the number of verified vectors."""
    sent = vectors.select("block", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("floor")).unionByName(asked.withColumn("kind", F.lit(1)))
    sent = sent.repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], {}
        for b in batches:
            numbers = b.column(0).to_numpy(zero_copy_only=False)
            kinds = b.column(1).to_numpy(zero_copy_only=False)
            # Runs of rows of one block and kind.
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if numbers[a] != now:
                    now, held, block = numbers[a], [], {}
                some = b.slice(a, e - a)
                if kinds[a] == 0:
                    held.append(some)
                    continue
                if held:
                    every = pa.Table.from_batches(held)
                    block = {d: Block(*of) for d, of in _matrices(every.column(2).combine_chunks(), every.column(3))}
                    held = []
                for first in range(0, len(some), QUERY_ROWS):
                    part = some.slice(first, QUERY_ROWS)
                    rows: list[tuple] = []
                    for d, (ids, queries, floor) in _matrices(part.column(2), part.column(3), part.column(4)):
                        if d in block:
                            for q, verified, best in block[d].search(ids, queries, k, np.where(np.isnan(floor.astype(float)), -np.inf, floor.astype(float))):
                                rows.append((q, None, None, verified))
                                rows += [(q, i, s, None) for i, s in best]
                    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "score", "verified"])

    return mapped(sent.select("block", "kind", "id", "v", "floor"), run, "query_id long, vec_id long, score double, verified long")


def _found(df: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> tuple[DataFrame, list[str]]:
    """Rows of both rounds as in ``_searched``, and the tables they are read from."""
    paths: list[str] = []

    def kept(t: DataFrame, name: str) -> DataFrame:
        t, path = written(t, name)
        paths.append(path)
        return t

    def usable(t: DataFrame) -> DataFrame:
        t = t.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        good = "id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)"
        return t.where(good)

    n = df.count()
    # Of equal vectors the k + 1 smallest ids; Spark cuts groups before they are shuffled.
    copies = Window.partitionBy("h", "v").orderBy("id")
    rows = usable(df).distinct().withColumn("h", F.xxhash64("v")).withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k + 1).select("id", "v")
    every = -(-n // SAMPLE_ROWS)
    sample = usable(df).where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(every)) == 0).limit(SAMPLE_ROWS).select("id", "v").toArrow()
    trees = {d: Cells(directions(of[1]), -(-n // CELL_VECTORS)) for d, of in _matrices(sample.column("id").combine_chunks(), sample.column("v"))} if len(sample) else {}
    empty = lambda d: trees.get(d) or Cells(np.zeros((0, d)), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, (ids, v) in _matrices(b.column(0), b.column(1)):
                norms, cell = norms_of(v), np.zeros(len(v), np.int32)
                for c, at in empty(d).touched(directions(v), np.zeros(len(v))):
                    cell[at] = c
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(v), pa.array(np.full(len(v), d, np.int32)), pa.array(norm_class(norms)), pa.array(cell), pa.array(norms)], names=["id", "v", "dim", "kind", "cell", "norm"])

    placed = kept(mapped(rows, place, "id long, v array<double>, dim int, kind long, cell int, norm double"), "placed")
    # Classes of few vectors are one cell.
    sizes = placed.groupBy("dim", "kind").agg(F.count("*").alias("n")).where(F.col("n") <= 2 * CELL_VECTORS).select("dim", "kind", F.lit(True).alias("one"))
    placed = placed.join(F.broadcast(sizes), ["dim", "kind"], "left").withColumn("cell", F.when(F.col("one"), 0).otherwise(F.col("cell")))
    # A row for each class and cell: bounded by the tree, whose size the sample bounds.
    found = placed.groupBy("dim", "kind", "cell").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()
    plan = Plan({d: empty(d) for d in {r.dim for r in found}}, [tuple(r) for r in found])
    firsts = [(d, kind, cell, first, parts) for d, kinds in plan.classes.items() for kind, (_, cells) in kinds.items() for cell, (first, parts) in cells.items()]
    numbers = df.sparkSession.createDataFrame(firsts, "dim int, kind long, cell int, first long, parts long")
    vectors = placed.join(F.broadcast(numbers), ["dim", "kind", "cell"]).select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "id", "v")
    schema = "block long, id long, v array<double>, floor double"

    def routed(t: DataFrame, home: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, (ids, q, floor) in _matrices(b.column(0), b.column(1), b.column(2)):
                    if d not in plan.classes:
                        continue
                    floor = np.where(np.isnan(floor.astype(float)), -np.inf, floor.astype(float))
                    for block, at in ((n, np.concatenate(r)) for n, r in plan.homes(ids, q).items()) if home else plan.routes(ids, q, floor):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(ids[at]), _lists(q[at]), pa.array(np.where(np.isfinite(floor[at]), floor[at], np.nan))], names=["block", "id", "v", "floor"])

        return mapped(t, run, schema)

    asked = usable(queries).distinct()
    first = kept(_searched(vectors, routed(asked.withColumn("floor", F.lit(None).cast("double")), True), plan.blocks, k), "homes")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    reached = first.where("vec_id IS NOT NULL").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    second = _searched(vectors, routed(asked.join(reached, "id", "left"), False), plan.blocks, k)
    return first.unionByName(second), paths


def neighbours(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries``."""
    found, paths = _found(df, queries, k, key, vector)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out, _ = written(ranked.select("query_id", "rank", "vec_id", "score"), "neighbours")
    for path in paths:
        dropped(df.sparkSession, path)
    return out


def verified_share(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> float:
    """Verified pairs over all pairs of a query and a vector."""
    found, paths = _found(df, queries, k, key, vector)
    verified = found.agg(F.sum("verified")).first()[0] or 0
    for path in paths:
        dropped(df.sparkSession, path)
    return verified / max(1, df.count() * queries.count())


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"))
