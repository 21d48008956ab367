"""Operator 8: nearest neighbours by a forest of random-projection trees and an exact sweep behind it.

Trees are fitted on a bounded sample (``SAMPLE`` distinct vectors, those with
the smallest hash): a node splits its vectors at the median of their
projections on the difference of two of them. Every row is indexed: each
distinct vector goes to one leaf of every tree. A query walks all trees
through one shared priority queue, nearest margin first, until the leaves it
has reached hold enough sample vectors; Spark joins those leaves with the
index, and the candidates are ranked by their exact distance.

What the forest finds is a start only: the distance of the last of the ``k + 1``
best bounds what can still come nearer. A sweep over all points then lets no
point out but those that a bound proves too far: points of neighbouring leaves
make cells, a cell is left out for a query if its ball lies beyond the query's
bound, and in the other cells every distance is taken. So the answer is exact
on any table. On data without clusters no cell can be left out, and the sweep
takes rows * queries distances; only those within the bound become rows. The
queries are sent to all tasks in blocks of about ``ASKED`` vectors.

Equal vectors are one vector to the forest. Of a group of equal vectors only
the ``k + 1`` smallest ids can be in an answer (ties go to the smaller id), so
only those are kept as candidates; all its rows are still queries.

Vectors that are null, empty, zero, hold a null or non-finite component, or
have another size than most vectors take no part. Repeated rows (the same id
and vector) are one row; an id with several vectors keeps them all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import Shared, stage

TREES, LEAF, SAMPLE, REACH = 16, 48, 1 << 16, 3000
ASKED, CELL, ROUNDING = 1 << 15, 256, 1e-9  # vectors of a block of queries, points of a cell, share of the norms by which a bound gives way


class Tree:
    """Nodes as arrays: split direction and threshold, children (-1 - leaf number for a leaf)."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, leaf: int):
        self.way, self.cut, self.kids, self.held = [], [], [], []
        self.root = self._grow(x, np.arange(len(x)), rng, leaf)
        self.way = np.array(self.way, np.float64).reshape(len(self.cut), x.shape[1])

    def _grow(self, x: np.ndarray, at: np.ndarray, rng: np.random.Generator, leaf: int) -> int:
        if len(at) > leaf:
            for _ in range(3):
                a, b = x[rng.choice(at, 2, replace=False)]
                way = (a - b) / max(np.linalg.norm(a - b), 1e-300)
                p = x[at] @ way
                cut = float(np.median(p))
                low = p < cut
                if 0 < low.sum() < len(at):
                    me = len(self.cut)
                    self.way.append(way)
                    self.cut.append(cut)
                    self.kids.append(None)
                    self.kids[me] = (self._grow(x, at[low], rng, leaf), self._grow(x, at[~low], rng, leaf))
                    return me
        self.held.append(len(at))
        return -len(self.held)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        out, todo = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                low = x[at] @ self.way[node] < self.cut[node]
                todo += [(self.kids[node][0], at[low]), (self.kids[node][1], at[~low])]
        return out


def walk(forest: list[Tree], q: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) by the largest margin crossed on the way to them, until they hold ``reach`` sample vectors."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    out, got = [], 0
    while queue and got < reach:
        far, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            gap = float(q @ tree.way[node] - tree.cut[node])
            near, other = tree.kids[node] if gap < 0 else tree.kids[node][::-1]
            heapq.heappush(queue, (max(far, abs(gap)), t, other))
            node = near
        out.append((t, -1 - node))
        got += tree.held[-1 - node]
    return out


class Sweep:
    """The ``k + 1`` best (distance, id) of each vector of a block of queries, among the points that are shown to it.

    ``most`` starts as the distance that the forest has reached and falls as
    points come; a point at that distance still counts.
    """

    def __init__(self, x: np.ndarray, most: np.ndarray, k: int):
        self.x, self.most, self.k = x, np.array(most, np.float64), k
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.held: list[list[tuple[float, int]]] = [[] for _ in x]

    def show(self, y: np.ndarray, ids: list[list[int]], leaf: np.ndarray) -> None:
        order = np.argsort(leaf, kind="stable")
        for a in range(0, len(order), CELL):
            cell = order[a : a + CELL]
            part = y[cell]
            middle = part.mean(axis=0)
            wide = np.sqrt(((part - middle) ** 2).sum(axis=1)).max()
            long = np.sqrt((part * part).sum(axis=1))
            for b in range(0, len(self.x), 4096):
                x = self.x[b : b + 4096]
                far = np.sqrt(((x - middle) ** 2).sum(axis=1)) - wide
                give = ROUNDING * (self.norm[b : b + 4096] + long.max())
                at = np.flatnonzero(~(far > self.most[b : b + 4096] + give)) + b
                if len(at):
                    self._compare(at, part, long, [ids[i] for i in cell])

    def _compare(self, at: np.ndarray, part: np.ndarray, long: np.ndarray, ids: list[list[int]]) -> None:
        square = (self.norm[at] ** 2)[:, None] + (long**2)[None, :]
        about = square - 2 * (self.x[at] @ part.T)
        i, j = np.nonzero(~(about > (self.most[at] ** 2)[:, None] + ROUNDING * square))  # not a number: look closer
        for a in range(0, len(i), 1 << 16):
            q, p = at[i[a : a + (1 << 16)]], j[a : a + (1 << 16)]
            d = np.sqrt(((self.x[q] - part[p]) ** 2).sum(axis=1))
            ok = d <= self.most[q]
            for n, m, score in zip(q[ok].tolist(), p[ok].tolist(), d[ok].tolist(), strict=True):
                if score <= self.most[n]:
                    best = self.held[n] = sorted(self.held[n] + [(score, z) for z in ids[m]])[: self.k + 1]
                    if len(best) > self.k:
                        self.most[n] = min(self.most[n], best[-1][0])


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, reach: int = REACH,
    sample: int = SAMPLE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest for each row whose id is divisible by ``every``; ``reach`` and ``sample`` change the work, not the answer."""
    v = F.col("v")
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("id").isNotNull()
    )
    most = given.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = given.filter(F.size(v) == (most["n"] if most else 0)).distinct()
    # distinct vectors, with the ids that can be in an answer
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    points = stage(
        first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("p", F.monotonically_increasing_id()), "points"
    )
    some = points.orderBy(F.xxhash64("v")).limit(sample).select("v").toArrow()["v"].combine_chunks()
    x = np.asarray(some.flatten()).reshape(len(some), -1) if len(some) else np.zeros((0, 1))
    rng = np.random.default_rng(11)
    forest = Shared(vectors.sparkSession, [Tree(x, rng, LEAF) for _ in range(TREES if len(x) else 0)])

    def matrix(col: pa.Array) -> np.ndarray:
        return np.asarray(col.flatten()).reshape(len(col), -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for t, tree in enumerate(forest.value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b.num_rows, t, np.int32)), pa.array(tree.leaves(matrix(b.column(1)))), b.column(0)],
                        names=["tree", "leaf", "p"],
                    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(p, *x) for p, q in zip(b.column(0).to_pylist(), matrix(b.column(1)) if b.num_rows else [], strict=True) for x in walk(forest.value, q, reach)]
            p, t, n = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(t, pa.int32()), pa.array(n, pa.int32())], names=["q", "tree", "leaf"])

    asked = rows.filter(F.col("id") % every == 0).join(points.select("v", "p"), "v").select(F.col("id").alias("query_id"), "p")
    asking = points.join(asked.select("p").distinct(), "p", "left_semi")
    probes = asking.select("p", "v").mapInArrow(probe, "q bigint, tree int, leaf int")
    leaves = points.select("p", "v").mapInArrow(index, "tree int, leaf int, p bigint")
    pairs = probes.join(leaves, ["tree", "leaf"]).select("q", "p").distinct()
    two = pairs.join(points.select(F.col("p").alias("q"), F.col("v").alias("a")), "q").join(
        points.select("p", F.col("v").alias("b"), "ids"), "p"
    ).select("q", "a", "b", "ids")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = np.sqrt(((matrix(b.column(1)) - matrix(b.column(2))) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d), b.column(3)], names=["q", "score", "ids"])

    near = two.mapInArrow(measure, "q bigint, score double, ids array<bigint>")
    near = near.select("q", "score", F.explode("ids").alias("vec_id"))
    # the k + 1 best of each distinct query vector: one more, as a query is no candidate of its own
    by = Window.partitionBy("q").orderBy("score", "vec_id")

    def first_of(found: DataFrame) -> DataFrame:
        return found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)

    bound = first_of(near).groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.max("score")).alias("bound"))
    bounded = stage(
        asking.select("p", "v").join(bound, F.col("p") == F.col("q"), "left").select("p", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")),
        "bounds",
    )

    def swept(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, x, most = block.value
            sweep = Sweep(x, most, k)
            for b in batches:
                if b.num_rows:
                    y = matrix(b.column(0))
                    sweep.show(y, b.column(1).to_pylist(), forest.value[0].leaves(y))
            for n, got in zip(p.tolist(), sweep.held, strict=True):
                if got:
                    score, ids = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(got), pa.int64()), pa.array(score), pa.array(ids, pa.int64())], names=["q", "score", "vec_id"])

        return points.select("v", "ids").mapInArrow(run, "q bigint, score double, vec_id bigint")

    found = near.limit(0)
    blocks = -(-bounded.count() // ASKED)
    for n in range(blocks):
        t = bounded.filter(F.pmod(F.xxhash64("p"), F.lit(blocks)) == n).toArrow().combine_chunks()
        if len(t):
            col = t["v"].combine_chunks()
            found = found.unionByName(swept(Shared(vectors.sparkSession, (t["p"].to_numpy(), matrix(col), t["bound"].to_numpy()))))
    best = first_of(found)
    mine = asked.join(best, asked["p"] == best["q"]).filter("vec_id != query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
