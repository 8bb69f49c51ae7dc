"""Approximate nearest neighbours: vantage-point trees, one per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

NEAREST = 5
#: Every row whose id is divisible by this is a query.
EVERY = 50
#: 1 searches exactly; above, a branch is left out that many times sooner.
FACTOR = 1.0
#: Rows of a shard at most, on average; small tables are cut into more shards than that.
SHARD_ROWS = 8192
MIN_SHARD_ROWS = 256
LEAF = 64
#: Queries that walk a tree together.
BLOCK = 512
#: Found beyond the nearest before the scores are computed exactly.
SPARE = 3


class VantageTree:
    """A tree over unit vectors under their Euclidean distance.

    An inner node keeps a vantage point and the median distance to it; nearer points go
    to one side, the others to the other. Equal vectors are one point with several ids.
    Distances between unit vectors order as cosines do.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.root = self._build(0, len(points), leaf)

    def _build(self, lo: int, hi: int, leaf: int):
        if hi - lo <= leaf:
            return lo, hi
        part = self.order[lo:hi]
        # The point farthest from the first one: it stands at the rim, where medians part best.
        far = np.argmax(_distances(self.points[part[:1]], self.points[part])[0])
        vantage = part[far]
        away = _distances(self.points[vantage][None], self.points[part])[0]
        sort = np.argsort(away, kind="stable")
        self.order[lo:hi] = part[sort]
        middle = (hi - lo) // 2
        # The vantage point itself is the first of the near side.
        inner, outer = away[sort[middle - 1]], away[sort[middle]]
        return int(vantage), float(inner), float(outer), self._build(lo, lo + middle, leaf), self._build(lo + middle, hi, leaf)

    def search(self, queries: np.ndarray, wanted: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and points of the `wanted` nearest of each query, and the -1s where there are fewer.

        The triangle inequality gives the least distance a side can have; a side is left
        out if `factor` times that is beyond the distances found so far.
        """
        near = np.full((len(queries), wanted), np.inf)
        which = np.full((len(queries), wanted), -1, np.int64)
        self._walk(self.root, np.arange(len(queries)), queries, near, which, factor)
        return near, which

    def within(self, queries: np.ndarray, radius: np.ndarray, factor: float, slack: float, take) -> None:
        """Calls `take` with queries and points, a leaf at a time, of all pairs within the radius of the query."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, active = stack.pop()
            if not len(active):
                continue
            if len(node) == 2:
                points = self.order[node[0] : node[1]]
                q, k = np.nonzero(_distances(queries[active], self.points[points]) <= radius[active, None])
                if len(q):
                    take(active[q], points[k])
                continue
            vantage, inner, outer, left, right = node
            away = _distances(queries[active], self.points[vantage][None])[:, 0]
            for side, bound in ((left, away - inner), (right, outer - away)):
                stack.append((side, active[factor * bound <= radius[active] + slack]))

    def _walk(self, node, active, queries, near, which, factor) -> None:
        if not len(active):
            return
        if len(node) == 2:
            points = self.order[node[0] : node[1]]
            away = np.hstack([near[active], _distances(queries[active], self.points[points])])
            named = np.hstack([which[active], np.broadcast_to(points, (len(active), len(points)))])
            first = np.argpartition(away, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
            near[active] = np.take_along_axis(away, first, 1)
            which[active] = np.take_along_axis(named, first, 1)
            return
        vantage, inner, outer, left, right = node
        away = _distances(queries[active], self.points[vantage][None])[:, 0]
        close = away - inner <= outer - away
        bound = {id(left): away - inner, id(right): outer - away}
        for side, first in ((left, close), (right, ~close)):
            self._walk(side, active[first], queries, near, which, factor)
        for side, first in ((left, close), (right, ~close)):
            worst = near[active].max(axis=1)
            # A hair of slack: distances of near equal vectors carry rounding.
            self._walk(side, active[~first & (factor * bound[id(side)] <= worst + 1e-6)], queries, near, which, factor)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, one component after the other: equal rows give equal sums wherever they stand."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _dots(a, b) / np.sqrt(_dots(a, a) * _dots(b, b))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, finite and not zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0)).filter(finite & F.exists(x, lambda v: v != 0))


def shards(count: int, tasks: int) -> int:
    """A few shards per task while they are not small, and none of more than SHARD_ROWS rows."""
    return max(1, -(-count // SHARD_ROWS), min(-(-count // MIN_SHARD_ROWS), 2 * tasks))


def nearest(
    vectors: DataFrame, wanted: int = NEAREST, factor: float = FACTOR, every: int = EVERY, vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query its `wanted` nearest rows by cosine.

    Rows are dealt to shards by a hash of their id, so equal vectors are spread. Each
    shard gets all queries, block by block, behind its own rows; it holds its tree and one
    block at a time. What the shards found for a query is ranked, ties to the smaller id.

    Vectors that are null, empty or zero, or hold null or non-finite components take no
    part, and neither do rows with a null id. Vectors of different lengths are not
    compared. A repeated row is a candidate of its own, but not for a query of the same
    id. Fewer candidates give fewer rows, an empty table none.
    """
    rows = usable(vectors.select("vec_id", F.col(vector).cast("array<double>").alias("v")), "v").filter("vec_id is not null")
    rows = saved(rows, "knn-vectors")
    spark = vectors.sparkSession
    n = shards(rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("shard"), F.lit(0).alias("side"), "vec_id", "v")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.lit(1).alias("side"), "vec_id", "v")
    dealt = index.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score"]
        shard, held, trees = None, [], None

        def blocks():
            for batch in batches:
                key = batch["shard"].to_numpy().astype(np.int64) * 2 + batch["side"].to_numpy()
                edges = np.flatnonzero(np.diff(key)) + 1
                for lo, hi in zip([0, *edges], [*edges, len(key)]):
                    for k in range(lo, hi, BLOCK):
                        part = batch.slice(k, min(BLOCK, hi - k))
                        yield key[lo] // 2, key[lo] % 2, part

        for at, side, part in blocks():
            if at != shard:
                shard, held, trees = at, [], None
            if side == 0:
                held.append(part)
                continue
            if trees is None:
                trees, held = Shard(held), []
            found = trees.search(part, wanted, factor)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")


def _matrix(part: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, by length of the vectors."""
    column = part["v"].combine_chunks() if isinstance(part, pa.Table) else part["v"]
    ids, size = part["vec_id"].to_numpy(), pa.compute.list_value_length(column).to_numpy()
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield ids[rows], column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d)


class Shard:
    """The trees of one shard: one per length of vector."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.trees = {}
        for ids, v in _matrix(pa.Table.from_batches(batches)) if batches else ():
            points, back = np.unique(v, axis=0, return_inverse=True)
            by_point = np.lexsort((ids, back.ravel()))
            start = np.searchsorted(back.ravel()[by_point], np.arange(len(points) + 1))
            unit = points / np.abs(points).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            self.trees[v.shape[1]] = VantageTree(unit), points, ids[by_point], start

    def search(self, part: pa.RecordBatch, wanted: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for query, v in _matrix(part):
            if v.shape[1] not in self.trees:
                continue
            tree, points, ids, start = self.trees[v.shape[1]]
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            # One point more than wanted, for the query's own may be among them.
            near, which = tree.search(unit, min(len(points), wanted + 1 + SPARE), factor)
            q, k = np.nonzero(which >= 0)
            best = self._best(v, query, points, ids, start, q, which[q, k], wanted)
            # Distances carry rounding, so ties and near ties are for the exact scores to decide.
            # Where they may reach beyond the points found, all points that near are taken.
            wide = 8 * np.finfo(float).eps * (v.shape[1] + 8)
            if len(points) > wanted + 1 + SPARE:
                near = np.sort(near, axis=1)
                radius = np.sqrt(near[:, wanted] ** 2 + wide)
                open_ = np.flatnonzero(near[:, -1] <= radius)
                if len(open_):
                    found = [tuple(c[~np.isin(best[0], open_)] for c in best)]
                    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

                    def take(q, point):
                        more = self._best(v[open_], query[open_], points, ids, start, q, point, wanted)
                        held[0] = _top(*(np.concatenate(c) for c in zip(held[0], more)), wanted)

                    tree.within(unit[open_], radius[open_], factor, 1e-6 + 4 * math.sqrt(wide), take)
                    q, vec, score = held[0]
                    found.append((open_[q], vec, score))
                    best = tuple(np.concatenate(c) for c in zip(*found))
            q, vec, score = best
            out.append((query[q], vec, score))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _best(self, v, query, points, ids, start, q, point, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and exact score of the best rows of these pairs of queries and points."""
        score = cosines(v[q], points[point])
        # Of equal vectors the smallest ids come first; one more than wanted, for the query's own.
        size = np.minimum(start[point + 1] - start[point], wanted + 1)
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        vec = ids[np.repeat(start[point], size) + nth]
        q, score = np.repeat(q, size), np.repeat(score, size)
        other = vec != query[q]
        return _top(q[other], vec[other], score[other], wanted)


def _top(q: np.ndarray, vec: np.ndarray, score: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score, q))
    q, vec, score = q[order], vec[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < wanted
    return q[top], vec[top], score[top]
