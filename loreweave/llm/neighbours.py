"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test holds.

Vectors are projected to `dims` dimensions by a Gaussian matrix, which is 2-stable: for a pair at distance d the squared projected
distance over d * d is chi-square with that many degrees of freedom. The top of the kd-tree is fitted on a bounded sample and
deals all vectors to parts; each part has the rest of the tree. A query is searched in its own part first, which bounds the distance
of its k-th best; then it goes to just those other parts whose cells come nearer than the test allows for that bound. In a part its
projected neighbours come in order of projected distance and are verified on the original vectors, until a vector as near as the
k-th best would, with the given confidence, already have come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

_LEAF = 128
_SCALE = 2.0**-20  # of projections, so that no sum of finite components overflows


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_limit(confidence: float, dims: int) -> float:
    """What a chi-square variable stays below with this probability."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dims) < confidence:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dims) < confidence else (low, middle)
    return high


class Cells:
    """The top of the tree: median splits of sample points into cells, by value, so that every vector has one cell."""

    def __init__(self, points: np.ndarray, count: int, dims: int):
        self.splits: list[tuple[int, float, int, int]] = []  # (axis, value, left, right); a child below 0 is the cell -1 - child
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.root = self._build(points, max(1, count), np.full(dims, -np.inf), np.full(dims, np.inf))
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _build(self, points: np.ndarray, count: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
        own = points[:, axis] if len(points) else np.zeros(0)
        value = float(np.quantile(own, (count // 2) / count)) if len(own) else 0.0
        if count == 1 or len(points) < 2 or not (own < value).any():
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        at = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        middle = lambda end: np.where(np.arange(len(low)) == axis, value, end)
        left = self._build(points[own < value], count // 2, low, middle(high))
        right = self._build(points[own >= value], count - count // 2, middle(low), high)
        self.splits[at] = (axis, value, left, right)
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        work = [(self.root, np.arange(len(points)))]
        while work:
            at, rows = work.pop()
            if at < 0:
                out[rows] = -1 - at
            else:
                axis, value, left, right = self.splits[at]
                less = points[rows, axis] < value
                work += [(left, rows[less]), (right, rows[~less])]
        return out

    def away(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from the point to each cell."""
        gap = np.maximum(np.maximum(self.lows - point, point - self.highs), 0)
        return np.einsum("ij,ij->i", gap, gap)


class KdTree:
    """One part's tree: median splits by rank, so equal points do not unbalance it. Leaves are runs of `rows` with bounding boxes."""

    def __init__(self, points: np.ndarray):
        runs: list[np.ndarray] = []
        work = [np.arange(len(points))]
        while work:
            rows = work.pop()
            if len(rows) <= _LEAF:
                runs.append(rows)
                continue
            own, middle = points[rows], len(rows) // 2
            order = np.argpartition(own[:, int(np.argmax(np.ptp(own, axis=0)))], middle)
            work += [rows[order[middle:]], rows[order[:middle]]]
        self.rows = np.concatenate(runs)
        self.points = points[self.rows]
        self.ends = np.cumsum([0, *map(len, runs)])
        self.low = np.minimum.reduceat(self.points, self.ends[:-1])
        self.high = np.maximum.reduceat(self.points, self.ends[:-1])

    def incremental(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(squared projected distances, rows) of all points, nearest first, some at a time."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        box = np.einsum("ij,ij->i", gap, gap)
        leaves = np.argsort(box, kind="stable")
        far, rows = np.zeros(0), np.zeros(0, np.int64)
        at, take = 0, 4
        while at < len(leaves) or len(rows):
            mine = np.concatenate([np.arange(self.ends[i], self.ends[i + 1]) for i in leaves[at : at + take]] or [rows[:0]])
            at, take = at + take, 2 * take
            gap = self.points[mine] - q
            far, rows = np.concatenate([far, np.einsum("ij,ij->i", gap, gap)]), np.concatenate([rows, self.rows[mine]])
            ready = far <= (box[leaves[at]] if at < len(leaves) else np.inf)
            order = np.flatnonzero(ready)[np.argsort(far[ready], kind="stable")]
            size = 32
            while len(order):
                yield far[order[:size]], rows[order[:size]]
                order, size = order[size:], min(1024, 2 * size)
            far, rows = far[~ready], rows[~ready]


def nearest(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, projected: np.ndarray, k: int, limit: float, bound: float):
    """(ids, distances, number verified) of the k nearest found within bound, nearest first, ties to the smaller id."""
    best_ids, best, verified = np.empty(0, np.int64), np.empty(0), 0
    rounding = 1e-24 * float(projected @ projected)
    for far, rows in tree.incremental(projected):
        last = min(bound, best[-1] if len(best) == k else np.inf)
        if last < np.inf and far[0] > rounding and far[0] >= limit * last**2:
            break
        rows = rows[ids[rows] != query_id]
        verified += len(rows)
        gap = vectors[rows] - query
        found = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        near = found <= last
        best_ids, best = np.concatenate([best_ids, ids[rows][near]]), np.concatenate([best, found[near]])
        order = np.lexsort((best_ids, best))[:k]
        best_ids, best = best_ids[order], best[order]
    return best_ids, best, verified


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _gaussian(length: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims)) * _SCALE


def _project(rows: np.ndarray, gaussian: np.ndarray) -> np.ndarray:
    """Each row's sums are made in the same order whatever rows stand beside it, so that equal vectors have equal projections."""
    return np.einsum("ij,jk->ik", rows, gaussian)


def _projected(column: pa.Array, dims: int, seed: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        out[rows] = _project(_matrix(column.take(pa.array(rows))), _gaussian(int(length), dims, seed))
    return out


def _in_cells(cells: Cells, dims: int, seed: int):
    """(vec_id, vector, ...) -> the same with the part of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = cells.of(_projected(batch.column("vector"), dims, seed))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    return run


def _routed(cells: Cells, blocks: dict[tuple[int, int], int], dims: int, seed: int, limit: float):
    """(vec_id, vector, length, home, home_block, bound) -> a row for each other block that may hold a nearer vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _projected(batch.column("vector"), dims, seed)
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            take, parts, numbers = [], [], []
            for i, (length, home, home_block, bound) in enumerate(zip(get("length"), get("home"), get("home_block"), get("bound"))):
                away = cells.away(points[i])
                for part in np.flatnonzero((away <= 1e-24 * float(points[i] @ points[i])) | (away < limit * bound**2) | np.isinf(bound)):
                    for block in range(blocks.get((int(length), int(part)), 0)):
                        if (part, block) != (home, home_block):
                            take.append(i)
                            parts.append(int(part))
                            numbers.append(block)
            rows = batch.select(["vec_id", "vector", "length", "bound"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(parts, pa.int64()), pa.array(numbers, pa.int64())], [*rows.schema.names, "part", "block"])

    return run


_KEYS = ("length", "part", "block")
_FOUND = "query_id long, query_hash long, vec_id long, score double, verified long"


def _searched(k: int, dims: int, limit: float, seed: int):
    """Batches sorted by (length, part, block, asks): each block's vectors, then its queries -> the k best of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        ids = vectors = gaussian = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_KEYS, "asks")]) if batch.num_rows else np.zeros((4, 0))
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()] if batch.num_rows else []
            for low, high in zip(cuts, [*cuts[1:], batch.num_rows]):
                rows = batch.slice(low, high - low)
                if tuple(keys[:3, low]) != key:
                    key, held, tree = tuple(keys[:3, low]), [], None
                if not keys[3, low]:
                    held.append(rows.select(["vec_id", "vector"]))
                    continue
                if not held:
                    continue
                if tree is None:
                    ids = np.concatenate([x.column("vec_id").to_numpy() for x in held])
                    vectors = np.concatenate([_matrix(x.column("vector")) for x in held])
                    gaussian = _gaussian(vectors.shape[1], dims, seed)
                    tree = KdTree(_project(vectors, gaussian))
                out: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []
                asked = zip(rows.column("vec_id").to_pylist(), rows.column("query_hash").to_pylist(), _matrix(rows.column("vector")), rows.column("bound").to_pylist())
                for query_id, query_hash, query, bound in asked:
                    out.append((query_id, query_hash, *nearest(tree, ids, vectors, query_id, query, _project(query[None, :], gaussian)[0], k, limit, bound)))
                n = [len(x[2]) for x in out]
                columns = [np.repeat([x[0] for x in out], n), np.repeat([x[1] for x in out], n), np.concatenate([x[2] for x in out]), np.concatenate([x[3] for x in out]), np.repeat([x[4] for x in out], n)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as doubles) of the vectors that take part: no nulls, all finite, not all zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    return rows.where(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def search(
    queries: DataFrame,
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    dims: int = 24,
    confidence: float = 0.9,
    part_rows: int = 16_384,
    sample_rows: int = 32_768,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest vectors by Euclidean distance, in doubles.

    The tree's top has a part for every part_rows vectors, at most one for every 8 of the sample; it is fitted on about sample_rows
    vectors (at most twice as many), drawn by a hash of the id. Every vector is in one block of its part, blocks having about part_rows
    rows, so that no task holds more. Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids;
    vectors of another length than the query's are no candidates, nor is the query's own id. Fewer candidates than k: all of
    them. Ties go to the smaller id; repeated rows are candidates each and one query; an id with several vectors asks once for each.
    Empty tables give no rows; other columns are ignored.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    data = usable(vectors, id_col, vector_col).withColumn("length", F.size("vector"))
    asked = usable(queries, id_col, vector_col).withColumn("length", F.size("vector")).dropDuplicates(["vec_id", "vector"])
    n = data.count()
    share = F.lit(1.0 if n <= sample_rows else sample_rows / n)
    drawn = data.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("vector").limit(2 * sample_rows)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _projected(batch.column(0), dims, seed)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), dims).cast(pa.list_(pa.float64()))], ["point"])

    sample = drawn.mapInArrow(projected, "point array<double>").toArrow().column("point").combine_chunks()
    points = _matrix(sample) if len(sample) else np.zeros((0, dims))
    cells = Cells(points, min(-(-n // part_rows), max(1, len(points) // 8)), dims)
    limit = chi_square_limit(confidence, dims) * _SCALE**2

    columns = "vec_id long, vector array<double>, length int, part long"
    placed = data.mapInArrow(_in_cells(cells, dims, seed), columns)
    counted = {(r["length"], r["part"]): -(-r["count"] // part_rows) for r in placed.groupBy("length", "part").count().toLocalIterator()}
    of_part = F.create_map(*(F.lit(x) for (length, part), c in counted.items() if c > 1 for x in (f"{length}/{part}", c)))
    blocks = F.coalesce(F.try_element_at(of_part, F.concat_ws("/", "length", "part")), F.lit(1)) if any(c > 1 for c in counted.values()) else F.lit(1)
    block = F.pmod(F.xxhash64("vec_id"), blocks).cast("long")
    rows = placed.withColumn("block", block).withColumns({"asks": F.lit(False), "bound": F.lit(float("inf")), "query_hash": F.lit(0).cast("long")})
    homes = asked.mapInArrow(_in_cells(cells, dims, seed), columns).withColumn("block", block).withColumns({"asks": F.lit(True), "query_hash": F.xxhash64("vector")})

    def searched(asks: DataFrame) -> DataFrame:
        both = rows.union(asks.select(*rows.columns))
        return both.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "asks").mapInArrow(_searched(k, dims, limit, seed), _FOUND)

    first = stage(searched(homes.withColumn("bound", F.lit(float("inf")))), "home-parts")
    bounds = first.groupBy("query_id", "query_hash").agg(F.when(F.count("*") >= k, F.max("score")).alias("reached"))
    homes = homes.join(bounds.withColumnsRenamed({"query_id": "of_id", "query_hash": "of_hash"}), (F.col("vec_id") == F.col("of_id")) & (F.col("query_hash") == F.col("of_hash")), "left")
    homes = homes.select("vec_id", "vector", "length", F.col("part").alias("home"), F.col("block").alias("home_block"), F.coalesce("reached", F.lit(float("inf"))).alias("bound"))
    others = homes.mapInArrow(_routed(cells, counted, dims, seed, limit), "vec_id long, vector array<double>, length int, bound double, part long, block long")
    found = first.union(searched(others.withColumns({"asks": F.lit(True), "query_hash": F.xxhash64("vector")})))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
