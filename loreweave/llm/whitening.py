"""Embedding whitening by singular values of the centred rows, without forming their covariance.

Blockwise QR reduces the centred rows to one triangle R, task by task and then in a tree; Householder reflections bidiagonalise R;
dqds finds the singular values of the bidiagonal to high relative accuracy; twisted factorisations give its right singular
vectors, which the reflections turn back into whitening directions. The driver holds R (dimensions squared) only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage, unstage

_EPS = np.finfo(float).eps
_TINY = 1e-300
_FAN = 32
_MOST = (1 << 63) - 1


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder bidiagonalisation of a square matrix: (diagonal, superdiagonal, right reflectors). Reflector k acts on the coordinates
    from k + 1 on and is a unit vector, or all zero where nothing was to be reflected."""
    a = np.array(matrix, float)
    d, right = len(a), []

    def reflector(x: np.ndarray) -> np.ndarray:
        scale = np.abs(x).max(initial=0)
        if not scale or not np.abs(x[1:]).max(initial=0):
            return np.zeros(len(x))
        v = x / scale
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        u = reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * u, u @ a[k:, k:])
        if k + 1 < d:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2 * v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference step with a shift: (q, e, least d); None where the shift was too large."""
    d, least, out_q, out_e = q[0] - shift, math.inf, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        least = min(least, d)
        top = d + e[i]
        ratio = q[i + 1] / top if top else 0.0
        out_q.append(top)
        out_e.append(e[i] * ratio)
        d = (d * ratio if top else q[i + 1]) - shift
    return None if d < 0 else ([*out_q, d], out_e, min(least, d))


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Of the bidiagonal matrix with this diagonal and superdiagonal, in falling order, by dqds with deflation. Entries are scaled first."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    blocks = [([float(x) for x in (diagonal / scale) ** 2], [float(x) for x in (above / scale) ** 2], 0.0)]
    found: list[float] = []
    while blocks:
        q, e, shifted = blocks.pop()
        hint = 0.0
        while len(q) > 1:
            # Off-diagonal entries that no longer matter split the block.
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS**2 * (shifted + min(q[i], q[i + 1])) or e[i] < _TINY), None)
            if cut is not None:
                if cut == len(e) - 1:
                    found.append(q.pop() + shifted)
                    e.pop()
                else:
                    blocks.append((q[: cut + 1], e[:cut], shifted))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                hint = 0.0
                continue
            if q[0] < q[-1] * 0.5:  # graded the wrong way round: reverse
                q, e = q[::-1], e[::-1]
            step = None
            while hint > _TINY and (step := _dqds(q, e, hint)) is None:
                hint /= 4
                if hint < _EPS * (shifted + q[-1]):
                    hint = 0.0
            if step is None:
                step, hint = _dqds(q, e, 0.0), 0.0
            q, e, least = step
            shifted += hint
            # The least d bounds the least value from above; near convergence the gap to it shrinks with the last e.
            hint = max(0.0, least - 2 * e[-1]) if e[-1] < 0.25 * least else 0.25 * least
        found += [q[0] + shifted] if q else []
    return np.sqrt(np.sort(np.array(found))[::-1].clip(0)) * scale


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float, start: np.ndarray | None) -> np.ndarray:
    """The unit vector of B'B for a squared singular value, B bidiagonal with non-zero diagonal. The stationary and the progressive transforms
    of L D L' - value meet at the row where the factorisation is nearest to singular. With a start vector, one step of inverse iteration through that factorisation instead."""
    n = len(diagonal)
    q, low = diagonal**2, np.zeros(n - 1) if n > 1 else np.zeros(0)
    low[:] = above / diagonal[:-1]
    guard = _EPS * max(value, float(q.max(initial=0)), _TINY)
    plus_d, plus_l, s = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = q[i] + s[i]
        plus_d[i] = pivot if abs(pivot) > guard * _EPS else math.copysign(guard * _EPS, pivot)
        plus_l[i] = q[i] * low[i] / plus_d[i]
        s[i + 1] = plus_l[i] * low[i] * s[i] - value
    plus_d[n - 1] = q[n - 1] + s[n - 1]
    minus_d, minus_u, p = np.empty(n), np.empty(max(n - 1, 0)), np.empty(n)
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * low[i] ** 2 + p[i + 1]
        minus_d[i + 1] = pivot if abs(pivot) > guard * _EPS else math.copysign(guard * _EPS, pivot)
        minus_u[i] = q[i] * low[i] / minus_d[i + 1]
        p[i] = p[i + 1] * q[i] / minus_d[i + 1] - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    if start is None:
        z[k] = 1.0
    else:
        z[:] = start
        for i in range(k):
            z[i + 1] -= plus_l[i] * z[i]
        for i in range(n - 1, k, -1):
            z[i - 1] -= minus_u[i - 1] * z[i]
        z[:k] /= plus_d[:k]
        z[k + 1 :] /= minus_d[k + 1 :]
        z[k] /= gamma[k] if abs(gamma[k]) > guard * _EPS else math.copysign(guard * _EPS, gamma[k])
    for i in range(k - 1, -1, -1):
        z[i] = (0.0 if start is None else z[i]) - plus_l[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = (0.0 if start is None else z[i + 1]) - minus_u[i] * z[i]
    return z / np.linalg.norm(z / (top := np.abs(z).max())) / top


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """Right singular vectors (columns) of the bidiagonal for the `many` largest of its singular values, orthonormal also where values nearly agree."""
    n, scale = len(diagonal), max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    d, b = diagonal / scale, above / scale
    small = _EPS**2
    d = np.where(np.abs(d) < small, small, d)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= _EPS * 0.5 * np.minimum(np.abs(d[:-1]), np.abs(d[1:]))) + 1), n]
    owned = []  # (value, first, last) of each unreduced block, largest first
    for first, last in zip(cuts, cuts[1:]):
        owned += [(v / scale, first, last) for v in singular_values(diagonal[first:last], above[first : last - 1])]
    owned.sort(key=lambda x: (-x[0], x[1]))
    out = np.zeros((n, many))
    rng = np.random.default_rng(0)
    for j, (value, first, last) in enumerate(owned[:many]):
        inside = slice(first, last)
        near = [i for i in range(j) if owned[i][1] == first and owned[i][0] - value <= 1e-3 * owned[i][0]]
        z = _twisted(d[inside], b[first : last - 1], value**2, None)
        if near:  # twisted vectors of near values can lean on each other: iterate against those that stand
            basis = out[inside][:, near]
            z = z - basis @ (basis.T @ z)
            if np.linalg.norm(z) < 0.5:
                z = rng.standard_normal(last - first)
                z -= basis @ (basis.T @ z)
            for _ in range(4):
                z = _twisted(d[inside], b[first : last - 1], value**2, z / np.linalg.norm(z))
                for _ in range(2):
                    z -= basis @ (basis.T @ z)
                z /= np.linalg.norm(z)
        out[inside, j] = z
    for j in range(many):  # the last digits
        out[:, j] -= out[:, :j] @ (out[:, :j].T @ out[:, j])
        out[:, j] /= np.linalg.norm(out[:, j])
    return out


def directions(triangle: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a square matrix, the largest first, values that are zero to double precision left out."""
    d = len(triangle)
    peak = np.abs(triangle).max(initial=0)
    if not d or not peak:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, above, right = bidiagonal(triangle / peak)
    values = singular_values(diagonal, above)
    many = min(many, int((values > d * _EPS * values[0]).sum()))
    vectors = right_vectors(diagonal, above, values, many)
    for k in range(len(right) - 1, -1, -1):
        vectors[k + 1 :] -= np.outer(2 * right[k], right[k] @ vectors[k + 1 :])
    return values[:many] * peak, vectors


def _longs(column: pa.Array) -> np.ndarray:
    """Rows of packed 64-bit integers."""
    return np.array([np.frombuffer(x, "<i8") for x in column.to_pylist()], np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            vectors = batch.column(1)
            values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.floor(256 * values).clip(-(2.0**63), 2.0**63 - 1024).astype("<i8").tobytes()
            ends = 8 * np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
            rows = [x[a:b] for a, b in zip([0, *ends[:-1]], ends)] if len(vectors) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "x"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _longs(batch.column(0))
            n += len(x)
            part = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])  # exact: halves of 32 bits
            total = [a + (int(h) << 32) + int(low) for a, h, low in zip(total or [0] * len(part[0]), *part)]
    rows = total or []
    kind = pa.decimal128(38, 0)
    columns = [pa.array(range(len(rows)), pa.int32()), pa.array([Decimal(v) for v in rows], kind), pa.array([n] * len(rows), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["axis", "total", "n"])


def _centred(x: np.ndarray, sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums exactly, 64-bit where all squares of a row fit and Python's integers elsewhere; x - sums / n in double)."""
    most = max(int(x.max()), -int(x.min()), 1) * n + max(map(abs, sums))
    wide = most * most * len(sums) > _MOST
    apart = (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)
    return apart, (apart / n).astype(float)


def _triangles(sums: list[int], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, held = np.zeros((0, len(sums))), [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append(_centred(_longs(batch.column(0)), sums, n)[1])
                held += batch.num_rows
            if held >= max(2048, 2 * len(sums)):
                found, rows, held = np.linalg.qr(np.vstack([found, *rows]), mode="r"), [], 0
        if held:
            found = np.linalg.qr(np.vstack([found, *rows]), mode="r")
        yield _triangle(TaskContext.get().partitionId(), found)

    return run


def _triangle(place: int, found: np.ndarray) -> pa.RecordBatch:
    some = [found.astype("<f8").tobytes()] if len(found) else []
    return pa.RecordBatch.from_arrays([pa.array([place] * len(some), pa.int32()), pa.array(some, pa.binary())], names=["place", "r"])


def _joined(d: int):
    """Triangles of a group, by place, to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, found = None, np.zeros((0, d))
        for batch in batches:
            for place, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if group is not None and place // _FAN != group:
                    yield _triangle(group, found)
                    found = np.zeros((0, d))
                group = place // _FAN
                found = np.linalg.qr(np.vstack([found, np.frombuffer(r, "<f8").reshape(-1, d)]), mode="r")
        if group is not None:
            yield _triangle(group, found)

    return run


def _products(sums: list[int], n: int, turn: np.ndarray):
    """Sums of whitened rows, and of the products of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        ones, pairs = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _centred(_longs(batch.column(0)), sums, n)[1] @ turn
                ones += w.sum(0)
                pairs += w.T @ w
        rows = [*ones, *pairs.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.float64())], names=["entry", "total"])

    return run


_OUT = "{} {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(sums: list[int], n: int, turn: np.ndarray, explained: np.ndarray, error: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            apart, centred = _centred(_longs(batch.column(1)), sums, n)
            far = [v if v <= _MOST else None for v in (apart * apart).sum(1).tolist()]
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(far, pa.int64()).take(pa.array(each)), pa.array((centred @ turn).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=names,
            )

    return run


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has only finite entries, at least one, and the length that most such rows have (the longer one, if equally many)."""
    c = F.col(vector_col)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.where(c.isNotNull() & (F.size(c) > 0) & ~bad)
    length = good.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size(c) == (length["d"] if length else 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c counts as the whole number floor(256 * c), held at the ends of 64 bits. Mean and directions are fitted on each distinct vector
    of such numbers once. Rows whose vector is null, empty, of another length than most, or holds a null or an entry that is not
    finite take no part; repeated rows and equal ids come out once each; other columns are ignored. Components whose variance is zero to
    double precision are left out, so one distinct vector gives no rows, as does an empty table. Where directions tie, any of them is
    taken, the same for all rows. deviation is null where it does not fit 64 bits.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    chosen = usable(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    packed = stage(chosen.mapInArrow(_pack, f"id {id_type}, x binary"), "packed")
    fit = stage(packed.select("x").distinct(), "distinct")
    totals = fit.mapInArrow(_sums, "axis int, total decimal(38,0), n long").groupBy("axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    rows = sorted(totals.collect())
    schema = _OUT.format(f"`{id_col}`", id_type)
    names = [x.rpartition(" ")[0].strip("`") for x in schema.split(", ")]
    if not rows:
        return spark.createDataFrame([], schema)
    sums, n, d = [int(r["total"]) for r in rows], int(rows[0]["n"]), len(rows)
    tree = stage(fit.mapInArrow(_triangles(sums, n), "place int, r binary"), "triangles")
    while (width := tree.count()) > _FAN:  # each level leaves one triangle in _FAN
        groups = tree.repartition(-(-width // _FAN), F.floor(F.col("place") / _FAN)).sortWithinPartitions("place")
        tree = stage(groups.mapInArrow(_joined(d), "place int, r binary"), "triangles")
    found = [np.frombuffer(r["r"], "<f8").reshape(-1, d) for r in sorted(tree.collect())]
    triangle = np.zeros((d, d))
    if found:
        top = np.linalg.qr(np.vstack(found), mode="r")
        triangle[: len(top)] = top
    values, turned = directions(triangle, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = turned / values * math.sqrt(n)
    explained = (values / np.linalg.norm(triangle)) ** 2
    entries = fit.mapInArrow(_products(sums, n, turn), "entry int, total double").groupBy("entry").agg(F.sum("total").alias("total")).collect()
    flat = np.array([r["total"] for r in sorted(entries)]) / n
    k = len(values)
    error = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())
    unstage(fit)
    return packed.mapInArrow(_whitened(sums, n, turn, explained, error, names), schema)
