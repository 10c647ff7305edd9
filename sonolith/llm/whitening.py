"""Whitening of embeddings by singular values of the centred rows.

Blocks of centred rows are reduced to triangles by QR, and triangles in groups to one, until a single R of the whole table
is left. Householder reflections make R bidiagonal; the dqds iteration finds its singular values to high relative
accuracy without forming a covariance; twisted factorisations give the vectors, which the reflections carry back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows of a block, triangles that one task stacks, and components returned.
BLOCK, FAN_IN, COMPONENTS = 4096, 64, 8
_EPS = float(np.finfo(float).eps)
_TINY = float(np.finfo(float).tiny)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v): u' r v is upper bidiagonal with these, by Householder reflections; v is orthogonal."""
    a, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        w, norm = x.copy(), np.linalg.norm(x)
        if norm == 0 or len(x) == 1:
            return w, 0.0
        w[0] += norm if x[0] >= 0 else -norm
        return w, 2.0 / float(w @ w)

    for k in range(d):
        w, t = reflector(a[k:, k])
        a[k:, k:] -= t * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w, t = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= t * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= t * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """One differential quotient-difference step with a shift; False where it went below zero."""
    n = len(q)
    qq, ee = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        qq[i] = d + e[i]
        if d < 0 or qq[i] <= 0:
            return q, e, False
        t = q[i + 1] / qq[i]
        ee[i] = e[i] * t
        d = d * t - shift
    qq[n - 1] = d
    return qq, ee, d >= 0


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds.

    Its squared entries are iterated; the last entry falls to the smallest value left, which the accumulated shifts
    are added to. A shift is tried a little below the smallest pivot and halved until no pivot goes below zero.
    """
    out: list[float] = []

    def block(q: np.ndarray, e: np.ndarray) -> None:
        total, small = 0.0, 0.0
        for _ in range(100 * len(q) + 100):
            while len(q) and (len(q) == 1 or e[-1] <= _EPS * _EPS * (q[-1] + total) or e[-1] <= _TINY):
                out.append(float(q[-1] + total))
                q, e, small = q[:-1], e[:-1], 0.0
            if not len(q):
                return
            cut = np.flatnonzero(e <= _EPS * _EPS * (q[1:] + total))
            if len(cut):
                # the two parts share the shifts taken so far
                for a, b in zip([0, *(cut + 1)], [*(cut + 1), len(q)], strict=True):
                    out.extend(total + x for x in singular_squares(np.sqrt(q[a:b]), np.sqrt(e[a : b - 1])))
                return
            shift = small
            while True:
                made = _dqds(q, e, shift)
                if made[2]:
                    break
                shift = shift / 4 if shift > _EPS * float(q.max()) * _EPS else 0.0
            q, e = made[:2]
            total += shift
            # a lower bound of the smallest value: pivots less their neighbours' pull
            pull = np.zeros(len(q))
            pull[:-1] += np.sqrt(np.maximum(q[:-1] * e, 0))
            pull[1:] += np.sqrt(np.maximum(q[:-1] * e, 0))
            full = q + np.concatenate([[0.0], e])
            small = max(0.0, float((full - pull).min()), 0.0 if len(q) < 2 else float(q[-1] - np.sqrt(q[-2] * e[-1])) * 0.98)
        raise ArithmeticError("dqds did not converge")

    if len(diagonal):
        block(np.asarray(diagonal, float) ** 2, np.asarray(above, float) ** 2)
    return np.sort(np.array(out))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float, scale: float):
    """The tridiagonal matrix (diagonal a, beside it b) less value, factored from both ends.

    Returns solve(x) by N D N', twisted at the row where the two factorisations meet with the smallest pivot, and that row.
    """
    n, least = len(a), _EPS * scale * _EPS
    safe = lambda x: x if abs(x) > least else (least if x >= 0 else -least)
    down, up = np.empty(n), np.empty(n)  # pivots of L D L' and U D U'
    down[0] = safe(a[0] - value)
    for i in range(1, n):
        down[i] = safe(a[i] - value - b[i - 1] ** 2 / down[i - 1])
    up[-1] = safe(a[-1] - value)
    for i in range(n - 2, -1, -1):
        up[i] = safe(a[i] - value - b[i] ** 2 / up[i + 1])
    gamma = down + up - (a - value)
    twist = int(np.argmin(np.abs(gamma)))
    pivot = safe(float(gamma[twist]))

    def solve(x: np.ndarray) -> np.ndarray:
        y = x.copy()
        for i in range(twist):
            y[i + 1] -= b[i] / down[i] * y[i]
        for i in range(n - 1, twist, -1):
            y[i - 1] -= b[i - 1] / up[i] * y[i]
        z = np.empty(n)
        z[twist] = y[twist] / pivot
        for i in range(twist - 1, -1, -1):
            z[i] = (y[i] - b[i] * z[i + 1]) / down[i]
        for i in range(twist + 1, n):
            z[i] = (y[i] - b[i - 1] * z[i - 1]) / up[i]
        return z

    return solve, twist


def singular_vectors(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of a bidiagonal matrix B for its first ``squares``, by twisted factorisations of
    B'B less each. Vectors of values side by side are kept orthogonal; they then take further solves."""
    n = len(diagonal)
    a = diagonal**2 + np.concatenate([[0.0], above**2])
    b = diagonal[:-1] * above
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    out = np.zeros((n, len(squares)))
    for j, value in enumerate(squares):
        solve, twist = _twisted(a, b, float(value), scale)
        close = out[:, :j][:, np.abs(squares[:j] - value) <= 1e-3 * scale]
        best = None
        for start in (twist, *range(n)):
            z = np.zeros(n)
            z[start] = 1.0
            for _ in range(4):
                z = solve(z - close @ (close.T @ z))
                z = z / (np.abs(z).max() or 1.0)
                for _ in range(2):
                    z -= close @ (close.T @ z)
                norm = np.linalg.norm(z)
                if norm < 1e-8:  # nothing new in this direction
                    break
                z /= norm
            else:
                wrong = a * z - value * z
                wrong[:-1] += b * z[1:]
                wrong[1:] += b * z[:-1]
                error = float(np.linalg.norm(wrong))
                if best is None or error < best[0]:
                    best = error, z
                if error <= 64 * n * _EPS * scale:
                    break
        if best is None:
            raise ArithmeticError("no vector found")
        out[:, j] = best[1]
    return out


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of the singular values of r, falling; right singular vectors of the first ``most`` as columns)."""
    diagonal, above, v = bidiagonal(r)
    squares = singular_squares(diagonal, above)
    return squares, v @ singular_vectors(diagonal, above, squares[:most])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _integers(column: pa.Array, d: int) -> np.ndarray:
    return np.floor(1024.0 * _matrix(column, d).astype(np.float64)).astype(np.int64) + 100_000


def _triangle(x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    r = np.linalg.qr(x, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _usable(embeddings: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    held = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embeddings.filter(v.isNotNull() & held).withColumn(vector, v)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S) ** 2; None where a long can't hold one."""
    s = np.array(sums, np.int64) if max(map(abs, sums), default=0) < 1 << 62 else None
    if s is not None and n * (float(np.abs(x).max(initial=0)) + 1.0) < 2.0**62:
        rough = ((float(n) * x - s.astype(float)) ** 2).sum(1)
        if rough.max(initial=0.0) < 2.0**62:
            return ((n * x - s) ** 2).sum(1).tolist()
    exact = (sum((n * v - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whitened(embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped, as are those whose length isn't the
    commonest (of equals the longest) or zero. Entries become floor(1024 * c) + 100000. Where a component has no variance
    (fewer different vectors than components, constant dimensions) whitened is null, and identity_error leaves it out;
    deviation is null where it exceeds a long. Repeated rows and null ids count as rows; further columns are ignored. An
    empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    kind = dict(embeddings.dtypes)[vec_id]
    rows = _usable(embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "v")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).filter("d > 0")
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], schema)
    d, n = most["d"], most["n"]
    rows = rows.filter(F.size("v") == d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            total = [a + b for a, b in zip(total, _integers(batch.column(0), d).sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "s"])

    parts = rows.select("v").mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(parts.collect(), key=lambda r: r["i"])]  # one row per dimension
    mean = np.array([s // n + s % n / n for s in sums])  # whole part first, so that large sums lose nothing

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = _triangle(np.vstack([r, _integers(batch.column(0).slice(at, BLOCK), d) - mean]))
        if len(r):
            yield packed(r)

    def packed(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for x in batch.column(0):
                r = _triangle(np.vstack([r, np.array(x.as_py()).reshape(d, d)]))
        if len(r):
            yield packed(r)

    triangles = C.materialize(rows.select("v").mapInArrow(reduce, "r array<double>"), "triangles")
    while (count := triangles.count()) > 1:
        before = triangles
        triangles = C.materialize(before.repartition(-(-count // FAN_IN)).mapInArrow(stack, "r array<double>"), "triangles")
        C.discard(before)
    r = np.array(triangles.first()["r"]).reshape(d, d)
    k = min(components, d)
    squares, v = directions(r, k)
    trace = float(squares.sum()) / n
    values = squares[:k] / n
    # rounding of centring and QR leaves some d * eps of the trace
    live = values > 8 * d * _EPS * max(trace, _TINY)
    weights = np.where(live, v / np.sqrt(np.where(live, values, 1.0)), 0.0)
    explained = [float(x / trace) if trace > 0 else 0.0 for x in values]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers, means and centred products of whitened rows, blocks merged."""
        m, c, p = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                w = (_integers(batch.column(0).slice(at, BLOCK), d) - mean) @ weights
                own, size = w.mean(0), len(w)
                gap = own - c
                p += (w - own).T @ (w - own) + np.outer(gap, gap) * (m * size / (m + size))
                c, m = c + gap * size / (m + size), m + size
        if m:
            yield pa.RecordBatch.from_pydict({"m": [m], "c": [c.tolist()], "p": [p.ravel().tolist()]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c, p = 0, np.zeros(k), np.zeros((k, k))
        for row in (row for batch in batches for row in batch.to_pylist()):
            size, gap = row["m"], np.array(row["c"]) - c
            p += np.array(row["p"]).reshape(k, k) + np.outer(gap, gap) * (m * size / (m + size))
            c, m = c + gap * size / (m + size), m + size
        if m:
            yield pa.RecordBatch.from_pydict({"m": [m], "c": [c.tolist()], "p": [p.ravel().tolist()]})

    shape = "m long, c array<double>, p array<double>"
    parts = C.materialize(rows.select("v").mapInArrow(moments, shape), "moments")
    while (count := parts.count()) > 1:
        before = parts
        parts = C.materialize(before.repartition(-(-count // FAN_IN)).mapInArrow(merged, shape), "moments")
        C.discard(before)
    covariance = np.array(parts.first()["p"]).reshape(k, k) / n
    C.discard(triangles, parts)
    error = float(np.abs(covariance - np.eye(k))[np.ix_(live, live)].max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in C.pieces(batches, rows=BLOCK):
            x = _integers(batch.column(1), d)
            w, m = (x - mean) @ weights, len(x)
            again = np.arange(m).repeat(k)
            flat = pa.array(w.ravel(), mask=np.tile(~live, m))
            component, deviation = np.tile(np.arange(1, k + 1, dtype=np.int32), m), pa.array(_deviations(x, n, sums), pa.int64())
            columns = [batch.column(0).take(pa.array(again)), pa.array(component), pa.array(np.full(m * k, n)), deviation.take(pa.array(again))]
            columns += [flat, pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("vec_id", "v").mapInArrow(project, schema)
