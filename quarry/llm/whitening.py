"""Whitening of embeddings by the singular values of their centred rows; no covariance is formed to find them.

Vectors are rounded to whole numbers, so sums are exact. Each task reduces its
centred rows to a triangle by QR, block by block, and triangles are stacked and
reduced again, `fan` at a time, until few are left: R of all rows, as large as the
dimension alone. Householder reflections make R bidiagonal, dqds finds its
singular values to high relative accuracy, and a twisted factorisation for each
of them gives the vector, whose rotation back is the whitening direction.

R and all behind it are as many numbers as the dimension squared, whatever the
rows; they are handled by the driver and go to the tasks.

Defined cases: rows whose vector is null, empty, or has entries that are null, not
finite or of 2**40 and more are left out, and those of another length than most
(of equally many the longer); a vec_id may be null or repeat, each row has its
result. Directions without variance, below 1e-11 of the largest deviation, cannot
be whitened and have no component, so of one vector, however often, there are
none, nor of an empty table. `deviation` is null where it exceeds a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

EPS = float(np.finfo(np.float64).eps)
#: Of squares of numbers up to one, what is taken as zero.
NOTHING = 1e-250
BLOCK = 4096
LARGEST = 1 << 40
SCALE, SHIFT = 64, 1_000_000


# ---- singular values of small matrices


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, right): an upper bidiagonal matrix of diagonal d and off-diagonal e, which is r with orthogonal matrices on both sides, the right one of them `right`."""
    a, n = r.astype(np.float64).copy(), r.shape[1]
    right = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        size = np.linalg.norm(x)
        v = x.copy()
        if size == 0:
            return v, 0.0
        v[0] += math.copysign(size, x[0])
        return v, 2.0 / float(v @ v)

    for k in range(n):
        v, b = reflector(a[k:, k])
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k + 2 < n:
            v, b = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= b * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= b * np.outer(right[:, k + 1 :] @ v, v)
    return a.diagonal().copy(), a.diagonal(1).copy(), right


def _dqds_sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform of a qd array; None where `shift` was above the least eigenvalue."""
    d, new_q, new_e = q[0] - shift, [], []
    if d < 0:
        return None
    for i, off in enumerate(e):
        top = d + off
        if top < NOTHING:
            top = share = 0.0
            d = q[i + 1] - shift
        else:
            share = q[i + 1] / top
            d = d * share - shift
        new_q.append(top)
        new_e.append(off * share)
        if d < 0:
            return None
    new_q.append(d)
    return new_q, new_e


def _shift(q: list[float], e: list[float]) -> float:
    """A guess below the least eigenvalue, by the residual of the vector that the last rows suggest."""
    total = term = e[-1] / q[-2] if q[-2] else 1.0
    for i in range(len(e) - 2, -1, -1):
        if term < 0.01 * total or total > 0.5625 or not q[i]:
            break
        term *= e[i] / q[i]
        total += term
    total *= 1.05
    return q[-1] * (1 - math.sqrt(total)) / (1 + total) if total < 0.5625 else 0.25 * min(q)


def dqds(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling; differential quotient-difference sweeps with shifts."""
    found: list[float] = []
    tolerance = (10 * EPS) ** 2
    size = float(max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))) or 1.0
    stack = [([float(x / size) ** 2 for x in d], [float(x / size) ** 2 for x in e], 0.0)]
    while stack:
        q, e2, moved = stack.pop()
        left = 60 * (len(q) + 2)
        shift = 0.0
        while len(q) > 1:
            if e2[-1] <= tolerance * (moved + q[-1]):
                found.append(moved + q.pop())
                e2.pop()
                shift = 0.0
                continue
            at = next((i for i in range(len(e2) - 2, -1, -1) if e2[i] <= tolerance * (moved + min(q[i], q[i + 1]))), None)
            if at is not None:
                stack.append((q[: at + 1], e2[:at], moved))
                q, e2 = q[at + 1 :], e2[at + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # the small ones belong at the end
                q.reverse()
                e2.reverse()
            shift = max(0.0, _shift(q, e2))
            swept = _dqds_sweep(q, e2, shift)
            while swept is None:
                shift = shift / 4 if shift > 1e-3 * min(q) else 0.0
                swept = _dqds_sweep(q, e2, shift)
            q, e2 = swept
            moved += shift
            left -= 1
            if not left:
                raise RuntimeError("dqds did not settle")
        found += [moved + x for x in q]
    return np.sort(np.array(found))[::-1] * size**2


class Twisted:
    """Twisted factorisations of B'B - x, of a bidiagonal B given as L D L'."""

    def __init__(self, d: np.ndarray, e: np.ndarray):
        size = float(max(np.abs(d).max(initial=0), np.abs(e).max(initial=0)))
        d = np.where(np.abs(d) < 1e-30 * size, 1e-30 * size, d)
        self.least = 1e-60 * size * size or 1e-300
        self.diag, self.low = (d * d).tolist(), (e / d[:-1]).tolist()
        self.n = len(d)

    def factor(self, x: float) -> None:
        """From both ends, to where the two meet with the least remainder."""
        n, diag, low = self.n, self.diag, self.low
        safe = lambda v: v if abs(v) > self.least else math.copysign(self.least, v)
        self.plus, self.minus = [0.0] * (n - 1), [0.0] * (n - 1)
        s, p = [-x] * n, [0.0] * n
        self.down, self.up = [0.0] * n, [0.0] * n
        for i in range(n - 1):
            self.down[i] = safe(s[i] + diag[i])
            self.plus[i] = diag[i] * low[i] / self.down[i]
            s[i + 1] = self.plus[i] * low[i] * s[i] - x
        self.down[n - 1] = safe(s[n - 1] + diag[n - 1])
        p[n - 1] = diag[n - 1] - x
        for i in range(n - 2, -1, -1):
            self.up[i + 1] = safe(diag[i] * low[i] ** 2 + p[i + 1])
            share = diag[i] / self.up[i + 1]
            self.minus[i] = low[i] * share
            p[i] = p[i + 1] * share - x
        self.up[0] = safe(p[0])
        rest = np.abs(np.array(s) + np.array(p) + x)
        self.at = int(np.argmin(np.where(np.isfinite(rest), rest, np.inf)))
        self.rest = s[self.at] + p[self.at] + x

    def vector(self) -> np.ndarray:
        """The vector that the factors send to the twist alone, of length 1."""
        z = np.zeros(self.n)
        z[self.at] = 1.0
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.plus[i] * z[i + 1]
        for i in range(self.at, self.n - 1):
            z[i + 1] = -self.minus[i] * z[i]
        return z / np.linalg.norm(z)


def singular_vectors(d: np.ndarray, e: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values, falling; right singular vectors, as columns, of the first `most` that are not nothing). Vectors of close values are made orthogonal, and where that leaves little, found again by inverse iteration."""
    cuts = [-1, *np.flatnonzero(np.abs(e) <= 4 * EPS * np.maximum(np.abs(d[:-1]), np.abs(d[1:]))).tolist(), len(d) - 1]
    blocks = [(a + 1, b + 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    factors = [Twisted(d[a:b], e[a : b - 1]) for a, b in blocks]
    own = [dqds(d[a:b], e[a : b - 1]) for a, b in blocks]
    where = sorted((-x, k) for k, found in enumerate(own) for x in found)
    squares = np.array([-x for x, _ in where])
    out = np.zeros((len(d), int((squares[:most] > 1e-22 * squares[0]).sum())))
    rng = np.random.default_rng(11)
    for j in range(out.shape[1]):
        x, k = -where[j][0], where[j][1]
        (a, b), twisted = blocks[k], factors[k]
        close = [i for i in range(j) if where[i][1] == k and abs(-where[i][0] - x) <= 1e-3 * x]
        before = out[a:b, close]
        away = lambda z: z - before @ (before.T @ z)  # noqa: B023, E731
        twisted.factor(x)
        z = twisted.vector()
        bare = away(away(z))
        if not np.isfinite(bare).all() or np.linalg.norm(bare) < 0.5:
            whole = np.diag(d[a:b]) + np.diag(e[a : b - 1], 1)
            shifted = whole.T @ whole - x * (1 + 4 * EPS) * np.eye(b - a)
            bare = away(rng.standard_normal(b - a))
            for _ in range(4):
                bare = np.linalg.solve(shifted, bare / np.linalg.norm(bare))
                bare = away(away(bare / np.linalg.norm(bare)))
        out[a:b, j] = bare / np.linalg.norm(bare)
    return squares, out


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of singular values of r, falling; right singular vectors as columns) of the first `most` that are not nothing."""
    d, e, right = bidiagonal(r)
    squares, vectors = singular_vectors(d, e, most)
    found = right @ vectors
    return squares, found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])


# ---- rows


def whole_vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, x): rows with a vector of the common length, as whole numbers."""
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float(LARGEST))))  # NaN is above all
    good = rows.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    widths = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else 0
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return good.where(F.size("v") == width).select("vec_id", x.cast("array<bigint>").alias("x"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _blocks(vectors: pa.Array) -> Iterator[np.ndarray]:
    for i in range(0, len(vectors), BLOCK):
        yield _matrix(vectors.slice(i, BLOCK))


class Centre:
    """n vectors with sums S by dimension: n * x - S exactly, and x - S / n to the last bit."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.middle, self.rest = (np.array([f(s) for s in sums], np.int64) for f in (lambda s: s // n, lambda s: s % n))

    def times(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in Python's numbers where a long does not hold it."""
        off = x - self.middle
        if len(off) and self.n * (int(np.abs(off).max()) + 1) >= 1 << 62:
            return off.astype(object) * self.n - self.rest
        return off * self.n - self.rest

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.times(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        off = self.times(x)
        if off.dtype == object or (len(off) and float((off.astype(np.float64) ** 2).sum(1).max()) >= 2.0**62):
            exact = [sum(int(v) ** 2 for v in row) for row in off]
            return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
        return pa.array((off * off).sum(1))


def centre_of(fit: DataFrame) -> Centre | None:
    """Number and sums of the vectors, exactly: high and low bits are added up apart."""

    def run(batches):
        n, high, low = 0, None, None
        for batch in batches:
            for x in _blocks(batch.column(0)):
                parts = (x >> 20).sum(0), (x & ((1 << 20) - 1)).sum(0)
                high, low = parts if high is None else (high + parts[0], low + parts[1])
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high), dtype=np.int32)), pa.array([n] * len(high), pa.int64()), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    summed = fit.select("x").mapInArrow(run, "dim int, n long, high long, low long").groupBy("dim")
    rows = sorted(summed.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).collect())  # a row for each dimension
    return Centre(int(rows[0]["n"]), [(int(r["high"]) << 20) + int(r["low"]) for r in rows]) if rows else None


def triangle(fit: DataFrame, centre: Centre, fan: int = 32) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    width = len(centre.middle)

    def row(at: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["at", "r"])

    def reduce(blocks) -> np.ndarray | None:
        r = None
        for block in blocks:
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        return r

    def run(batches):
        r = reduce(centre(x) for batch in batches for x in _blocks(batch.column(0)))
        if r is not None:
            yield row(TaskContext.get().partitionId(), r)

    def stacked(values) -> Iterator[np.ndarray]:
        return (np.frombuffer(v.as_py(), "<f8").reshape(-1, width) for v in values)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([row(key[0].as_py(), reduce(stacked(rows.column("r"))))])

    parts = cut(fit.select("x").mapInArrow(run, "at long, r binary"))
    while parts.count() > fan:
        parts = cut(parts.withColumn("at", F.floor(F.col("at") / fan)).groupBy("at").applyInArrow(merge, "at long, r binary"))
    rows = sorted(parts.collect())  # `fan` at most
    r = reduce(np.frombuffer(bytes(x["r"]), "<f8").reshape(-1, width) for x in rows)
    return np.vstack([r, np.zeros((max(0, width - len(r)), width))])


class Whitening:
    """Directions, eigenvalues of the covariance, and the trace."""

    def __init__(self, centre: Centre, r: np.ndarray, most: int):
        squares, self.axes = directions(r, most)
        self.centre = centre
        self.values = squares[: self.axes.shape[1]] / centre.n
        self.trace = float(squares.sum()) / centre.n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.centre(x) @ self.axes) / np.sqrt(self.values)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, by one pass over the rows."""
    k = len(model.values)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _blocks(batch.column(0)):
                w = model(x)  # centred as it is; the means that are left are a rounding's
                first += w.sum(0)
                second += w.T @ w
        i, j = np.triu_indices(k)
        at = np.concatenate([i * k + j, k * k + np.arange(k)])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([second[i, j], first]))], names=["at", "total"])

    got = fit.select("x").mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()  # k * (k + 3) / 2 rows
    sums = {r["at"]: r["total"] for r in got}
    means = np.array([sums[k * k + i] for i in range(k)]) / model.centre.n
    return max(abs(sums[i * k + j] / model.centre.n - means[i] * means[j] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(rows: DataFrame, most: int = 16, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, component (from 1), n, deviation, whitened, explained, eigenvalue, identity_error: one row for each vector and component."""
    read = whole_vectors(rows, id_column, vector)
    fit = cut(read.select("x").distinct())
    kind = rows.schema[id_column].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, eigenvalue double, identity_error double"
    centre = centre_of(fit)
    model = Whitening(centre, triangle(fit, centre), most) if centre else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(fit, model), len(model.values)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                ids, x = batch.column(0).slice(i, BLOCK), _matrix(batch.column(1).slice(i, BLOCK))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                again = lambda a: pa.array(np.tile(a, len(x)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(each), again(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(each), centre.n)), centre.deviations(x).take(each),
                        pa.array(model(x).ravel()), again(model.values / model.trace), again(model.values), pa.array(np.full(len(each), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"],
                )

    return read.mapInArrow(run, schema)
