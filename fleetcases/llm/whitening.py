"""Operator 11, embedding whitening with components by FEAST contour integration.

A vector's entries become whole numbers x = floor(64 c) + 1000000. Mean and covariance V are those of the
fit list, every different x vector once.

1. The fit list is a distinct, written once to the shared folder. Sums of the entries, then of the products
   of entries centred at the whole number nearest the mean, are whole numbers: partial sums of a task are
   exact, are added up by Spark entry by entry, and do not depend on the partitioning. The exact rest of the
   centring is taken off before the division by n.
2. V (as many rows as a vector has entries, however many vectors there are) is brought to tridiagonal
   form once; the signs of the pivots of V - s I there (its inertia) count the eigenvalues below s.
3. The spectrum is cut by these counts into intervals of at most ``WIDEST`` eigenvalues, from the top until
   the components asked for lie above a cut.
4. In every interval a block of vectors is projected onto the eigenspace by Gauss quadrature of the complex
   shifted solves (z I - V)^-1 Q along a circle; Rayleigh-Ritz of V in the block gives pairs; this is repeated
   until the pairs inside settle and are as many as the inertia counts of the interval's ends say. Pairs are
   told from mixtures by their residuals; where they do not settle the block gets room for the eigenvalues beside.
   A last Rayleigh-Ritz over all intervals' vectors makes them orthogonal to double precision.
5. All rows (copies too) are projected by a broadcast matrix of entries x components.

Results for odd input: rows whose vector is null or holds null or non-finite entries are dropped, and so are
those whose entries do not fit whole 64-bit numbers and those whose length is not the commonest one (of
several commonest the greatest; empty vectors count as dropped); copies and rows sharing an id are rows of
their own; a null id stays null; a direction without variance (eigenvalue within rounding of 0) is no
component, so fewer than ``n_components`` may be returned, none for a single different vector; equal
eigenvalues keep one arbitrary basis, the same for all rows; a deviation beyond 64 bits is null; an empty
table gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import stage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: eigenvalues in an interval at most (unless they are equal to rounding), nodes on a half circle, rounds
WIDEST, NODES, ROUNDS = 8, 8, 40
#: half widths of an interval around its middle beyond which the quadrature leaves less than a thousandth of a vector
REACH = 1.6
#: entries up to here leave room for the offset in 64 bits
_FITS = float(2**62)
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows that can be used."""
    c = F.col("c")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("c"))
    good = F.forall(c, lambda e: F.coalesce(F.abs(e * SCALE) < _FITS, F.lit(False)) & ~F.isnan(e))
    rows = rows.filter(c.isNotNull() & (F.size(c) > 0) & F.coalesce(good, F.lit(False)))
    width = rows.groupBy(F.size(c).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.filter(F.size(c) == (width["width"] if width else 0))
    return rows.select("vec_id", F.transform(c, lambda e: F.floor(e * SCALE).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix (all lists have one length)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _add_up(rows: DataFrame, partial, size: int, bits: int) -> list[int]:
    """Sum of whole-number arrays over all partitions: ``partial`` makes one array of ``size`` Python
    integers of a partition; they are added entry by entry as two limbs, so no sum overflows."""
    schema = pa.schema([("at", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])

    def limbs(it: Iterator[pa.RecordBatch]):
        total = partial(it)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([int(t) >> bits for t in total], pa.int64()),
                 pa.array([int(t) & ((1 << bits) - 1) for t in total], pa.int64())], schema=schema)

    out = [0] * size
    wide = "decimal(38,0)"
    for r in (rows.mapInArrow(limbs, "at int, high long, low long").groupBy("at")
              .agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()):
        out[r["at"]] = (int(r["high"]) << bits) + int(r["low"])
    return out


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S per entry and the covariance V (divisor n) of the vectors x of ``fit``."""
    def sums(it):
        n, total = 0, [0] * d
        for batch in it:
            x = _matrix(batch.column(0))
            n += len(x)
            # 32-bit halves keep the column sums of a batch exact
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(k) for t, h, k in zip(total, high, low, strict=True)]
        return [n, *total] if n else None

    n, *s = _add_up(fit.select("x"), sums, d + 1, 62)
    if not n:
        return 0, s, np.zeros((d, d))
    centre = [(2 * t + n) // (2 * n) for t in s]

    def products(it):
        total, any_rows = np.zeros((d, d), object), False
        mid = np.array(centre, np.int64)
        for batch in it:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            any_rows, y = True, x - mid
            most = max(int(np.abs(y.max())), int(np.abs(y.min())), 1)
            # products of so many rows add up below 2^53: exact in doubles
            step = (2**53 - 1) // most**2
            if step:
                for lo in range(0, len(y), step):
                    part = y[lo:lo + step].astype(float)
                    total += (part.T @ part).astype(np.int64).astype(object)
            else:
                total += y.astype(object).T @ y.astype(object)
        return total.ravel().tolist() if any_rows else None

    p = _add_up(fit.select("x"), products, d * d, 62)
    rest = [t - n * c for t, c in zip(s, centre, strict=True)]
    v = [[(n * p[i * d + j] - rest[i] * rest[j]) / n**2 for j in range(d)] for i in range(d)]
    return n, s, np.array(v)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of a tridiagonal matrix with the eigenvalues of ``v``."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        u = a[k + 1:, k].copy()
        norm = np.linalg.norm(u)
        if norm == 0 or norm == abs(u[0]):
            continue
        u[0] += math.copysign(norm, u[0])
        u /= np.linalg.norm(u)
        a[k + 1:, :] -= 2 * np.outer(u, u @ a[k + 1:, :])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_below(diag: np.ndarray, off: np.ndarray, s: float) -> int:
    """Eigenvalues below ``s``: negative pivots of the tridiagonal matrix less s times the identity."""
    least = np.finfo(float).tiny
    n, pivot = 0, 1.0
    for k, a in enumerate(diag.tolist()):
        pivot = a - s - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < least:
            pivot = -least
        n += pivot < 0
    return n


def intervals(diag, off, lo: float, hi: float, wanted: int, eps: float) -> list[tuple[float, float, int]]:
    """Intervals from the top down, with the number of eigenvalues in each, until ``wanted`` are in."""
    todo, out, have = [(lo, hi, count_below(diag, off, lo), count_below(diag, off, hi))], [], 0
    while todo and have < wanted:
        a, b, na, nb = todo.pop()
        if nb == na:
            continue
        if nb - na <= WIDEST or b - a <= eps:
            out.append((a, b, nb - na))
            have += nb - na
        else:
            mid = (a + b) / 2
            nm = count_below(diag, off, mid)
            todo += [(a, mid, na, nm), (mid, b, nm, nb)]
    return out


def feast(v: np.ndarray, a: float, b: float, count: int, eps: float, near: int = 0) -> np.ndarray:
    """Unit eigenvectors of ``v``, as columns, for its ``count`` eigenvalues in [a, b). Where they do not settle, a
    second run has room for all ``near`` eigenvalues within ``REACH`` half widths of the middle."""
    for m in (count + max(4, count), max(count, near) + max(4, count)):
        got = _settled_pairs(v, a, b, count, eps, min(len(v), m))
        if got is not None:
            return got
    raise RuntimeError(f"interval [{a}, {b}): pairs do not agree with the {count} eigenvalues its inertia counts")


def _settled_pairs(v: np.ndarray, a: float, b: float, count: int, eps: float, m: int) -> np.ndarray | None:
    """The vectors of ``feast`` out of a block of ``m``; None if they do not settle."""
    d = len(v)
    q = np.random.default_rng(d).standard_normal((d, m))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    mid, radius = (a + b) / 2, max((b - a) / 2, eps)
    circle = radius * np.exp(1j * np.pi / 2 * (nodes + 1))       # the upper half; the lower one is conjugate
    best = None
    for _ in range(ROUNDS):
        filtered = np.zeros((d, m))
        for w, z in zip(weights, circle, strict=True):
            filtered += (w / 2) * (z * np.linalg.solve((mid + z) * np.eye(d) - v, q)).real
        basis, _ = np.linalg.qr(filtered)
        ritz, turn = np.linalg.eigh(basis.T @ v @ basis)
        q = basis @ turn
        # a mixture of vectors from below and above has a Ritz value inside, too: its residual tells it from a pair
        off = np.abs(v @ q - q * ritz).max(axis=0)
        inside = np.flatnonzero((ritz >= a - eps) & (ritz <= b + eps))
        inside = inside[np.argsort(off[inside], kind="stable")[:count]]
        inside = inside[np.argsort(np.abs(ritz[inside] - mid), kind="stable")]
        met, rest = len(inside) == count, off[inside].max(initial=0.0)
        if met and best is not None and best / 2 <= rest <= eps:
            return q[:, inside]
        best = rest if met else None
    return None


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of ``v``, falling, and unit eigenvectors as columns."""
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((d, 0))
    eps = 4 * d * np.finfo(float).eps * size
    diag, off = tridiagonal(v)
    # below 2 eps an eigenvalue is rounding; size bounds all eigenvalues
    cut = intervals(diag, off, 2 * eps, size + eps, wanted, eps)
    if not cut:
        return np.zeros(0), np.zeros((d, 0))
    def near(a: float, b: float) -> int:
        mid, reach = (a + b) / 2, REACH * max((b - a) / 2, eps)
        return count_below(diag, off, mid + reach) - count_below(diag, off, mid - reach)

    basis, _ = np.linalg.qr(np.hstack([feast(v, a, b, n, eps, near(a, b)) for a, b, n in cut]))
    ritz, turn = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-ritz, kind="stable")[:wanted]
    values = ritz[order]
    floor = cut[-1][0]
    if len(ritz) != d - count_below(diag, off, floor) or ritz.min() < floor - eps:
        raise RuntimeError("a component was missed")
    return values, (basis @ turn)[:, order]


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Exact sum of (n x - S)^2 per row, with x = y + S // n and rest = S % n; null beyond 64 bits."""
    most = max(abs(n * int(e) - t) for edge in (y.min(axis=0), y.max(axis=0)) for e, t in zip(edge, rest, strict=True))
    if most**2 * len(rest) < 2**63:
        z = n * y - np.array(rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    out = [sum((n * int(e) - t) ** 2 for e, t in zip(row, rest, strict=True)) for row in y]
    return [v if v < 2**63 else None for v in out]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           n_components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained (share of the trace) and identity_error (how far the covariance of the whitened fit list is
    from the identity, at most)."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col)
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    one = fit.first()
    if one is None:
        return spark.createDataFrame([], _OUT)
    d = len(one["x"])
    n, s, v = moments(fit, d)
    values, vectors_ = components(v, min(n_components, d))
    if not len(values):
        return spark.createDataFrame([], _OUT)
    matrix = vectors_ / np.sqrt(values)
    error = float(np.abs(matrix.T @ v @ matrix - np.eye(len(values))).max())
    explained = (values / np.trace(v)).tolist()
    shared = spark.sparkContext.broadcast((n, s, matrix))
    k = len(values)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(it: Iterator[pa.RecordBatch]):
        n, s, matrix = shared.value
        whole, rest = np.array([t // n for t in s], np.int64), [t % n for t in s]
        part = np.array([t / n for t in rest])
        for batch in it:
            y = _matrix(batch.column(1)) - whole
            m = len(y)
            if not m:
                continue
            # entry by entry, so that a row's sums do not depend on the rows that share its batch
            z = np.zeros((m, k))
            for e, row in zip((y - part).T, matrix, strict=True):
                z += e[:, None] * row
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(_deviations(y, n, rest), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], schema=schema)

    return rows.mapInArrow(project, _OUT)
