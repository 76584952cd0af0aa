"""Whitening of embeddings with components from FEAST contour integration.

Vectors are counted in 256ths, x = floor(256 c), so that equality and sums are exact. The
fit list is each distinct x vector once. Over it, each a pass of partial sums in tasks:

1. n and the sums S of each dimension, as exact integers;
2. the covariance V of x - S/n, centred before multiplying (d x d numbers, d the dimension);
3. the covariance of the whitened fit list, for its distance from the identity.

What the driver holds is d x d and never grows with the rows. On V it runs:

* Inertia counts. V is brought to tridiagonal form T once (orthogonal, so eigenvalues stay);
  the signs of the pivots of T - s I tell how many eigenvalues lie above s. Bisection finds
  intervals of the axis with few eigenvalues and empty margins.
* FEAST. For an interval, the sum over the nodes of a circle around it of weighted complex
  solves (z I - V)^-1 Y is the projection of Y onto the eigenvectors inside. Rayleigh-Ritz in
  that space gives values and vectors; they are the next Y until the residuals are of the
  size of rounding.
* The inertia count of the interval says how many eigenvalues it holds; a search that ends
  with fewer goes on with more columns, so that none is missed.

Rows whose vector is null, or holds null or non-finite entries, are left out, and so are
rows whose vector has another number of entries than most (of equal counts the larger
dimension; zero entries never). Repeated rows give a row each and count once in the fit list.
Components without variance (relative 1e-13) cannot be whitened and are not given, so a table
of equal vectors gives none; an empty table gives no rows. Equal eigenvalues have any
orthonormal vectors of their space, the same for all rows. Columns beyond the named ones are
not looked at. Entries beyond the range of a long are its ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.scratch import keep, plain
from vigilog.llm.sums import PARTIAL, added, listed, partial_sums
from vigilog.session import ship_package

SCALE = 256
NODES = 16  # on the circle; the upper half is solved
ROUNDS = 60  # of FEAST; a handful are needed
_LONG = np.iinfo(np.int64)


# --- vectors as integers ---------------------------------------------------------------


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as long; beyond its range its ends."""
    x = np.floor(values.astype(np.float64) * SCALE)
    inside = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(x >= 2.0**63, _LONG.max, inside)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, where each row begins, which rows are whole) of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten()  # entries of null rows are not among them
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    return entries, ends, (sizes > 0) & (bad[ends[1:]] == bad[ends[:-1]])


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row of longs as bytes, in the fewest that hold all its values (2, 4 or 8 each).

    Equal rows give equal bytes: the width follows from the row. The length tells the width.
    """
    if not len(rows):
        return pa.array([], pa.binary())
    top = np.maximum(rows.max(axis=1), -(rows.min(axis=1) + 1))
    out = np.empty(len(rows), dtype=object)
    width = np.where(top < 2**15, 2, np.where(top < 2**31, 4, 8))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        data, size = rows[at].astype(f"<i{w}").tobytes(), rows.shape[1] * int(w)
        for k, i in enumerate(at):
            out[i] = data[k * size : (k + 1) * size]
    return pa.array(out, pa.binary())


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """The rows of longs that ``_packed`` wrote."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    out = np.empty((len(column), dimension), dtype=np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        data = b"".join(column.take(pa.array(at)).to_pylist())
        out[at] = np.frombuffer(data, f"<i{size // dimension}").reshape(len(at), dimension)
    return out


def _whole_rows(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are kept, and their x."""
    entries, ends, whole = _lists(column)
    rows = np.flatnonzero(whole & (np.diff(ends) == dimension))
    at = ends[rows][:, None] + np.arange(dimension)
    return rows, scaled(entries[at]) if len(rows) else np.zeros((0, dimension), np.int64)


def dimension_of(vectors: DataFrame) -> int:
    """The number of entries that most whole vectors have; 0 without any."""

    def count(batches):
        for batch in batches:
            _, ends, whole = _lists(batch.column("vector"))
            sizes, times = np.unique(np.diff(ends)[whole], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], ["d", "n"])

    told = vectors.select("vector").mapInArrow(count, "d bigint, n bigint").groupBy("d").agg(F.sum("n").alias("n"))
    found = told.orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


def fit_list(vectors: DataFrame, dimension: int) -> DataFrame:
    """(x): each distinct x vector once, packed."""

    def pack(batches):
        for batch in batches:
            x = _whole_rows(batch.column("vector"), dimension)[1]
            yield pa.RecordBatch.from_arrays([_packed(x)], ["x"])

    return vectors.select("vector").mapInArrow(pack, "x binary").distinct()


# --- sums over the fit list --------------------------------------------------------------


def counts_and_sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """n and S, exact: halves of 32 bits are added apart, as decimals across tasks."""

    def add(batches):
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = _unpacked(batch.column("x"), dimension)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dimension), pa.int64()), pa.array([n] * dimension, pa.int64()), pa.array(high), pa.array(low)],
            ["row", "n", "high", "low"],
        )

    told = fit.mapInArrow(add, "row bigint, n bigint, high bigint, low bigint").groupBy("row")
    rows = told.agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    ).collect()
    rows = sorted(rows, key=lambda r: r["row"])
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _covariance(fit: DataFrame, dimension: int, n: int, mean: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """Covariance of x - mean over the fit list, or of its projection onto columns of ``onto``."""
    width = dimension if onto is None else onto.shape[1]

    def add(batches):
        total = np.zeros((width, width))
        for batch in batches:
            away = _unpacked(batch.column("x"), dimension) - mean
            away = away if onto is None else away @ onto
            total += away.T @ away
        yield partial_sums(total)

    return added(fit.mapInArrow(add, PARTIAL)) / n


# --- eigenvectors --------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of an orthogonally similar matrix (Householder)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        q = 2 * (p - (x @ p) * x)
        rest -= np.outer(x, q) + np.outer(q, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(d - 1)])


def above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Inertia: how many eigenvalues are larger than ``shift``, by pivots of T - shift I."""
    main, side = tri
    least = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    for i, value in enumerate(main):
        pivot = value - shift - (side[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


def _edge(tri, low: float, high: float, wanted: int) -> float:
    """A shift near the point below which the ``wanted``-th largest eigenvalue lies."""
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        if above(tri, mid) >= wanted:
            low = mid
        else:
            high = mid
    return low


def _ritz(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values (falling) and vectors of V in the space of ``y``."""
    basis = np.linalg.qr(y)[0]
    small = basis.T @ v @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (basis @ vectors)[:, ::-1]


def feast(v: np.ndarray, low: float, high: float, inside: int, seed: int = 20240601) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues of symmetric ``v`` in [low, high], falling, with vectors.

    Gauss-Legendre nodes on the circle over the interval; of a real matrix the lower half of
    the circle gives the conjugate, so the upper is solved.
    """
    d = len(v)
    size = np.linalg.norm(v, 2) if d else 0.0
    columns = min(d, inside + max(2, inside // 2))
    rng = np.random.default_rng(seed)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi / 2 * (1 + nodes))
    solves = [(centre + radius * t, w * radius * t) for t, w in zip(turn, weights)]
    y = rng.standard_normal((d, columns))
    best = None
    for turns in range(ROUNDS):
        projected = np.zeros((d, y.shape[1]))
        for z, weight in solves:
            projected += (weight * np.linalg.solve(z * np.eye(d) - v, y.astype(complex))).real / 2
        values, vectors = _ritz(v, projected)
        residual = np.linalg.norm(v @ vectors - vectors * values, axis=0)
        # Columns beyond the rank of the projection are noise, whose Ritz values may lie inside.
        near = residual <= 4 * d * np.finfo(float).eps * size
        within = np.flatnonzero(near & (values >= low) & (values <= high))
        worst = residual[within].max(initial=0.0)
        if len(within) == inside:
            if best is not None and worst >= best[0] / 2:
                return best[1:] if best[0] < worst else (values[within], vectors[:, within])
            best = (worst, values[within], vectors[:, within])
        elif len(within) < inside and y.shape[1] < d and turns >= 3:  # inertia says that some are missing
            vectors = np.hstack([vectors, rng.standard_normal((d, min(inside, d - y.shape[1])))])
        y = vectors
    if best is None:
        raise ArithmeticError(f"{inside} eigenvalues lie in [{low}, {high}]; the contour found {len(within)}")
    return best[1:]


def largest_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, with unit vectors.

    Intervals are cut where inertia counts show a gap; each is searched by its own contour.
    """
    d = len(v)
    k = min(k, d)
    if not k:
        return np.zeros(0), np.zeros((d, 0))
    if not v.any():
        return np.zeros(k), np.eye(d)[:, :k]
    # Numbers of order one; powers of two change no digits.
    unit = 2.0 ** np.ceil(np.log2(np.abs(v).max()))
    v = v / unit
    tri = tridiagonal(v)
    bound = np.abs(v).sum(axis=1).max() * 1.01 + 1e-300
    close = 1e-9 * bound
    values, vectors, top = [], [], bound
    while len(values) < k:
        # One interval holds the next eigenvalue and all that follow within small gaps.
        done, last = len(values), len(values) + 1
        first = edge = _edge(tri, -bound, top, last)
        while last < d:
            following = _edge(tri, -bound, edge, last + 1)
            if edge - following > max(close, 0.02 * abs(first)) or (last >= k and edge - following > close):
                break
            edge, last = following, last + 1
        following = _edge(tri, -bound, edge, last + 1) if last < d else -bound
        low = (edge + max(following, edge - bound / 4)) / 2
        # As much room above as below, so that the circle is of the size of the gaps.
        high = min(top, first + max(edge - low, 4 * np.finfo(float).eps * bound))
        inside = above(tri, low) - above(tri, high)
        found, at = feast(v, low, high, inside)
        if inside != len(found) or inside != last - done:
            raise ArithmeticError(f"inertia counts {last - done} and {inside}, contour {len(found)}")
        values += found.tolist()
        vectors += list(at.T)
        top = low
    order = np.argsort(-np.array(values), kind="stable")[:k]
    return np.array(values)[order] * unit, np.array(vectors)[order].T


# --- the operator ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: everything of the size of one vector, or a few of them."""

    dimension: int
    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column each
    total: float  # trace of the covariance
    identity_error: float


def fit(vectors: DataFrame, components: int, *, vector_col: str = "vector") -> Whitening | None:
    """The largest components of the distinct vectors; None without a whole vector."""
    ship_package(vectors.sparkSession)
    narrow = plain(vectors, vector=vector_col)
    dimension = dimension_of(narrow)
    if not dimension:
        return None
    listed = keep(fit_list(narrow, dimension), "vectors")
    n, sums = counts_and_sums(listed, dimension)
    mean = np.array([_ratio(s, n) for s in sums])
    v = _covariance(listed, dimension, n, mean)
    v = (v + v.T) / 2
    values, columns = largest_components(v, components)
    some = values > 1e-13 * max(np.abs(v).max(), 1e-300) * dimension
    values, columns = values[some], columns[:, some]
    error = 0.0
    if len(values):
        white = _covariance(listed, dimension, n, mean, columns / np.sqrt(values))
        error = float(np.abs(white - np.eye(len(values))).max())
    return Whitening(dimension, n, tuple(sums), mean, values, columns, float(np.trace(v)), error)


def _ratio(a: int, b: int) -> float:
    return a / b  # of integers: rounded once


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """sum of (n x - S)^2 a row, exact; null beyond the range of a long."""
    top = max(int(np.abs(x[x > _LONG.min]).max(initial=0)), 2**63 if (x == _LONG.min).any() else 0)
    reach = n * top + max(map(abs, sums))
    if x.shape[1] * reach * reach < 2**63:
        away = x * n - np.array(sums, dtype=np.int64)
        return pa.array((away * away).sum(axis=1))
    told = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([t if t < 2**63 else None for t in told], pa.int64())


def whiten(
    vectors: DataFrame, components: int = 4, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error), a row for each vector.

    ``whitened`` and ``explained`` are arrays by component, of falling eigenvalue.
    """
    narrow = plain(vectors, vec_id=id_col, vector=vector_col)
    model = fit(narrow, components)
    kind = dict(narrow.dtypes)["vec_id"]
    schema = f"vec_id {kind}, deviation bigint, whitened array<double>"
    if model is None:
        projected, explained = narrow.sparkSession.createDataFrame([], schema), []
    else:
        onto = model.vectors / np.sqrt(model.values)
        explained = (model.values / model.total).tolist() if model.total else []

        def project(batches):
            for batch in batches:
                rows, x = _whole_rows(batch.column("vector"), model.dimension)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        _deviations(x, model.n, model.sums),
                        listed((x - model.mean) @ onto),
                    ],
                    ["vec_id", "deviation", "whitened"],
                )

        projected = narrow.mapInArrow(project, schema)
    return projected.select(
        "vec_id",
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
