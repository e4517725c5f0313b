"""Whitening of vectors, with eigenpairs of the covariance by contour integration.

Vectors are made integers, so that counts, sums and sums of products are exact:
the covariance is a quotient of integers, centred before anything is multiplied
(at the mean rounded to an integer; the small rest is taken off exactly). Tasks
add up their own rows with matrix products that double precision holds exactly,
and an aggregation adds up the tasks; only sums of the size of a covariance
reach the driver.

The spectrum is cut into intervals that hold a few eigenvalues each, by inertia:
as many eigenvalues lie below s as V - s has negative pivots. Every interval is a
task of its own. There, the projector onto its eigenvectors, an integral of
(z - V)^-1 around the interval, is applied by quadrature to a few start vectors:
one complex shifted solve for each point of the contour. Rayleigh and Ritz extract
eigenpairs from what it spans, until all residuals vanish in rounding; as many
must lie in the interval as the inertia says.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LIMIT = 2**40
"""Entries are at most this large after scaling; larger ones (of either sign) count as this."""
ROWS = 4096
"""Rows multiplied at a time."""
POINTS = 8
"""Quadrature points on the upper half of a contour; the lower half is its mirror image."""
PER_INTERVAL = 8
"""Eigenvalues in an interval, unless they lie so close that no cut parts them."""
MOST_ROUNDS = 40
TOLERANCE = 1e-13
"""Residuals, relative to the norm of the covariance."""


class Whitening(NamedTuple):
    """What whitens the vectors of one number of dimensions."""

    n: int
    centre: np.ndarray
    """Mean of the integer vectors, rounded, [dims]."""
    rest: list[int]
    """n times what the mean is above ``centre``, exact, [dims]."""
    trace: float
    values: np.ndarray
    """Falling eigenvalues of the covariance."""
    vectors: np.ndarray
    """[dims, components]: unit eigenvectors."""
    identity_error: float
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""


def integers(column: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> Column:
    """Integer vector: floor(``scale`` * entry) + ``offset``; null for vectors that are null or hold null or non-finite entries."""
    infinity = F.lit(float("inf"))
    values = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
    held = lambda x: F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    whole = F.transform(values, lambda x: F.floor(held(x)).cast("long") + F.lit(offset).cast("long"))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(rows, dims, their numbers in the batch, integer matrix), at most ROWS rows at a time, by number of dimensions."""
    for rows in batches:
        lists = rows.column(column)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes):
            own = np.flatnonzero(sizes == dims)
            for begin in range(0, len(own), ROWS):
                part = own[begin : begin + ROWS]
                flat = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False)
                yield rows, int(dims), part, flat.reshape(len(part), int(dims)).astype(np.int64)


def _products(z: np.ndarray) -> np.ndarray:
    """z^T z, exact: int64 where it fits, Python's integers else."""
    largest = int(np.abs(z).max(initial=0))
    if largest**2 * len(z) < 2**53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    # |z| <= 2^41 in two halves of 21 bits: 2^42 times 2,048 rows are exact.
    high = (z >> 20).astype(np.float64)
    low = (z & (2**20 - 1)).astype(np.float64)
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for begin in range(0, len(z), ROWS // 2):
        h, m = high[begin : begin + ROWS // 2], low[begin : begin + ROWS // 2]
        cross = h.T @ m
        whole = lambda x: x.astype(np.int64).astype(object)
        total = total + whole(h.T @ h) * 2**40 + (whole(cross) + whole(cross.T)) * 2**20 + whole(m.T @ m)
    return total


_SUMS = "dims int, i int, j int, total decimal(38,0)"


def _emitted(totals: dict[int, dict[tuple[int, int], int]]) -> Iterator[pa.RecordBatch]:
    for dims, entries in totals.items():
        places = list(entries)
        columns = [
            pa.array([dims] * len(places), pa.int32()),
            pa.array([i for i, _ in places], pa.int32()),
            pa.array([j for _, j in places], pa.int32()),
            pa.array([Decimal(int(entries[p])) for p in places], pa.decimal128(38, 0)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["dims", "i", "j", "total"])


def _added(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Sums by dims and place: as many numbers as covariances have entries, however many vectors there are."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("dims", "i", "j").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r.dims, {})[r.i, r.j] = int(r.total)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of vectors (at -1, -1) and sum of each entry (at i, -1), of one task."""
    totals: dict[int, list] = {}
    for _, dims, part, x in _matrices(batches, 0):
        known = totals.setdefault(dims, [0, np.zeros(dims, dtype=object)])
        known[0] += len(part)
        known[1] = known[1] + x.sum(axis=0).astype(object)
    yield from _emitted({d: {(-1, -1): n} | {(i, -1): s for i, s in enumerate(sums)} for d, (n, sums) in totals.items()})


def _moments(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, dims, _, x in _matrices(batches, 0):
            totals[dims] = totals.get(dims, 0) + _products(x - centres[dims]).astype(object)
        yield from _emitted({d: {(i, j): t[i, j] for i in range(d) for j in range(i, d)} for d, t in totals.items()})

    return run


def inertia(matrix: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix, from its pivots (of one or two rows, chosen over all that is left)."""
    a = matrix.copy()
    negative = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(off.argmax()), len(a)) if len(a) > 1 else (r, r)
        if diagonal[r] == 0 and off[p, q] == 0:
            return negative
        # The bound that limits growth for both kinds of pivots, (1 + sqrt 17) / 8.
        if diagonal[r] >= 0.6404 * off[p, q]:
            pivots = [r]
            negative += int(a[r, r] < 0)
        else:
            pivots = [p, q]
            negative += 1  # such a pair has one eigenvalue of either sign
        others = np.delete(np.arange(len(a)), pivots)
        block, side = a[np.ix_(pivots, pivots)], a[np.ix_(others, pivots)]
        a = a[np.ix_(others, others)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return negative


def _below(matrix: np.ndarray, s: float) -> int:
    return inertia(matrix - s * np.eye(len(matrix)))


class Interval(NamedTuple):
    low: float
    high: float
    held: int
    """Eigenvalues inside, by inertia."""


def intervals(matrix: np.ndarray, wanted: int) -> list[Interval]:
    """Disjoint intervals that hold the ``wanted`` greatest eigenvalues (and at most some more), falling."""
    dims = len(matrix)
    radius = np.abs(matrix).sum(axis=1).max()
    low, high = -1.001 * radius, 1.001 * radius
    out, todo = [], [(low, high, 0, dims)]
    while todo:
        low, high, under, upto = todo.pop()
        if upto == under or dims - upto >= wanted:
            continue
        if upto - under <= PER_INTERVAL or high - low < 1e-9 * radius:
            out.append(Interval(float(low), float(high), upto - under))
            continue
        for share in (0.5, 0.55, 0.45, 0.6, 0.4, 0.65, 0.35):
            # A cut must not touch an eigenvalue: its near surroundings hold none.
            cut, near = low + share * (high - low), 1e-4 * (high - low)
            count = _below(matrix, cut - near)
            if count == _below(matrix, cut + near):
                break
        todo += [(low, cut, under, count), (cut, high, count, upto)]
    return sorted(out, reverse=True)


def eigenpairs(matrix: np.ndarray, interval: Interval) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues in the interval, falling, and unit eigenvectors, by contour integration."""
    dims = len(matrix)
    norm = np.abs(matrix).sum(axis=1).max()
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (interval.low + interval.high) / 2, (interval.high - interval.low) / 2
    turns = radius * np.exp(0.5j * np.pi * (1 + nodes))
    many = min(dims, 2 * interval.held + 4)
    space = np.random.default_rng(0).standard_normal((dims, many))
    for _ in range(MOST_ROUNDS):
        projected = np.zeros((dims, many))
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + turn) * np.eye(dims) - matrix, space.astype(complex))
            projected += weight / 2 * (turn * solved).real
        basis = np.linalg.qr(np.linalg.qr(projected)[0])[0]
        small = basis.T @ matrix @ basis
        values, turned = np.linalg.eigh((small + small.T) / 2)
        space = basis @ turned
        residual = np.linalg.norm(matrix @ space - space * values, axis=0)
        # Directions the contour has wiped out may give values inside as well; their residuals tell.
        inside = (values > interval.low) & (values < interval.high) & (residual <= TOLERANCE * norm)
        if inside.sum() == interval.held:
            own = np.flatnonzero(inside)[::-1]
            return values[own], space[:, own]
    raise ArithmeticError(f"{interval}: only {inside.sum()} eigenpairs converged")


def _spectrum(spark, covariances: dict[int, np.ndarray], wanted: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Greatest eigenvalues and their vectors by dims; every interval is solved in a task of its own."""
    todo = [(d, *i) for d, v in covariances.items() if d and np.abs(v).max() > 0 for i in intervals(v, wanted)]
    found: dict[int, list[tuple[float, list[float]]]] = {d: [] for d in covariances}
    if todo:
        shared = spark.sparkContext.broadcast(covariances)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for r in rows.to_pylist():
                    values, vectors = eigenpairs(shared.value[r["dims"]], Interval(r["low"], r["high"], r["held"]))
                    columns = [pa.array([r["dims"]] * len(values), pa.int32()), pa.array(values)]
                    columns.append(pa.array(vectors.T.tolist(), pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(columns, ["dims", "value", "vector"])

        tasks = spark.createDataFrame(todo, "dims int, low double, high double, held int").repartition(len(todo))
        for r in tasks.mapInArrow(run, "dims int, value double, vector array<double>").collect():
            found[r.dims].append((r.value, r.vector))
        shared.destroy()
    out = {}
    for dims, pairs in found.items():
        pairs.sort(key=lambda p: -p[0])
        # Vectors of close values in different intervals are orthogonal up to rounding over their gap only.
        best = pairs[:wanted]
        vectors = np.linalg.qr(np.array([v for _, v in best]).reshape(len(best), dims).T)[0]
        # Either sign would do; the largest entry is positive, so that all runs agree.
        for k in range(vectors.shape[1]):
            vectors[:, k] *= np.sign(vectors[np.abs(vectors[:, k]).argmax(), k])
        out[dims] = np.array([e for e, _ in best]), vectors
    return out


def _centred(model: Whitening, x: np.ndarray) -> np.ndarray:
    """x minus the mean; the difference is exact before it is divided."""
    return _scaled(model, x).astype(np.float64) / model.n


def _scaled(model: Whitening, x: np.ndarray) -> np.ndarray:
    """n * x minus the sum, exact; of Python's integers where 64 bits could overflow."""
    z = x - model.centre
    if model.n * (int(np.abs(z).max(initial=0)) + 1) < 2**62:
        return z * model.n - np.array(model.rest, dtype=np.int64)
    return z.astype(object) * model.n - np.array(model.rest, dtype=object)


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    return _centred(model, x) @ (model.vectors / np.sqrt(model.values))


def _deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    scaled = _scaled(model, x)
    if scaled.dtype != object and int(np.abs(scaled).max(initial=0)) ** 2 * x.shape[1] < 2**63:
        return pa.array((scaled**2).sum(axis=1))
    squares = [sum(v * v for v in map(int, row)) for row in scaled]
    return pa.array([s if s < 2**63 else None for s in squares], pa.int64())


def _identity_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Measured on the whitened vectors themselves, in one more pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, dims, _, x in _matrices(batches, 0):
            w = np.column_stack([_whitened(models[dims], x), np.ones(len(x))])
            totals[dims] = totals.get(dims, 0) + w.T @ w
        for dims, t in totals.items():
            i, j = np.triu_indices(len(t))
            columns = [pa.array(np.full(len(i), dims, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "i", "j", "total"])

    found = vectors.mapInArrow(run, "dims int, i int, j int, total double")
    products = {d: np.zeros((len(m.values) + 1,) * 2) for d, m in models.items()}
    for r in found.groupBy("dims", "i", "j").agg(F.sum("total").alias("total")).collect():
        products[r.dims][r.i, r.j] = products[r.dims][r.j, r.i] = r.total
    errors = {}
    for dims, p in products.items():
        p = p / models[dims].n
        mean = p[:-1, -1]
        errors[dims] = float(np.abs(p[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return errors


def fit(vectors: DataFrame, components: int = 32, column: str = "x") -> dict[int, Whitening]:
    """Whitening by number of dimensions, of the integer vectors in ``column`` (see :func:`integers`).

    Vectors of different numbers of dimensions are whitened apart; null vectors
    take no part, repeated rows count as often as they occur. A component whose
    eigenvalue drowns in rounding (constant or dependent entries, fewer vectors
    than dimensions) can't be scaled to one and is left out; without vectors
    the result is empty.
    """
    rows = vectors.select(column).where(F.col(column).isNotNull())
    sums = _added(rows.mapInArrow(_sums, _SUMS))
    counts = {d: t[-1, -1] for d, t in sums.items()}
    totals = {d: [t[i, -1] for i in range(d)] for d, t in sums.items()}
    centres = {d: np.array([round(s / counts[d]) for s in t], dtype=np.int64) for d, t in totals.items()}
    moments = _added(rows.mapInArrow(_moments(centres), _SUMS))
    covariances, rests = {}, {}
    for d, n in counts.items():
        rests[d] = [s - n * int(c) for s, c in zip(totals[d], centres[d], strict=True)]
        v = np.zeros((d, d))
        for (i, j), product in moments.get(d, {}).items():
            v[i, j] = v[j, i] = (n * product - rests[d][i] * rests[d][j]) / (n * n)
        covariances[d] = v
    models = {}
    for d, (values, found) in _spectrum(vectors.sparkSession, covariances, components).items():
        trace = float(np.trace(covariances[d]))
        good = values > 1e4 * np.finfo(float).eps * d * trace
        models[d] = Whitening(counts[d], centres[d], rests[d], trace, values[good], found[:, good], 0.0)
    errors = _identity_errors(rows, models)
    return {d: m._replace(identity_error=errors[d]) for d, m in models.items()}


def whiten(vectors: DataFrame, models: dict[int, Whitening], column: str = "x") -> DataFrame:
    """``vectors`` with ``whitening``: struct of n, deviation, identity_error and, by falling eigenvalue, components (component, whitened, explained).

    Rows without an integer vector, and those of a number of dimensions the
    models don't know, are left out. A deviation (squared distance to the mean,
    times n squared) that does not fit a long is null. A column ``whitening`` is
    replaced, others stay as they are.
    """
    vectors = vectors.drop("whitening").where(F.col(column).isNotNull())
    names = vectors.columns
    at = names.index(column)
    part = pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, dims, own, x in _matrices(batches, at):
            model = models.get(dims)
            if model is None:
                continue
            white = _whitened(model, x)
            many = white.shape[1]
            entries = pa.StructArray.from_arrays(
                [
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                ],
                fields=list(part),
            )
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * many), entries)
            found = pa.StructArray.from_arrays(
                [
                    pa.array(np.full(len(x), model.n, dtype=np.int64)),
                    _deviations(model, x),
                    pa.array(np.full(len(x), model.identity_error)),
                    lists,
                ],
                names=["n", "deviation", "identity_error", "components"],
            )
            yield pa.RecordBatch.from_arrays([*rows.take(pa.array(own)).columns, found], [*names, "whitening"])

    one = "array<struct<component: int, whitened: double, explained: double>>"
    more = StructType.fromDDL(f"whitening struct<n: long, deviation: long, identity_error: double, components: {one}>")
    return vectors.mapInArrow(run, StructType(vectors.schema.fields + more.fields))
