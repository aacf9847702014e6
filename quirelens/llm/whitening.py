"""Whitening of embeddings by shifted CholeskyQR.

Tasks add up Gram matrices of centred rows; the driver, which sees only those d x d sums, factors them.
Each pass takes the rows through the triangular factors found so far, so that their columns come out
orthonormal, and the composed factor R has the singular values and right vectors of the centred rows.
Nothing squares the condition of the rows, as a covariance matrix would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import ship
from quirelens.plans.lineage import cut, release

SCALE = 256  # fixed value: an entry c becomes floor(256 * c)
COMPONENTS = 4
PASSES = 3
_BLOCK = 64  # columns of a partial sum's row
_ROWS = 8192
_EDGE = float(1 << 62)


def scaled(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part, with it as longs in ``x``: a null vector, a null or a non-finite
    entry leaves the row out. Beyond 2^62 an entry counts as that."""
    rows = df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    edge = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(_EDGE)), F.lit(-_EDGE))
    return rows.withColumn("x", F.transform(vector, lambda c: F.floor(edge(c)).cast("bigint")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column; entries that a shorter vector lacks are zero."""
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten())
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            part = batch.slice(i, _ROWS)
            yield _matrix(part.column("x"), width)


def _solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _through(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for upper in factors:
        rows = _solve(rows, upper)
    return rows


def _wide(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partial sum as rows of at most 64 numbers."""
    r, c = sums.shape
    padded = np.zeros((r, -(-c // _BLOCK) * _BLOCK), dtype=sums.dtype)
    padded[:, :c] = sums
    flat = padded.reshape(-1, _BLOCK)
    n = padded.shape[1] // _BLOCK
    where = np.arange(len(flat))
    yield pa.RecordBatch.from_arrays(
        [pa.array(where // n, pa.int32()), pa.array(where % n, pa.int32()), *[pa.array(flat[:, k].copy()) for k in range(_BLOCK)]],
        names=["i", "b", *[f"c{k}" for k in range(_BLOCK)]])


def _summed(fit: DataFrame, partial, shape: tuple[int, int], kind: str) -> np.ndarray:
    """The sum of ``partial``'s matrix over all tasks; only the sum, of ``shape``, reaches the driver."""
    columns = [f"c{k}" for k in range(_BLOCK)]
    parts = fit.mapInArrow(partial, "i int, b int, " + ", ".join(f"{c} {kind}" for c in columns))
    total = parts.groupBy("i", "b").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    out = np.zeros((shape[0], -(-shape[1] // _BLOCK) * _BLOCK), dtype=np.int64 if kind == "bigint" else np.float64)
    for row in total:
        out[row["i"], row["b"] * _BLOCK : (row["b"] + 1) * _BLOCK] = row[2:]
    return out[:, : shape[1]]


def _sums(fit: DataFrame, width: int) -> list[int]:
    """Sums per dimension, exact: high and low halves are added apart."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, width), dtype=np.int64)
        for x in _blocks(batches, width):
            out[0] += (x >> 32).sum(axis=0)
            out[1] += (x & 0xFFFFFFFF).sum(axis=0)
        yield from _wide(out)

    high, low = _summed(fit, partial, (2, width), "bigint")
    return [(int(h) << 32) + int(v) for h, v in zip(high, low)]


class Centre:
    """Rows minus their mean: whole parts are subtracted as integers, so large values lose nothing."""

    def __init__(self, sums: list[int], n: int):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row, exact; null where a long cannot hold it."""
        away = x - self.whole
        rough = ((away.astype(np.float64) * self.n - self.rest) ** 2).sum(axis=1)
        if len(rough) and rough.max() < 2.0**62:
            return ((away * self.n - self.rest) ** 2).sum(axis=1).tolist()
        rest = [int(r) for r in self.rest]
        exact = [sum((int(a) * self.n - r) ** 2 for a, r in zip(row, rest)) for row in away]
        return [v if v < 1 << 63 else None for v in exact]


def _gram(fit: DataFrame, centre: Centre, live: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred live columns after the triangular solves."""
    width, d = len(centre.whole), int(live.sum())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((d, d))
        for x in _blocks(batches, width):
            rows = _through(centre(x)[:, live], factors)
            out += rows.T @ rows
        yield from _wide(out)

    return _summed(fit, partial, (d, d), "double")


def _factor(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper Cholesky factor; where the matrix is not safely positive, of the matrix shifted by
    11 (n d + d (d + 1)) u |A|^2, the amount that rounding could have taken away."""
    d = gram.shape[0]
    gram = (gram + gram.T) / 2
    norm = float(np.linalg.norm(gram, 2))
    shift = 11 * (min(n, 1 << 20) * d + d * (d + 1)) * np.finfo(float).eps / 2 * norm
    if np.linalg.eigvalsh(gram)[0] > norm / 16:
        shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, np.finfo(float).tiny)


class Whitening:
    """What a fit found: ``axes`` holds a unit component per column (largest entry positive), ``eigen`` their
    eigenvalues in falling order, ``trace`` the whole variance, ``identity_error`` the largest entry of the
    whitened rows' covariance minus the identity."""

    def __init__(self, width: int, centre: Centre | None, axes: np.ndarray, eigen: np.ndarray, trace: float):
        self.width, self.centre, self.axes, self.eigen, self.trace = width, centre, axes, eigen, trace
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.axes / np.sqrt(self.eigen)


def fit_whitening(distinct: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> Whitening:
    """Fit over ``distinct`` (x, an array of longs per row), which is read once per pass and should be written down.

    Dimensions without variance are set aside exactly. Directions that depend on others shrink with
    every pass by the shift's root and end below the rounding limit, where components stop.
    """
    ship(distinct.sparkSession)
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    none = Whitening(width, None, np.zeros((width, 0)), np.zeros(0), 0.0)
    if not n or not width:
        return none
    centre = Centre(_sums(distinct, width), n)
    every = np.ones(width, dtype=bool)
    gram = _gram(distinct, centre, every, [])
    live = np.diag(gram) > 0
    if not live.any():
        none.centre = centre
        return none
    trace = float(np.trace(gram)) / n
    gram = gram[np.ix_(live, live)]
    factors = [_factor(gram, n)]
    for _ in range(passes - 1):
        factors.append(_factor(_gram(distinct, centre, live, factors), n))
    composed = np.eye(int(live.sum()))
    for upper in factors:
        composed = upper @ composed
    _, sizes, right = np.linalg.svd(composed)
    seen = sizes > sizes[0] * len(sizes) * 16 * np.finfo(float).eps
    seen[components:] = False
    axes = np.zeros((width, int(seen.sum())))
    axes[live] = right[seen].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    out = Whitening(width, centre, axes, sizes[seen] ** 2 / n, trace)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = out.axes.shape[1]
        sums = np.zeros((k + 1, k))
        for x in _blocks(batches, width):
            white = out.whiten(x)
            sums[:k] += white.T @ white
            sums[k] += white.sum(axis=0)
        yield from _wide(sums)

    k = axes.shape[1]
    sums = _summed(distinct, partial, (k + 1, k), "double")
    mean = sums[k] / n
    out.identity_error = float(np.abs(sums[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return out


def whitened(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, passes: int = PASSES,
) -> DataFrame:
    """For each row that takes part and each component (from 1): vec_id, component, n (distinct vectors), deviation,
    whitened, explained and identity_error.

    Rows whose vector is null or holds a null or a non-finite entry give nothing. Repeated vectors count once in
    the fit, and every row is returned, also under a repeated or null id. A vector shorter than the longest counts
    as filled up with zeros (distinct as written). There are as many components as the rank allows; an empty table, a single
    distinct vector or vectors without entries give no rows. A deviation that a long cannot hold is null. Other
    columns do not matter.
    """
    rows = scaled(df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")), "v").select("vec_id", "x")
    distinct = cut(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    model = fit_whitening(distinct, components, passes)
    release(distinct)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.axes.shape[1]
        for batch in batches:
            for i in range(0, batch.num_rows if k else 0, _ROWS):
                part = batch.slice(i, _ROWS)
                x = _matrix(part.column("x"), model.width)
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.centre.n)),
                    pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(model.whiten(x).reshape(-1)),
                    pa.array(np.tile(model.eigen / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
