"""Embedding whitening from an exact integer scatter.

Entries become whole numbers. Tasks subtract a shift and add up numbers, sums and cross-products, in whole floats where these
are exact and in Python's integers elsewhere; their parts, in limbs of 32 bits, are added up by Spark for each pair of
dimensions. From the totals ``n * X'X - S S'`` follows exactly, and is the same for any shift; only then is it converted to
float and decomposed by ``eigh``. The model has as many numbers as the vectors have pairs of dimensions, whatever the number of
rows, so it's the driver that decomposes it; vectors never leave their tasks, and nothing is shuffled but those parts.

A component is told from noise only while its eigenvalue is above about 1e-15 of the largest, the precision of a double.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Limbs of 32 bits: 256 bits hold cross-products of any longs over any number of rows.
LIMBS, BITS = 8, 32
#: Rows whose products are added up at a time; whole numbers up to EXACT are exact in a float.
BLOCK, EXACT = 4_096, 2.0**53


@dataclass(frozen=True)
class Whitening:
    """``mean`` is sums / n; rows of ``project`` are components over the root of their eigenvalue (null: no variance), largest first."""

    n: int
    dimension: int
    sums: list[int]
    shares: np.ndarray
    project: np.ndarray
    scale: int
    shift: int


def integers(values: np.ndarray, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * value), without the shift, as longs; and which rows have entries that are all finite and, shifted, in a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values * scale)
        fits = (np.isfinite(x) & (np.abs(x) < 2.0**62)).all(axis=1)
    return np.where(fits[:, None], x, 0).astype(np.int64), fits


def vectors(column: pa.Array, dimension: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows of a batch, and their whole numbers before the shift."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dimension)
    flat = column.take(pa.array(at)).flatten()
    whole = ~np.asarray(flat.is_null()).reshape(len(at), dimension).any(axis=1)
    values = np.asarray(flat.fill_null(0).cast(pa.float64()), np.float64).reshape(len(at), dimension)
    x, fits = integers(values, scale, shift)
    return at[whole & fits], x[whole & fits]


def products(z: np.ndarray) -> np.ndarray:
    """Z'Z of whole numbers, exactly: by floats where all sums stay whole in them, else by Python's integers."""
    most = float(np.abs(z).max(initial=0))
    if most * most * len(z) < EXACT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < 2.0**46:  # in two parts of 23 bits: the parts' products stay exact for BLOCK rows
        low = (z & ((1 << 23) - 1)).astype(np.float64)
        high = (z >> 23).astype(np.float64)
        if len(z) * 2.0**46 <= EXACT:
            a, b, c = (m.astype(np.int64).astype(object) for m in (high.T @ high, high.T @ low, low.T @ low))
            return (a << 46) + ((b + b.T) << 23) + c
    z = z.astype(object)
    return z.T @ z


def limbs(value: int) -> list[int]:
    """A whole number in base 2**32, lowest first; the last limb has the sign. Sums of limbs are limbs of sums."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << BITS) - 1))
        value >>= BITS
    return [*out, value]


def from_limbs(parts: list[int]) -> int:
    return sum(int(p) << (BITS * k) for k, p in enumerate(parts))


def _scatter(batches: Iterator[pa.RecordBatch], dimension: int, scale: int, shift: int, origin: list[int]) -> Iterator[pa.RecordBatch]:
    """A partition's number of rows, sums and cross-products (upper triangle), each as one row of limbs; z = x - shift - origin."""
    n, away = 0, np.array(origin, np.int64)
    sums, cross = np.zeros(dimension, object), np.zeros((dimension, dimension), object)
    for batch in batches:
        x = vectors(batch.column("vector"), dimension, scale, shift)[1]
        for k in range(0, len(x), BLOCK):
            z = x[k : k + BLOCK]
            z = z - away if np.abs(z).max(initial=0) < 2**61 and np.abs(away).max(initial=0) < 2**61 else z.astype(object) - away.astype(object)
            n, sums = n + len(z), sums + z.astype(object).sum(axis=0)
            cross += products(z) if z.dtype != object else z.T @ z
    if n:
        upper = np.triu_indices(dimension)
        values = [n, *sums, *cross[upper]]
        rows = [limbs(int(v)) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(LIMBS))], names=["at", *(f"l{k}" for k in range(LIMBS))])


def usual_length(rows: DataFrame) -> int | None:
    """The commonest length of vectors without nulls or non-finite entries (ties: the longest)."""
    ok = F.col("vector").isNotNull() & F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    got = rows.where(ok & (F.size("vector") > 0)).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return got and got["d"]


def scatter(rows: DataFrame, dimension: int, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int], list[list[int]]]:
    """n, S (of x) and n * X'X - S S', all exact."""
    # Any origin gives the same result; one inside the data keeps products small. So the first vector will do.
    origin = next((x[0].tolist() for r in rows.where(F.size("vector") == dimension).take(1) if len(x := vectors(pa.array([r["vector"]], pa.list_(pa.float64())), dimension, scale, shift)[1])), [0] * dimension)
    parts = rows.mapInArrow(partial(_scatter, dimension=dimension, scale=scale, shift=shift, origin=origin), "at int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS)))
    # decimal: a limb is under 2**32, so its sum stays exact for any number of partitions
    got = {r["at"]: from_limbs(r[1:]) for r in parts.groupBy("at").agg(*(F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(LIMBS))).collect()}
    n = got.get(0, 0)
    z = [got.get(1 + i, 0) for i in range(dimension)]
    centred = [[0] * dimension for _ in range(dimension)]
    for k, (i, j) in enumerate(zip(*np.triu_indices(dimension), strict=True)):
        centred[i][j] = centred[j][i] = n * got.get(1 + dimension + k, 0) - z[i] * z[j]
    return n, [s + n * (o + shift) for s, o in zip(z, origin, strict=True)], centred


def fit(rows: DataFrame, vector_col: str = "embedding", dimension: int | None = None, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of ``vector_col`` over all usable rows (see :func:`whiten`); None where there are none."""
    rows = rows.select(F.col(vector_col).cast("array<double>").alias("vector"))
    dimension = dimension or usual_length(rows)
    n, sums, centred = scatter(rows, dimension, scale, shift) if dimension else (0, [], [])
    if not n:
        return None
    total = sum(centred[i][i] for i in range(dimension))
    # n * n * V has whole entries, of any size; a quotient of integers is rounded once.
    largest = max((abs(v) for row in centred for v in row), default=0) or 1
    values, axes = np.linalg.eigh(np.array([[v / largest for v in row] for row in centred], np.float64))
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order].T
    sure = values > max(values.max(initial=0) * dimension * np.finfo(np.float64).eps, 0)
    unit = largest / (n * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        project = np.where(sure[:, None], axes / np.sqrt(np.where(sure, values, 1) * unit)[:, None], np.nan)
    shares = np.where(sure, values, np.maximum(values, 0)) / (total / largest) if total else np.zeros(len(values))
    return Whitening(n, dimension, sums, shares, project, scale, shift)


def numerators(x: np.ndarray, m: Whitening) -> np.ndarray:
    """n * x - S for whole numbers before the shift, as longs where these suffice and else as Python's integers."""
    rest = [s - m.n * m.shift for s in m.sums]
    if m.n * int(np.abs(x).max(initial=0)) + max(map(abs, rest)) < 2**62:
        return x * m.n - np.array(rest, np.int64)
    return x.astype(object) * m.n - np.array(rest, object)


def deviations(numerator: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None beyond a long."""
    most = np.abs(numerator).max(initial=0)
    if numerator.dtype != object and float(most) ** 2 * numerator.shape[1] < 2.0**62:
        return (numerator * numerator).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in numerator]
    return [s if s < 2**63 else None for s in sums]


def whitened(x: np.ndarray, m: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """Rows by components, and each row's deviation."""
    top = numerators(x, m)
    centred = (top / m.n).astype(np.float64)
    return centred @ m.project.T, deviations(top)


def _whiten(batches: Iterator[pa.RecordBatch], m: Whitening) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, x = vectors(batch.column("vector"), m.dimension, m.scale, m.shift)
        out, deviation = whitened(x, m)
        flat = pa.array(out.ravel(), pa.float64(), mask=np.isnan(out.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "whitened"])


def _covariance(batches: Iterator[pa.RecordBatch], m: Whitening) -> Iterator[pa.RecordBatch]:
    """A partition's sums of whitened values, and of their products, as rows."""
    k = len(m.project)
    sums, cross = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        out, _ = whitened(vectors(batch.column("vector"), m.dimension, m.scale, m.shift)[1], m)
        sums, cross = sums + out.sum(axis=0), cross + out.T @ out
    values = np.concatenate([sums, cross[np.triu_indices(k)]])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["at", "v"])


def identity_error(rows: DataFrame, m: Whitening, vector_col: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity, over all rows; components without variance stand aside."""
    k, rows = len(m.project), rows.select(F.col(vector_col).cast("array<double>").alias("vector"))
    got = {r["at"]: r["v"] for r in rows.mapInArrow(partial(_covariance, m=m), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got[i] for i in range(k)]) / m.n  # of values that are centred already, so what is left of it is rounding
    error = [abs(got[k + at] / m.n - mean[i] * mean[j] - (i == j)) for at, (i, j) in enumerate(zip(*np.triu_indices(k), strict=True))]
    return float(max((e for e in error if not np.isnan(e)), default=0)) if k else None


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int | None = None, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """For each usable row its id, ``n`` (rows fitted), ``deviation`` (sum of (n * x - S)**2) and ``whitened``, a list by component;
    and, the same in each row, ``explained`` (shares of the variance, a list) and ``identity_error``.

    An entry c becomes x = floor(scale * c) + shift. Rows are left out whose vector is null, has null or non-finite entries, has
    an entry beyond 2**62 / scale, or another length than ``dimension`` (by default the commonest length; ties: the longest).
    All other rows are fitted and returned: repeated ones each, those with a null id, too. A component without variance has null
    for ``whitened``. A deviation beyond a long is null. No usable rows give no rows. Other columns aren't read.
    """
    kind = rows.select(id_col).dtypes[0][1]
    m = fit(rows, vector_col, dimension, components, scale, shift)
    schema = f"id {kind}, deviation bigint, whitened array<double>"
    if m is None:
        empty = rows.sparkSession.createDataFrame([], f"{schema}, n bigint, explained array<double>, identity_error double")
        return empty.select(F.col("id").alias(id_col), "n", "deviation", "whitened", "explained", "identity_error")
    out = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(partial(_whiten, m=m), schema)
    explained = F.array(*(F.lit(float(s)) for s in m.shares))
    return out.select(F.col("id").alias(id_col), F.lit(m.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(rows, m, vector_col)).cast("double").alias("identity_error"))
