"""Embedding whitening: eigenvectors of the covariance by LOBPCG over distributed block products.

x = floor(64 * entry) + 1,000,000; the fit list is each distinct x vector once. A product of the covariance V
with a block B of columns is one Spark job: every task centres its vectors and adds up c^T (c B), the tasks'
sums meet by row of V. The driver holds blocks of `dimension x 3 (wanted + GUARD)` and never a vector. Each
round is Rayleigh-Ritz on the iterates, their residuals and the previous directions, with V times that whole
basis taken anew, until the residuals |V q - e q| of all wanted components are at most TOL times the largest e.

Defined cases: a null vector, or one with null or non-finite entries, is dropped; so are empty vectors and
those of another length than the commonest (of equally common ones the longer). A null id stays. Repeated rows
and equal vectors keep a row each and count once in the fit list. Components whose e is at most RANK times the
largest are left out (their whitened values would be noise); with no others, as with one distinct vector, or an
empty table, the result is empty. A deviation beyond 64 bits raises OverflowError. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

WANTED, GUARD = 16, 8
#: Residuals allowed and eigenvalues kept, as parts of the largest eigenvalue; rounds that are allowed.
TOL, RANK, MOST_ROUNDS = 1e-13, 1e-11, 400
SCALE, SHIFT = 64, 1_000_000


@dataclass
class Whitening:
    """What the fit gives: n distinct vectors with sums, the components as columns, their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    rounds: int = 0


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x (array of long) of the rows that stay."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    vectors = rows.select(F.col(key), F.col(vector).cast("array<double>").alias("_v"))
    whole = vectors.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.coalesce(F.forall("_v", finite), F.lit(False)))
    length = whole.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("_v", lambda v: F.floor(v * SCALE) + SHIFT)
    return whole.where(F.size("_v") == (length.d if length else 0)).select(F.col(key), x.alias("x"))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of part(x) over all batches of x: each task sends one row for each row of the matrix, and these are added by row."""
    names, kind = [f"v{j}" for j in range(shape[1])], "long" if part is _sums else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(shape, np.int64 if kind == "long" else float), False
        for batch in batches:
            if batch.num_rows:
                total += part(_vectors(batch.column(0)))
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], ["r", *names])

    parts = fit.select("x").mapInArrow(run, "r int, " + ", ".join(f"{c} {kind}" for c in names))
    out = np.zeros(shape, np.int64 if kind == "long" else float)
    for row in parts.groupBy("r").agg(*(F.sum(c).alias(c) for c in names)).collect():  # as many rows as the matrix has
        out[row[0]] = row[1:]
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    return np.vstack([x.sum(0), np.full(x.shape[1], len(x))])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding: the difference is taken in whole numbers."""
    return (n * x - sums) / n


def _orthonormal(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """basis (orthonormal columns) with more's directions that it doesn't span."""
    length = np.linalg.norm(more, axis=0)
    more = more[:, length > 0] / length[length > 0]
    for _ in range(2):
        more = more - basis @ (basis.T @ more)
    if not more.size:
        return basis
    u, s, _ = np.linalg.svd(more, full_matrices=False)
    own = u[:, s > 1e-8][:, : len(basis) - basis.shape[1]]
    own = own - basis @ (basis.T @ own)
    return np.hstack([basis, np.linalg.qr(own)[0]]) if own.size else basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = WANTED, guard: int = GUARD, tol: float = TOL, most: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues and their vectors of the symmetric operator that product applies to a block of columns.

    The residuals of the wanted ones are at most tol times the largest value, or it raises RuntimeError.
    """
    m = min(d, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((d, m)))[0]
    residual = direction = np.zeros((d, 0))
    for rounds in range(1, most + 1):
        basis = _orthonormal(_orthonormal(x, residual), direction)
        image = product(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        old = x.shape[1]
        x, direction = basis @ turn, basis[:, old:] @ turn[old:]
        residual = image @ turn - x * values
        error = np.linalg.norm(residual[:, :wanted], axis=0).max()
        if error <= tol * max(values[0], 0):
            return values[:wanted], x[:, :wanted], rounds
        q, r = np.linalg.qr(x)
        x = q * np.sign(np.diag(r))  # the same columns, rounding taken out
    raise RuntimeError(f"residual {error} after {most} rounds, largest eigenvalue {values[0]}")


def fitted(rows: DataFrame, wanted: int = WANTED) -> Whitening | None:
    """The whitening of quantised rows; None if no component is left."""
    fit = written(rows.select("x").distinct(), "fit")
    first = fit.first()
    if first is None:
        dropped(fit)
        return None
    d = len(first.x)
    sums = summed(fit, _sums, (2, d))
    n, sums = int(sums[1, 0]), sums[0]
    trace = float(summed(fit, lambda x: np.array([[(centred(x, n, sums) ** 2).sum()]]), (1, 1))[0, 0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ block)

        return summed(fit, part, block.shape) / n

    if trace == 0:
        dropped(fit)
        return None
    values, components, rounds = lobpcg(product, d, wanted)
    own = values > RANK * values[0]
    values, components = values[own], components[:, own]
    components = components * np.where(components[np.abs(components).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    scale = components / np.sqrt(values)

    def gram(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ scale
        return z.T @ z

    error = float(np.abs(summed(fit, gram, (len(values),) * 2) / n - np.eye(len(values))).max())
    dropped(fit)
    return Whitening(n, sums, components, values, trace, error, rounds)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, wanted: int = WANTED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per row that stays and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    kept = quantised(rows, key, vector)
    model = fitted(kept, wanted)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {OUT}"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, explained, error = model.n, model.sums, model.values / model.trace, model.identity_error
    scale, k = model.components / np.sqrt(model.values), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            off = n * _vectors(batch.column(1)) - sums
            if float(np.abs(off).max()) ** 2 * off.shape[1] >= 2.0**63:
                raise OverflowError("a deviation exceeds 64 bits")
            rows_ = len(off)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows_), k))), np.tile(np.arange(1, k + 1, dtype=np.int32), rows_), np.full(rows_ * k, n),
                np.repeat((off * off).sum(1), k), ((off / n) @ scale).ravel(), np.tile(explained, rows_), np.full(rows_ * k, error),
            ]
            yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], [key, *(c.split()[0] for c in OUT.split(", "))])

    return kept.mapInArrow(run, schema)
