"""Embedding whitening (operator 13) by Jacobi-Davidson over distributed products.

Every entry c becomes the whole number ``x = floor(64 c) + 1000000``; the covariance V is that of the distinct x vectors
(the fit list), taken about their mean with divisor n. V is never formed: ``jacobi_davidson`` asks for products V U with a
few vectors, and each is one pass over the written fit list in which tasks centre their blocks, multiply, and send the
sums of U's size. What the driver holds are vectors of the embedding's length, some dozens at most.

Sums of x are exact (as high and low halves); centring subtracts whole numbers first. ``deviation`` is exact too, and NULL
where it does not fit 64 bits. Components whose eigenvalue is below ``LEAST_SHARE`` of the largest are noise of rounding, so
they are left out; if all vectors are equal there is none, and the result is empty.

Dropped are rows whose vector is NULL, empty, or holds NULL, non-finite or absurdly large entries (beyond 2^55), and rows
of another length than the most frequent (of equally frequent ones the longest). Repeated rows and NULL ids get their
values each; repeated vectors count once in the fit. Equal eigenvalues have some orthonormal vectors. Empty tables give an
empty result. Only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.llm.common import materialise
from gazeledger.llm.jacobi_davidson import largest_pairs

SCALE, SHIFT = 64, 1_000_000
LARGEST_ENTRY = float(1 << 55)
COMPONENTS = 16
LEAST_SHARE = 1e-11
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Whitening:
    """The fitted transform: ``mean`` is ``whole + rest / n``, ``vectors`` holds unit eigenvectors as columns."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.whole, self.rest, self.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``n x - S`` per row, exact."""
        apart = x - self.whole
        reach = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if reach * reach * x.shape[1] < 1 << 63:
            return ((apart * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((apart.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - whole) - rest / n


def numbers(vector: Column) -> Column:
    """The x vector of an embedding; NULL if it is to be dropped."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST_ENTRY, F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint"))
    return F.when((F.size(vector) > 0) & fits, x)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``vec_id, x`` of the rows that remain, and the length of their vectors."""
    own = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), numbers(F.col(vector_col)).alias("x")).where("x is not null")
    sizes = own.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).head(1)
    size = sizes[0]["size"] if sizes else 0
    return own.where(F.size("x") == size), size


def fit_list(own: DataFrame, size: int) -> DataFrame:
    """The distinct x vectors, many to a row, as blocks of 64-bit integers; a written table."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["block"])

    return materialise(own.groupBy("x").agg(F.lit(1)).select("x").mapInArrow(blocks, "block binary"), "fit-list")


def summed(fit: DataFrame, size: int, measure: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray | None:
    """The sum over all blocks of the array that ``measure`` makes of a block: added up in the tasks, then by Spark."""
    dtype = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                own = measure(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, size)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.astype(dtype))], ["place", "value"])

    rows = fit.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), dtype)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def fit(own: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The transform of the rows ``own``; None if there is no row."""
    table = fit_list(own, size)

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    sums = [int(v) for v in summed(table, size, halves, "bigint")]
    if not sums:
        return None
    n = sums[0]
    total = [(high << 32) + low for high, low in zip(sums[1 : 1 + size], sums[1 + size :], strict=True)]
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n for t in total], np.int64)

    def product(u: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, whole, rest, n)
            return c.T @ (c @ u)

        return summed(table, size, part).reshape(u.shape) / n

    trace = float(summed(table, size, lambda x: (_centred(x, whole, rest, n) ** 2).sum(axis=0)).sum()) / n
    values, vectors = largest_pairs(product, size, components) if trace > 0 else (np.zeros(0), np.zeros((size, 0)))
    real = values > LEAST_SHARE * values.max(initial=0.0)
    found = Whitening(n, whole, rest, values[real], vectors[:, real], trace, 0.0)
    if real.any():
        found.identity_error = _identity_error(table, size, found)
    return found


def _identity_error(table: DataFrame, size: int, found: Whitening) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened vectors minus the identity."""
    k = len(found.values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = summed(table, size, moments) / found.n
    covariance = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def transform(own: DataFrame, size: int, found: Whitening | None) -> DataFrame:
    """One row per row of ``own`` and component."""
    if found is None or not len(found.values):
        return own.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.values)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(rows, size)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, found.n)),
                pa.array(found.deviation(x), pa.int64()).take(each), pa.array(found.whitened(x).ravel()),
                pa.array(np.tile(found.values / found.trace, rows)), pa.array(np.full(rows * k, found.identity_error))], _NAMES)

    return own.select("vec_id", "x").mapInArrow(run, SCHEMA)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit on ``rows`` and transform them."""
    own, size = usable(rows, id_col, vector_col)
    return transform(own, size, fit(own, size, components) if size else None)
