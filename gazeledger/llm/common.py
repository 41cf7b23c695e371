"""What several operators of this folder share: reading tables, Arrow text as numpy bytes, vectorised hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.session import materialise

BLOCK_BYTES = 2 << 20
BROADCAST_ROWS = 500_000


# Arrow batches by bytes: by rows alone, ten thousand long texts would have to fit a worker at once.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n


def keep_ids(df: DataFrame, ids: DataFrame, column: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the written one-column table ``ids``.

    The ids are broadcast only while they are few; beyond that it is a shuffled semi-join with the same result.
    """
    ids = F.broadcast(ids) if ids.count() <= rows else ids
    return df.join(ids, column, "left_semi").select(*df.columns)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with NULL as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column, "")


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` over runs of rows of about ``limit`` bytes; a longer text stands alone.

    The arrays are views of the Arrow buffers; offsets start at 0.
    """
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an uint64 array."""
    v = values ^ np.uint64(seed)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, int(n).bit_length())
        known = np.full(size, np.uint64(base))
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``data[start:end]``, from one prefix sum; equal bytes give equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * _powers(_INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


__all__ = [
    "BLOCK_BYTES", "BROADCAST_ROWS", "crc_mod", "keep_ids", "lists", "materialise", "mix", "small_batches",
    "span_hashes", "table",
    "text_blocks", "text_column",
]
