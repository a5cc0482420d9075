"""Small helpers of the text operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stored  # noqa: F401

#: Bytes of text that one step of a task holds as arrays.
STEP_BYTES = 1 << 20


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def bit_field(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit field of a column of longs (one bit a value), on the driver."""
    per = 32768  # bits of one piece of the bitmap functions
    piece = F.floor(F.pmod(F.col(column), F.lit(bits)) / per)
    pieces = keys.groupBy(piece.alias("piece")).agg(F.expr(f"bitmap_construct_agg(cast(pmod(pmod({column}, {bits}), {per}) as bigint))").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces:
        out[int(r["piece"]) * per // 8: (int(r["piece"]) + 1) * per // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def field_bits(keys: int) -> int:
    """Bits of a field for so many keys: eight a key, 1 MB (2**23 bits) at
    least, and 128 MB (2**30) at most, beyond which it spares less."""
    return 1 << min(30, max(23, (8 * keys).bit_length()))


def in_field(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of unsigned 64-bit ``values`` are set; the field has a power of two of bits."""
    place = (values & np.uint64(len(field) * 8 - 1)).astype(np.int64)
    return (field[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def batch_of(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A bounded sample that any partitioning gives alike: the ``rows`` rows
    whose key has the smallest hash."""
    return df.orderBy(F.xxhash64(F.lit(17), F.col(key)), key).limit(rows)
