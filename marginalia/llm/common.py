"""What the operators of this subpackage share: Arrow batches cut to a byte bound, columns as numpy, gathers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from marginalia.sources.shared import new_path, shared_dir, spread, written

__all__ = ["SLICE_BYTES", "column", "fresh", "ints", "new_path", "offsets", "ragged", "shared_dir", "slices", "table", "texts", "written"]

#: Bytes of text that an operator holds in numpy form at once in one task; a longer single text comes alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each piece has at most so many bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def ints(array: pa.Array, null: int = -(2**63)) -> np.ndarray:
    """An integer column as int64; null becomes the given value."""
    return pc.fill_null(array.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def texts(array: pa.Array) -> list[str]:
    """Strings, null as empty."""
    return pc.fill_null(array, "").to_pylist()


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces pool[start:start+length], one after the other."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return pool[:0]
    shift = np.asarray(start, np.int64) - (np.cumsum(length) - length)
    return pool[np.repeat(shift, length) + np.arange(total)]


def offsets(length: np.ndarray) -> np.ndarray:
    """0 and the running totals."""
    out = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=out[1:])
    return out
