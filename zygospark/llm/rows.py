"""Arrow row helpers: whole rows through a map, and packed shuffles of numpy columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zygospark.session import written  # noqa: F401


def map_rows(df: DataFrame, text: str, change: Callable[[pa.Array, list[pa.Array]], list[pa.Array]], names: list[str] | None = None) -> DataFrame:
    """Rows of `df` after `change(text column, all columns)` for every Arrow batch.

    Columns travel under position names, so extra columns, and extra columns
    whose names differ only in case, come through as they are.
    """
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    at = df.columns.index(text)
    own = [f.name for f in plain.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(change(batch.column(at), batch.columns), names=own)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema])
    return plain.mapInArrow(run, schema).toDF(*(names or df.columns))


def shuffle_groups(df: DataFrame) -> int:
    """Packed groups of one shuffle: as many as the session's shuffle partitions, the knob by which a cluster sizes its tasks."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed(keys: np.ndarray, columns: dict[str, np.ndarray], groups: int) -> pa.RecordBatch:
    """One row per group of keys: `p` and every column's values as bytes; rows of one key get one group."""
    to = (keys % np.uint64(groups)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(groups + 1))
    used = np.flatnonzero(np.diff(bounds))
    out = [pa.array(used, pa.int32())]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        size = values.dtype.itemsize
        ends = np.append(bounds[used], bounds[-1]) * size
        out.append(pa.Array.from_buffers(pa.large_binary(), len(used), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary()))
    return pa.record_batch(out, names=["p", *columns])


def packed_schema(columns: dict[str, str]) -> str:
    return "p int, " + ", ".join(f"{c} binary" for c in columns)


def unpacked(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The values of a packed column of a whole group."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for chunk in table[name].chunks for x in chunk]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def by_group(df: DataFrame, reduce: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`reduce` over each packed group."""

    def run(table: pa.Table) -> pa.Table:
        return reduce(table)

    return df.groupBy("p").applyInArrow(run, schema)


def long_id(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, with the named columns beside them."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
