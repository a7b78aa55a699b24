"""What the operators of this subpackage share: row keys, pieces of batches, and tables in the shared folder."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import forget, saved, shared_dir  # noqa: F401

#: What a partition of a result is worth at least, and the partitions that a core gets in any case.
PART_BYTES = 8 << 20
PARTS_PER_CORE = 3


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that name a row by its id and its text; rows equal in both are one document."""
    body = F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.unhex(F.md5(body.cast("binary")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def worth(df: DataFrame) -> int:
    """Partitions that a result of the size of ``df`` is worth: ``PARTS_PER_CORE``, or one for each ``PART_BYTES`` that Spark estimates if that is more.

    A shuffle deals a small table over as many partitions as a large one. Each becomes a file, and where
    Hadoop lacks its native library, each local file is a process that a worker starts for ``chmod``.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-estimate // PART_BYTES)), 2**31 - 1)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``most`` bytes of text each, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when memory happens to run low."""
    gc.collect()
    spark._jvm.System.gc()
