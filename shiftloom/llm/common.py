"""What the operators share: tables in the shared folder, batches bounded in bytes, text columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path, write_shared  # noqa: F401

#: Python-side work is done on so many bytes of text at a time, whatever the Arrow batch holds.
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For queries of ``in_small_steps``: shuffle files go when a query ends, and Arrow batches have no more bytes than a chunk.
SMALL_STEPS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(CHUNK_BYTES)}


@contextlib.contextmanager
def in_small_steps(spark: SparkSession) -> Iterator[None]:
    """What is written as a table inside leaves no shuffle files behind and passes batches of bounded bytes to Python. The
    session's settings are as before afterwards."""
    before = {name: spark.conf.get(name) for name in SMALL_STEPS}
    try:
        for name, value in SMALL_STEPS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """Free memory of this worker goes back to the system; workers are kept from stage to stage, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def drop_shared(table: DataFrame) -> None:
    """Delete what ``write_shared`` wrote; nothing may read it any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        while "=" in folder.getName():
            folder = folder.getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def texts_of(column: pa.Array) -> pa.Array:
    """A text column as large_string without nulls (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; offsets start at 0."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``size`` bytes in ``column`` (one row at least), with its bytes and offsets."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        text = texts_of(batch.column(i))
        data, offsets = buffers(text)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs start..start+length, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_col(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.int64()) if column.type != pa.int64() else column
