"""Shared pieces of the training-data operators: table readers, written
intermediates in the shared folder, Arrow task helpers."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts the
    lineage, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def let_go(spark: SparkSession, *written: DataFrame) -> None:
    """Delete frames of ``materialise`` that nothing reads any more, and have
    Spark's cleaner drop the shuffle files of finished steps (it waits for the
    driver's garbage collection)."""
    for df in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


ROWS_PER_FILE = 50_000


def files_of(rows: int) -> int:
    """Files for so many narrow rows."""
    return max(1, math.ceil(rows / ROWS_PER_FILE))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most about ``rows`` narrow rows, in partitions for that many
    (never more than it has): as a written frame, files by rows and not by
    shuffle partitions.  Each file costs its executor a process on file systems
    that set permissions by one."""
    return df.coalesce(files_of(rows))


SLICE_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` bytes of text (a longer
    text is a run of its own), so a task's memory does not follow the number
    of rows in a batch."""
    at = batch.schema.get_field_index(column)
    if at < 0:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    lo = size = 0
    for k, n in enumerate(sizes.tolist()):
        if k > lo and size + n > limit:
            yield batch.slice(lo, k - lo)
            lo, size = k, 0
        size += n
    if lo < len(sizes):
        yield batch.slice(lo)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over slices of record batches; ``fn(batch)`` returns a
    dict of columns in the order of ``schema``, or None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name
