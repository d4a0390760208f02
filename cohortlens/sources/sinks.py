"""Sinks for derived tables (the suite's CREATE TABLE AS SELECT)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str | None = None, table: str | None = None,
                mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Materialise ``df`` as Parquet at ``path`` or as catalog table ``table``.

    Partitioning by a date column (``partition_by=["date"]``) lets later
    date-bounded reads prune files."""
    if (path is None) == (table is None):
        raise ValueError("give exactly one of path / table")
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path is not None:
        w.save(path)
    else:
        w.saveAsTable(table)


def write_bucketed(df: DataFrame, path: str, table: str, key: str, buckets: int) -> DataFrame:
    """Materialise ``df`` at ``path`` as catalog table ``table`` bucketed and
    sorted by ``key``; later joins on ``key`` with the same number of
    partitions read it without a shuffle.  Returns the table."""
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
