"""Panel tables laid out by unit: bucketed and sorted, so that panel ops on them need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_panel(df: DataFrame, table: str, unit: str, time: str, buckets: int, path: str | None = None) -> None:
    """Save ``df`` as a table of ``buckets`` buckets by unit, each sorted by unit and time.

    Every bucket is written by one task, as one file. The number of buckets bounds the tasks of what reads the table: take it
    from the table's size. path: where the files lie; the warehouse if none is given. Fails if the table exists.
    """
    writer = df.repartition(buckets, unit).write.bucketBy(buckets, unit).sortBy(unit, time).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_panel(spark: SparkSession, table: str) -> DataFrame:
    """A table that ``write_panel`` saved: partitioned by unit as far as the planner goes."""
    return spark.table(table)
