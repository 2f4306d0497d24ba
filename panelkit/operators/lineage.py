"""Lineage cuts in the shared checkpoint folder, and joins that a hot key can't load onto one task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a folder of our own is taken on a local master only (tests, a laptop); a cluster's
    executors don't share one, so there RuntimeError is raised.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "panelkit-checkpoints"))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python in rows and in bytes, as texts may be long; bounds are only ever lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        set_to = spark.conf.get(key, None) or ""
        if not (set_to.isdigit() and 0 < int(set_to) <= most):
            spark.conf.set(key, str(most))


def settled(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared checkpoint folder: for loops.

    A checkpoint passes the planner's size estimate on, which joins multiply: after some rounds it has millions of
    digits. A table's size is that of its files. Folders stay until the checkpoint folder is cleared, as checkpoints do.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = os.path.join(spark.sparkContext.getCheckpointDir(), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def attach(df: DataFrame, facts: DataFrame, key: str | list[str], spread: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """``df`` joined to ``facts`` (one row a key at most) without one task per key.

    The facts go to the (key, salt) pairs that occur, ``salts`` a key at most, and the rows of
    ``df`` meet them there; ``spread`` are the columns that deal a key's rows. ``df`` is read
    twice: cut it first if it is costly.
    """
    keys = [key] if isinstance(key, str) else key
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    cells = salted.select(*keys, "_salt").distinct().join(facts, keys, how)
    return salted.join(cells, [*keys, "_salt"], how).drop("_salt")
