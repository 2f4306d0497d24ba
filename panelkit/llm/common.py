"""Helpers that the operators share: lineage cuts, gapless ranks, salted joins, CRC, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.operators.lineage import attach, bound_batches, checkpoint_folder, written

__all__ = ["attach", "cut", "gapless_rank", "min_label_components", "prepare", "read", "remove", "utf8_crc32", "written"]


def prepare(spark: SparkSession) -> None:
    """Make checkpoint() usable and bound the Arrow batches that reach Python; bounds are only ever lowered."""
    checkpoint_folder(spark)
    bound_batches(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, by a path that only Spark's readers need to open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def utf8_crc32(text: Column) -> Column:
    """CRC32 (unsigned) of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], salts: int, out: str, facts: DataFrame | None = None) -> DataFrame:
    """Number the rows of each key 0, 1, ... without one task per key.

    Rows are dealt by (key, salt), ranked there, and shifted by the number of rows
    that the key has under smaller salts. That offset table has at most
    ``salts`` rows a key. ``order`` must identify a row up to repeated rows, which
    may then take either place. ``df`` is read twice: cut it first if it is costly.
    ``facts``, one row a key at most, reach the rows by way of the offset table, so that
    a hot key's rows meet them salted; its columns are null where it lacks a key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_salt", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    if facts is not None:
        sizes = sizes.join(facts, keys, "left")
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    joined = ranked.join(sizes, [*keys, "_salt"])
    return joined.withColumn(out, F.col("_below") + F.col("_rank")).drop("_salt", "_below", "_rank")


def min_label_components(nodes_edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): one row (node, label) per linked node.

    ``label`` is the smallest node that is reachable. Each round takes the least label
    among neighbours and then jumps to that label's own label; each round is a written
    table, and they end when no label changes. Every aggregate is a min with map-side
    combining, and a hub's edges and a label's members meet their labels salted.

    Raises RuntimeError if ``max_rounds`` rounds don't reach the fixpoint, as a partial
    answer would be wrong.
    """
    # A node keeps the edge to its least neighbour; its other smaller neighbours are linked to that one, which many nodes say
    # alike: the rounds join about as many edges as there are nodes, not each bucket's.
    one = written(nodes_edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    least = one.groupBy("u").agg(F.min("v").alias("w"))
    star = attach(one, least, "u", ["v"]).where("v <> w").select(F.col("v").alias("u"), "w").unionByName(least)
    both = written(star.distinct())
    both = both.select("u", F.col("w").alias("v")).unionByName(both.select(F.col("w").alias("u"), F.col("u").alias("v")))
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    for _ in range(max_rounds):
        near = attach(both, labels.withColumnRenamed("node", "v"), "v", ["u"]).groupBy("u").agg(F.min("label").alias("near"))
        step = written(labels.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "near").alias("new")))
        if step.where("label <> new").isEmpty():
            return labels
        jump = attach(step.select("node", "new"), labels.select(F.col("node").alias("new"), F.col("label").alias("further")), "new", ["node"])
        labels = written(jump.select("node", F.least("new", "further").alias("label")))
    raise RuntimeError("components did not settle")
