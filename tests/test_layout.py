"""Sketches, digests and laid-out tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.operators import sketches
from panelkit.sources import digest, layout


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    return spark.createDataFrame([(r.randint(0, 30), i, r.choice([None, float("nan"), r.random()]), r.choice("abc")) for i in range(3000)], "u int, t long, x double, k string")


def test_merged_sketches_stay_within_their_error(rows):
    parts = sketches.sketched(rows, ["k", "u"], distinct=["t", "u", "x"], quantiles=["x"])
    whole = sketches.merged(parts, []).select("rows", *[sketches.distinct_estimate(c).alias(c) for c in ("t", "u")], sketches.quantile_estimate("x", 0.5).alias("q")).first()
    assert whole["rows"] == 3000 and abs(whole["t"] - 3000) < 4 * sketches.distinct_error() * 3000 and whole["u"] == 31
    known = rows.where("x IS NOT NULL AND NOT isnan(x)")
    assert abs(known.where(F.col("x") <= whole["q"]).count() / known.count() - 0.5) < 2 * sketches.RANK_ERROR
    none = sketches.merged(sketches.sketched(rows.where("x IS NULL"), ["k"], distinct=["x"], quantiles=["x"]), []).select(sketches.distinct_estimate("x").alias("n"), sketches.quantile_estimate("x", 0.5).alias("q")).first()
    assert (none["n"], none["q"]) == (0, None)


def test_a_digest_depends_on_rows_alone(rows):
    told = digest.table_digest(rows, 7)
    assert digest.table_digest(rows.repartition(9).orderBy("x").select("k", "x", "u", "t"), 7) == told
    assert digest.table_digest(rows.unionByName(rows.limit(1)), 7) != told
    assert digest.table_digest(rows.withColumn("x", F.when(F.col("t") != 5, F.col("x")).otherwise(F.lit(0.123))), 7) != told
    assert digest.table_digest(rows.withColumnRenamed("k", "kk"), 7) != told
    assert digest.table_digest(rows.limit(0)) == digest.table_digest(rows.limit(0).repartition(3)) != told
    shift = rows.sparkSession.createDataFrame([("a", "b,1:c"), (None, "x")], "p string, q string")
    assert digest.table_digest(shift) != digest.table_digest(shift.select(F.lit("a,1:b").alias("p"), F.lit("c").alias("q")))


def test_panel_ops_on_a_laid_out_table_need_no_exchange(spark, rows, tmp_path):
    layout.write_panel(rows, "laid_out", "u", "t", 4, str(tmp_path / "t"))
    order = Window.partitionBy("u").orderBy("t")
    made = layout.read_panel(spark, "laid_out").withColumns({"l": F.lag("x").over(order), "m": F.avg("t").over(Window.partitionBy("u"))})
    means = made.groupBy("u").agg(F.avg("l").alias("a"))
    both = made.join(means.hint("merge"), "u")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.count() == rows.count()
    spark.sql("DROP TABLE laid_out")
