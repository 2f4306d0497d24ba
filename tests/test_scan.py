"""Prefix scans against plain windows, with groups that lie in many parts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.operators import stats
from panelkit.operators.scan import Scan, adjust_scanned, panel_shifts


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    keys = ["hot"] * 400 + ["a"] * 3 + [None] * 40 + [f"k{i}" for i in range(20)]
    data = [(k, i if r.random() > 0.02 else None, r.choice([None, r.uniform(-5, 5)]), i) for i, k in enumerate(keys)]
    r.shuffle(data)
    return spark.createDataFrame(data, "g string, t long, x double, id long")


def _sorted(df):
    return sorted(df.select("id", "got", "want").collect(), key=lambda r: r["id"])


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("function", ["sum", "count", "min", "max", "last"])
def test_running_functions_equal_windows(rows, function, reverse):
    s = Scan(rows, ["g"], ["t", "id"], parts=17).running("got", function, "x", reverse)
    order = [F.col("t").desc_nulls_first(), F.desc("id")] if reverse else [F.col("t").asc_nulls_last(), "id"]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = {"sum": F.sum("x"), "count": F.count("x"), "min": F.min("x"), "max": F.max("x"), "last": F.last("x", ignorenulls=True)}[function]
    got = _sorted(s.result().withColumn("want", plain.over(w)))
    assert len(got) == rows.count() and [r["got"] for r in got] == pytest.approx([r["want"] for r in got])
    assert {len(set(p)) for p in [[r["_part"] for r in s.df.where("g = 'hot'").select("_part").distinct().collect()]]}.pop() > 5


@pytest.mark.parametrize("k", [1, 3, -1, -30])
def test_shifts_equal_windows(rows, k):
    got = Scan(rows, ["g"], ["t", "id"], parts=40).shifted("got", "x", k).result()
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_last(), "id")
    got = _sorted(got.withColumn("want", F.lag("x", k).over(w) if k > 0 else F.lead("x", -k).over(w)))
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_numbers_and_no_group(rows):
    got = Scan(rows, [], ["id"], parts=9).number("got", "n").result().withColumn("want", F.col("id") + 1)
    assert all(r["got"] == r["want"] for r in _sorted(got)) and got.where(F.col("n") != rows.count()).count() == 0


def test_adjusted_p_values_equal_those_of_one_task(spark):
    r = random.Random(2)
    tests = spark.createDataFrame([(r.choice(["f", "f", "f", "g"]), i, r.choice([0.0, 0.01, 1.0, r.random()])) for i in range(500)], "family string, id long, p double")
    got = adjust_scanned(tests, "p", ["family"], ["id"], parts=13)
    want = stats.adjust(tests, "p", ["family"], ["id"])
    pair = got.select("id", "holm", "bh").join(want.select("id", F.col("holm").alias("h"), F.col("bh").alias("b")), "id").collect()
    assert len(pair) == 500 and all(r["holm"] == pytest.approx(r["h"]) and r["bh"] == pytest.approx(r["b"]) for r in pair)


def test_hot_panels_keep_their_rows_apart(spark, rows):
    panel = rows.where("t IS NOT NULL").withColumn("t", F.col("id"))
    got = {r["id"]: r for r in panel_shifts(panel, "x", "g", "t", 2, parts=11).collect()}
    w = Window.partitionBy("g").orderBy("t")
    for r in panel.withColumns({"a": F.lag("x", 2).over(w), "b": F.lead("x", 2).over(w)}).collect():
        one, known = got[r["id"]], r["g"] is not None
        assert (one["lag"], one["lead"]) == ((r["a"], r["b"]) if known else (None, None))
        assert one["difference"] == (r["x"] - r["a"] if known and None not in (r["x"], r["a"]) else None)


def test_two_exchanges_and_defined_cases(spark, rows):
    s = Scan(rows, ["g"], ["t", "id"], parts=5).running("a", "sum", "x")
    plan = s.df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    assert Scan(rows.limit(0), ["g"], ["id"]).running("a", "max", "x").shifted("b", "x").number("c", "d").result().count() == 0
    with pytest.raises(ValueError):
        s.running("b", "median", "x")
