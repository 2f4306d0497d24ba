"""One-pass plans: guards counted during the write, publishing by rename, nothing left of a failure."""

import os

import pytest
from pyspark.sql import functions as F

from panelkit.operators.construct import construct
from panelkit.operators.guards import PlanFailure
from panelkit.operators.harmonize import harmonize
from panelkit.plans import staged as module
from panelkit.plans.acceptance import execute
from panelkit.plans.staged import run_staged, staged

ROWS = [(u, t, float(10 * u + t) if (u, t) != (2, 3) else None, str(u)) for u in range(1, 6) for t in range(4)]
SCHEMA = "u long, t long, x double, k string"
PANEL = {"panel_by": "u", "time_by": "t"}


def _counted(df):
    """The frame with a count of the rows that are read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    return df.withColumn("x", told.asNondeterministic()("x")), seen


def _merge_plan(how, cardinality, unmatched="warn", sort_by=()):
    op = {"kind": "merge", "right": "r", "left_keys": ["k"], "right_keys": ["code"], "how": how, "cardinality": cardinality, "unmatched": unmatched}
    return {"inputs": [{"input_id": "a"}, {"input_id": "r"}], "operations": [{"kind": "convert_unit", "source_column": "x", "source_unit": "a", "target_column": "y", "target_unit": "b", "factor": 2, "factor_mode": "multiply"}, op], "output": {"sort_by": list(sort_by)}}


def _same(a, b):
    assert dict(a.dtypes) == dict(b.dtypes) and sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


def test_construct_reads_its_source_once(spark):
    plan = {**PANEL, "operations": [{"kind": "lag", "source": "x", "target": "l"}, {"kind": "growth_rate", "source": "x", "target": "g"}, {"kind": "lead", "source": "x", "target": "f", "periods": 2}, {"kind": "ratio", "numerator": "x", "denominator": "u", "target": "r"}]}
    df = spark.createDataFrame(ROWS, SCHEMA)
    want, log = construct(plan, df)
    source, seen = _counted(df)
    got, told = run_staged(plan, source)
    assert seen.value == len(ROWS) and told == log
    _same(got, want)


@pytest.mark.parametrize(("how", "cardinality"), [("left", "m:1"), ("inner", "m:1"), ("left", "1:m"), ("inner", "1:1")])
def test_merges_report_what_eager_ones_do(spark, how, cardinality):
    left = spark.createDataFrame(ROWS if cardinality == "m:1" else ROWS[::4], SCHEMA)
    right = spark.createDataFrame([("1", "one"), ("2", "two"), ("9", "nine")] + ([("1", "uno")] if cardinality == "1:m" else []), "code string, name string")
    plan = _merge_plan(how, cardinality)
    want, log = harmonize(plan, {"a": left, "r": right})
    source, seen = _counted(left)
    got, told = run_staged(plan, {"a": source, "r": right})
    assert seen.value == left.count() and told == log
    _same(got, want)


def test_a_merge_with_nothing_is_still_reported(spark):
    # The side that the join makes needless may report no counts: the plan is then run with a guard at a time.
    left, right = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], "code string, name string")
    plan = _merge_plan("inner", "m:1")
    want, log = harmonize(plan, {"a": left, "r": right})
    got, told = run_staged(plan, {"a": left, "r": right})
    assert got.count() == 0 and told == log and dict(got.dtypes) == dict(want.dtypes)


FAILING = [
    ({**PANEL, "operations": [{"kind": "log", "source": "t", "target": "l"}]}, 0, 5),
    ({**PANEL, "operations": [{"kind": "interaction", "terms": ["x", "t"], "target": "i"}, {"kind": "arithmetic", "operator": "divide", "left": "x", "right": "t", "target": "d"}, {"kind": "log", "source": "t", "target": "l"}]}, 1, 5),
    ({"panel_by": "u", "time_by": "k", "operations": [{"kind": "lag", "source": "x", "target": "l"}]}, 0, 15),
    ({**PANEL, "operations": [{"kind": "growth_rate", "source": "t", "target": "g"}]}, 0, 5),
]


@pytest.mark.parametrize(("plan", "op", "count"), FAILING)
def test_a_failure_publishes_nothing(spark, tmp_path, plan, op, count):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(PlanFailure) as one:
        construct(plan, df)
    with pytest.raises(PlanFailure) as two:
        staged(plan, df, str(tmp_path / "x"))
    assert (two.value.op, two.value.reason, two.value.count, two.value.log) == (one.value.op, one.value.reason, one.value.count, one.value.log)
    assert (two.value.op, two.value.count) == (op, count)
    made, log = execute(plan, df, str(tmp_path / "out"), str(tmp_path / "log.json"))
    assert made is None and log["overall"] == "failed" and log["errors"][0]["count"] == count
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["log.json"]


def test_merge_and_key_failures(spark):
    left = spark.createDataFrame(ROWS, SCHEMA)
    right = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "code string, name string")
    lower = {"inputs": [{"input_id": "a"}], "operations": [{"kind": "coerce", "column": "t", "to": "integer"}, {"kind": "normalize_key", "column": "k", "rules": ["lower_case"]}]}
    mixed = left.withColumn("k", F.when(F.col("t") == 0, F.lit("A")).otherwise("a"))
    cases = [(_merge_plan("left", "m:1"), {"a": left, "r": right}), (_merge_plan("left", "1:m"), {"a": left, "r": right}), (_merge_plan("left", "m:1", "fail"), {"a": left, "r": right.limit(1)}), (lower, {"a": mixed})]
    for plan, frames in cases:
        with pytest.raises(PlanFailure) as one:
            harmonize(plan, frames)
        with pytest.raises(PlanFailure) as two:
            run_staged(plan, frames)
        assert str(two.value) == str(one.value) and two.value.log == one.value.log


def test_an_error_of_the_engine_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("z", F.when(F.col("u") < 9, F.raise_error(F.lit("broken"))).cast("double"))
    with pytest.raises(PlanFailure) as e:
        staged({"operations": [{"kind": "log", "source": "z", "target": "l"}]}, df, str(tmp_path / "x"))
    assert "broken" in str(e.value) and not (tmp_path / "x").exists()


def test_execute_publishes_by_rename_sorted_or_as_csv(spark, tmp_path):
    text = spark.createDataFrame([(str(u), str(x)) for u, t, x, k in ROWS if x is not None], "u string, x string")
    plan = {"inputs": [{"input_id": "a"}], "operations": [{"kind": "coerce", "column": "u", "to": "integer"}, {"kind": "coerce", "column": "x", "to": "numeric"}]}
    for name, sort_by, fmt in (("plain", [], "parquet"), ("sorted", ["x"], "parquet"), ("csv", ["x"], "csv")):
        made, log = execute({**plan, "output": {"sort_by": sort_by}}, {"a": text}, str(tmp_path / name), None, fmt)
        assert log["overall"] == "completed" and log["operations"][0]["fractions"] == 0
        assert dict(made.dtypes) == {"u": "bigint", "x": "double"} and made.count() == text.count()
        if sort_by and fmt == "parquet":
            assert [r["x"] for r in made.collect()] == sorted(r["x"] for r in made.collect())
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["csv", "plain", "sorted"]
    with pytest.raises(FileExistsError):
        module.publish(spark, str(tmp_path / "csv"), str(tmp_path / "plain"))
