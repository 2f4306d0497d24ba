"""Plans, guards, validation, statistics, linkage, artifacts, sources, streams."""

import hashlib
import json
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit import engine_queries
from panelkit.functions import text
from panelkit.operators import artifacts, linkage, stats
from panelkit.operators.construct import construct
from panelkit.operators.guards import PlanFailure
from panelkit.operators.harmonize import harmonize
from panelkit.operators.validate import cardinality, sample_flow_holds, validate
from panelkit.plans import resolver
from panelkit.plans.canonical import canonical_json, content_hash, number_text
from panelkit.plans.acceptance import execute
from panelkit.plans.validate import construct_errors, harmonize_errors, plan_errors
from panelkit.sources import tables, works
from panelkit.streaming.rowwise import construct_stream


def run(ops, df, **frames):
    return harmonize({"inputs": [{"input_id": "a"}, *({"input_id": k} for k in frames)], "operations": ops}, {"a": df, **frames})


def column(df, c, order):
    return [r[c] for r in df.orderBy(order).collect()]


COERCE = [("3", "integer", 3), (" 2.5", "integer", 2.5), ("1e3", "numeric", 1000.0), ("YES", "boolean", True), ("", "boolean", None)]


@pytest.mark.parametrize("cell, to, want", COERCE)
def test_coerce(spark, cell, to, want):
    assert run([{"kind": "coerce", "column": "c", "to": to}], spark.createDataFrame([(cell,)], "c string"))[0].first()["c"] == want


@pytest.mark.parametrize("cell, to", [("abc", "integer"), ("x", "numeric"), ("maybe", "boolean"), (None, "boolean"), ("NaN", "numeric")])
def test_coerce_fails_closed(spark, cell, to):
    with pytest.raises(PlanFailure) as e:
        run([{"kind": "coerce", "column": "c", "to": to}], spark.createDataFrame([(cell,), ("1",)], "c string"))
    assert (e.value.op, e.value.count) == (0, 1)


def test_first_failing_op_in_plan_order_is_reported(spark):
    df = spark.createDataFrame([("1", "Z", "1995-13")], "a string, b string, d string")
    ops = [{"kind": "coerce", "column": "a", "to": "integer"}, {"kind": "map_code", "column": "b", "mapping": {"A": "x"}, "unknown": "fail"}, {"kind": "normalize_date", "column": "d", "in_format": "%Y-%m", "out": "year"}]
    with pytest.raises(PlanFailure) as e:
        run(ops, df)
    assert e.value.op == 1


def test_keys_normalise_and_collide(spark):
    ops = [{"kind": "normalize_key", "column": "k", "rules": ["trim", "upper_case", "zero_pad"], "width": 3}]
    df = spark.createDataFrame([(" a1 ",), ("-5",), ("abcd",), (None,)], "k string")
    assert sorted(map(str, column(run(ops, df)[0], "k", "k"))) == ["-05", "0A1", "ABCD", "None"]
    with pytest.raises(PlanFailure):
        run(ops, spark.createDataFrame([("F001",), (" f001 ",)], "k string"))
    assert run(ops, spark.createDataFrame([("F001",), ("F001",)], "k string"))[0].count() == 2


def test_dates(spark):
    df = spark.createDataFrame([("1995-1",), ("1995-01",)], "d string")
    assert {r["d"] for r in run([{"kind": "normalize_date", "column": "d", "in_format": "%Y-%m", "out": "year_month"}], df)[0].collect()} == {"1995-01"}
    assert text.date_pattern("%dT%H:%M") == "d'T'H:m"


def test_merge(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    op = {"kind": "merge", "right": "r", "right_keys": ["k"], "how": "left", "cardinality": "1:1", "unmatched": "warn"}
    out, log = run([op], left, r=right)
    assert out.columns == ["k", "v", "v_r"] and column(out, "v_r", "v") == [10, 20, None]
    assert (log[0]["matched"], log[0]["unmatched"], log[0]["warning"]) == (2, 1, "unmatched rows")
    assert run([op | {"how": "inner"}], left, r=right)[0].count() == 2
    for bad in ({"unmatched": "fail"}, {"right_keys": ["gone"]}):
        with pytest.raises(PlanFailure):
            run([op | bad], left, r=right)
    with pytest.raises(PlanFailure):
        run([op], left, r=right.unionAll(right))
    assert run([op | {"cardinality": "1:m"}], left, r=right.unionAll(right))[0].count() == 5


def test_inner_merge_reports_no_unmatched_rows(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, v int"), spark.createDataFrame([("a", 10), ("a", 20)], "k string, w int")
    op = {"kind": "merge", "right": "r", "right_keys": ["k"], "how": "inner", "cardinality": "1:m", "unmatched": "fail"}
    out, log = run([op], left, r=right)
    assert out.count() == 2 and (log[0]["rows_before"], log[0]["matched"], log[0]["unmatched"], log[0]["row_count_effect"]) == (3, 2, 0, -1)
    out, log = run([op | {"cardinality": "m:1", "right_keys": ["w"], "left_keys": ["v"]}], left, r=right)
    assert out.count() == 0 and log[0]["unmatched"] == 0


def test_unknown_codes_are_listed(spark):
    df = spark.createDataFrame([("x",), ("b",), ("a",), ("b",)], "c string")
    with pytest.raises(PlanFailure, match=r"\['a', 'b'\].*3 rows"):
        run([{"kind": "map_code", "column": "c", "mapping": {"x": "1"}, "unknown": "fail"}], df)


def test_scientific_roles_need_an_approved_binding():
    op = {"kind": "log", "source": "x", "target": "z", "scientific_role": "treatment"}
    errors = lambda op=op, **b: construct_errors({"input": {"columns": ["x"]}, "operations": [op], **({"scientific_bindings": {"z": b}} if b else {})})
    good = {"approved": True, "decision_ref": "d", "role": "treatment"}
    assert errors(**good) == []
    for bad in ({}, {"approved": False, **{k: good[k] for k in ("decision_ref", "role")}}, {"approved": True, "role": "treatment"}, {**good, "role": "instrument"}):
        assert errors(**bad) != []
    assert errors(op | {"scientific_role": "material_variable_definition"}, **{**good, "role": "material_variable_definition"}) == []
    assert any("unsupported" in e for e in errors(op | {"scientific_role": "material_definition"}, **good))


def test_plan_documents():
    op = {"op_id": "a", "kind": "log", "source": "x", "target": "z"}
    plan = {"schema_version": "1.0", "plan_id": "p", "input": {"dataset_id": "d", "file": "f", "columns": ["x"]}, "output": {"dataset_id": "o", "file": "g"}, "operations": [op]}
    assert plan_errors(plan, "construct") == []
    for bad in ({"schema_version": "2"}, {"plan_id": " "}, {"output": {}}, {"input": {"columns": ["x"]}}, {"operations": [op, op | {"target": "w"}]}, {"operations": [{**op, "op_id": None}]}):
        assert plan_errors({**plan, **bad}, "construct") != []
    two = {**plan, "inputs": [{"input_id": "a", "file": "f"}, {"input_id": "a", "file": "g"}], "operations": [{"op_id": "a", "kind": "coerce", "column": "c", "to": "string"}]}
    assert plan_errors(two, "harmonize") == ["input_id 'a' repeats"]


def test_a_failed_plan_keeps_its_log_and_writes_nothing_else(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "k string, x double")
    ops = [{"kind": "log", "source": "one", "target": "l"}, {"kind": "ratio", "numerator": "l", "denominator": "x", "target": "r"}, {"kind": "log", "source": "r", "target": "s"}]
    made, log = execute({"plan_id": "p", "operations": ops}, df.withColumn("one", F.lit(1.0)), str(tmp_path / "o"), str(tmp_path / "l.json"))
    assert made is None and not (tmp_path / "o").exists() and json.loads((tmp_path / "l.json").read_text()) == log
    assert log["overall"] == "failed" and log["errors"] == [{"op": 1, "kind": "ratio", "reason": "denominator is zero", "count": 1}]
    assert [(x["op"], x["status"]) for x in log["operations"]] == [(0, "ok"), (1, "fail")] and len(log["plan_sha256"]) == 64
    made, log = execute({"plan_id": "p", "operations": ops[:1]}, df.withColumn("one", F.lit(1.0)), str(tmp_path / "o"), str(tmp_path / "m.json"))
    assert log["overall"] == "completed" and spark.read.parquet(str(tmp_path / "o")).count() == 2
    _, log = execute({"plan_id": "p", "operations": [{"kind": "eval"}]}, df)
    assert log["overall"] == "failed" and "unsupported" in log["errors"][0]["reason"]
    _, log = execute({"operations": [{"kind": "interaction", "terms": ["k", "x"], "target": "v"}]}, df.select(F.array("x").alias("k"), "x"))
    assert log["overall"] == "failed" and log["errors"][0]["reason"].startswith("exception")


def test_plan_errors():
    say = lambda op: " ".join(harmonize_errors({"inputs": [{"input_id": "a"}], "operations": [op]}))
    assert "unsupported op kind" in say({"kind": "eval"})
    assert "category" in say({"kind": "coerce", "column": "c", "to": "category"})
    assert "m:m" in say({"kind": "merge", "right": "a", "right_keys": ["k"], "how": "left", "cardinality": "m:m", "unmatched": "warn"})
    assert "duplicate targets" in say({"kind": "rename", "mapping": {"a": "x", "b": "x"}})
    base = {"input": {"columns": ["x"]}}
    bad = lambda *ops, **more: " ".join(construct_errors({**base, "operations": list(ops), **more}))
    assert "exists" in bad({"kind": "log", "source": "x", "target": "x"})
    assert "unknown column" in bad({"kind": "log", "source": "y", "target": "z"})
    assert "distinct" in bad({"kind": "interaction", "terms": ["x", "x"], "target": "z"})
    assert "two arguments" in bad({"kind": "indicator", "target": "z", "predicate": {"op": "and", "args": []}})
    assert "column or a number" in bad({"kind": "indicator", "target": "z", "predicate": {"op": "gt", "left": {"op": "gt"}, "right": 1}})
    assert "panel_by" in bad({"kind": "lag", "source": "x", "target": "z"})
    assert "approved" in bad({"kind": "log", "source": "x", "target": "z"}, role_bindings=[{"role": "treatment", "decision_id": "d"}])
    assert construct_errors({**base, "operations": [{"kind": "log", "source": "x", "target": "z"}, {"kind": "ratio", "numerator": "z", "denominator": "x", "target": "w"}]}) == []


PANEL = [("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0), ("b", 1, 8.0), ("b", 2, 16.0)]


def made(ops, df):
    return construct({"operations": ops, "panel_by": "u", "time_by": "t"}, df)


def test_windows_and_missing_counts(spark):
    df = spark.createDataFrame(PANEL, "u string, t int, x double")
    out, log = made([{"kind": k, "source": "x", "target": k} for k in ("lag", "lead", "difference", "growth_rate")], df)
    rows = {(r["u"], r["t"]): r for r in out.collect()}
    assert rows["b", 2]["growth_rate"] == 1.0 and rows["b", 2]["difference"] == 8.0 and rows["a", 2]["lag"] == 2.0 and rows["a", 1]["lead"] is None
    assert [(e["structural_missing"], e["propagated_missing"]) for e in log] == [(2, 1), (2, 1), (2, 2), (2, 2)]


@pytest.mark.parametrize(
    "rows, op",
    [
        ([("a", 1, 0.0)], {"kind": "log", "source": "x", "target": "v"}),
        ([("a", 1, -5.0)], {"kind": "log", "source": "x", "target": "v", "base": "10"}),
        ([("a", 1, 0.0)], {"kind": "ratio", "numerator": "t", "denominator": "x", "target": "v"}),
        ([("a", 1, 0.0)], {"kind": "arithmetic", "operator": "divide", "left": "t", "right": "x", "target": "v"}),
        ([("a", 1, 0.0), ("a", 2, 1.0)], {"kind": "growth_rate", "source": "x", "target": "v"}),
        ([("a", 1, 1.0), ("a", 1, 2.0)], {"kind": "lag", "source": "x", "target": "v"}),
        ([("a", 1, 1.0)], {"kind": "lag", "source": "x", "target": "v", "time_by": "gone"}),
    ],
)
def test_construct_fails_closed(spark, rows, op):
    with pytest.raises(PlanFailure):
        made([op], spark.createDataFrame(rows, "u string, t int, x double"))


def test_missing_log_propagates(spark):
    out, log = made([{"kind": "log", "source": "x", "target": "v"}], spark.createDataFrame(PANEL, "u string, t int, x double"))
    assert out.where("v is null").count() == 1 and log[0]["missing_propagated"] == 1


def test_validation_defects(spark):
    rules = {"unit_key": ["f", "y"], "expected_n": 2, "variables": [{"name": "f", "type": "integer"}, {"name": "y", "type": "integer"}, {"name": "v", "type": "float"}]}
    failed = lambda rows, schema, r=rules: {c["check_id"] for c in validate(spark.createDataFrame(rows, schema), r)["checks"] if c["status"] == "fail"}
    schema = "f int, y int, v double"
    assert failed([(1, 1, 1.0), (1, 2, 2.0)], schema) == set()
    assert failed([(1, 1, 1.0), (1, 1, 2.0)], schema) == {"DV_KEY_UNIQUE"}
    assert failed([(1, 1, None), (1, 2, 2.0)], schema) == {"DV_MISSINGNESS"}
    assert failed([(1, 1, 1.0)], schema) == {"DV_ROWCOUNT"}
    assert failed([("x", 1, 1.0), ("y", 2, 2.0)], "f string, y int, v double") == {"DV_VAR_TYPE"}
    assert failed([(1, 1), (1, 2)], "f int, y int") == {"DV_VAR_PRESENT"}
    assert failed([(1, 1, 1.0), (1, 2, 2.0)], schema, rules | {"unit_key": ["f", "gone"]}) == {"DV_KEY_UNIQUE"}
    a, b = spark.createDataFrame([(1,), (1,)], "id int"), spark.createDataFrame([(1,), (2,)], "id int")
    assert (cardinality(a, b, "id", "id"), cardinality(a, a, "id", "id"), cardinality(b, b, "id", "id")) == ("m:1", "m:m", "1:1")
    step = lambda a, r, b: {"n_before": a, "n_removed": r, "n_after": b}
    assert sample_flow_holds([step(9, 1, 8), step(8, 3, 5)], 5) and not sample_flow_holds([step(9, 1, 8), step(7, 2, 5)], 5)


def _panel(spark, drop=0.0):
    r = np.random.default_rng(3)
    rows = []
    for i in range(12):
        for t in range(8):
            x = r.normal(size=2)
            if r.random() >= drop:
                rows.append((i, t, float(2 * x[0] - x[1] + i + 0.5 * t + r.normal() * 0.1), float(x[0] + i), float(x[1])))
    return rows, spark.createDataFrame(rows, "i int, t int, y double, a double, b double")


@pytest.mark.parametrize("drop", [0.0, 0.2])
def test_panel_fe_equals_dummy_regression(spark, drop):
    rows, df = _panel(spark, drop)
    d = np.array(rows)
    dummies = [(d[:, 0] == i).astype(float) for i in range(12)] + [(d[:, 1] == t).astype(float) for t in range(1, 8)]
    X = np.column_stack([d[:, 3], d[:, 4], *dummies])
    beta, *_ = np.linalg.lstsq(X, d[:, 2], rcond=None)
    e = stats.panel_fe(df, "y", ["a", "b"], "i", "t")
    assert np.allclose(e.beta, beta[:2], rtol=1e-8)
    u, inv = d[:, 2] - X @ beta, np.linalg.inv(X.T @ X)
    meat = sum(np.outer(s, s) for i in range(12) for s in [(X * u[:, None])[d[:, 0] == i].sum(0)])
    n, k = len(d), 2 + 8
    want = np.sqrt(np.diag(inv @ meat @ inv)[:2] * 12 / 11 * (n - 1) / (n - k))
    assert np.allclose(e.se, want, rtol=1e-6) and e.df_resid == 11
    iid = stats.panel_fe(df, "y", ["a", "b"], "i", "t", covariance="iid")
    assert np.allclose(iid.se, np.sqrt(np.diag(inv)[:2] * (u @ u) / (n - 2 - 19)), rtol=1e-6)


def test_iv_and_diagnostics(spark):
    r = np.random.default_rng(4)
    z, w, v = r.normal(size=(3, 500))
    x = 0.5 * z + w + v
    y = 1.5 * x - w + v + r.normal(size=500)
    e = stats.iv_2sls(spark.createDataFrame(np.column_stack([y, w, x, z]).tolist(), "y double, w double, x double, z double"), "y", ["w"], "x", ["z"])
    Z, X = np.column_stack([np.ones(500), w, z]), np.column_stack([np.ones(500), w, x])
    beta = np.linalg.solve(Z.T @ X, Z.T @ y)
    assert np.allclose(e.beta, beta)
    f = e.facts["cragg_donald_f"]
    assert math.isclose(e.facts["anderson_lm"], 500 * f / (f + 500 - 3)) and e.facts["sargan"] == "not_applicable"


def test_over_identified_iv_and_cluster_variants(spark):
    r = np.random.default_rng(5)
    z1, z2, v = r.normal(size=(3, 400))
    x = z1 + 0.5 * z2 + v
    y = 2 * x + v + r.normal(size=400)
    e = stats.iv_2sls(spark.createDataFrame(np.column_stack([y, x, z1, z2]).tolist(), "y double, x double, z1 double, z2 double"), "y", [], "x", ["z1", "z2"])
    Z, X = np.column_stack([np.ones(400), z1, z2]), np.column_stack([np.ones(400), x])
    P = Z @ np.linalg.inv(Z.T @ Z) @ Z.T
    beta = np.linalg.solve(X.T @ P @ X, X.T @ P @ y)
    u = y - X @ beta
    assert np.allclose(e.beta, beta) and math.isclose(e.facts["sargan"], u @ P @ u / (u @ u / 400), rel_tol=1e-6) and e.facts["sargan_df"] == 1
    # The published standard errors of 10 firms and 20 years stand to each other as the scales do. Fixed values.
    published = {"A": 0.010565288935392969, "B": 0.010565288935392969, "C": 0.009760951067962407, "D": 0.010503321896893385, "E": 0.01110891552047251, "F": 0.010263191236561026, None: 0.01082442947686367}
    scale = {v: math.sqrt(stats.cluster_factor(200, 2, 10, 20, v)) for v in published}
    assert all(math.isclose(published[v] / published["C"], scale[v] / scale["C"], rel_tol=1e-9) for v in published)


def test_adjusted_values_of_two_engines(spark):
    raw = spark.createDataFrame([("a", 0.01), ("b", 0.2)], "k string, p double")
    mine = stats.adjust(raw.withColumn("f", F.lit(1)), "p", ["f"])
    told = lambda other: {(r["k"], r["check"]) for r in stats.adjusted_problems(raw, mine, other, ["k"]).collect() if r["verdict"] == "FAIL"}
    assert told(mine) == set()
    assert told(mine.withColumn("bh", F.when(F.col("k") == "b", 1.5).otherwise(F.col("bh")))) == {("b", "bh_cross_engine")}
    assert told(mine.where("k = 'a'")) == {("b", c) for c in ("raw_p_cross_engine", "holm_cross_engine", "bh_cross_engine")}


def test_distributions():
    assert math.isclose(stats.t_pvalue(1.0, 1), 0.5, rel_tol=1e-12)
    assert math.isclose(stats.t_quantile(0.975, 9), 2.2621571627, rel_tol=1e-9)
    lo, hi = stats.confidence_interval(0.11771585508260658, 0.01082442947686367, 9)
    assert math.isclose(lo, 0.0932292944083154, rel_tol=1e-9) and math.isclose(hi, 0.14220241575689777, rel_tol=1e-9)
    assert math.isclose(stats.t_pvalue(0.11771585508260658 / 0.01082442947686367, 9), 1.7726713730995302e-06, rel_tol=1e-9)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    rows = stats.adjust(spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double"), "p", ["f"], ["i"]).orderBy("i").collect()
    assert np.allclose([r["holm"] for r in rows], [0.04, 0.09, 0.09, 0.025, 0.9])
    assert np.allclose([r["bh"] for r in rows], [0.025, 0.05, 0.05, 0.025, 0.9])


RECORDS = [
    ("T one", "10.1234/AA", [("A", "Li")], 2001, "crossref", "1"), ("T  One!", "https://doi.org/10.1234/aa", [("A", "Li")], 2001, "openalex", "W1"),
    ("T two", "10.1234/b", [("A", "Li")], 2002, "crossref", "2"), ("T two", "10.1234/c", [("A", "Li")], 2002, "openalex", "W2"),
    ("Other", None, [("B", "Xu")], 2003, "crossref", "3"), ("other", None, [("B", "Xu")], 2003, "openalex", "W3"),
    ("Same", "10.9999/z", [("C", "Ra")], 2004, "crossref", "4"), ("Same", "10.9999/z", [("D", "So")], 2004, "openalex", "W4"),
    (None, None, [], None, "crossref", "5"), (None, None, [], None, "openalex", "W5"),
]


def test_linkage(spark):
    df = spark.createDataFrame(RECORDS, "title string, doi string, authors array<struct<given string, family string>>, year int, source string, source_id string")
    find = lambda d: {tuple(r["record_ids"]): (r["decision"], r["rule"], r["state"]) for r in linkage.verified(linkage.groups(linkage.normalize_records(d))).collect()}
    got = find(df)
    assert sorted(got.values()) == sorted([("dedupe_same", "canonical_doi", "verified"), ("distinct", "single", "verified"), ("distinct", "single", "verified"), ("dedupe_same", "source_id_or_normalized", "verified"), ("conflict", "author_conflict", "conflicting"), ("distinct", "single", "partially_verified"), ("distinct", "single", "partially_verified")])
    assert find(df.orderBy(F.desc("source_id"))) == got


VERIFIED = [  # records (title, doi, family, year, source), then state and reason codes
    ([("a", "10.1234/a", "Li", 2001, "x")], "verified", ["authoritative_doi", "core_fields_compatible"]),
    ([("b", "10.1234/b", "Li", 2001, "x"), ("b", "10.1234/b", "So", 2001, "y")], "conflicting", ["doi_identity_conflict"]),
    ([("c", None, "Li", 2001, "x"), ("c", None, "Li", 2001, "y")], "verified", ["multi_source_agreement", "no_doi"]),
    ([("d", None, "Li", 2001, "x")], "partially_verified", ["single_source_or_incomplete", "no_doi"]),
    ([("g", None, "Li", 2001, None)], "partially_verified", ["single_source_or_incomplete", "no_doi"]),
    ([(None, None, "Li", 2002, None)], "unresolved", ["insufficient_evidence", "no_doi"]),
]


def test_verification_states_and_reasons(spark):
    rows = [(t, d, [("A", f)], y, s, f"{i}-{k}") for i, (records, *_) in enumerate(VERIFIED) for k, (t, d, f, y, s) in enumerate(records)]
    df = spark.createDataFrame(rows, "title string, doi string, authors array<struct<given string, family string>>, year int, source string, source_id string")
    records = linkage.normalize_records(df).cache()
    group = F.split("source_id", "-")[0]
    found = linkage.verified(linkage.groups(records))
    of = {r["record_id"]: r["g"] for r in records.select("record_id", group.cast("int").alias("g")).collect()}
    got = {}
    for r in found.collect():
        got.setdefault(of[r["record_ids"][0]], []).append((r["state"], r["reason_codes"], r["member_count"], r["evidence"]))
    for i, (members, state, codes) in enumerate(VERIFIED):
        assert [x[:3] for x in got[i]] == [(state, codes, len(members))]
    assert got[0][0][3]["doi"] == "10.1234/a" and got[0][0][3]["dois"] is None and got[0][0][3]["sources"] == ["x"]
    assert got[1][0][3]["dois"] == ["10.1234/b"] and got[1][0][3]["sources"] == ["x", "y"]
    two = linkage.verified(linkage.groups(records.where(group == "0").unionByName(records.where(group == "0").withColumn("canonical_doi", F.lit("10.1234/z")))))
    assert [(r["state"], r["reason_codes"]) for r in two.collect()] == [("conflicting", ["multiple_dois"])]


ORDERED = [  # records (title, doi, family names, year, source), the rule; the rules' order tells
    ([("t", "10.1234/o", ["Li", "So"], 2001, "x"), ("t", "10.1234/o", ["So", "Li"], 2001, "y")], "dedupe_same", "canonical_doi"),
    ([("t", "10.1234/p", ["Li"], 2001, "x"), ("u", "10.1234/p", ["So"], 2001, "y")], "conflict", "identity_conflict"),
    ([("v", "10.1234/q", ["Li"], 2001, "x"), ("v", "10.1234/q", ["So"], 2001, "y")], "conflict", "author_conflict"),
    ([("w", None, ["Li"], 2001, "x"), ("w", None, ["Li"], 2001, "x")], "dedupe_same", "source_id_or_normalized"),
]


def test_rules_are_tried_in_their_order(spark):
    rows = [(t, d, [("A", f) for f in fs], y, s, f"{i}-{k}") for i, (records, *_) in enumerate(ORDERED) for k, (t, d, fs, y, s) in enumerate(records)]
    df = spark.createDataFrame(rows, "title string, doi string, authors array<struct<given string, family string>>, year int, source string, source_id string")
    records = linkage.normalize_records(df)
    of = {r["record_id"]: int(r["source_id"][0]) for r in records.collect()}
    got = {of[r["record_ids"][0]]: (r["decision"], r["rule"], r["member_count"]) for r in linkage.groups(records).collect()}
    assert got == {i: (d, rule, len(records)) for i, (records, d, rule) in enumerate(ORDERED)}
    twice = linkage.groups(records.where("source_id = '3-0'").unionAll(records.where("source_id = '3-0'"))).first()
    assert (twice["member_count"], twice["rule"]) == (2, "source_id_or_normalized")


def test_groups_are_numbered_over_partitions(spark):
    df = spark.range(500).select(F.array(F.lpad(((F.col("id") * 37) % 500).cast("string"), 3, "0")).alias("record_ids")).repartition(7)
    got = {r["record_ids"][0]: r["group_id"] for r in linkage.numbered(df).collect()}
    assert got == {f"{i:03d}": f"G{i}" for i in range(500)}


def _brute_groups(rows):
    """Record ids by group: documents linked by DOI, and by whole title and language where DOIs allow it."""
    records = []
    for r in rows:
        title = " ".join((r["text"] or "").split())
        key = " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in title.lower()).split())
        rid = "rec_" + hashlib.sha256(f"{r['source'] or ''}|{r['doc_id']}|{title}".encode()).hexdigest()[:12]
        doi = f"10.1234/abc{r['doc_id'] % 50}" if r["doc_id"] % 5 == 0 else None
        records.append((rid, doi, (key, (r["lang"] or "").lower())))
    root = {rid: rid for rid, *_ in records}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_doi, by_key = {}, {}
    for rid, doi, key in sorted(records, key=lambda r: r[0]):
        if doi:
            root[find(rid)] = find(by_doi.setdefault(doi, rid))
        first, other = by_key.setdefault(key, (rid, doi))
        if not doi or not other or doi == other:
            root[find(rid)] = find(first)
    out = {}
    for rid, *_ in records:
        out.setdefault(find(rid), set()).add(rid)
    return sorted(map(sorted, out.values()))


def test_l_groups_compares_whole_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = engine_queries.l_groups(spark, sf).collect()
    assert sorted(r["record_ids"].split(",") for r in found) == _brute_groups(rows)


def test_identifiers(spark):
    cells = ["DOI: 10.1234/Ab", "https://doi.org/10.1234/x y", "10.66/x", " ", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(text.canonical_doi(F.col("c")).alias("d"), text.doi_reason(F.col("c")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [("10.1234/ab", None), (None, "malformed"), (None, "malformed"), (None, "missing"), (None, "missing")]
    row = spark.createDataFrame([("ﬁne  Text ",)], "c string").select(text.normal_text(F.col("c")).alias("n")).first()
    assert row["n"] == "fine Text"


def test_works_sources(spark):
    item = {"DOI": "10.1/A", "title": ["T"], "author": [{"given": " A ", "family": "B"}], "issued": {"date-parts": [[2001, 2]]}, "container-title": ["V"], "type": "x", "URL": "u"}
    got = works.search_crossref("q", lambda url: (200, json.dumps({"message": {"items": [item]}})))
    assert got["status"] == "success" and "rows=5" in got["request_identity"] and got["result_count"] == 1
    row = works.map_crossref(spark.createDataFrame([(json.dumps(item),)], "j string").select(F.from_json("j", works.CROSSREF_ITEM).alias("i")).select("i.*")).first()
    assert (row["title"], row["year"], row["authors"][0]["given"]) == ("T", 2001, "A")
    answers = {"malformed_response http_429": (429, ""), "malformed_response http_500": (500, ""), "source_unavailable transport": (None, ""), "malformed_response invalid_json": (200, "<"), "success_zero_records None": (200, '{"results": []}')}
    for want, answer in answers.items():
        got = works.search_openalex("q", lambda url, a=answer: a)
        assert f"{got['status']} {got['error_category']}" == want
    assert works.search_openalex("q", lambda url: (200, "{}"))["status"] == "success_zero_records"
    assert works.search_crossref("q", lambda url: (_ for _ in ()).throw(OSError()))["status"] == "source_unavailable"


def test_artifacts(spark):
    views = spark.createDataFrame([("v", [("a", ["1", "2"])])], "view_id string, source_refs array<struct<artifact_id string, item_ids array<string>>>")
    items = spark.createDataFrame([("a", "1")], "artifact_id string, item_id string")
    assert [tuple(r) for r in artifacts.reference_orphans(views, items).collect()] == [("v", "a", "2")]
    families = spark.createDataFrame([("f", ["e1", "e1", "e2"])], "family_id string, member_estimate_ids array<string>")
    estimates = spark.createDataFrame([("e1", ["f"]), ("e3", ["f"])], "estimate_id string, multiple_testing_family_ids array<string>")
    assert {(r["estimate_id"], r["problem"]) for r in artifacts.family_gaps(families, estimates).collect()} == {("e2", "member_does_not_claim_family"), ("e3", "estimate_not_a_member"), ("e1", "repeated_member")}
    assert artifacts.fixed(1.005, 2) == "1.00" and artifacts.fixed(2.675, 2) == "2.67"
    assert artifacts.markdown_table(["a", "b"], [{"a": 1, "b": 0.5}]) == "| a | b |\n|---|---|\n| 1 | 0.5000 |\n"


def test_canonical_json():
    assert canonical_json({"b": [1.0, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,null,true]}'
    assert [number_text(x) for x in (1e21, 1e-7, 123456.789, 0.000001, -2.5e-10, 1e20, 100)] == ["1e+21", "1e-7", "123456.789", "0.000001", "-2.5e-10", "100000000000000000000", "100"]
    with pytest.raises(ValueError):
        canonical_json([float("nan")])
    assert content_hash("a\r\nb", "lf_text") == content_hash("a\rb", "lf_text") == content_hash("a\nb", "raw")


def test_resolver():
    env = [{"id": "i", "runtime": "python", "version": "3.11.2", "packages": {"p": "1.10"}}]
    cap = {"risk": "high", "implementations": [{"id": "x", "runtime": "python", "status": "verified"}], "decisions": ["d"]}
    cap["implementations"][0] |= {"constraints": [">=3.9"], "packages": {"p": ">1.9"}}
    assert resolver.resolve(cap, env, approvals=("d",))["implementation"] == "x"
    assert resolver.resolve(cap, env)["status"] == "needs_decision"
    assert resolver.resolve({**cap, "implementations": [{**cap["implementations"][0], "status": "experimental"}]}, env)["reason"] == "risk_not_admitted"
    assert resolver.resolve(None, env)["reason"] == "unknown_capability" and resolver.resolve(cap, [])["status"] == "blocked"
    assert not resolver.satisfies(None, ">=1") and resolver.satisfies("1.2", "==1.2.0")
    assert resolver.stages({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}) == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(ValueError):
        resolver.stages({"a": ["b"], "b": ["a"]})
    assert resolver.propagate({"a": [], "b": ["a"]}, {"a": "blocked"})["b"] == "blocked"
    assert resolver.in_scope("x.y.z", ["x.y.*"]) and not resolver.in_scope("x.yz", ["x.y.*"])


def test_tables(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('k,v\n 1,NA\n"a,b",null\n')
    import hashlib

    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert [tuple(r) for r in tables.read_csv(spark, str(path), digest).collect()] == [(" 1", None), ("a,b", None)]
    with pytest.raises(tables.SourceFailure):
        tables.read_csv(spark, str(path), "0" * 64)
    (tmp_path / "r.txt").write_text("b=1=2\nnoise\n")
    assert tables.read_key_values(spark, str(tmp_path / "r.txt"), ["b"]) == {"b": "1=2"}
    tables.write_table(spark.createDataFrame([(2, None), (1, "x")], "b int, a string"), str(tmp_path / "o"), ["a"], "csv", True)
    [out] = (tmp_path / "o").glob("part-*")
    assert out.read_text().splitlines()[:2] == ["a,b", "x,1"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a double, b double").parquet(str(tmp_path / "in"))
    ops = [{"kind": "ratio", "numerator": "a", "denominator": "b", "target": "r"}, {"kind": "indicator", "target": "i", "predicate": {"op": "gt", "left": "r", "right": 0}}]
    q = construct_stream(stream, ops).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(60)
    assert sorted((r["r"] is None, r["i"], r["violations"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(False, 1, 0), (True, 0, 1)]
    ten = construct_stream(spark.createDataFrame([(100.0,)], "a double"), [{"kind": "log", "source": "a", "target": "l", "base": "10"}, {"kind": "log", "source": "a", "target": "n"}]).first()
    assert ten["l"] == 2.0 and math.isclose(ten["n"], math.log(100))
    with pytest.raises(ValueError):
        construct_stream(stream, [{"kind": "lag", "source": "a", "target": "x"}])
