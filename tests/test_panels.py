"""Estimators on panels with gaps and on data far from zero, against dense algebra."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import stats


def _gaps(seed, firms=40, years=9, split=False):
    r = random.Random(seed)
    rows = []
    for u in range(firms):
        for t in range(years):
            if r.random() < 0.5 and (not split or (u % 2 == 0) == (t < 5)):
                rows += [(u, t, r.gauss(t, 1), r.gauss(u % 3, 1))] * (2 if r.random() < 0.1 else 1)
    return rows


def _residuals(rows, column):
    u, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    dummies = np.column_stack([u[:, None] == np.unique(u), t[:, None] == np.unique(t)]).astype(float)
    y = np.array([r[column] for r in rows])
    return y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]


@pytest.mark.parametrize(("seed", "split", "dense"), [(1, False, None), (2, True, None), (3, False, 3), (4, True, 3)])
def test_absorbed_effects_equal_dummies(spark, seed, split, dense):
    rows = _gaps(seed, 12 if dense else 40, 6 if dense else 9, split)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "u int, t int, y double, x double, id int")
    got = stats.absorb_two_way(df, "u", "t", ["y", "x"], dense).collect()
    want = sorted(zip([r[0] for r in rows], [r[1] for r in rows], _residuals(rows, 2), _residuals(rows, 3)))
    assert len(got) == len(rows)
    assert np.allclose(np.array(sorted(tuple(r) for r in got)), np.array(want), atol=1e-8)


def test_absorption_of_nothing(spark):
    empty = spark.createDataFrame([], "u int, t int, y double")
    assert stats.absorb_two_way(empty, "u", "t", ["y"]).count() == 0


def test_fixed_effects_on_gaps_equal_dummies(spark):
    rows = _gaps(5)
    e = stats.panel_fe(spark.createDataFrame(rows, "u int, t int, y double, x double"), "y", ["x"], "u", "t")
    y, x = _residuals(rows, 2), _residuals(rows, 3)
    b = x @ y / (x @ x)
    u = np.array([r[0] for r in rows])
    scores = np.array([(x * (y - b * x))[u == k].sum() for k in np.unique(u)])
    se = np.sqrt(stats.cluster_factor(len(rows), 1, len(np.unique(u)), 9) * (scores @ scores)) / (x @ x)
    assert (e.beta[0], e.se[0]) == pytest.approx((b, se), rel=1e-9)


def test_2sls_keeps_its_digits_far_from_zero(spark):
    r = np.random.default_rng(6)
    z, w = r.normal(size=(2, 500))
    x = z + 0.5 * w + r.normal(size=500)
    y = 2 * x - w + r.normal(size=500)
    df = spark.createDataFrame(np.column_stack([y, w, x, z]).tolist(), "y double, w double, x double, z double")
    near = stats.iv_2sls(df, "y", ["w"], "x", ["z"])
    far = stats.iv_2sls(df.select(*[(F.col(c) + 1e7).alias(c) for c in df.columns]), "y", ["w"], "x", ["z"])
    assert far.beta[1:] == pytest.approx(near.beta[1:], rel=1e-6) and far.se[1:] == pytest.approx(near.se[1:], rel=1e-6)
    xs, zs = np.column_stack([np.ones(500), w, x]), np.column_stack([np.ones(500), w, z])
    hat = zs @ np.linalg.lstsq(zs, xs, rcond=None)[0]
    b = np.linalg.solve(hat.T @ xs, hat.T @ y)
    cov = ((y - xs @ b) ** 2).mean() * np.linalg.inv(hat.T @ hat)
    assert near.beta == pytest.approx(b, rel=1e-9) and near.se == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-9)


def test_t_tails_and_quantiles_have_closed_forms():
    import math

    for k in range(40):
        t = k / 4
        assert stats.t_pvalue(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert stats.t_pvalue(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    for p in (0.05, 0.5, 0.9, 0.99):
        assert stats.t_quantile(p, 1) == pytest.approx(math.tan(math.pi * (p - 0.5)), abs=1e-9)
        assert stats.t_quantile(p, 2) == pytest.approx((2 * p - 1) / math.sqrt(2 * p * (1 - p)), abs=1e-9)


def test_the_overall_verdict_needs_a_second_aligned_engine(spark):
    def told(rows):
        got = stats.overall_verdict(spark.createDataFrame(rows, "engine string, verdict string"), "engine").collect()
        return {r["engine"]: r["alignment"] or r["verdict"] for r in got}

    assert told([]) == {None: "UNRESOLVED"}
    assert told([("a", "PASS"), ("a", "PASS")]) == {"a": "ALIGNED", None: "PASS"}
    assert told([("a", "PASS"), ("b", "UNRESOLVED"), ("b", "PASS")]) == {"a": "ALIGNED", "b": "UNRESOLVED", None: "UNRESOLVED"}
    assert told([("a", "PASS"), ("b", "UNRESOLVED"), ("b", "FAIL")]) == {"a": "ALIGNED", "b": "FAIL", None: "FAIL"}
