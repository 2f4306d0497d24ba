"""Staggered difference-in-differences against plain loops over units."""

import math
import random

import pytest

from panelkit.operators.did import Staggered

SCHEMA = "firm long, year long, first long, y double, region string"


def _panel(seed, firms=60, years=range(2001, 2007), holes=0.0):
    r = random.Random(seed)
    rows = []
    for i in range(firms):
        first = r.choice([None, 2001, 2003, 2004, 2006, 2009])
        level, region = r.gauss(0, 2), f"r{i % 7}"
        for t in years:
            if r.random() >= holes:
                effect = 0 if first is None or t < first else 1 + 0.5 * (t - first)
                rows.append((i, t, first, level + 0.3 * t + effect + r.gauss(0, 0.5), region))
    return rows


def _loops(rows, control, anticipation, how):
    """(effects, aggregates) by the definitions, a unit at a time."""
    ys, first, region = {}, {}, {}
    for i, t, g, y, c in rows:
        if y is not None:
            ys.setdefault(i, {})[t] = y
        first[i], region[i] = g, c
    times = sorted({r[1] for r in rows})
    units = [i for i in first if first[i] is None or first[i] - anticipation > times[0]]
    n = len(units)
    effects, influence = [], []
    for g in sorted({first[i] for i in units if first[i] is not None and first[i] <= times[-1]}):
        for t in times[1:]:
            before = [s for s in times if s + anticipation < g] if t >= g else [s for s in times if s < t and s + anticipation < g]
            b = before[-1]
            own = [i for i in units if first[i] == g and t in ys.get(i, {}) and b in ys[i]]
            late = max(t, b) + anticipation
            others = [i for i in units if (first[i] is None or (control == "not_yet_treated" and first[i] != g and first[i] > late)) and t in ys.get(i, {}) and b in ys[i]]
            if not own or not others:
                continue
            d = {i: ys[i][t] - ys[i][b] for i in {*own, *others}}
            m1, m0 = sum(d[i] for i in own) / len(own), sum(d[i] for i in others) / len(others)
            psi = {i: 0.0 for i in units}
            for i in own:
                psi[i] += n / len(own) * (d[i] - m1)
            for i in others:
                psi[i] -= n / len(others) * (d[i] - m0)
            effects.append((g, t, b, len(own), len(others), m1 - m0, math.sqrt(sum(x * x for x in psi.values())) / n))
            influence.append(psi)
    key = {"simple": lambda e: 0, "dynamic": lambda e: e[1] - e[0], "group": lambda e: e[0], "calendar": lambda e: e[1]}[how]
    groups = {}
    for k, e in enumerate(effects):
        if how == "dynamic" or e[1] >= e[0]:
            groups.setdefault(key(e), []).append(k)
    out = {}
    for target, members in groups.items():
        p = [sum(first[i] == effects[k][0] for i in units) / n for k in members]
        w = [1 / len(members)] * len(members) if how == "group" else [x / sum(p) for x in p]
        att = sum(a * effects[k][5] for a, k in zip(w, members))
        by_region = {}
        for i in units:
            psi = sum(a * influence[k][i] for a, k in zip(w, members))
            if how != "group":
                own = [(first[i] == effects[k][0]) - q for k, q in zip(members, p)]
                psi += sum((x / sum(p) - sum(own) * q / sum(p) ** 2) * effects[k][5] for x, q, k in zip(own, p, members))
            by_region[region[i]] = by_region.get(region[i], 0.0) + psi
        out[target] = att, math.sqrt(sum(x * x for x in by_region.values())) / n
    return effects, out


@pytest.mark.parametrize(("seed", "holes", "control", "anticipation", "how"), [(1, 0.0, "not_yet_treated", 0, "dynamic"), (2, 0.2, "not_yet_treated", 0, "simple"), (3, 0.2, "never_treated", 1, "calendar"), (4, 0.1, "not_yet_treated", 1, "group")])
def test_effects_equal_loops(spark, seed, holes, control, anticipation, how):
    rows = _panel(seed, holes=holes)
    rows += [(1000, 2002, 2004, None, "r1"), (1001, 2003, None, float("nan"), "r2")]  # nothing known of them
    panel = Staggered(spark.createDataFrame(rows, SCHEMA), "firm", "year", "first", "y", control, anticipation, cluster="region")
    plain = [(i, t, g, None if y is None or math.isnan(y) else y, c) for i, t, g, y, c in rows]
    effects, aggregates = _loops(plain, control, anticipation, how)
    got = {(r["cohort"], r["period"]): tuple(r) for r in panel.att_gt().collect()}
    assert set(got) == {e[:2] for e in effects} and len(effects) > 8
    for e in effects:
        assert got[e[:2]] == pytest.approx(e, abs=1e-10)
    frame, targets, covariance = panel.aggregate(how)
    found = {r["target"]: (r["att"], r["se"]) for r in frame.collect()}
    assert set(found) == set(aggregates) == set(targets)
    for k, want in aggregates.items():
        assert found[k] == pytest.approx(want, abs=1e-10)
    assert [covariance[j][j] ** 0.5 for j in range(len(targets))] == pytest.approx([found[k][1] for k in targets])


def test_true_effects_are_found(spark):
    panel = Staggered(spark.createDataFrame(_panel(5, firms=600), SCHEMA), "firm", "year", "first", "y")
    found = {r["target"]: (r["att"], r["se"]) for r in panel.aggregate("dynamic")[0].collect()}
    for k, (att, se) in found.items():
        assert abs(att - (1 + 0.5 * k if k >= 0 else 0)) < 4 * se + 1e-9


def test_rows_meet_once(spark):
    panel = Staggered(spark.createDataFrame(_panel(6), SCHEMA), "firm", "year", "first", "y")
    plan = panel.differences()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_defined_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = _panel(7, firms=20)
    for more in ([rows[0]], [(0, 2020, 2018, 1.0, "r0")], [(0, 2020, rows[0][2], 1.0, "other")], [(None, 2001, None, 1.0, "r0")], [(0, None, rows[0][2], 1.0, "r0")]):
        with pytest.raises(ValueError):
            Staggered(frame(rows + more), "firm", "year", "first", "y", cluster="region").effects()
    with pytest.raises(ValueError):
        Staggered(frame(rows), "firm", "year", "first", "y", control="any")
    with pytest.raises(ValueError):
        Staggered(frame(rows), "firm", "year", "first", "y").aggregate("median")
    for none in ([], [r for r in rows if r[2] is None], [r for r in rows if r[2] == 2003]):  # empty, nobody treated, no controls
        panel = Staggered(frame(none), "firm", "year", "first", "y")
        assert panel.att_gt().count() == 0 and panel.aggregate("simple")[0].count() == 0
