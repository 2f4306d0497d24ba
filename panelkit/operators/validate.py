"""Structural validation: seven read-only checks; defects are reported, never repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
CHECKS = ("DV_ROWCOUNT", "DV_VAR_PRESENT", "DV_VAR_TYPE", "DV_KEY_UNIQUE", "DV_MISSINGNESS", "DV_SAMPLE_FLOW", "DV_MERGE_CARDINALITY")


def key_facts(df: DataFrame, keys: list[str]) -> dict:
    """Rows, distinct keys, and half the rows whose key repeats."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated")).first()
    return {"rows": found["rows"], "n_unique": found["n_unique"], "duplicates": found["repeated"] // 2}


def cardinality(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> str:
    """The observed relationship of two tables' keys."""
    sides = []
    for df, key in ((left, left_key), (right, right_key)):
        facts = key_facts(df, [key])
        sides.append(facts["n_unique"] == facts["rows"])
    return f"{'1' if sides[0] else 'm'}:{'1' if sides[1] else 'm'}"


def _type_holds(name: str, actual: str, fractions: int, present: int) -> bool:
    if not present:
        return True  # all missing: nothing to hold against
    return {"integer": actual in _NUMERIC and not fractions, "float": actual in _NUMERIC, "string": actual == "string"}.get(name, True)


def sample_flow_holds(steps: list[dict], expected_n: int) -> bool:
    """n_before - n_removed = n_after, each step from the one before, the last at expected_n."""
    last = None
    for s in steps:
        if s["n_before"] - s["n_removed"] != s["n_after"] or last not in (None, s["n_before"]):
            return False
        last = s["n_after"]
    return last is None or last == expected_n


def validate(df: DataFrame, rules: dict, merged: tuple[DataFrame, DataFrame] | None = None) -> dict:
    """Run all checks in two actions; merged: the tables of rules["merge_spec"]."""
    spec, types = rules.get("variables", []), dict(df.dtypes)
    present = [v["name"] for v in spec if v["name"] in types]
    counts = [F.count(F.lit(1)).alias("n")]
    for v in present:
        counts.append(F.count_if(F.col(v).isNull()).alias(f"null_{v}"))
        counts.append((F.count_if(F.col(v) % 1 != 0) if types[v] in _NUMERIC else F.lit(0)).alias(f"frac_{v}"))
    got = df.agg(*counts).first()
    n, checks = got["n"], []

    def add(check_id: str, status: str, **facts) -> None:
        checks.append({"check_id": check_id, "status": status, "facts": facts})

    def told(ok: bool) -> str:
        return "pass" if ok else "fail"

    if "expected_n" in rules:
        add("DV_ROWCOUNT", told(n == rules["expected_n"]), n=n, expected=rules["expected_n"])
    else:
        add("DV_ROWCOUNT", "not_applicable", n=n)
    absent = sorted({v["name"] for v in spec} - set(types))
    add("DV_VAR_PRESENT", told(not absent), missing_variables=absent)
    wrong = [v["name"] for v in spec if v["name"] in types and not _type_holds(v.get("type"), types[v["name"]], got[f"frac_{v['name']}"], n - got[f"null_{v['name']}"])]
    add("DV_VAR_TYPE", told(not wrong), wrong_type=wrong)
    key = rules.get("unit_key", [])
    if any(k not in types for k in key):
        add("DV_KEY_UNIQUE", "fail", n_unique=None)
    elif key:
        facts = key_facts(df, key)
        add("DV_KEY_UNIQUE", told(facts["n_unique"] == n and not facts["duplicates"]), **facts)
    else:
        add("DV_KEY_UNIQUE", "not_applicable")
    nulls = {v: got[f"null_{v}"] for v in present}
    add("DV_MISSINGNESS", told(not any(nulls.values())), counts=nulls, rates={v: round(c / n, 6) if n else 0.0 for v, c in nulls.items()})
    steps = rules.get("sample_flow_steps")
    add("DV_SAMPLE_FLOW", told(sample_flow_holds(steps, rules.get("expected_n", n))) if steps else "not_applicable")
    join = rules.get("merge_spec")
    if join and merged:
        seen = cardinality(*merged, join["left_key"], join["right_key"])
        add("DV_MERGE_CARDINALITY", told(seen == join["expected_relationship"]), observed=seen)
    else:
        add("DV_MERGE_CARDINALITY", "not_applicable")
    summary = {s: sum(c["status"] == s for c in checks) for s in ("pass", "fail", "not_applicable")}
    return {"checks": checks, "summary": summary}
