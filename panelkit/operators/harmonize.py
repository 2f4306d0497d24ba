"""Harmonize plans: ordered ops compiled to DataFrame transforms, guarded and fail-closed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.nulls import number
from panelkit.functions.text import date_output, normalize_key, parsed_date
from panelkit.plans.validate import harmonize_errors

from .guards import PlanFailure, Run, duplicate_rows
from .lineage import settled

#: Texts of true and false. Fixed values.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def coerced(c: Column, to: str) -> tuple[Column, Column]:
    """(value, violated). Missing stays missing; as a boolean, missing is a violation."""
    if to in ("integer", "numeric"):
        value = number(c)
        return value, c.isNotNull() & value.isNull()
    if to == "string":
        return c.cast("string"), F.lit(False)
    text = F.lower(F.trim(c.cast("string")))
    value = F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)
    return value, F.coalesce(text != "", F.lit(True)) & value.isNull()


def map_code(c: Column, mapping: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, c.cast("string"))


def unknown_codes(df: DataFrame, column: str, mapping: dict[str, str], most: int = 1000) -> DataFrame:
    """The distinct codes that a mapping lacks: U3. A plan that fails lists ``most`` of them, in order."""
    c = F.col(column)
    return df.where(map_code(c, mapping).isNull()).select(c.cast("string").alias("code")).distinct().orderBy("code").limit(most)


def convert_unit(c: Column, factor: float, mode: str) -> Column:
    return c * F.lit(float(factor)) if mode == "multiply" else F.try_divide(c, F.lit(float(factor)))


def merge(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str) -> DataFrame:
    """Null-safe equi-join; right columns that clash get ``_r``; equal-named keys are one column.

    ``_matched`` says whether a row found a partner.
    """
    same = {r for a, r in zip(left_keys, right_keys) if a == r}
    names = {c: f"_key_{c}" if c in same else c + "_r" if c in left.columns else c for c in right.columns}
    right = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.lit(True).alias("_matched"))
    on = reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[names[b]]) for a, b in zip(left_keys, right_keys)])
    joined = left.join(right, on, how)
    return joined.drop(*[names[c] for c in same]).withColumn("_matched", F.coalesce("_matched", F.lit(False)))


def _merge_op(run: Run, frames: dict[str, DataFrame], op: dict, at: int) -> dict:
    run.flush()
    right, rk = frames[op["right"]], op["right_keys"]
    lk = op.get("left_keys", rk)
    gone = [c for c in lk if c not in run.df.columns] + [c for c in rk if c not in right.columns]
    if gone:
        raise PlanFailure(at, "merge", f"missing key columns {gone}")
    one_left, one_right = op["cardinality"][0] == "1", op["cardinality"][-1] == "1"
    left, how = run.df, op["how"]
    if run.mode == "silent":
        run.df = merge(left, right, lk, rk, how).drop("_matched")
        return {}
    if run.mode == "observed":
        return _observed_merge(run, right, lk, rk, op, at)
    for one, df, keys, side in ((one_left, run.df, lk, "left"), (one_right, right, rk, "right")):
        if one and (n := duplicate_rows(df, keys)):
            raise PlanFailure(at, "merge", f"{side} keys repeat under {op['cardinality']}", n)
    # Joined once, for the counts and for what follows.
    joined = settled(merge(left, right, lk, rk, how))
    found = joined.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((~F.col("_matched")).cast("long")), F.lit(0)).alias("unmatched")).first()
    # A left join to a unique side keeps every row once.
    before = found["rows"] if how == "left" and one_right else left.count()
    # An inner join reports no unmatched rows: what finds no partner leaves, and rows_before tells.
    lost = found["unmatched"]
    if lost and op["unmatched"] == "fail":
        raise PlanFailure(at, "merge", "unmatched rows", lost)
    run.df = joined.drop("_matched")
    return _merge_facts(op, before, found["rows"], lost)


def _merge_facts(op: dict, before: int, after: int, lost: int) -> dict:
    facts = {"rows_before": before, "rows_after": after, "matched": after - lost, "unmatched": lost, "cardinality": op["cardinality"], "how": op["how"]}
    return facts | ({"warning": "unmatched rows"} if lost else {}) | ({"row_count_effect": after - before} if after != before else {})


def _observed_merge(run: Run, right: DataFrame, lk: list[str], rk: list[str], op: dict, at: int) -> dict:
    """The same counts on the way: keys are numbered by windows that share the join's partitioning."""
    counts: dict = {}
    repeats = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) > 1
    if op["cardinality"][-1] == "1":
        side = Run(right, mode="observed")
        side.guard(at, "merge", f"right keys repeat under {op['cardinality']}", repeats(rk))
        side.flush()
        right = side.df
        run.points += side.points
    if op["cardinality"][0] == "1":
        run.guard(at, "merge", f"left keys repeat under {op['cardinality']}", repeats(lk))
    run.count(counts, "before", F.lit(True))
    run.flush()
    run.df = merge(run.df, right, lk, rk, op["how"])
    if op["unmatched"] == "fail":
        run.guard(at, "merge", "unmatched rows", ~F.col("_matched"))
    run.count(counts, "after", F.lit(True))
    run.count(counts, "lost", ~F.col("_matched"))
    run.df = run.df.drop("_matched")
    entry = run.log[-1]
    run.then.append(lambda: entry.update(_merge_facts(op, counts["before"], counts["after"], counts["lost"])))
    return {}


def key_collisions(df: DataFrame, op: dict) -> int:
    """Normalized keys that several originals share."""
    c = F.col(op["column"])
    return df.select(c.alias("o"), normalize_key(c.cast("string"), op["rules"], op.get("width")).alias("n")).where("n is not null").distinct().groupBy("n").count().where("count > 1").count()


def apply(run: Run, frames: dict[str, DataFrame], op: dict, at: int) -> None:
    """One op on the working frame."""
    kind, entry = op["kind"], {"op": at, "kind": op["kind"]}
    run.log.append(entry)
    needs = [*op.get("mapping", {})] if kind == "rename" else [op[f] for f in ("column", "source_column") if f in op]
    gone = [c for c in needs if c not in run.df.columns]
    if gone:
        raise PlanFailure(at, kind, f"missing columns {gone}")
    if kind == "rename":
        kept = [c for c in run.df.columns if c not in op["mapping"]]
        if clash := sorted(set(kept) & set(op["mapping"].values())):
            raise PlanFailure(at, kind, f"targets exist: {clash}")
        run.df = run.df.withColumnsRenamed(op["mapping"])
    elif kind == "coerce":
        c = F.col(op["column"])
        value, violated = coerced(c, op["to"])
        run.guard(at, kind, f"{op['column']} is not {op['to']}", violated)
        run.df = run.df.withColumn(op["column"], value)
        if op["to"] == "integer":
            entry["column"] = op["column"]
            run.count(entry, "fractions", F.col(op["column"]) % 1 != 0)
    elif kind == "normalize_key":
        run.flush()
        c = normalize_key(F.col(op["column"]).cast("string"), op["rules"], op.get("width"))
        if run.mode == "eager" and (merged := key_collisions(run.df, op)):
            raise PlanFailure(at, kind, "normalized keys collide", merged)
        run.df = run.df.withColumn(op["column"], c)
    elif kind == "map_code":
        value = map_code(F.col(op["column"]), op["mapping"])
        run.guard(at, kind, f"unknown codes in {op['column']}", value.isNull())
        run.examples[at] = unknown_codes(run.df, op["column"], op["mapping"])
        run.df = run.df.withColumn(op["column"], value)
    elif kind == "normalize_date":
        t = parsed_date(F.col(op["column"]), op["in_format"])
        run.guard(at, kind, f"{op['column']} does not parse", t.isNull())
        run.df = run.df.withColumn(op["column"], date_output(t, op.get("out", "iso_date")))
    elif kind == "convert_unit":
        run.df = run.df.withColumn(op["target_column"], convert_unit(F.col(op["source_column"]), op["factor"], op["factor_mode"]))
    else:
        entry |= _merge_op(run, frames, op, at)


def finish(df: DataFrame, sort_by: list[str] = ()) -> DataFrame:
    """Columns by name; rows by ``sort_by``, missing last. Unknown sort keys are passed over."""
    keys = [F.col(k).asc_nulls_last() for k in sort_by if k in df.columns]
    df = df.select(*sorted(df.columns))
    return df.orderBy(*keys) if keys else df


def integral(df: DataFrame, log: list[dict]) -> DataFrame:
    """Columns that were made integers are integral where every value is."""
    for entry in log:
        if entry.get("fractions") == 0 and entry["column"] in df.columns and dict(df.dtypes)[entry["column"]] == "double":
            df = df.withColumn(entry["column"], F.col(entry["column"]).cast("long"))
    return df


def harmonize(plan: dict, frames: dict[str, DataFrame]) -> tuple[DataFrame, list[dict]]:
    """The harmonized frame and the log. The first input is the working frame.

    Raises PlanFailure (guards) or ValueError (the plan itself).
    """
    if errors := harmonize_errors(plan):
        raise ValueError("; ".join(errors))
    run = Run(frames[plan["inputs"][0]["input_id"]])
    with run.logged():
        for at, op in enumerate(plan["operations"]):
            apply(run, frames, op, at)
        run.flush()
    return finish(integral(run.df, run.log), plan.get("output", {}).get("sort_by", [])), run.log
