"""Construct plans: derived variables, row-wise and over a panel, guarded and fail-closed."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.nulls import compare
from panelkit.plans.validate import construct_errors, op_inputs

from .guards import PlanFailure, Run, duplicate_rows
from .harmonize import finish
from .lineage import settled


def operand(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def predicate(p: dict) -> Column:
    """A predicate tree as a column that is never missing."""
    if p["op"] in ("and", "or"):
        a, b = map(predicate, p["args"])
        return a & b if p["op"] == "and" else a | b
    return compare(p["op"], operand(p["left"]), operand(p["right"]))


def arithmetic(operator: str, left: Column, right: Column) -> Column:
    left, right = left.cast("double"), right.cast("double")
    return {"add": left + right, "subtract": left - right, "multiply": left * right, "divide": F.try_divide(left, right)}[operator]


def logarithm(x: Column, base: str = "natural") -> Column:
    return F.log10(x) if str(base) == "10" else F.ln(x)


def panel_window(panel_by: str, time_by: str) -> Window:
    """One spec for every op on a panel, so that all share one exchange and sort."""
    return Window.partitionBy(panel_by).orderBy(F.col(time_by).asc_nulls_last())


def shifted(source: str, k: int, panel_by: str, time_by: str) -> Column:
    """The value k rows before (after, if k < 0) in the panel; missing without a panel key."""
    w = panel_window(panel_by, time_by)
    return F.when(F.col(panel_by).isNotNull(), F.lag(source, k).over(w) if k > 0 else F.lead(source, -k).over(w))


def _panel_op(run: Run, op: dict, plan: dict, at: int, entry: dict, checked: set) -> Column:
    kind, k = op["kind"], op.get("periods", 1)
    panel_by, time_by = (op.get(f, plan.get(f)) for f in ("panel_by", "time_by"))
    gone = [c for c in (panel_by, time_by) if c not in run.df.columns]
    if gone:
        raise PlanFailure(at, kind, f"missing columns {gone}")
    if (panel_by, time_by) not in checked:
        if run.mode == "eager":
            run.flush()
            if n := duplicate_rows(run.df, [panel_by, time_by]):
                raise PlanFailure(at, kind, f"({panel_by}, {time_by}) repeats", n)
            if not checked:
                run.df = settled(run.df)  # what follows reads the frame again and again
        else:  # in the window of the op itself: a repeated key stands next to its like
            order = panel_window(panel_by, time_by)
            run.guard(at, kind, f"({panel_by}, {time_by}) repeats", F.lag(time_by).over(order).eqNullSafe(F.col(time_by)) & (F.row_number().over(order) > 1))
        checked.add((panel_by, time_by))
    near = shifted(op["source"], -k if kind == "lead" else k, panel_by, time_by)
    run.df = run.df.withColumn("_near", near)
    x = F.col(op["source"])
    value = {"lag": F.col("_near"), "lead": F.col("_near"), "difference": x - F.col("_near"), "growth_rate": F.try_divide(x - F.col("_near"), F.col("_near"))}[kind]
    if kind == "growth_rate":
        run.guard(at, kind, "growth from zero", F.col("_near") == 0)
    w = panel_window(panel_by, time_by)
    place = F.row_number().over(w) - 1 if kind != "lead" else F.count(F.lit(1)).over(Window.partitionBy(panel_by)) - F.row_number().over(w)
    run.count(entry, "structural_missing", F.col(panel_by).isNotNull() & (place < k))
    entry["_total"] = op["target"]
    run.df = run.df.withColumn(op["target"], value).drop("_near")
    run.count(entry, "missing", F.col(op["target"]).isNull())
    return F.col(op["target"])


def apply(run: Run, op: dict, plan: dict, at: int, checked: set) -> None:
    kind, target = op["kind"], op["target"]
    entry = {"op": at, "kind": kind, "inputs": op_inputs(op), "output": target}
    run.log.append(entry)
    if target in run.df.columns:
        raise PlanFailure(at, kind, f"target {target!r} exists")
    if gone := [c for c in entry["inputs"] if c not in run.df.columns]:
        raise PlanFailure(at, kind, f"missing columns {gone}")
    if kind in ("lag", "lead", "difference", "growth_rate"):
        _panel_op(run, op, plan, at, entry, checked)
        return
    if kind == "arithmetic":
        if op["operator"] == "divide":
            run.guard(at, kind, "division by zero", operand(op["right"]) == 0)
        value = arithmetic(op["operator"], operand(op["left"]), operand(op["right"]))
    elif kind == "log":
        x = F.col(op["source"])
        run.guard(at, kind, "log of a value that is not positive", x <= 0)
        run.count(entry, "missing_propagated", x.isNull())
        value = logarithm(x, op.get("base", "natural"))
    elif kind == "ratio":
        run.guard(at, kind, "denominator is zero", F.col(op["denominator"]) == 0)
        value = F.try_divide(F.col(op["numerator"]), F.col(op["denominator"]))
    elif kind == "interaction":
        value = reduce(mul, map(F.col, op["terms"]))
    else:
        value = predicate(op["predicate"]).cast("int")
    run.df = run.df.withColumn(target, value)


def propagated(log: list[dict]) -> None:
    """Missing values of panel ops that the panel's ends don't account for."""
    for entry in log:
        if entry.pop("_total", None):
            entry["propagated_missing"] = max(0, entry["missing"] - entry["structural_missing"])


def construct(plan: dict, df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """The constructed frame and the log. Raises PlanFailure or ValueError."""
    if errors := construct_errors(plan, df.columns):
        raise ValueError("; ".join(errors))
    run, checked = Run(df), set()
    with run.logged():
        for at, op in enumerate(plan["operations"]):
            apply(run, op, plan, at, checked)
        run.flush()
    propagated(run.log)
    return finish(run.df, plan.get("output", {}).get("sort_by", [])), run.log
