"""Referential integrity, sanity and stamps of result artifacts; roll-ups and rendering."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.plans.canonical import canonical_json


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key, if any, no parent has."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reference_orphans(views: DataFrame, items: DataFrame) -> DataFrame:
    """(view_id, artifact_id, item_id) that a view's source_refs name and no item has."""
    refs = views.select("view_id", F.explode("source_refs").alias("r")).select("view_id", F.col("r.artifact_id").alias("artifact_id"), F.explode("r.item_ids").alias("item_id"))
    return refs.join(items.select("artifact_id", "item_id").distinct(), ["artifact_id", "item_id"], "left_anti").select("view_id", "artifact_id", "item_id")


def family_gaps(families: DataFrame, estimates: DataFrame) -> DataFrame:
    """Where families and estimates don't name each other, in either direction, or members repeat."""
    members = families.select("family_id", F.explode("member_estimate_ids").alias("estimate_id"))
    claims = estimates.select(F.explode("multiple_testing_family_ids").alias("family_id"), "estimate_id")
    a = members.distinct().join(claims, ["family_id", "estimate_id"], "left_anti").withColumn("problem", F.lit("member_does_not_claim_family"))
    b = claims.distinct().join(members, ["family_id", "estimate_id"], "left_anti").withColumn("problem", F.lit("estimate_not_a_member"))
    c = members.groupBy("family_id", "estimate_id").count().where("count > 1").drop("count").withColumn("problem", F.lit("repeated_member"))
    return a.unionByName(b).unionByName(c)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def numeric_problems(estimate: Column, low: Column, high: Column, p: Column) -> Column:
    """Why an estimate row isn't sane, or NULL."""
    return F.when(~(finite(estimate) & finite(low) & finite(high) & finite(p)), "not_finite").when((p < 0) | (p > 1), "p_out_of_range").when((low > estimate) | (estimate > high), "outside_interval")


def broken_flow(steps: DataFrame, order: str, group: str) -> DataFrame:
    """Steps that don't add up or don't begin where the one before ended."""
    before = F.lag("n_after").over(Window.partitionBy(group).orderBy(order))
    return steps.withColumn("_before", before).where((F.col("n_before") - F.col("n_removed") != F.col("n_after")) | (F.col("_before") != F.col("n_before"))).drop("_before")


def stamp(models: DataFrame, estimates: DataFrame, model_key: str, estimate_key: str) -> DataFrame:
    """Each model with its sorted estimate ids; a model without any has an empty list."""
    grouped = estimates.groupBy(model_key).agg(F.sort_array(F.collect_set(estimate_key)).alias("estimate_ids"))
    return models.select(model_key).distinct().join(grouped, model_key, "left").select(model_key, F.coalesce("estimate_ids", F.array().cast("array<string>")).alias("estimate_ids"))


def ordered_lookup(ids: DataFrame, items: DataFrame, list_col: str, key: str) -> DataFrame:
    """Items by the places of their ids in a list; ids without an item stay, empty."""
    wanted = ids.select(F.posexplode(list_col).alias("pos", key))
    return wanted.join(items, key, "left")


def share(condition: Column) -> list[Column]:
    """share (0 without rows) and count of a condition."""
    n = F.count_if(condition)
    return [F.coalesce(F.try_divide(n, F.count(F.lit(1))), F.lit(0.0)).alias("share"), n.alias("count")]


def worst(status: Column) -> Column:
    """blocked over needs_decision over ready."""
    rank = F.max(F.when(status == "blocked", 2).when(status == "needs_decision", 1).otherwise(0))
    return F.when(rank == 2, "blocked").when(rank == 1, "needs_decision").otherwise("ready")


def fixed(x: float, places: int = 4) -> str:
    """The exact binary value, rounded half up, with so many places."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def scalar_text(x) -> str:
    """Integers as they are, floats with four places, lists joined, objects as canonical JSON."""
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return fixed(x)
    if isinstance(x, (list, tuple)):
        return ", ".join(map(scalar_text, x))
    return canonical_json(x) if isinstance(x, dict) else str(x)


def markdown_table(columns: list[str], rows: list[dict]) -> str:
    """A view's rows (few, in order) as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(scalar_text(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"
