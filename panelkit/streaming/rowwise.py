"""Row-wise ops on streams: what needs a whole table or another row's value is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.construct import arithmetic, logarithm, operand, predicate

ROWWISE = ("arithmetic", "ratio", "log", "interaction", "indicator")


def construct_stream(df: DataFrame, operations: list[dict]) -> DataFrame:
    """Derived columns and ``violations``, the number of guards that a row breaks."""
    broken = F.lit(0)
    for at, op in enumerate(operations):
        if op["kind"] not in ROWWISE:
            raise ValueError(f"op {at}: {op['kind']} is not row-wise")
        if op["kind"] == "arithmetic":
            value = arithmetic(op["operator"], operand(op["left"]), operand(op["right"]))
            bad = operand(op["right"]) == 0 if op["operator"] == "divide" else F.lit(False)
        elif op["kind"] == "ratio":
            value, bad = F.try_divide(F.col(op["numerator"]), F.col(op["denominator"])), F.col(op["denominator"]) == 0
        elif op["kind"] == "log":
            value, bad = logarithm(F.col(op["source"]), op.get("base", "natural")), F.col(op["source"]) <= 0
        elif op["kind"] == "interaction":
            value, bad = F.expr("*".join(f"`{t}`" for t in op["terms"])), F.lit(False)
        else:
            value, bad = predicate(op["predicate"]).cast("int"), F.lit(False)
        df = df.withColumn(op["target"], value)
        broken = broken + F.coalesce(bad, F.lit(False)).cast("int")
    return df.withColumn("violations", broken)
