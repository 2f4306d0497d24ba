"""Mergeable sketches of columns: distinct counts and quantiles kept as a table, merged and told later.

A sketch is as large as its precision asks, whatever it has seen, and merging two is as good as having seen both. So a table of
sketches by part (a day, a source) answers for any union of parts without the rows, and new parts are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Precision of distinct counts (a relative standard error of 1.04 / sqrt(2^12) = 1.6 %) and of quantiles (a rank error of 1.65 % at most, nearly always).
LG, KLL, RANK_ERROR = 12, 200, 0.0165


def distinct_error(lg: int = LG) -> float:
    return 1.04 / 2 ** (lg / 2)


def sketched(df: DataFrame, by: list[str], distinct: list[str] = (), quantiles: list[str] = (), lg: int = LG) -> DataFrame:
    """by's columns, rows, and a sketch ``<column>_distinct`` or ``<column>_quantiles`` for each column. Missing values are not seen.

    A map-side sketch a task and group is all that is shuffled.
    """
    made = [F.hll_sketch_agg(F.col(c).cast("string") if df.schema[c].dataType.simpleString() not in ("int", "bigint", "string", "binary") else F.col(c), lg).alias(f"{c}_distinct") for c in distinct]
    made += [F.kll_sketch_agg_double(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), KLL).alias(f"{c}_quantiles") for c in quantiles]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *made)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups (none: of all)."""
    unions = []
    for c in sketches.columns:
        if c.endswith("_distinct"):
            unions.append(F.hll_union_agg(c).alias(c))
        elif c.endswith("_quantiles"):
            unions.append(F.kll_merge_agg_double(c).alias(c))
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *unions)


def distinct_estimate(column: str) -> Column:
    return F.hll_sketch_estimate(f"{column}_distinct")


def quantile_estimate(column: str, p: float) -> Column:
    """A value whose rank is ``p``, up to RANK_ERROR; missing where nothing was seen."""
    sketch = F.col(f"{column}_quantiles")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))
