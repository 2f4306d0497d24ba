"""Missing values: held as NULL, never NaN; comparisons that never return NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a CSV cell may use for a missing value. Fixed values.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def na_to_null(c: Column) -> Column:
    """A cell's text, or NULL if it is one of the missing tokens."""
    return F.when(~c.isin(*NA_TOKENS), c)


def compare(op: str, left: Column, right: Column) -> Column:
    """gt gte lt lte eq: false if a side is missing; neq: true then."""
    made = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right, "eq": left == right, "neq": left != right}[op]
    return F.coalesce(made, F.lit(op == "neq"))


def number(c: Column) -> Column:
    """A double, or NULL where the text is no number; NaN counts as missing."""
    made = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(made), made)
