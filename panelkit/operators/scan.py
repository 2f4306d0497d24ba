"""Ordered functions over groups of any size: a prefix scan over range partitions.

A window function puts a group into one task. Here rows are dealt by ranges of (group, order), so that a large group lies
in several parts in order; a first pass computes the function within each part and keeps what a part ends with, a table of a
row a part and group; a window over that table, which is as long as there are parts, gives what each part
begins with; a second pass adds it. Rows are exchanged twice however many functions are scanned: by range, and by (part,
group), which windows, summaries and the join of what is carried share.

``order`` must identify a row up to repeated ones, which may take either place; missing values of the order come
last. Equal rows lie in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

RUNNING = ("sum", "count", "min", "max", "last")


class Scan:
    """Rows of ``df`` in parts, by group and order; functions are added one after the other.

    parts: how many ranges; the session's shuffle partitions unless told otherwise.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str], parts: int | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Materialised: which part a row is in must not change between the passes.
        ranges = df.repartitionByRange(parts, *[F.col(c).asc_nulls_last() for c in (*by, *order)])
        self.df = settled(ranges.withColumn("_part", F.spark_partition_id()))
        self.by, self.order = by, order

    def _window(self, reverse: bool = False) -> Window:
        end = [F.col(c).desc_nulls_first() if reverse else F.col(c).asc_nulls_last() for c in self.order]
        return Window.partitionBy("_part", *self.by).orderBy(*end)

    def _carried(self, summaries: DataFrame, reverse: bool) -> Window:
        return Window.partitionBy(*self.by).orderBy(F.desc("_part") if reverse else F.asc("_part"))

    def _joined(self, df: DataFrame, carried: DataFrame, names: list[str]) -> DataFrame:
        keys = ["_part", *self.by]
        other = carried.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *names)
        on = df["_part"] == other["_key__part"]
        for k in self.by:
            on &= df[k].eqNullSafe(other[f"_key_{k}"])
        return df.join(other, on, "left").drop(*[f"_key_{k}" for k in keys])

    def running(self, out: str, function: str, value: Column | str | None = None, reverse: bool = False) -> Scan:
        """Up to each row (from each row on, if ``reverse``): sum, count, min, max or the last value that isn't missing."""
        if function not in RUNNING:
            raise ValueError(f"{function!r} is one of {RUNNING}")
        value = F.lit(1) if value is None else F.col(value) if isinstance(value, str) else value
        over = self._window(reverse)
        upto = over.rowsBetween(Window.unboundedPreceding, 0)
        local = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[function](value).over(upto)
        rows = self.df.withColumns({"_local": local, "_i": F.row_number().over(over)})
        ends = rows.groupBy("_part", *self.by).agg(F.max_by("_local", "_i").alias("_end"))
        before = self._carried(ends, reverse).rowsBetween(Window.unboundedPreceding, -1)
        fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[function]("_end").over(before)
        rows = self._joined(rows, ends.withColumn("_carry", fold), ["_carry"])
        local, carry = F.col("_local"), F.col("_carry")
        made = {
            "sum": F.when(local.isNotNull() | carry.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))),
            "count": F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
            "min": F.least(local, carry), "max": F.greatest(local, carry), "last": F.coalesce(local, carry),
        }[function]
        self.df = rows.withColumn(out, made).drop("_local", "_i", "_carry")
        return self

    def number(self, out: str, total: str | None = None, reverse: bool = False) -> Scan:
        """The row's number in its group from 1, and the number of the group's rows."""
        rows = self.df.withColumn("_i", F.row_number().over(self._window(reverse)).cast("long"))
        sizes = rows.groupBy("_part", *self.by).agg(F.count(F.lit(1)).alias("_n"))
        before = self._carried(sizes, reverse).rowsBetween(Window.unboundedPreceding, -1)
        carried = sizes.select("_part", *self.by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"), F.sum("_n").over(Window.partitionBy(*self.by)).alias("_total"))
        rows = self._joined(rows, carried, ["_carry", "_total"]).withColumn(out, F.col("_i") + F.col("_carry"))
        self.df = (rows.withColumn(total, F.col("_total")) if total else rows).drop("_i", "_carry", "_total")
        return self

    def shifted(self, out: str, value: str, k: int = 1) -> Scan:
        """The value k rows before (after, if k is negative); missing where there is no such row."""
        reverse, k = k < 0, abs(k)
        over = self._window(reverse)
        rows = self.df.withColumns({"_local": F.lag(value, k).over(over), "_i": F.row_number().over(over), "_j": F.row_number().over(self._window(not reverse))})
        tail = F.sort_array(F.collect_list(F.when(F.col("_j") <= k, F.struct("_i", F.col(value).alias("v")))))
        ends = rows.groupBy("_part", *self.by).agg(tail.alias("_tail"))
        near = self._carried(ends, reverse).rowsBetween(-k, -1)  # no part is without a row
        rows = self._joined(rows, ends.withColumn("_tails", F.flatten(F.collect_list("_tail").over(near))), ["_tails"])
        reach = F.try_element_at("_tails", F.col("_i") - F.lit(k + 1))["v"]
        self.df = rows.withColumn(out, F.when(F.col("_i") <= k, reach).otherwise(F.col("_local"))).drop("_local", "_i", "_j", "_tails")
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_part")


def adjust_scanned(df: DataFrame, p: str, family: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``stats.adjust`` for families of any size: holm and bh of each test, by three scans over its family.

    ``order`` tells equal p-values apart; missing p-values come last and stay missing, but count as tests.
    """
    s = Scan(df, family, [p, *order], parts).number("_rank", "_tests")
    s.df = s.df.withColumns({"_h": (F.col("_tests") - F.col("_rank") + 1) * F.col(p), "_b": F.col(p) * F.col("_tests") / F.col("_rank")})
    s.running("_holm", "max", "_h").running("_bh", "min", "_b", reverse=True)
    known = F.col(p).isNotNull()
    made = s.result().withColumns({"holm": F.when(known, F.least(F.lit(1.0), "_holm")), "bh": F.when(known, F.least(F.lit(1.0), "_bh"))})
    return made.drop("_rank", "_tests", "_h", "_b", "_holm", "_bh")


def panel_shifts(df: DataFrame, source: str, panel_by: str, time_by: str, k: int = 1, parts: int | None = None) -> DataFrame:
    """lag, lead, difference and growth of ``source`` over panels of any size (a panel's times are distinct).

    Missing without a panel key; growth from zero is missing.
    """
    s = Scan(df, [panel_by], [time_by], parts).shifted("lag", source, k).shifted("lead", source, -k)
    x, known = F.col(source), F.col(panel_by).isNotNull()
    made = s.result().withColumns({"lag": F.when(known, F.col("lag")), "lead": F.when(known, F.col("lead"))})
    return made.withColumns({"difference": x - F.col("lag"), "growth": F.try_divide(x - F.col("lag"), F.col("lag"))})
