"""As-of join: each row of one side with the nearest earlier (later) row of the other in its group.

Both sides lie in one order, and the other side's values are carried along it: one prefix scan, so a group of any size
is split over parts and what a part begins with comes from a table of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Scan


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, direction: str = "backward", strict: bool = False, tolerance: Column | None = None, tie: list[str] = (), how: str = "left", suffix: str = "_r", parts: int | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` of the last row not later (``forward``: the first not earlier).

    by: key columns, named alike on both sides; strict: equal times don't match; tie: columns of ``right`` by which
    the last (forward: the first) of rows of one time is taken, by all of its columns if none are given;
    tolerance: how far off a time may be, in the unit of a difference of the times. Clashing names of ``right`` get the
    suffix. A missing key or time matches nothing; a left row is kept once (``inner``: if it matches); repeated rows are
    joined each; empty sides give what a join gives.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner"):
        raise ValueError("direction is backward or forward, how is left or inner")
    forward = direction == "forward"
    known = right.where(F.col(right_time).isNotNull())
    for k in by:
        known = known.where(F.col(k).isNotNull())
    others = [c for c in right.columns if c not in by]
    keys = [F.col(k).alias(f"_by{i}") for i, k in enumerate(by)]
    rank = list(tie) or others
    nothing = lambda df, columns: F.lit(None).cast(df.select(F.struct(*columns)).schema[0].dataType)
    # At one time, their rows stand before mine if mine look back, and behind them if they look forward; strict: the other way.
    theirs_first = strict == forward
    mine = left.select(
        *keys, F.col(left_time).alias("_time"), F.lit(int(theirs_first)).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}") for i, c in enumerate(rank)],
        F.struct(*left.columns).alias("_left"), nothing(known, others).alias("_right"),
    )
    theirs = known.select(
        *keys, F.col(right_time).alias("_time"), F.lit(int(not theirs_first)).alias("_side"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(rank)],
        nothing(left, left.columns).alias("_left"), F.struct(*others).alias("_right"),
    )
    by_keys = [f"_by{i}" for i in range(len(by))]
    s = Scan(mine.unionByName(theirs), by_keys, ["_time", "_side", *[f"_tie{i}" for i in range(len(rank))]], parts).running("_match", "last", "_right", reverse=forward)
    found = s.result().where("_left IS NOT NULL")
    off = F.col("_left")[left_time] - F.col("_match")[right_time]
    near = F.col("_time").isNotNull() & F.col("_match").isNotNull()
    if tolerance is not None:
        near &= (-off if forward else off) <= tolerance
    found = found.withColumn("_match", F.when(near, F.col("_match")))
    if how == "inner":
        found = found.where("_match IS NOT NULL")
    return found.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col("_match")[c].alias(c + suffix if c in left.columns else c) for c in others])
