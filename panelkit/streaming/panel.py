"""Panel ops on streams: rows wait for the watermark, then leave in their panel's order.

A unit's state holds the rows that the watermark hasn't passed and the last k values that it has, so it is bounded by the
watermark's delay. When the watermark passes a row, a timer or the unit's next batch lets it leave, with the value k rows
before it: the result is the batch plan's whatever the order of arrival, as long as rows come within the delay. A row that
comes behind one of its unit that has left is late: it leaves at once, marked, without derived values, and moves nothing.

A unit's rows meet in one task, as its state is one. Units share the states of BUCKETS buckets, which are worked on as columns: a
call a unit would cost more than its rows. Rows without unit or time leave marked as late. Times before
1970 don't wait, as a watermark begins there.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_AHEAD = 36_500
#: Fixed, as states are found by it.
BUCKETS = 1024


def _packed(frame) -> bytes | None:
    if not len(frame):
        return None
    sink = io.BytesIO()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue()


def _unpacked(held: bytes | None):
    return pa.ipc.open_stream(held).read_all().to_pandas() if held else None


def panel_stream(df: DataFrame, unit: str, time: str, source: str, k: int = 1, keep: list[str] = (), delay: str = "1 hour") -> DataFrame:
    """unit, time, source, ``keep``'s columns, lag, difference, growth, structural, late; in append mode.

    structural: the unit has no k rows before this one. Growth from zero is missing. Rows of one time are ordered by
    ``keep``'s columns (whole numbers beyond 2^53 only if none is missing). df: a stream; delay: how long rows may come out
    of order; k: 1 at least.
    """
    types = {c: df.schema[c].dataType.simpleString() for c in (unit, *keep)}
    columns = ["_unit", "_time", "_value", *[f"_k{i}" for i in range(len(keep))]]
    schema = f"_unit {types[unit]}, _time timestamp, _value double, " + "".join(f"_k{i} {types[c]}, " for i, c in enumerate(keep)) + "lag double, difference double, growth double, structural boolean, late boolean"

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        came = [] if state.hasTimedOut else [f for f in frames if len(f)]
        new = pd.concat(came) if came else pd.DataFrame(columns=[*columns, "_at"])
        # Waiting rows, and the last k rows of each unit that have left.
        held, left = map(_unpacked, state.get) if state.exists else (None, None)
        behind = new["_at"].isna() | new["_unit"].isna()
        if left is not None and len(new):
            behind |= new["_at"] <= new["_unit"].map(left.groupby("_unit")["_at"].last())
        late, fresh = new[behind.astype(bool)], new.loc[~behind.astype(bool), [*columns, "_at"]]
        frames = [f for f in (held, fresh) if f is not None and len(f)]
        waiting = (pd.concat(frames) if frames else fresh).sort_values(["_unit", "_at", *columns[3:]], kind="stable")
        mark = state.getCurrentWatermarkMs() * 1000
        passed = (waiting["_at"] < mark).astype(bool)
        ready, rest = waiting[passed], waiting[~passed]
        if len(late):
            yield late[columns].assign(lag=np.nan, difference=np.nan, growth=np.nan, structural=False, late=True)
        if len(ready):
            kept = ["_unit", "_at", "_value"]
            own = pd.concat([f for f in (left, ready[kept]) if f is not None], ignore_index=True).assign(_new=np.arange(len(ready) + (len(left) if left is not None else 0)) >= (len(left) if left is not None else 0))
            own = own.sort_values("_unit", kind="stable")  # a unit's rows that have left stand before the others
            units = own.groupby("_unit", sort=False)
            fresh_rows = own["_new"].to_numpy()
            near = units["_value"].shift(k).to_numpy(float)[fresh_rows]
            values = ready["_value"].to_numpy(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                growth = np.where(near == 0, np.nan, (values - near) / near)
            yield ready[columns].assign(lag=near, difference=values - near, growth=growth, structural=(units.cumcount() < k).to_numpy()[fresh_rows], late=False)
            left = units.tail(k)[kept]
        if len(rest) or left is not None:
            state.update((_packed(rest), _packed(left) if left is not None else None))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["_at"].min()), mark) // 1000 + 1)

    rows = df.select(F.col(unit).alias("_unit"), F.col(time).cast("timestamp").alias("_time"), F.col(source).cast("double").alias("_value"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    # The clock that Spark drops late rows by stands a century ahead, and so does the delay: the watermark is the rows' own,
    # and none is dropped.
    rows = rows.withColumns({"_at": F.unix_micros("_time"), "_clock": F.col("_time") + F.expr(f"INTERVAL '{_AHEAD}' DAY")}).withWatermark("_clock", f"{_AHEAD} days {delay}")
    # Rows without a unit have no state: they are dealt by their times.
    alone = F.col("_unit").isNull()
    bucket = F.pmod(F.when(alone, F.xxhash64("_time")).otherwise(F.xxhash64("_unit")), F.lit(BUCKETS)) - F.when(alone, BUCKETS).otherwise(0)
    made = rows.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(step, schema, "held binary, left binary", "append", GroupStateTimeout.EventTimeTimeout)
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return made.select(F.col("_unit").alias(unit), F.col("_time").alias(time), F.when(~F.isnan("_value"), F.col("_value")).alias(source), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], nan("lag"), nan("difference"), nan("growth"), "structural", "late")


def share_stream(df: DataFrame, time: str, condition: Column, window: str, delay: str = "1 hour") -> DataFrame:
    """start, share, count, rows: how many rows of each window of time meet a condition; a window leaves when the watermark has passed it."""
    held = df.select(F.col(time).cast("timestamp").alias("_time"), F.coalesce(condition, F.lit(False)).alias("_met")).withWatermark("_time", delay)
    found = held.groupBy(F.window("_time", window).alias("w")).agg(F.count_if("_met").alias("count"), F.count(F.lit(1)).alias("rows"))
    return found.select(F.col("w.start").alias("start"), (F.col("count") / F.col("rows")).alias("share"), "count", "rows")
