"""Panel ops on streams against the batch plan, in any order of arrival."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.streaming.panel import panel_stream, share_stream

START = datetime.datetime(2024, 1, 1)
SCHEMA = "u string, t timestamp, x double, id long"


def _run(spark, path, batches, build):
    """Feed batches one by one and a last row, a year on, that makes the watermark pass all others."""
    end = ("end", START + datetime.timedelta(days=400), 0.0, -1)
    for i, rows in enumerate([*batches, [end]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path / "in" / f"{i:03d}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(path / "in" / "*"))
        q = build(stream).writeStream.format("parquet").option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start(str(path / "out"))
        q.awaitTermination()
    return spark.read.parquet(str(path / "out"))


def _rows(seed, n=120):
    r = random.Random(seed)
    return [(r.choice("abc"), START + datetime.timedelta(minutes=i), r.choice([None, 0.0, float(r.randint(-5, 5))]), i) for i in range(n)]


@pytest.mark.parametrize("k", [1, 3])
def test_any_order_of_arrival_gives_the_batch_plan(spark, tmp_path, k):
    rows = _rows(k)
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    got = {r["id"]: r for r in _run(spark, tmp_path, [shuffled[:50], shuffled[50:90], shuffled[90:]], lambda s: panel_stream(s, "u", "t", "x", k, ["id"], "1 day")).collect()}
    w = Window.partitionBy("u").orderBy("t", "id")
    want = spark.createDataFrame(rows, SCHEMA).withColumns({"near": F.lag("x", k).over(w), "n": F.row_number().over(w)}).collect()
    assert len(want) == len(rows) and set(got) == {r[3] for r in rows}
    for r in want:
        one = got[r["id"]]
        assert (one["u"], one["t"], one["x"], one["lag"], one["structural"], one["late"]) == (r["u"], r["t"], r["x"], r["near"], r["n"] <= k, False)
        both = None not in (r["x"], r["near"])
        assert one["difference"] == (r["x"] - r["near"] if both else None)
        assert one["growth"] == ((r["x"] - r["near"]) / r["near"] if both and r["near"] else None)


def test_units_share_states(spark, tmp_path, monkeypatch):
    """Of more units than buckets each keeps its own rows, and there are no more states than buckets."""
    from panelkit.streaming import panel

    monkeypatch.setattr(panel, "BUCKETS", 3)
    rows = [(f"u{i % 40}", START + datetime.timedelta(minutes=i), float(i), i) for i in range(200)]
    got = {r["id"]: r for r in _run(spark, tmp_path, [rows[120:], rows[:120]], lambda s: panel_stream(s, "u", "t", "x", 2, ["id"], "1 day")).collect()}
    assert [(got[i]["lag"], got[i]["structural"]) for i in range(200)] == [(float(i - 80), False) if i >= 80 else (None, True) for i in range(200)]
    q = panel_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*")), "u", "t", "x", 2, ["id"], "1 day").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 3


def test_late_rows_leave_marked_and_move_nothing(spark, tmp_path):
    hour = datetime.timedelta(hours=1)
    first = [("a", START + i * hour, float(i), i) for i in range(5)] + [("b", START + 50 * hour, 1.0, 90)]
    second = [("a", START + hour / 2, 99.0, 50), ("c", START, 7.0, 60), ("a", START + 60 * hour, 5.0, 5), (None, START, 1.0, 70), ("a", None, 2.0, 71)]
    got = {r["id"]: r for r in _run(spark, tmp_path, [first, second], lambda s: panel_stream(s, "u", "t", "x", 1, ["id"], "1 hour")).collect()}
    assert set(got) == {*range(5), 90, 50, 60, 5, 70, 71}  # no row vanishes
    assert {i for i, r in got.items() if r["late"]} == {50, 70, 71} and got[50]["lag"] is None
    assert got[60]["structural"] and [got[i]["lag"] for i in range(6)] == [None, 0.0, 1.0, 2.0, 3.0, 4.0]


def test_shares_of_windows(spark, tmp_path):
    rows = _rows(4)
    got = {r["start"]: (r["count"], r["rows"], r["share"]) for r in _run(spark, tmp_path, [rows[60:], rows[:60]], lambda s: share_stream(s, "t", F.col("x") > 0, "30 minutes", "1 day")).collect()}
    want = {}
    for _, t, x, _ in rows:
        start = t.replace(minute=t.minute // 30 * 30)
        n, m = want.get(start, (0, 0))
        want[start] = n + (x is not None and x > 0), m + 1
    assert got == {s: (n, m, n / m) for s, (n, m) in want.items()}
