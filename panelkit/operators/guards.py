"""Fail-closed guards: counts of violations, in an aggregate of their own or observed while the output is written."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class PlanFailure(Exception):
    """A plan stopped at an op: nothing is written, nothing repaired."""

    def __init__(self, op: int, kind: str, reason: str, count: int | None = None):
        super().__init__(f"op {op} ({kind}): {reason}" + (f" ({count} rows)" if count is not None else ""))
        self.op, self.kind, self.reason, self.count = op, kind, reason, count
        #: The entries of the ops up to the one that failed.
        self.log: list[dict] = []


@dataclass
class Run:
    """The working frame, the guards that wait for the next action, and the log.

    mode: ``eager`` evaluates what waits in an aggregate of its own and stops at the first failing op;
    ``observed`` lets the write of the output count it on the way, see ``reported``; ``silent`` counts nothing.
    """

    df: DataFrame
    log: list[dict] = field(default_factory=list)
    waiting: list[tuple[str, int, str, str]] = field(default_factory=list)
    counted: list[tuple[str, dict, str]] = field(default_factory=list)
    #: By op: the values to list if it fails (code).
    examples: dict[int, DataFrame] = field(default_factory=dict)
    mode: str = "eager"
    #: Observed: (observation, guards, facts) from the source on, and what follows from the facts.
    points: list[tuple[Observation, list, list]] = field(default_factory=list)
    then: list[Callable[[], None]] = field(default_factory=list)

    @contextmanager
    def logged(self):
        """A failure carries the log along: it says which op failed and why, and nothing is written.

        An error of the engine itself becomes a failure of the op that ran.
        """
        try:
            yield
        except PlanFailure as e:
            failed = e
        except PySparkException as e:
            failed = PlanFailure(len(self.log) - 1, self.log[-1]["kind"] if self.log else "plan", f"exception: {e}"[:500])
        else:
            return
        failed.log = [{**x, "status": "fail", "reason": failed.reason, "count": failed.count} if x["op"] == failed.op else x for x in self.log if x["op"] <= failed.op]
        raise failed

    def guard(self, op: int, kind: str, reason: str, violated: Column) -> None:
        """Rows for which ``violated`` is true are counted at the next flush; any fails the plan."""
        if self.mode == "silent":
            return
        name = f"_guard{len(self.waiting)}"
        self.waiting.append((name, op, kind, reason))
        self.df = self.df.withColumn(name, F.coalesce(violated, F.lit(False)).cast("long"))

    def count(self, entry: dict, key: str, true: Column) -> None:
        """A fact for the log, counted with the guards."""
        if self.mode == "silent":
            return
        name = f"_fact{len(self.counted)}"
        self.counted.append((name, entry, key))
        self.df = self.df.withColumn(name, F.coalesce(true, F.lit(False)).cast("long"))

    def flush(self) -> None:
        """Evaluate what waits in one aggregate; report the first failing op in plan order."""
        names = [w[0] for w in self.waiting] + [c[0] for c in self.counted]
        if not names:
            return
        sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
        if self.mode == "observed":
            point = Observation(uuid.uuid4().hex)
            self.points.append((point, self.waiting, self.counted))
            self.df = self.df.observe(point, *sums).drop(*names)
        else:
            found = self.df.agg(*sums).first()
            for name, op, kind, reason in self.waiting:
                if found[name]:
                    codes = [r["code"] for r in self.examples[op].collect()] if op in self.examples else []
                    raise PlanFailure(op, kind, reason + (f": {codes}" if codes else ""), found[name])
            for name, entry, key in self.counted:
                entry[key] = found[name]
            self.df = self.df.drop(*names)
        self.waiting, self.counted = [], []

    def reported(self, seconds: float = 20.0) -> bool:
        """Once the observed frame is written: the facts go to the log. False if a guard counted anything.

        Also False if a count didn't come, as that of a side that a join with nothing made needless. A task that is
        run again is counted again: a guard's zero is exact, facts may then be too high.
        """
        until = time.monotonic() + seconds
        for point, waiting, counted in self.points:
            while not point._jo.future().isCompleted():
                if time.monotonic() > until:
                    return False
                time.sleep(0.01)
            try:
                found = point.get
            except Py4JJavaError:  # completed without counts
                return False
            if any(found[name] for name, *_ in waiting):
                return False
            for name, entry, key in counted:
                entry[key] = found[name]
        for step in self.then:
            step()
        return True


def duplicate_rows(df: DataFrame, keys: list[str]) -> int:
    """Rows beyond the first of each key; missing keys compare equal."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")).first()["d"]
