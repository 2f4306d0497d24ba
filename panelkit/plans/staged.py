"""Plans in one pass: guards are counted while the output is written, and it is published only if they count nothing.

The source is read once. The output goes to a staging folder beside its place, with the guards' and facts' sums
observed on the way (``DataFrame.observe``), and takes its place by a rename. If a guard counted anything, the
staging folder is removed and the plan is run again with a guard at a time, so that the failure names the first
failing op and its exact count. What an aggregate over groups decides is read apart, and only its columns: the originals
of normalized keys. Windows that number join keys share the join's exchange.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelkit.operators import construct as constructing
from panelkit.operators import harmonize as harmonizing
from panelkit.operators.guards import PlanFailure, Run
from panelkit.operators.lineage import checkpoint_folder
from panelkit.plans.validate import construct_errors, harmonize_errors


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def publish(spark: SparkSession, staging: str, path: str) -> None:
    """Rename; FileExistsError if the place was taken meanwhile."""
    fs, place = _fs(spark, path)
    if fs.exists(place) or not fs.rename(_fs(spark, staging)[1], place):
        raise FileExistsError(path)


def _observed(plan: dict, frames: dict[str, DataFrame] | DataFrame) -> Run:
    """The plan's frame with its counts attached; no job has run but for normalized keys."""
    many = isinstance(frames, dict)
    if errors := harmonize_errors(plan) if many else construct_errors(plan, frames.columns):
        raise ValueError("; ".join(errors))
    source = frames[plan["inputs"][0]["input_id"]] if many else frames
    run, checked = Run(source, mode="observed"), set()
    with run.logged():
        for at, op in enumerate(plan["operations"]):
            if not many:
                constructing.apply(run, op, plan, at, checked)
                continue
            if op["kind"] == "normalize_key":
                bare = Run(source, mode="silent")
                for before, earlier in enumerate(plan["operations"][:at]):
                    harmonizing.apply(bare, frames, earlier, before)
                if op["column"] in bare.df.columns and (n := harmonizing.key_collisions(bare.df, op)):
                    run.log.append({"op": at, "kind": op["kind"]})
                    raise PlanFailure(at, op["kind"], "normalized keys collide", n)
            harmonizing.apply(run, frames, op, at)
        run.flush()
    return run


def staged(plan: dict, frames: dict[str, DataFrame] | DataFrame, folder: str) -> tuple[DataFrame, list[dict]]:
    """Write a plan's guarded output to ``folder`` (which must not exist); the frame read from there, and the log.

    Raises PlanFailure (nothing remains in ``folder``) or ValueError.
    """
    eager = harmonizing.harmonize if isinstance(frames, dict) else constructing.construct
    try:
        run = _observed(plan, frames)
    except PlanFailure:
        eager(plan, frames)  # an op before it may fail
        raise
    spark = run.df.sparkSession
    with run.logged():
        try:
            harmonizing.finish(run.df).write.parquet(folder)
        except BaseException:
            remove(spark, folder)
            raise
    log = run.log
    if not run.reported():
        remove(spark, folder)
        made, log = eager(plan, frames)
        made.write.parquet(folder)
    constructing.propagated(log)
    return harmonizing.integral(spark.read.parquet(folder), log), log


def run_staged(plan: dict, frames: dict[str, DataFrame] | DataFrame) -> tuple[DataFrame, list[dict]]:
    """``staged`` in a folder of its own, in the shared checkpoint folder."""
    spark = (next(iter(frames.values())) if isinstance(frames, dict) else frames).sparkSession
    checkpoint_folder(spark)
    return staged(plan, frames, os.path.join(spark.sparkContext.getCheckpointDir(), f"plan-{uuid.uuid4().hex}"))
