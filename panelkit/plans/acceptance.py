"""Runs of plans with their logs, and the record that binds data to the plans, logs and rules that made it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from panelkit.operators.construct import construct
from panelkit.operators.guards import PlanFailure
from panelkit.operators.harmonize import harmonize
from panelkit.plans.canonical import content_hash
from panelkit.plans.staged import publish, remove, staged
from panelkit.sources.tables import write_log, write_table


def execute(plan: dict, frames: dict[str, DataFrame] | DataFrame, out_path: str | None = None, log_path: str | None = None, fmt: str = "parquet") -> tuple[DataFrame | None, dict]:
    """Run a harmonize plan (a dict of frames) or a construct plan (a frame). The log is written either way.

    A plan that fails has no output: nothing is written but the log, which names the op and the reason. With
    ``out_path`` the guards are counted while the output is written, see ``plans/staged.py``; a sorted output, a CSV and
    columns that turn out integral are written from the staged rows.
    """
    many = isinstance(frames, dict)
    log = {"plan_id": plan.get("plan_id"), "plan_sha256": content_hash(plan), "operations": [], "warnings": [], "errors": [], "overall": "completed"}
    made, staging = None, f"{out_path.rstrip('/')}.staging-{uuid.uuid4().hex}" if out_path is not None else None
    try:
        if staging is None:
            made, log["operations"] = harmonize(plan, frames) if many else construct(plan, frames)
        else:
            made, log["operations"] = staged(plan, frames, staging)
    except PlanFailure as e:
        log |= {"operations": e.log, "errors": [{"op": e.op, "kind": e.kind, "reason": e.reason, "count": e.count}], "overall": "failed"}
    except ValueError as e:
        log |= {"errors": [{"reason": str(e)}], "overall": "failed"}
    log["operations"] = [{"status": "ok", **x} for x in log["operations"]]
    log["warnings"] = [{"op": x["op"], "warning": x["warning"]} for x in log["operations"] if "warning" in x]
    if made is not None:
        log["cols_after"] = len(made.columns)
        if staging is not None:
            spark, sort_by = made.sparkSession, [k for k in plan.get("output", {}).get("sort_by", []) if k in made.columns]
            if sort_by or fmt != "parquet" or made.dtypes != spark.read.parquet(staging).dtypes:
                try:
                    write_table(made, out_path, sort_by, fmt)
                finally:
                    remove(spark, staging)
            else:
                publish(spark, staging, out_path)
            made = spark.read.parquet(out_path) if fmt == "parquet" else spark.read.csv(out_path, header=True, schema=made.schema)
    if log_path is not None:
        write_log(log, log_path)
    return made, log


#: Bindings of a data-acceptance record: name, place in the record, how it is hashed. Fixed values.
BINDINGS = (
    ("source_variant", "source_variant_sha256", "raw"),
    ("harmonized", "harmonize.harmonized_sha256", "raw"),
    ("harmonize_plan", "harmonize.plan_hash", "canonical_json"),
    ("harmonize_log", "harmonize.execution_log_sha256", "lf_text"),
    ("constructed", "construct.constructed_sha256", "raw"),
    ("construct_plan", "construct.plan_hash", "canonical_json"),
    ("construct_log", "construct.execution_log_sha256", "lf_text"),
    ("validation", "validation.result_sha256", "lf_text"),
    ("rules", "validation.rules_sha256", "lf_text"),
)
#: What a broken binding is called. Fixed values.
MISMATCH = (
    "source_variant_sha256_mismatch", "harmonized_sha256_mismatch", "harmonize_plan_hash_mismatch", "harmonize_evidence_mismatch", "constructed_sha256_mismatch",
    "construct_plan_hash_mismatch", "construct_evidence_mismatch", "validation_result_mismatch", "rules_sha256_mismatch",
)


def accept(study: dict, chain: dict, summary: dict, rules_id: str) -> dict:
    """The record of accepted data. ``chain``: the nine contents by name; nothing is timed, so runs agree."""
    record: dict = {"study_id": study.get("study_id"), "run_id": content_hash(chain["construct_log"], "lf_text")[:16], "accepted": True, "timestamp": None}
    for name, place, mode in BINDINGS:
        *above, last = place.split(".")
        at = record
        for k in above:
            at = at.setdefault(k, {})
        at[last] = content_hash(chain[name], mode)
    record["validation"] |= {"rules_id": rules_id, "summary": summary}
    return record


def broken_bindings(record: dict, read: Callable[[str], object]) -> list[str]:
    """Which bindings no longer hold. ``read`` gives a content by name, None where it isn't checked."""
    out = []
    for (name, place, mode), told in zip(BINDINGS, MISMATCH):
        content, want = read(name), record
        for k in place.split("."):
            want = (want or {}).get(k)
        if content is not None and content_hash(content, mode) != want:
            out.append(told)
    return out
