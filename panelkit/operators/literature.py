"""The search workflow: sources to one log of records, groups and verified states; its checks and comparisons."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators import linkage
from panelkit.operators.linkage import EMPTY, FAILED, SUCCESS
from panelkit.plans.canonical import content_hash
from panelkit.sources import works

#: By source: how to ask it, the schema of its items, how to map them. Fixed values.
SOURCES = {
    "crossref": (works.search_crossref, works.CROSSREF_ITEM, works.map_crossref),
    "openalex": (works.search_openalex, works.OPENALEX_ITEM, works.map_openalex),
}
STATES = ("verified", "partially_verified", "conflicting", "unresolved")
#: How many results a request wants of a source, unless it says so.
MAX_RESULTS = 20
_LISTS = ("candidates", "normalized", "dedupe_groups", "verification")


def request_errors(request: dict) -> list[str]:
    out = [] if isinstance(request.get("search_scope"), str) and request["search_scope"] else ["search_scope is required"]
    queries, sources = request.get("query_strings"), request.get("requested_sources")
    if not (isinstance(queries, list) and queries and all(isinstance(q, str) and q.strip() for q in queries)):
        out.append("query_strings: a filled list of texts is needed")
    if not (isinstance(sources, list) and sources and all(s in SOURCES for s in sources)):
        out.append(f"requested_sources: only {', '.join(SOURCES)} are supported, one at least")
    most = request.get("max_results", MAX_RESULTS)
    if not (isinstance(most, int) and most > 0):
        out.append("max_results: a positive integer is needed")
    return out


def union_records(frames: list[DataFrame]) -> DataFrame:
    """All sources' records: columns by name, what a source lacks is missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _rows(df: DataFrame, order: str) -> list[dict]:
    """A result set's rows, bounded by what the request asked for."""
    return [json.loads(r["j"]) for r in df.orderBy(order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()]


def run_search(spark: SparkSession, request: dict, fetchers: dict[str, Callable]) -> dict:
    """The search log: the same whatever the order of sources and of their answers."""
    if errors := request_errors(request):
        raise ValueError("; ".join(errors))
    sources, most = request["requested_sources"], request.get("max_results", MAX_RESULTS)
    asked, frames = [], []
    for name in sources:
        ask, schema, mapped = SOURCES[name]
        got = ask(request["query_strings"][0], fetchers[name], most)
        asked.append({k: got[k] for k in ("source", "status", "error_category", "request_identity", "result_count")})
        items = spark.createDataFrame([(json.dumps(x),) for x in got["items"]], "j string")
        frames.append(mapped(items.select(F.from_json("j", schema).alias("i")).select("i.*")))
    found = union_records(frames)
    # Titles as they were supplied make the ids; normalized ones are only compared.
    records = linkage.normalize_records(found)
    groups = linkage.numbered(linkage.verified(linkage.groups(records)))
    default = content_hash("|".join((request["search_scope"], "\x01".join(request["query_strings"]), ",".join(sorted(sources)))), "raw")[:12]
    return {
        "schema_version": "1.0",
        "request": {"request_id": request.get("request_id", f"req_{default}"), "search_scope": request["search_scope"], "query_strings": request["query_strings"], "requested_sources": sorted(sources), "max_results": most},
        "source_executions": sorted(asked, key=lambda x: x["source"]),
        "candidates": _rows(records.select("record_id", "source", "source_id", "display_title", F.col("doi_original").alias("doi_supplied")), "record_id"),
        "normalized": _rows(records, "record_id"),
        "dedupe_groups": _rows(groups.select("group_id", "record_ids", "decision", "rule", "member_count"), "group_id"),
        "verification": _rows(groups.select("group_id", "state", "reason_codes", "evidence"), "group_id"),
        "workflow_status": linkage.workflow_status(spark.createDataFrame([(x["status"],) for x in asked], "status string")).first()["workflow_status"],
    }


def log_errors(log) -> list[str]:
    """The shape of a search log, and its closed vocabularies."""
    if not isinstance(log, dict):
        return ["an object is needed"]
    asked = log.get("request") or {}
    out = [] if log.get("schema_version") == "1.0" else ["schema_version must be 1.0"]
    out += [f"request.{f} is required" for f in ("search_scope", "query_strings", "requested_sources") if not asked.get(f)]
    out += [f"{f}: a list is needed" for f in ("source_executions", *_LISTS) if not isinstance(log.get(f), list)]
    out += [f"source status {x.get('status')!r}" for x in log.get("source_executions") or [] if x.get("status") not in (SUCCESS, EMPTY, *FAILED)]
    return out + [f"verification state {x.get('state')!r}" for x in log.get("verification") or [] if x.get("state") not in STATES]


def log_hash(log: dict) -> str:
    """The digest of a log's content; what differs from run to run (execution_metadata) isn't part of it."""
    body = log.get("canonical", log)
    return content_hash({k: v for k, v in body.items() if k != "execution_metadata"})


def provenance(log: dict, implementation_id: str) -> dict:
    """What an execution record binds of a log."""
    return {"literature_search_log_sha256": log_hash(log), "implementation_id": implementation_id, "source_statuses": [{"source": x["source"], "status": x["status"]} for x in log["source_executions"]]}


def broken_integrity(record: dict, log: dict, study: dict) -> list[str]:
    """Which bindings between an execution record, its log and the study don't hold."""
    bound, asked, wanted = record.get("provenance") or {}, log.get("request") or {}, study.get("search_request") or {}
    told = lambda xs: sorted((x["source"], x["status"]) for x in xs or [])
    implementation = (record.get("resolved") or {}).get("implementation_id")
    checks = (
        ("canonical_log_hash_mismatch", bound.get("literature_search_log_sha256") == log_hash(log)),
        ("search_scope_binding_mismatch", bool(asked) and asked.get("search_scope") == (study.get("decisions") or {}).get("search_scope")),
        ("query_binding_mismatch", (asked.get("query_strings") or []) == (wanted.get("query_strings") or [])),
        ("requested_sources_binding_mismatch", sorted(asked.get("requested_sources") or []) == sorted(wanted.get("requested_sources") or [])),
        ("implementation_binding_missing", bool(implementation)),
        ("implementation_binding_mismatch", not implementation or bound.get("implementation_id") == implementation),
        ("source_statuses_binding_mismatch", told(log.get("source_executions")) == told(bound.get("source_statuses"))),
    )
    return [name for name, holds in checks if not holds]


def rerun_diff(a: dict, b: dict) -> list[str]:
    """What differs between two runs' logs, coarsely: ids, groups with their DOIs, states, source ids."""

    def groups(log: dict) -> list:
        doi = {x["record_id"]: x.get("canonical_doi") for x in log["normalized"]}
        return [(g["group_id"], g["decision"], len(g["record_ids"]), sorted(doi[r] for r in g["record_ids"] if doi.get(r))) for g in log["dedupe_groups"]]

    views = {
        "canonical_sha256_differs": log_hash,
        "record_ids_differ": lambda x: sorted(c["record_id"] for c in x["candidates"]),
        "dedupe_groups_differ": groups,
        "verification_differ": lambda x: [(v["group_id"], v["state"], v["reason_codes"]) for v in x["verification"]],
        "source_ids_differ": lambda x: sorted(f"{c['source']}:{c['source_id']}" for c in x["candidates"]),
    }
    return [name for name, view in views.items() if view(a) != view(b)]


def state_counts(verified: DataFrame) -> DataFrame:
    """(state, n) of a search's groups."""
    return verified.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
