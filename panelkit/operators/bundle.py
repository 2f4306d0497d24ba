"""Artifact bundles: load, write, validate as a whole, and render what is valid.

A bundle is a set of documents. Their headers are control data; their lists of items (models, estimates, ...) are
DataFrames, so that ids, references and numbers are checked by aggregates and anti-joins whatever their size.
``problems`` gives one row a defect: (check, artifact, item, detail). Nothing is repaired.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.operators import artifacts
from panelkit.plans.canonical import canonical_json, content_hash

#: By artifact: its list of items, their id, the fields that each item needs. Fixed values.
ITEMS = {
    "variable_dictionary": ("variables", "name", ("name", "definition")),
    "sample_flow": ("steps", "step_id", ("step_id", "n_before", "n_after", "n_removed", "reason")),
    "descriptive_facts": ("facts", "fact_id", ()),
    "model_registry": ("models", "model_id", ("model_id", "capability_id", "implementation_id", "runtime", "sample_id", "outcome", "n", "code_ref", "result_ref")),
    "estimates": ("estimates", "estimate_id", ("estimate_id", "model_id", "term", "estimate", "std_error", "ci_lower", "ci_upper", "p_value", "n")),
    "diagnostics": ("diagnostics", "diagnostic_id", ()),
    "multiple_testing": ("families", "family_id", ()),
    "presentation_manifest": ("views", "view_id", ("view_id", "view_type", "output_ref", "source_refs")),
}
#: Every artifact's own fields; the first seven artifacts must be there. Fixed values.
HEADER = ("artifact_id", "artifact_type", "schema_version", "producer_role", "producer_task_id")
NEEDED = ("data_manifest", "variable_dictionary", "sample_flow", "descriptive_facts", "model_registry", "estimates", "diagnostics")
MORE = {"data_manifest": ("dataset_id", "observation_count", "variable_count")}
#: What the lists' items hold. Fixed values.
SCHEMAS = {
    "variables": "name string, definition string",
    "steps": "step_id string, n_before double, n_after double, n_removed double, reason string",
    "facts": "fact_id string, name string, value string, unit string, sample_id string",
    "models": "model_id string, capability_id string, implementation_id string, runtime string, sample_id string, outcome string, specification string, fixed_effects array<string>, vcov_spec string, clustering string, n double, code_ref string, result_ref string",
    "estimates": "estimate_id string, model_id string, term string, estimate double, std_error double, ci_lower double, ci_upper double, p_value double, n double, multiple_testing_family_ids array<string>",
    "diagnostics": "diagnostic_id string, name string, value string, method string, model_id string",
    "families": "family_id string, member_estimate_ids array<string>, adjusted_results array<struct<estimate_id string, p_adjusted double>>",
    "views": "view_id string, view_type string, output_ref string, source_refs array<struct<artifact_id string, item_ids array<string>, source_hash string, source_hash_mode string>>",
}
#: Hash modes as documents name them. Fixed values.
MODES = {"canonical_json_sha256_v1": "canonical_json", "raw_file_sha256": "raw", "text_file_sha256_lf": "lf_text"}
CANONICAL = "canonical_json_sha256_v1"
#: The columns of the families of tables that a view can show. Fixed values.
TABLES = {
    "descriptive_facts": ("fact_id", "name", "value", "unit", "sample_id"),
    "diagnostics": ("diagnostic_id", "name", "value", "method", "model_id"),
    "estimates": ("term", "estimate", "std_error", "p_value", "n"),
    "model_registry": ("model_id", "capability_id", "implementation_id", "runtime", "sample_id", "outcome", "specification", "fixed_effects", "vcov_spec", "clustering", "n"),
}
#: The only keys of a presentation manifest, of its views and of their references. Fixed values.
PRESENTATION_KEYS = (*HEADER, "created_at", "inputs", "code_ref", "data_ref", "views")
VIEW_KEYS = ("view_id", "view_type", "output_ref", "source_refs")
REFERENCE_KEYS = ("artifact_id", "item_ids", "source_hash", "source_hash_mode")
PROBLEM = "check string, artifact string, item string, detail string"


@dataclass
class Bundle:
    spark: SparkSession
    #: By artifact: the document without its list of items.
    headers: dict[str, dict] = field(default_factory=dict)
    #: By artifact: its items, numbered by ``at``.
    items: dict[str, DataFrame] = field(default_factory=dict)
    #: By artifact: the digest of the whole document.
    digests: dict[str, str] = field(default_factory=dict)
    #: The presentation manifest's views as they stand, (at, j): a schema drops what it doesn't name.
    views: DataFrame | None = None


def bundle_of(spark: SparkSession, documents: dict[str, dict]) -> Bundle:
    """A bundle from its documents; absent ones are None or left out."""
    out = Bundle(spark)
    for name, doc in documents.items():
        if doc is None:
            continue
        out.digests[name] = content_hash(doc)
        key = ITEMS[name][0] if name in ITEMS else None
        out.headers[name] = {k: v for k, v in doc.items() if k != key}
        if key and isinstance(doc.get(key), list):
            rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(doc[key])], "at int, j string")
            if name == "presentation_manifest":
                out.views = rows
            out.items[name] = rows.select("at", F.from_json("j", SCHEMAS[key]).alias("x")).select("at", "x.*")
    return out


def read_bundle(spark: SparkSession, folder: str) -> tuple[Bundle, dict[str, dict | None]]:
    """The bundle in a folder, by Spark's own reader; unreadable documents count as absent."""
    documents: dict[str, dict | None] = {}
    for r in spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f"), "value").collect():
        try:
            documents[r["f"].removesuffix(".json")] = json.loads(r["value"])
        except ValueError:
            documents[r["f"].removesuffix(".json")] = None
    return bundle_of(spark, documents), documents


def write_bundle(documents: dict[str, dict], write: Callable[[str, str], None]) -> dict:
    """Write documents (indent 2, a line end at the end) and a manifest of their checksums; gives the manifest."""
    listed = [{"artifact_id": d.get("artifact_id"), "path": f"{n}.json", "sha256": content_hash(d), "hash_mode": CANONICAL} for n, d in sorted(documents.items())]
    manifest = {"artifact_type": "artifact_manifest", "artifacts": listed}
    for name, doc in {**documents, "artifact_manifest": manifest}.items():
        write(f"{name}.json", json.dumps(doc, indent=2, ensure_ascii=False) + "\n")
    return manifest


def artifact(kind: str, artifact_id: str, role: str, task: str, items: list[dict] = (), inputs: list[str] = (), **more) -> dict:
    """A document of a bundle: the header fields, the list of items, the artifacts that it was made from."""
    key = {ITEMS[kind][0]: list(items)} if kind in ITEMS else {}
    return {"artifact_id": artifact_id, "artifact_type": kind, "schema_version": "1.0", "producer_role": role, "producer_task_id": task, "inputs": list(inputs), **more, **key}


def stamp(bundle: Bundle) -> dict:
    """The replication stamp that the registry and the estimates make: ids, sorted, and the critical numbers."""
    models, estimates = bundle.items["model_registry"], bundle.items["estimates"]
    critical = F.array_sort(F.collect_list(F.struct("estimate_id", "term", "estimate", "std_error")))
    grouped = estimates.groupBy("model_id").agg(critical.alias("c"))
    rows = models.select("model_id", "n").join(grouped, "model_id", "left").orderBy("model_id").collect()
    parts = [{"model_id": r["model_id"], "n": r["n"], "estimate_ids": [c["estimate_id"] for c in r["c"] or []], "critical_estimates": [c.asDict() for c in r["c"] or []]} for r in rows]
    ids = [r["estimate_id"] for r in estimates.select("estimate_id").orderBy("estimate_id").collect()]
    hashes = {n: bundle.digests[n] for n in ("model_registry", "estimates", "diagnostics") if n in bundle.digests}
    return {"schema_version": "1.0", "model_count": len(rows), "estimate_count": len(ids), "model_ids": [r["model_id"] for r in rows], "estimate_ids": ids, "models": parts, "source_hashes": hashes, "source_hash_mode": CANONICAL}


def _told(df: DataFrame, check: str, artifact: str, item: Column | str, detail: Column | str) -> DataFrame:
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    return df.select(F.lit(check).alias("check"), F.lit(artifact).alias("artifact"), c(item).alias("item"), c(detail).alias("detail"))


def _header_problems(b: Bundle, read: Callable[[str], bytes | None] | None) -> list[tuple]:
    """Fields, types, references between documents, checksums and freshness: one look at each header."""
    out: list[tuple] = [("missing_artifact", n, None, None) for n in NEEDED if n not in b.headers]
    for name, h in b.headers.items():
        if name in NEEDED or name == "presentation_manifest":
            out += [("missing_field", name, f, None) for f in (*HEADER, *MORE.get(name, ())) if f not in h]
        if name in ITEMS and name not in b.items:
            out.append(("missing_field", name, ITEMS[name][0], None))
        if name not in ("replication_stamp", "artifact_manifest") and h.get("artifact_type") != name:
            out.append(("artifact_type", name, None, str(h.get("artifact_type"))))
    ids = {h.get("artifact_id") for n, h in b.headers.items() if n in NEEDED}
    out += [("unknown_input", n, str(x), None) for n, h in b.headers.items() if n in NEEDED for x in h.get("inputs") or [] if x not in ids]
    for a in b.headers.get("artifact_manifest", {}).get("artifacts") or []:
        name = str(a.get("path", "")).replace(".json", "")
        if name not in b.digests:
            out.append(("manifest_file", "artifact_manifest", str(a.get("path") or a.get("artifact_id")), None))
        elif a.get("hash_mode") not in (CANONICAL, "raw_file_sha256"):
            out.append(("manifest_hash_mode", "artifact_manifest", a["path"], a.get("hash_mode")))
        else:
            raw = read(a["path"]) if a["hash_mode"] != CANONICAL and read else None
            actual = b.digests[name] if a["hash_mode"] == CANONICAL else raw and content_hash(raw, "raw")
            if a.get("sha256") and actual != a["sha256"]:
                out.append(("manifest_checksum", "artifact_manifest", a["path"], actual))
    data = b.headers.get("data_manifest", {})
    if data.get("dataset_sha256"):  # freshness is checked where a source is declared
        out += [("data_source", "data_manifest", f, None) for f in ("dataset_hash_mode", "data_path") if not data.get(f)]
        mode = MODES.get(data.get("dataset_hash_mode"))
        if data.get("dataset_hash_mode") and not mode:
            out.append(("data_source", "data_manifest", "dataset_hash_mode", data["dataset_hash_mode"]))
        if mode and data.get("data_path") and read:
            raw = read(data["data_path"])
            if raw is None:
                out.append(("data_source", "data_manifest", data["data_path"], "not there"))
            elif content_hash(json.loads(raw) if mode == "canonical_json" else raw, mode) != data["dataset_sha256"]:
                out.append(("data_stale", "data_manifest", data["data_path"], None))
    return out


def _list_problems(b: Bundle) -> list[DataFrame]:
    """Ids, references, numbers: aggregates and anti-joins over the lists."""
    out, at = [], b.items
    for name, df in at.items():
        key, needed = ITEMS[name][1], ITEMS[name][2]
        gaps = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in (*needed, *([key] if key not in needed else []))]))
        out.append(_told(df.select(key, F.explode(gaps).alias("f")), "missing_field", name, key, "f"))
        out.append(_told(artifacts.duplicate_ids(df.where(F.col(key).isNotNull()), key), "repeated_id", name, key, "n"))
    models, estimates = at.get("model_registry"), at.get("estimates")
    if models is not None:
        for name in ("estimates", "diagnostics"):
            if name in at:
                out.append(_told(artifacts.orphans(at[name], models, "model_id", "model_id"), "unknown_model", name, ITEMS[name][1], "model_id"))
    if estimates is not None:
        if models is not None:
            sizes = models.groupBy("model_id").agg(F.max("n").alias("model_n"))
            unlike = estimates.join(sizes, "model_id").where(~F.col("n").eqNullSafe(F.col("model_n")))
            out.append(_told(unlike, "sample_size", "estimates", "estimate_id", F.concat_ws(" <> ", "n", "model_n")))
        sane = artifacts.numeric_problems(F.col("estimate"), F.col("ci_lower"), F.col("ci_upper"), F.col("p_value"))
        sane = F.coalesce(F.when(~artifacts.finite(F.col("std_error")), "not_finite"), sane)
        out.append(_told(estimates.withColumn("p", sane).where("p is not null"), "number", "estimates", "estimate_id", "p"))
    if "sample_flow" in at:
        steps = at["sample_flow"].withColumn("all", F.lit(1))
        whole = reduce(lambda a, c: a | (F.col(c) % 1 != 0), ("n_before", "n_after", "n_removed"), F.lit(False))
        out.append(_told(steps.where(whole), "sample_flow", "sample_flow", "step_id", F.lit("not whole")))
        out.append(_told(artifacts.broken_flow(steps, "at", "all"), "sample_flow", "sample_flow", "step_id", F.lit("does not add up")))
        n = b.headers.get("data_manifest", {}).get("observation_count")
        final = steps.orderBy(F.desc("at")).limit(1).where(~F.col("n_after").eqNullSafe(F.lit(n).cast("double")))
        out.append(_told(final, "sample_flow", "sample_flow", "step_id", F.lit("does not end at the observation count")))
    if "multiple_testing" in at and estimates is not None:
        out += _family_problems(at["multiple_testing"], estimates)
    return out


def _family_problems(families: DataFrame, estimates: DataFrame) -> list[DataFrame]:
    """Families cover their members, members exist, and whoever claims a family is covered by it."""
    members = families.select("family_id", F.explode("member_estimate_ids").alias("estimate_id"))
    covered = families.select("family_id", F.explode("adjusted_results.estimate_id").alias("estimate_id")).distinct()
    claims = estimates.select(F.explode("multiple_testing_family_ids").alias("family_id"), "estimate_id").distinct()
    both, named = ["family_id", "estimate_id"], claims.join(families.select("family_id"), "family_id", "left_semi")
    found = (
        ("repeated_member", members.groupBy(*both).count().where("count > 1")),
        ("unknown_member", members.join(estimates.select("estimate_id"), "estimate_id", "left_anti")),
        ("unknown_family", claims.join(families.select("family_id"), "family_id", "left_anti")),
        ("estimate_not_a_member", named.join(members, both, "left_anti")),
        ("not_adjusted", members.distinct().unionByName(named).distinct().join(covered, both, "left_anti")),
    )
    return [_told(df, check, "multiple_testing", "family_id", "estimate_id") for check, df in found]


def _key_problems(views: DataFrame) -> list[DataFrame]:
    """Keys that a view or a reference may not have: a view binds numbers, it holds none."""
    view = F.get_json_object("j", "$.view_id")
    extra = lambda held, keys: F.explode(F.array_except(F.coalesce(F.json_object_keys(held), F.array().cast("array<string>")), F.array(*map(F.lit, keys))))
    own = views.select(view.alias("view_id"), extra(F.col("j"), VIEW_KEYS).alias("key"))
    refs = views.select(view.alias("view_id"), F.explode(F.from_json(F.get_json_object("j", "$.source_refs"), "array<string>")).alias("r"))
    theirs = refs.select("view_id", extra(F.col("r"), REFERENCE_KEYS).alias("key"))
    return [_told(df, check, "presentation_manifest", "view_id", "key") for check, df in (("view_key", own), ("reference_key", theirs))]


def _view_problems(b: Bundle) -> list[DataFrame]:
    """Views bind to documents that exist, as they are now, and to items that they hold, and have no keys of their own."""
    views = b.items.get("presentation_manifest")
    if views is None:
        return []
    strange = [("presentation_key", "presentation_manifest", k, None) for k in b.headers.get("presentation_manifest", {}) if k not in PRESENTATION_KEYS]
    known = [(h.get("artifact_id"), n, b.digests[n], n in ITEMS and n not in ("multiple_testing", "presentation_manifest", "variable_dictionary", "sample_flow")) for n, h in b.headers.items() if n in (*NEEDED, "presentation_manifest") and h.get("artifact_id")]
    known = b.spark.createDataFrame(known, "artifact_id string, type string, digest string, listed boolean")
    refs = views.select("view_id", F.explode("source_refs").alias("r")).select("view_id", "r.*")
    bound = refs.join(known, "artifact_id", "left")
    item = F.col("artifact_id")
    checks = (
        (F.col("type").isNull(), "view_unknown_artifact"),
        (F.col("type") == "presentation_manifest", "view_of_a_view"),
        (F.col("source_hash_mode").isNull() | F.col("source_hash").isNull(), "view_unbound"),
        (F.col("source_hash_mode") != CANONICAL, "view_hash_mode"),
        ((F.col("source_hash_mode") == CANONICAL) & (F.col("source_hash") != F.col("digest")), "view_stale"),
        (F.col("item_ids").isNotNull() & ~F.col("listed"), "view_items_unsupported"),
    )
    out = [_told(bound.where(F.coalesce(c, F.lit(False))), name, "presentation_manifest", "view_id", item) for c, name in checks]
    out += [b.spark.createDataFrame(strange, PROBLEM), *(_key_problems(b.views) if b.views is not None else [])]
    out.append(_told(views.where(F.coalesce(F.size("source_refs"), F.lit(0)) < 1), "view_unbound", "presentation_manifest", "view_id", F.lit(None)))
    out.append(_told(views.where(~F.col("view_type").isin("table", "figure")), "view_type", "presentation_manifest", "view_id", "view_type"))
    lists = [df.select(F.lit(b.headers[n].get("artifact_id")).alias("artifact_id"), F.col(ITEMS[n][1]).alias("item_id")) for n, df in b.items.items() if n in ("model_registry", "estimates", "diagnostics", "descriptive_facts")]
    if lists:
        held = reduce(DataFrame.unionByName, lists)
        named = refs.join(known.where("listed").select("artifact_id"), "artifact_id", "left_semi").where("item_ids is not null")
        out.append(_told(artifacts.reference_orphans(named.groupBy("view_id").agg(F.collect_list(F.struct("artifact_id", "item_ids")).alias("source_refs")), held), "view_unknown_item", "presentation_manifest", "view_id", "item_id"))
    return out


def item_problems(b: Bundle) -> DataFrame:
    """What is wrong with the lists alone."""
    return reduce(DataFrame.unionByName, _list_problems(b))


def view_problems(b: Bundle) -> DataFrame:
    """What is wrong with the views alone."""
    return reduce(DataFrame.unionByName, _view_problems(b))


def problems(b: Bundle, read: Callable[[str], bytes | None] | None = None) -> DataFrame:
    """(check, artifact, item, detail), a row a defect; empty if the bundle is valid.

    ``read`` gives a file's bytes by its path in the bundle, None if it isn't there; without it files aren't looked at.
    """
    told = _header_problems(b, read)
    made = b.headers.get("replication_stamp")
    if made is None:
        told.append(("missing_artifact", "replication_stamp", None, None))
    elif {"model_registry", "estimates"} <= b.items.keys() and not told and canonical_json(stamp(b)) != canonical_json(made):
        told.append(("stamp", "replication_stamp", None, "is not what the registry and the estimates make"))
    frames = [b.spark.createDataFrame(told, PROBLEM), *_list_problems(b), *_view_problems(b)]
    return reduce(DataFrame.unionByName, frames)


def table_rows(b: Bundle, family: str, view_id: str | None = None) -> list[dict]:
    """The rows that a view names of a family, in its order. Raises ValueError where it names none or unknown ones."""
    own = b.headers[family].get("artifact_id")
    refs = b.items["presentation_manifest"].where("view_type = 'table'").select("at", "view_id", F.posexplode("source_refs").alias("k", "r")).where(F.col("r.artifact_id") == own)
    refs = refs.where(F.col("view_id") == view_id) if view_id else refs
    first = refs.withColumn("first", F.min("at").over(Window.partitionBy(F.lit(1)))).where("at = first")
    ids = first.select("k", F.posexplode("r.item_ids").alias("pos", ITEMS[family][1]))
    rows = ids.join(b.items[family], ITEMS[family][1], "left").orderBy("k", "pos").collect()
    if not rows or any(r["at"] is None for r in rows):
        raise ValueError(f"no view names known items of {family}")
    return [r.asDict() for r in rows]


def render(b: Bundle, family: str, view_id: str | None = None, read=None) -> dict:
    """A family's table as Markdown, only of a bundle that is valid."""
    if family not in TABLES:
        return {"ok": False, "errors": [f"unknown family {family}"]}
    found = [" ".join(str(x) for x in r if x is not None) for r in problems(b, read).collect()]
    if found:
        return {"ok": False, "errors": found}
    try:
        rows = table_rows(b, family, view_id)
    except ValueError as e:
        return {"ok": False, "errors": [str(e)]}
    whole = [{k: int(v) if isinstance(v, float) and k == "n" and v.is_integer() else v for k, v in r.items()} for r in rows]
    return {"ok": True, "output": artifacts.markdown_table(list(TABLES[family]), whole)}
