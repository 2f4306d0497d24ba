"""Studies, searches, bundles and acceptance records: the documents around plans."""

import json

import pytest
from pyspark.sql import functions as F

from panelkit.functions import text
from panelkit.operators import bundle, literature
from panelkit.plans import acceptance, study
from panelkit.plans.canonical import content_hash

SCHEMA = {
    "type": "object", "required": ["study_id", "domain", "selected_capabilities"], "additionalProperties": False, "minProperties": 1,
    "properties": {
        "study_id": {"type": "string", "minLength": 1, "pattern": "^[a-z]+$"}, "domain": {"const": "economics"}, "tags": {"type": "array", "items": [{"type": "integer"}, {"type": ["string", "null"]}]},
        "execution_context": {"type": "object", "properties": {"mode": {"enum": ["production", "test"]}}}, "decisions": {"type": "object"}, "preconditions": {"type": "object"}, "manual_validations": {"type": "object"},
        "selected_capabilities": {"type": "object", "additionalProperties": {"type": "array", "minItems": 1, "items": {"type": "string"}}},
    },
}
CAP = {"id": "x.fe", "decision_requirements": ["cluster"], "scientific_preconditions": [{"kind": "machine", "field": "panel", "on_missing": "needs_decision"}, {"kind": "machine", "field": "other", "on_missing": "blocked"}, {"kind": "manual", "label": "read"}]}
STUDY = {"study_id": "s", "domain": "economics", "selected_capabilities": {"analyst": ["x.fe"]}}


@pytest.mark.parametrize(
    "change, codes",
    [
        ({}, []),
        ({"study_id": ""}, ["STUDY_ID_INVALID", "STUDY_ID_INVALID"]),
        ({"domain": "x"}, ["STUDY_DOMAIN_INVALID"]),
        ({"execution_context": {"mode": "y"}}, ["EXECUTION_MODE_INVALID"]),
        ({"selected_capabilities": []}, ["SELECTED_CAPABILITIES_INVALID"]),
        ({"selected_capabilities": {"a": []}}, ["SELECTED_CAPABILITIES_EMPTY"]),
        ({"selected_capabilities": {"a": [1, "gone"]}}, ["SELECTED_CAPABILITIES_INVALID", "CAPABILITY_ID_UNKNOWN"]),
        ({"decisions": 1, "preconditions": [], "manual_validations": None}, ["DECISIONS_INVALID", "PRECONDITIONS_INVALID", "MANUAL_VALIDATIONS_INVALID"]),
        ({"more": 1, "tags": [1.0, None, "any"]}, ["STUDY_SCHEMA_INVALID"]),
        ({"tags": [True]}, ["STUDY_SCHEMA_INVALID"]),
    ],
)
def test_studies_are_held_against_their_schema(change, codes):
    assert [e["code"] for e in study.study_errors({**STUDY, **change}, SCHEMA, {"x.fe": CAP})] == codes


def test_missing_fields_and_paths():
    assert [(e["code"], e["path"]) for e in study.study_errors({"domain": "economics"}, SCHEMA, {})] == [("STUDY_ID_INVALID", "study_id"), ("SELECTED_CAPABILITIES_INVALID", "selected_capabilities")]
    assert list(study.violations({"properties": {"a": {"items": {"type": "string"}}}}, {"a": ["x", 2]})) == [("a[1]", "type")]
    assert study.study_errors([], SCHEMA, {})[0]["code"] == "STUDY_SCHEMA_INVALID"


def test_pending_decisions():
    got = study.validate_then_evaluate(STUDY, SCHEMA, {"x.fe": CAP})
    assert [(u["kind"], u["field"]) for u in got["result"]["unresolved_decisions"]] == [("decision_requirement", "cluster"), ("precondition", "panel"), ("manual_validation", "read")]
    done = {**STUDY, "decisions": {"cluster": "firm"}, "preconditions": {"panel": False}, "manual_validations": {"read": False}}
    assert study.validate_then_evaluate(done, SCHEMA, {"x.fe": CAP})["result"]["status"] == "ready"
    assert not study.validate_then_evaluate({}, SCHEMA, {})["ok"]


def test_registry_overlay_and_plan(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(CAP))
    (tmp_path / "index.json").write_text("[]")
    assert study.load_registry(tmp_path) == study.load_registry([CAP]) == {"x.fe": CAP}
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(ValueError, match="b.json"):
        study.load_registry(tmp_path)
    assert study.load_registry(tmp_path, lenient=True) == {"x.fe": CAP}
    assert study.overlay({"packages": {"a": 1, "b": 1}, "x": 2}, {"packages": {"b": 3}, "resources": {"skills": {"s": 1}}}) == {"packages": {"a": 1, "b": 3}, "x": 2, "resources": {"skills": {"s": 1}}}
    chosen = {"selected_capabilities": {"a": ["x.fe", "gone"], "b": ["x.fe"]}}
    found = study.resolve_all(chosen, {"x.fe": CAP}, lambda i, c: {"status": "resolved" if c else "blocked"})
    assert (found["overall"], found["roles"]["a"]["blocked_capabilities"], found["roles"]["b"]["status"]) == ("blocked", ["gone"], "ready")
    plan = study.dispatch_plan(chosen, [{"id": "a"}, {"id": "b", "depends_on": ["a"]}], found, [["a"], ["b"]])
    assert [plan["roles"][r]["dispatch_allowed"] for r in "ab"] == [False, False]


def test_role_and_capability_shapes():
    role = {"id": "a", "name": "A", "responsibility": ["r"], "authority": {}, "capability_scope": ["x.*"]}
    assert study.role_errors([role]) == [] and len(study.role_errors([{**role, "name": "", "prompt": "p", "authority": {"may_decide": 1}}])) == 3
    assert study.scope_errors({"selected_capabilities": {"a": ["x.fe", "y"], "b": []}}, [role], {"x.fe": 1, "y": 1}) == ["a: y is outside its scope", "b: unknown role"]
    cap = {"id": "x", "domain": "d", "description": "t", "risk_level": "low", "fallback_policy": "allow", "methodology": {}, "implementations": [{"id": "i", "runtime": "p", "kind": "tool", "verification_status": "tested", "environment_requirements": {}, "verification": {"evidence": 1, "benchmark_ref": 1}}]}
    assert study.capability_errors(cap) == []
    assert len(study.capability_errors({**cap, "maturity": 1, "risk_level": "none", "scientific_preconditions": [{"kind": "machine"}, {"kind": "x"}]})) == 5
    assert study.gate_reasons(admitted="i", executed="i") == [] and study.gate_reasons(admitted="i", executed="j") == ["implementation_mismatch"] and study.gate_reasons(contract_valid=False, director_ready=False) == ["study_contract_invalid", "director_needs_decision"]


def test_acceptance_binds_nine_contents():
    chain = {name: {"plan": name} if mode == "canonical_json" else f"{name}\r\n" for name, _, mode in acceptance.BINDINGS}
    record = acceptance.accept({"study_id": "s"}, chain, {"pass": 7}, "rules")
    assert acceptance.broken_bindings(record, chain.get) == [] and record["run_id"] == content_hash("construct_log\n", "raw")[:16]
    for name, told in zip(chain, acceptance.MISMATCH):
        assert acceptance.broken_bindings(record, lambda n, name=name: "other" if n == name else chain[n]) == [told]


WORKS = [{"DOI": "10.1234/A", "title": ["One work"], "author": [{"given": "A", "family": "Li"}], "issued": {"date-parts": [[2001, 5]]}}, {"DOI": "10.1234/b", "title": ["Other"]}]
OTHERS = [{"id": "W1", "display_name": "One  Work", "doi": "https://doi.org/10.1234/a", "publication_year": 2001, "authorships": [{"author": {"display_name": "Li"}}]}]
REQUEST = {"search_scope": "s", "query_strings": ["q w"], "requested_sources": ["openalex", "crossref"]}


def _fetchers(crossref=WORKS):
    return {"crossref": lambda url: (200, json.dumps({"message": {"items": crossref}})), "openalex": lambda url: (200, json.dumps({"results": OTHERS}))}


def test_search_is_the_same_in_any_order(spark):
    log = literature.run_search(spark, REQUEST, _fetchers())
    assert literature.log_errors(log) == [] and log["workflow_status"] == "completed" and "rows=20" in log["source_executions"][0]["request_identity"]
    assert [(g["decision"], g["rule"], g["member_count"]) for g in sorted(log["dedupe_groups"], key=lambda g: -g["member_count"])] == [("dedupe_same", "canonical_doi", 2), ("distinct", "single", 1)]
    again = literature.run_search(spark, {**REQUEST, "requested_sources": ["crossref", "openalex"]}, _fetchers(WORKS[::-1]))
    assert literature.rerun_diff(log, again) == [] and literature.log_hash(log) == literature.log_hash({"canonical": {**again, "execution_metadata": 1}})
    less = literature.run_search(spark, REQUEST, {**_fetchers(WORKS[:1]), "openalex": lambda url: (500, "")})
    assert less["workflow_status"] == "completed_degraded" and set(literature.rerun_diff(log, less)) == {"canonical_sha256_differs", "record_ids_differ", "dedupe_groups_differ", "verification_differ", "source_ids_differ"}
    with pytest.raises(ValueError, match="only crossref"):
        literature.run_search(spark, {**REQUEST, "requested_sources": ["x"]}, {})


def test_integrity_of_a_search_record(spark):
    log = literature.run_search(spark, REQUEST, _fetchers())
    record = {"resolved": {"implementation_id": "i"}, "provenance": literature.provenance(log, "i")}
    wanted = {"decisions": {"search_scope": "s"}, "search_request": {"query_strings": ["q w"], "requested_sources": ["crossref", "openalex"]}}
    assert literature.broken_integrity(record, log, wanted) == []
    assert literature.broken_integrity({**record, "resolved": {}}, log, wanted) == ["implementation_binding_missing"]
    assert literature.broken_integrity(record, log, {}) == ["search_scope_binding_mismatch", "query_binding_mismatch", "requested_sources_binding_mismatch"]
    assert literature.broken_integrity(record, {**log, "source_executions": []}, wanted) == ["canonical_log_hash_mismatch", "source_statuses_binding_mismatch"]
    assert len(literature.log_errors({"verification": [{"state": "x"}], "source_executions": [{"status": "x"}]})) == 9


def test_dates_by_parts(spark):
    row = spark.createDataFrame([("2001", "abc")], "y string, bad string").select(
        text.date_parts(F.col("y"), semantics="year").alias("a"), text.date_parts(F.col("bad"), semantics="year").alias("b"), text.date_parts(F.lit(1), F.lit(2), F.lit(3), "issued").alias("c"), text.date_parts(F.lit(None)).alias("d")
    ).first()
    assert (row["a"]["year"], row["a"]["semantics"], row["b"]["year"], tuple(row["c"]), row["d"]["semantics"]) == (2001, "year", None, (1, 2, 3, "issued"), "unknown")


def documents(spark):
    model = {f: "x" for f in bundle.ITEMS["model_registry"][2]} | {"model_id": "m1", "n": 50}
    estimate = {"estimate_id": "e1", "model_id": "m1", "term": "t", "estimate": 1.0, "std_error": 0.1, "ci_lower": 0.8, "ci_upper": 1.2, "p_value": 0.01, "n": 50, "multiple_testing_family_ids": ["f"]}
    d = {
        "data_manifest": bundle.artifact("data_manifest", "a1", "r", "t", dataset_id="d", observation_count=50, variable_count=1, dataset_sha256=content_hash("k,v\n", "raw"), dataset_hash_mode="text_file_sha256_lf", data_path="d.csv"),
        "variable_dictionary": bundle.artifact("variable_dictionary", "a2", "r", "t", [{"name": "v", "definition": "d"}]),
        "sample_flow": bundle.artifact("sample_flow", "a3", "r", "t", [{"step_id": "s1", "n_before": 60, "n_removed": 8, "n_after": 52, "reason": "x"}, {"step_id": "s2", "n_before": 52, "n_removed": 2, "n_after": 50, "reason": "x"}]),
        "descriptive_facts": bundle.artifact("descriptive_facts", "a4", "r", "t", [{"fact_id": "f1", "name": "n", "value": "1"}], ["a1"]),
        "model_registry": bundle.artifact("model_registry", "a5", "r", "t", [model, {**model, "model_id": "m2"}]),
        "estimates": bundle.artifact("estimates", "a6", "r", "t", [estimate]),
        "diagnostics": bundle.artifact("diagnostics", "a7", "r", "t", [{"diagnostic_id": "d1", "model_id": "m1"}]),
        "multiple_testing": {"artifact_id": "a8", "artifact_type": "multiple_testing", "families": [{"family_id": "f", "member_estimate_ids": ["e1"], "adjusted_results": [{"estimate_id": "e1", "p_adjusted": 0.01}]}]},
    }
    refs = [{"artifact_id": "a5", "item_ids": ["m2", "m1"], "source_hash": content_hash(d["model_registry"]), "source_hash_mode": bundle.CANONICAL}]
    d["presentation_manifest"] = bundle.artifact("presentation_manifest", "a9", "r", "t", [{"view_id": "v", "view_type": "table", "output_ref": "o", "source_refs": refs}])
    d["replication_stamp"] = bundle.stamp(bundle.bundle_of(spark, d))
    return d


def _checks(spark, d, read=lambda p: b"k,v\r\n" if p == "d.csv" else None):
    return {r["check"] for r in bundle.problems(bundle.bundle_of(spark, json.loads(json.dumps(d))), read).collect()}


def test_a_valid_bundle_is_written_read_and_rendered(spark, tmp_path):
    d = documents(spark)
    manifest = bundle.write_bundle(d, lambda name, body: (tmp_path / name).write_text(body))
    found, docs = bundle.read_bundle(spark, str(tmp_path))
    read = lambda p: b"k,v\n" if p == "d.csv" else None
    assert docs["artifact_manifest"] == manifest and bundle.problems(found, read).collect() == []
    out = bundle.render(found, "model_registry", read=read)
    assert out["ok"] and [line.split(" | ")[0] for line in out["output"].splitlines()[2:]] == ["| m2", "| m1"] and " | 50 |" in out["output"]
    assert bundle.render(found, "estimates", read=read)["errors"] == ["no view names known items of estimates"] and bundle.render(found, "diagnostics", read=read)["errors"] == ["no view names known items of diagnostics"]


def _viewed(d, name, item_ids, **more):
    refs = [{"artifact_id": d[name]["artifact_id"], "item_ids": item_ids, "source_hash": content_hash(d[name]), "source_hash_mode": bundle.CANONICAL, **more}]
    return {"view_id": "w", "view_type": "table", "output_ref": "o", "source_refs": refs}


def test_the_estimates_table_is_rendered_of_a_valid_bundle(spark):
    d = documents(spark)
    d["presentation_manifest"]["views"].append(_viewed(d, "estimates", ["e1"]))
    read = lambda p: b"k,v\n" if p == "d.csv" else None
    out = bundle.render(bundle.bundle_of(spark, d), "estimates", "w", read)
    assert out == {"ok": True, "output": "| term | estimate | std_error | p_value | n |\n|---|---|---|---|---|\n| t | 1.0000 | 0.1000 | 0.0100 | 50 |\n"}
    d["presentation_manifest"]["views"][-1] = _viewed(d, "estimates", ["gone"])
    assert not bundle.render(bundle.bundle_of(spark, d), "estimates", "w", read)["ok"]


def test_views_hold_no_keys_of_their_own(spark):
    d = documents(spark)
    d["presentation_manifest"] |= {"title": "x", "code_ref": "c"}
    d["presentation_manifest"]["views"][0]["estimate"] = 1.0
    d["presentation_manifest"]["views"].append(_viewed(d, "estimates", ["e1"], n=50))
    found = {(r["check"], r["item"], r["detail"]) for r in bundle.view_problems(bundle.bundle_of(spark, d)).collect()}
    assert found == {("presentation_key", "title", None), ("view_key", "v", "estimate"), ("reference_key", "w", "n")}


def test_views_without_a_header_are_checked(spark):
    views = spark.createDataFrame([("v", "table", "o", [("a0", None, "old", bundle.CANONICAL)])], "view_id string, view_type string, output_ref string, source_refs array<struct<artifact_id string, item_ids array<string>, source_hash string, source_hash_mode string>>")
    b = bundle.Bundle(spark, {"estimates": {"artifact_id": "a0"}}, {"presentation_manifest": views}, {"estimates": "now"})
    assert [tuple(r) for r in bundle.view_problems(b).collect()] == [("view_stale", "presentation_manifest", "v", "a0")]


BROKEN = [
    (lambda d: d.pop("diagnostics"), {"missing_artifact"}),
    (lambda d: d["estimates"].pop("producer_role"), {"missing_field"}),
    (lambda d: d["estimates"].update(artifact_type="x"), {"artifact_type"}),
    (lambda d: d["model_registry"]["models"][1].update(model_id="m1"), {"repeated_id", "stamp", "view_unknown_item", "view_stale"}),
    (lambda d: d["estimates"]["estimates"][0].update(model_id="gone"), {"unknown_model", "stamp"}),
    (lambda d: d["estimates"]["estimates"][0].update(n=49), {"sample_size", "stamp"}),
    (lambda d: d["estimates"]["estimates"][0].update(p_value=1.5), {"number", "stamp"}),
    (lambda d: d["estimates"]["estimates"][0].update(term=None), {"missing_field", "stamp"}),
    (lambda d: d["estimates"]["estimates"][0].update(estimate=1.1), {"stamp"}),
    (lambda d: d["sample_flow"]["steps"][1].update(n_before=51), {"sample_flow"}),
    (lambda d: d["data_manifest"].update(observation_count=49), {"sample_flow"}),
    (lambda d: d["descriptive_facts"].update(inputs=["gone"]), {"unknown_input"}),
    (lambda d: d["data_manifest"].update(dataset_sha256="0"), {"data_stale"}),
    (lambda d: d["data_manifest"].update(dataset_hash_mode="md5"), {"data_source"}),
    (lambda d: d["data_manifest"].update(data_path="e.csv"), {"data_source"}),
    (lambda d: d.update(artifact_manifest={"artifacts": [{"path": "estimates.json", "sha256": "0", "hash_mode": bundle.CANONICAL}, {"path": "gone.json"}, {"path": "estimates.json", "hash_mode": "md5"}]}), {"manifest_checksum", "manifest_file", "manifest_hash_mode"}),
    (lambda d: d["multiple_testing"]["families"][0].update(member_estimate_ids=["e1", "e1", "e9"]), {"repeated_member", "unknown_member", "not_adjusted"}),
    (lambda d: d["multiple_testing"]["families"][0].update(member_estimate_ids=[], adjusted_results=[]), {"estimate_not_a_member", "not_adjusted"}),
    (lambda d: d["multiple_testing"]["families"][0].update(family_id="g"), {"unknown_family"}),
    (lambda d: d["presentation_manifest"]["views"][0]["source_refs"][0].update(source_hash="0"), {"view_stale"}),
    (lambda d: d["presentation_manifest"]["views"][0]["source_refs"][0].update(artifact_id="a9"), {"view_of_a_view", "view_stale", "view_items_unsupported"}),
    (lambda d: d["presentation_manifest"]["views"][0].update(source_refs=[], view_type="x"), {"view_unbound", "view_type"}),
    (lambda d: d["replication_stamp"].update(model_count=3), {"stamp"}),
]


@pytest.mark.parametrize("change, checks", BROKEN)
def test_each_defect_of_a_bundle_is_told(spark, change, checks):
    d = json.loads(json.dumps(documents(spark)))
    change(d)
    assert _checks(spark, d) == checks


def test_texts_reach_python_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = ["plain  text ", None, "\u2460 \ufb01\u00a0 x", "e\u0301"]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(text.normal_text(F.col("t")).alias("t"))
    assert [r["t"] for r in made.collect()] == ["plain text", "", "1 fi x", "\u00e9"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
