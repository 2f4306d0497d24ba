"""Study documents: schema evaluation, registry membership, pending decisions, role scopes. Control data: no Spark."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

from panelkit.plans.canonical import canonical_json
from panelkit.plans.resolver import in_scope, roll_up

#: What each JSON type means.
TYPES: dict[str, Callable[[object], bool]] = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}
#: Error codes by path; ``selected_capabilities.`` covers what is below. Fixed values.
CODES = {
    "study_id": "STUDY_ID_INVALID",
    "domain": "STUDY_DOMAIN_INVALID",
    "execution_context": "EXECUTION_CONTEXT_INVALID",
    "execution_context.mode": "EXECUTION_MODE_INVALID",
    "selected_capabilities": "SELECTED_CAPABILITIES_INVALID",
    "decisions": "DECISIONS_INVALID",
    "preconditions": "PRECONDITIONS_INVALID",
    "manual_validations": "MANUAL_VALIDATIONS_INVALID",
}
RISKS = ("low", "medium", "high")
STATUSES = ("reference", "experimental", "tested", "verified", "deprecated")
KINDS = ("tool", "skill", "workflow", "script")
FALLBACKS = ("allow", "recorded", "needs_decision", "hard_stop")


def _same(a: object, b: object) -> bool:
    return canonical_json(a) == canonical_json(b)


def violations(schema, value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, keyword) of what breaks the schema; a wrong type, enum or const hides what is below it."""
    if schema is False:
        yield path, "falseSchema"
    if not isinstance(schema, dict):
        return
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(TYPES.get(k, lambda _: True)(value) for k in kinds):
        yield path, "type"
        return
    if "enum" in schema and not any(_same(v, value) for v in schema["enum"]):
        yield path, "enum"
        return
    if "const" in schema and not _same(schema["const"], value):
        yield path, "const"
        return
    if isinstance(value, dict):
        yield from _object(schema, value, path)
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            yield path, "minItems"
        items = schema.get("items")
        each = zip(items, value) if isinstance(items, list) else ((items, v) for v in value)
        for i, (sub, v) in enumerate(each):
            yield from violations(sub, v, f"{path}[{i}]" if path else str(i))
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield path, "minLength"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, "pattern"


def _object(schema: dict, value: dict, path: str) -> Iterator[tuple[str, str]]:
    def below(k: str) -> str:
        return f"{path}.{k}" if path else k

    if len(value) < schema.get("minProperties", 0):
        yield path, "minProperties"
    known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
    yield from ((below(k), "required") for k in schema.get("required", []) if k not in value)
    for k in [k for k in value if k not in known]:
        if more is False:
            yield below(k), "additionalProperties"
        else:
            yield from violations(more, value[k], below(k))
    for k in [k for k in known if k in value]:
        yield from violations(known[k], value[k], below(k))


def error_code(path: str, keyword: str) -> str:
    if path in CODES:
        return CODES[path]
    if path.startswith("selected_capabilities."):
        return "SELECTED_CAPABILITIES_EMPTY" if keyword == "minItems" else "SELECTED_CAPABILITIES_INVALID"
    return "STUDY_REQUIRED_FIELD_MISSING" if keyword == "required" else "STUDY_SCHEMA_INVALID"


def study_errors(study, schema: dict, registry: dict) -> list[dict]:
    """What is wrong with a study: its schema, then capabilities that the registry lacks."""
    if not isinstance(study, dict):
        return [{"code": "STUDY_SCHEMA_INVALID", "path": "", "keyword": "type"}]
    out = [{"code": error_code(p, k), "path": p, "keyword": k} for p, k in violations(schema, study)]
    chosen = study.get("selected_capabilities")
    for role, ids in (chosen.items() if isinstance(chosen, dict) else ()):
        for i, c in enumerate(ids if isinstance(ids, list) else []):
            if isinstance(c, str) and c and c not in registry:
                out.append({"code": "CAPABILITY_ID_UNKNOWN", "path": f"selected_capabilities.{role}.{i}", "keyword": "registry"})
    return out


def _listed(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def pending(capability: dict, study: dict) -> list[tuple[str, str]]:
    """(kind, field) of what a person still has to decide for a capability."""
    decided, given, checked = (study.get(k) or {} for k in ("decisions", "preconditions", "manual_validations"))
    empty = (None, "", [], {})
    out = [("decision_requirement", r) for r in _listed(capability.get("decision_requirements")) if isinstance(r, str) and r and decided.get(r) in empty]
    for p in (p for p in _listed(capability.get("scientific_preconditions")) if isinstance(p, dict)):
        if p.get("kind") == "machine" and p.get("field") and p.get("on_missing") == "needs_decision" and given.get(p["field"]) in empty:
            out.append(("precondition", p["field"]))
        # True and False are both answers; whether False blocks is the resolver's business.
        if p.get("kind") == "manual" and p.get("label") and not isinstance(checked.get(p["label"]), bool):
            out.append(("manual_validation", p["label"]))
    return out


def evaluate(study: dict, registry: dict) -> dict:
    """ready, or needs_decision with what is pending, each selected capability once."""
    chosen = study.get("selected_capabilities") or {}
    ids = dict.fromkeys(c for v in chosen.values() if isinstance(v, list) for c in v)
    left = [{"capability": c, "kind": k, "field": f} for c in ids if c in registry for k, f in pending(registry[c], study)]
    return {"study_id": study.get("study_id"), "status": "needs_decision" if left else "ready", "unresolved_decisions": left, "selected_capabilities": chosen}


def validate_then_evaluate(study, schema: dict, registry: dict) -> dict:
    """The evaluation only of a study that is valid."""
    errors = study_errors(study, schema, registry)
    return {"ok": False, "errors": errors} if errors else {"ok": True, "result": evaluate(study, registry)}


def read_json(path: str | Path):
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_registry(source, lenient: bool = False) -> dict:
    """Capabilities by id, from a folder (index.json is passed over), a file, a list or a mapping.

    An unreadable file fails, unless ``lenient``.
    """
    if isinstance(source, (str, Path)) and Path(source).is_dir():
        found = []
        for f in sorted(Path(source).glob("*.json")):
            try:
                found += [read_json(f)] if f.name != "index.json" else []
            except ValueError as e:
                if not lenient:
                    raise ValueError(f"{f.name}: {e}") from e
        source = found
    elif isinstance(source, (str, Path)):
        source = read_json(source)
    if isinstance(source, list):
        return {c["id"]: c for c in source if isinstance(c, dict) and c.get("id")}
    return source or {}


def overlay(env: dict, more: dict | None) -> dict:
    """``env`` with an overlay's runtimes, packages and resources put over it, one level deep: right wins."""
    out = dict(env)
    for part in ("runtime_instances", "runtimes", "packages"):
        if (more or {}).get(part):
            out[part] = {**env.get(part, {}), **more[part]}
    kept = {k: {**env.get("resources", {}).get(k, {}), **v} for k, v in (more or {}).get("resources", {}).items() if k in ("skills", "workflows") and v}
    return out | ({"resources": {**env.get("resources", {}), **kept}} if kept else {})


def resolve_all(study: dict, registry: dict, resolve: Callable[[str, dict | None], dict]) -> dict:
    """Each selected capability's resolution, each role's and the study's status, worst first."""
    chosen = study.get("selected_capabilities") or {}
    found = {c: resolve(c, registry.get(c)) for ids in chosen.values() for c in ids}
    roles = {}
    for role, ids in chosen.items():
        at = {s: [c for c in ids if found[c]["status"] == s] for s in ("blocked", "needs_decision")}
        roles[role] = {"status": roll_up([found[c]["status"] for c in ids]), "capabilities": ids, "blocked_capabilities": at["blocked"], "needed_decisions": at["needs_decision"]}
    return {"study_id": study.get("study_id"), "domain": study.get("domain"), "overall": roll_up([r["status"] for r in roles.values()]), "capabilities": found, "roles": roles}


def dispatch_plan(study: dict, roles: list[dict], resolved: dict, stages: list[list[str]]) -> dict:
    """Which of the active roles may start, by their own status and that of the roles that they wait for."""
    by_id, chosen, out = {r["id"]: r for r in roles}, study.get("selected_capabilities") or {}, {}
    for number, level in enumerate(stages, 1):
        for role in level:
            status = resolved["roles"].get(role, {}).get("status", "ready")
            waits = by_id[role].get("depends_on", [])
            free = status == "ready" and all(out[d]["dispatch_allowed"] for d in waits if d in out)
            out[role] = {"role": role, "stage": number, "selected_capabilities": chosen.get(role, []), "resolution": status, "dispatch_allowed": free, "depends_on": waits, "outputs": by_id[role].get("outputs", [])}
    return {"plan_id": study.get("study_id"), "active_roles": [r for level in stages for r in level], "stages": [{"stage": i, "roles": level} for i, level in enumerate(stages, 1)], "roles": out}


def scope_errors(study: dict, roles: list[dict], registry: dict | None = None) -> list[str]:
    """Selected capabilities of unknown roles, unknown ones, and those outside their role's scope."""
    out, by_id = [], {r.get("id"): r for r in roles}
    for role, ids in (study.get("selected_capabilities") or {}).items():
        if role not in by_id:
            out.append(f"{role}: unknown role")
        elif not isinstance(ids, list):
            out.append(f"{role}: a list of capabilities is needed")
        else:
            scope = by_id[role].get("capability_scope") or []
            for c in ids:
                if registry is not None and scope and c not in registry:
                    out.append(f"{role}: unknown capability {c}")
                elif not in_scope(c, scope):
                    out.append(f"{role}: {c} is outside its scope")
    return out


def role_errors(roles) -> list[str]:
    """The shape of roles: named, responsible for something, with an authority and a scope."""
    if not isinstance(roles, list):
        return ["roles: a list is needed"]
    out = []
    for i, r in enumerate(roles):
        say = f"roles[{i}]"
        if not isinstance(r, dict):
            out.append(f"{say}: an object is needed")
            continue
        out += [f"{say}.{f}: text is needed" for f in ("id", "name") if not (isinstance(r.get(f), str) and r[f])]
        if not (isinstance(r.get("responsibility"), list) and r["responsibility"]):
            out.append(f"{say}.responsibility: a filled list is needed")
        if not isinstance(r.get("authority"), dict):
            out.append(f"{say}.authority: an object is needed")
        lists = {f"authority.{f}": r["authority"].get(f) for f in ("may_decide", "must_escalate")} if isinstance(r.get("authority"), dict) else {}
        lists |= {f: r.get(f) for f in ("inputs", "outputs", "depends_on", "escalation_rules")}
        out += [f"{say}.{f}: a list is needed" for f, v in lists.items() if v is not None and not isinstance(v, list)]
        if not isinstance(r.get("capability_scope"), list):
            out.append(f"{say}.capability_scope: a list is needed")
        out += [f"{say}.{f}: not allowed here" for f in ("prompt", "methodology", "toolchain", "journal", "policy") if f in r]
    return out


def capability_errors(c) -> list[str]:
    """The shape of a capability and its implementations; maturity is derived, never declared."""
    if not isinstance(c, dict):
        return ["an object is needed"]
    out = [f"{f}: text is needed" for f in ("id", "domain", "description") if not (isinstance(c.get(f), str) and c[f])]
    out += [f"{f}: {c.get(f)!r} is not one of {', '.join(allowed)}" for f, allowed in (("risk_level", RISKS), ("fallback_policy", FALLBACKS)) if c.get(f) not in allowed]
    out += [f"{f}: not allowed here" for f in ("environment_requirements", "maturity") if f in c]
    if not isinstance(c.get("methodology"), dict):
        out.append("methodology: an object is needed")
    elif not isinstance(c["methodology"].get("references", []), list):
        out.append("methodology.references: a list is needed")
    if not (isinstance(c.get("implementations"), list) and c["implementations"]):
        out.append("implementations: a filled list is needed")
    for i, x in enumerate(c.get("implementations") if isinstance(c.get("implementations"), list) else []):
        say = f"implementations[{i}]"
        if not isinstance(x, dict):
            out.append(f"{say}: an object is needed")
            continue
        out += [f"{say}.{f}: text is needed" for f in ("id", "runtime") if not (isinstance(x.get(f), str) and x[f])]
        out += [f"{say}.{f}: {x.get(f)!r} is not one of {', '.join(allowed)}" for f, allowed in (("kind", KINDS), ("verification_status", STATUSES)) if x.get(f) not in allowed]
        if not isinstance(x.get("environment_requirements"), dict):
            out.append(f"{say}.environment_requirements: an object is needed")
        if not (isinstance(x.get("verification"), dict) and {"evidence", "benchmark_ref"} <= x["verification"].keys()):
            out.append(f"{say}.verification: evidence and benchmark_ref are needed")
    for i, p in enumerate(_listed(c.get("scientific_preconditions"))):
        say, kind = f"scientific_preconditions[{i}]", p.get("kind") if isinstance(p, dict) else None
        if kind == "machine":
            out += [f"{say}.{f}: needed" for f in ("field", "required_value") if p.get(f) is None]
            out += [f"{say}.{f}: needs_decision or blocked" for f in ("on_missing", "on_mismatch") if p.get(f, "blocked") not in ("needs_decision", "blocked")]
        elif kind == "manual":
            out += [] if p.get("label") else [f"{say}.label: needed"]
        else:
            out.append(f"{say}.kind: machine or manual")
    wanted = c.get("decision_requirements", [])
    return out + ([] if isinstance(wanted, list) and all(isinstance(x, str) for x in wanted) else ["decision_requirements: a list of texts is needed"])


def gate_reasons(contract_valid: bool = True, director_ready: bool = True, admitted: str | None = None, data_accepted: bool = True, executed: str | None = None) -> list[str]:
    """Why an empirical run may not count; each later reason only where the earlier steps hold."""
    out = [] if contract_valid else ["study_contract_invalid"]
    if not director_ready:
        return [*out, "director_needs_decision"]
    if not admitted:
        return [*out, "empirical_not_admissible"]
    if not data_accepted:
        return [*out, "data_acceptance_invalid"]
    return out + (["implementation_mismatch"] if executed != admitted else [])
