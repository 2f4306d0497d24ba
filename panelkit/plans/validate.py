"""Plan-time checks: the closed vocabularies, required fields, references. No Spark job runs."""

from __future__ import annotations

from panelkit.functions.text import DATE_DIRECTIVES, DATE_OUTPUTS, KEY_RULES

#: Operation kinds and the fields that each requires. Fixed values.
HARMONIZE = {
    "rename": ("mapping",),
    "coerce": ("column", "to"),
    "normalize_key": ("column", "rules"),
    "map_code": ("column", "mapping", "unknown"),
    "normalize_date": ("column", "in_format"),
    "convert_unit": ("source_column", "target_column", "source_unit", "target_unit", "factor", "factor_mode"),
    "merge": ("right", "right_keys", "how", "cardinality", "unmatched"),
}
CONSTRUCT = {
    "arithmetic": ("operator", "left", "right", "target"),
    "log": ("source", "target"),
    "ratio": ("numerator", "denominator", "target"),
    "interaction": ("terms", "target"),
    "difference": ("source", "target"),
    "growth_rate": ("source", "target"),
    "lag": ("source", "target"),
    "lead": ("source", "target"),
    "indicator": ("target", "predicate"),
}
COERCIONS = ("integer", "numeric", "string", "boolean")
CARDINALITIES = ("1:1", "1:m", "m:1")
COMPARISONS = ("gt", "gte", "lt", "lte", "eq", "neq")
SCIENTIFIC_ROLES = ("treatment", "exposure", "instrument", "material_variable_definition")


def _required(op: dict, kinds: dict, at: int) -> list[str]:
    kind = op.get("kind")
    if kind not in kinds:
        return [f"op {at}: unsupported op kind {kind!r}"]
    return [f"op {at} ({kind}): {f} is required" for f in kinds[kind] if f not in op]


def harmonize_errors(plan: dict) -> list[str]:
    """What is wrong with a harmonize plan; empty if nothing is."""
    out = [f"{f} is required" for f in ("inputs", "operations") if not plan.get(f)]
    inputs = {i.get("input_id") for i in plan.get("inputs", [])}
    for at, op in enumerate(plan.get("operations", [])):
        missing = _required(op, HARMONIZE, at)
        out += missing
        if missing:
            continue
        kind, say = op["kind"], f"op {at} ({op['kind']}): "
        if op.get("on_failure", "fail") != "fail":
            out.append(say + "on_failure can only be fail")
        if kind == "rename" and len(set(op["mapping"].values())) < len(op["mapping"]):
            out.append(say + "duplicate targets")
        if kind == "coerce" and op["to"] not in COERCIONS:
            out.append(say + f"unsupported coercion target {op['to']!r}")
        if kind == "normalize_key":
            out += [say + f"unknown rule {r!r}" for r in op["rules"] if r not in (*KEY_RULES, "zero_pad")]
            if "zero_pad" in op["rules"] and not isinstance(op.get("width"), int):
                out.append(say + "zero_pad needs a width")
        if kind == "map_code" and op["unknown"] != "fail":
            out.append(say + "unknown codes can only fail")
        if kind == "normalize_date":
            if op.get("out", "iso_date") not in DATE_OUTPUTS:
                out.append(say + f"unknown output {op['out']!r}")
            f = op["in_format"]
            out += [say + f"unsupported directive {f[i : i + 2]!r}" for i, c in enumerate(f) if c == "%" and f[i : i + 2] not in DATE_DIRECTIVES]
        if kind == "convert_unit" and op["factor_mode"] not in ("multiply", "divide"):
            out.append(say + "factor_mode is multiply or divide")
        if kind == "merge":
            if op["right"] not in inputs:
                out.append(say + f"unknown input {op['right']!r}")
            if op["how"] not in ("left", "inner"):
                out.append(say + "how is left or inner")
            if op["cardinality"] not in CARDINALITIES:
                out.append(say + f"cardinality {op['cardinality']!r} is not allowed")
            if op["unmatched"] not in ("warn", "fail"):
                out.append(say + "unmatched is warn or fail")
            if len(op.get("left_keys", op["right_keys"])) != len(op["right_keys"]) or not op["right_keys"]:
                out.append(say + "as many left keys as right keys")
    return out


def predicate_errors(p, say: str) -> list[str]:
    if not isinstance(p, dict):
        return [say + "a predicate is an object"]
    if p.get("op") in ("and", "or"):
        args = p.get("args", [])
        return ([say + f"{p['op']} takes two arguments"] if len(args) != 2 else []) + [e for a in args for e in predicate_errors(a, say)]
    if p.get("op") not in COMPARISONS:
        return [say + f"unknown predicate {p.get('op')!r}"]
    return [say + f"{side} is a column or a number" for side in ("left", "right") if isinstance(p.get(side), (dict, list)) or p.get(side) is None]


def predicate_columns(p: dict) -> list[str]:
    if p.get("op") in ("and", "or"):
        return [c for a in p["args"] for c in predicate_columns(a)]
    return [p[s] for s in ("left", "right") if isinstance(p.get(s), str)]


def op_inputs(op: dict) -> list[str]:
    """The columns that a construct op reads, sorted."""
    fields = [op.get(f) for f in ("left", "right", "source", "numerator", "denominator")] + list(op.get("terms", []))
    fields += predicate_columns(op["predicate"]) if op.get("kind") == "indicator" else []
    return sorted({f for f in fields if isinstance(f, str)})


def construct_errors(plan: dict, columns: list[str] | None = None) -> list[str]:
    """What is wrong with a construct plan; columns: those of its input, where known."""
    out = [] if plan.get("operations") else ["operations is required"]
    declared = plan.get("input", {}).get("columns")
    known = set(columns if columns is not None else declared or [])
    if columns is not None and declared is not None and set(declared) != set(columns):
        out.append("the input's columns are not those declared")
    targets: set[str] = set()
    for at, op in enumerate(plan.get("operations", [])):
        missing = _required(op, CONSTRUCT, at)
        out += missing
        if missing:
            continue
        kind, say = op["kind"], f"op {at} ({op['kind']}): "
        if kind == "arithmetic" and op["operator"] not in ("add", "subtract", "multiply", "divide"):
            out.append(say + f"unknown operator {op['operator']!r}")
        if kind == "log" and str(op.get("base", "natural")) not in ("natural", "10"):
            out.append(say + "base is natural or 10")
        if kind == "interaction" and (len(op["terms"]) < 2 or len(set(op["terms"])) < len(op["terms"])):
            out.append(say + "two or more distinct terms")
        if kind in ("difference", "growth_rate", "lag", "lead"):
            if not (isinstance(op.get("periods", 1), int) and op.get("periods", 1) >= 1):
                out.append(say + "periods is a positive integer")
            out += [say + f"{f} is required" for f in ("panel_by", "time_by") if not op.get(f, plan.get(f))]
        if kind == "indicator":
            bad = predicate_errors(op["predicate"], say)
            out += bad
            if bad:
                continue
        if known:
            out += [say + f"unknown column {c!r}" for c in op_inputs(op) if c not in known | targets]
        if op["target"] in known | targets:
            out.append(say + f"target {op['target']!r} exists")
        targets.add(op["target"])
        if role := op.get("scientific_role"):
            bound = plan.get("scientific_bindings", {}).get(op["target"]) or {}
            if role not in SCIENTIFIC_ROLES:
                out.append(say + f"unsupported scientific role {role!r}")
            if bound.get("approved") is not True or not bound.get("decision_ref"):
                out.append(say + f"role {role!r} lacks an approved decision for {op['target']!r}")
            elif bound.get("role") != role:
                out.append(say + f"role {role!r} is not the approved one, {bound.get('role')!r}")
    approved = {d.get("decision_id") for d in plan.get("decisions", []) if d.get("status") == "approved"}
    for role in plan.get("role_bindings", []):
        if role.get("role") in SCIENTIFIC_ROLES and role.get("decision_id") not in approved:
            out.append(f"role {role['role']}: needs an approved decision")
    return out


def plan_errors(plan: dict, kind: str) -> list[str]:
    """A plan document as a whole: its own fields besides what its ops need. kind: harmonize or construct."""
    out = [] if plan.get("schema_version") == "1.0" else ["schema_version must be 1.0"]
    if not (isinstance(plan.get("plan_id"), str) and plan["plan_id"].strip()):
        out.append("plan_id is required")
    sources = plan.get("inputs", []) if kind == "harmonize" else [plan.get("input") or {}]
    needed = ("input_id", "file") if kind == "harmonize" else ("dataset_id", "file", "columns")
    out += [f"input {at}: {f} is required" for at, i in enumerate(sources) for f in needed if not i.get(f)]
    ids = [i.get("input_id") for i in sources] if kind == "harmonize" else []
    out += [f"input_id {x!r} repeats" for x in sorted({x for x in ids if x and ids.count(x) > 1})]
    out += [f"output: {f} is required" for f in ("dataset_id", "file") if not (plan.get("output") or {}).get(f)]
    names = [op.get("op_id") for op in plan.get("operations", [])]
    out += [f"op {at}: op_id is required" for at, x in enumerate(names) if not x]
    out += [f"op_id {x!r} repeats" for x in sorted({x for x in names if x and names.count(x) > 1})]
    return out + (harmonize_errors(plan) if kind == "harmonize" else construct_errors(plan))
