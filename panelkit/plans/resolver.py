"""Admission of implementations, stages of a role graph, scopes. Small control data: no Spark."""

from __future__ import annotations

import re
from graphlib import CycleError, TopologicalSorter

RANK = {"ready": 0, "resolved": 0, "needs_decision": 1, "blocked": 2}
#: Statuses that each risk admits. Fixed values.
ADMITTED = {"low": ("verified", "tested", "experimental"), "medium": ("verified", "tested"), "high": ("verified",), "production": ("verified",)}


def version_key(v: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", v))


def satisfies(version: str | None, constraint: str) -> bool:
    """>= == > < ; an unknown version never satisfies."""
    m = re.fullmatch(r"\s*(>=|==|>|<)\s*(\S+)\s*", constraint)
    if not m or not version or not version_key(version):
        return False
    a, b = version_key(version), version_key(m[2])
    n = max(len(a), len(b))
    a, b = a + (0,) * (n - len(a)), b + (0,) * (n - len(b))
    return {">=": a >= b, "==": a == b, ">": a > b, "<": a < b}[m[1]]


def matching_instance(requirement: dict, instances: list[dict]) -> dict | None:
    """The first instance that has the runtime and all packages itself."""
    for i in instances:
        runtime = i.get("runtime") == requirement.get("runtime") and i.get("available", True)
        if runtime and all(satisfies(i.get("version"), c) for c in requirement.get("constraints", [])):
            if all(satisfies(i.get("packages", {}).get(p), c) for p, c in requirement.get("packages", {}).items()):
                return i
    return None


def precondition(p: dict, context: dict) -> bool | None:
    """A machine check's truth; None where a person has yet to confirm."""
    value = context.get(p["id"])
    return bool(value) if p.get("kind") == "machine" or value is not None else None


def maturity(capability: dict) -> str:
    """The best status among implementations."""
    order = ("verified", "tested", "experimental", "planned")
    found = [i.get("status") for i in capability.get("implementations", [])]
    return next((s for s in order if s in found), "planned")


def resolve(capability: dict | None, instances: list[dict], context: dict | None = None, approvals: tuple[str, ...] = ()) -> dict:
    """resolved (with the implementation), needs_decision or blocked, with the reason."""
    if capability is None:
        return {"status": "blocked", "reason": "unknown_capability"}
    context = context or {}
    checks = [precondition(p, context) for p in capability.get("preconditions", [])]
    if False in checks:
        return {"status": "blocked", "reason": "precondition_failed"}
    runnable = [(i, matching_instance(i, instances)) for i in capability.get("implementations", [])]
    runnable = [(i, x) for i, x in runnable if x]
    if not runnable:
        return {"status": "blocked", "reason": "no_matching_instance"}
    admitted = [(i, x) for i, x in runnable if i.get("status") in ADMITTED.get(capability.get("risk", "high"), ())]
    if not admitted:
        return {"status": "blocked", "reason": "risk_not_admitted"}
    if None in checks or any(d not in approvals for d in capability.get("decisions", [])):
        return {"status": "needs_decision", "reason": "decision_pending"}
    order = ("verified", "tested", "experimental")
    prefer = capability.get("runtime_preference", [])
    best = min(admitted, key=lambda c: (order.index(c[0]["status"]), prefer.index(c[0]["runtime"]) if c[0]["runtime"] in prefer else len(prefer), c[0].get("rank", 0)))
    return {"status": "resolved", "reason": "admitted", "implementation": best[0].get("id"), "instance": best[1].get("id")}


def roll_up(statuses: list[str]) -> str:
    """blocked over needs_decision over ready."""
    return max((("ready" if s == "resolved" else s) for s in statuses), key=RANK.get, default="ready")


def stages(depends_on: dict[str, list[str]]) -> list[list[str]]:
    """Levels that can run at once, each sorted. Raises ValueError on cycles and unknown names."""
    if unknown := sorted({d for v in depends_on.values() for d in v} - set(depends_on)):
        raise ValueError(f"unknown: {unknown}")
    graph, out = TopologicalSorter(depends_on), []
    try:
        graph.prepare()
    except CycleError as e:
        raise ValueError(f"cycle: {e.args[1]}") from None
    while graph.is_active():
        level = sorted(graph.get_ready())
        out.append(level)
        graph.done(*level)
    return out


def propagate(depends_on: dict[str, list[str]], own: dict[str, str]) -> dict[str, str]:
    """Each node's status, no better than what it depends on."""
    out: dict[str, str] = {}
    for level in stages(depends_on):
        for node in level:
            out[node] = roll_up([own.get(node, "ready"), *(out[d] for d in depends_on[node])])
    return out


def in_scope(capability_id: str, patterns: list[str]) -> bool:
    """x.y.* stands for all below x.y."""
    return any(capability_id.startswith(p[:-1]) if p.endswith(".*") else capability_id == p for p in patterns)
