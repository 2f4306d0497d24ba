"""Canonical JSON and content hashes of control documents."""

from __future__ import annotations

import hashlib
import json
import math


def number_text(x: float) -> str:
    """A number as JavaScript prints it: 1.0 is 1, exponents from 1e21 and below 1e-6."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise TypeError(x)
    if not math.isfinite(x):
        raise ValueError("a non-finite number has no canonical form")
    if x == 0:
        return "0"
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    digits, _, exponent = repr(abs(float(x))).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if 0 < point <= 21:
        text = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = digits[0] + ("." + digits[1:] if digits[1:] else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + text


def canonical_json(value) -> str:
    """Sorted keys, no blanks."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"


def content_hash(value, mode: str = "canonical_json") -> str:
    """sha256 of a document (canonical_json), of bytes (raw), or of text with LF ends (lf_text)."""
    if mode == "canonical_json":
        data = canonical_json(value).encode()
    else:
        data = value if isinstance(value, bytes) else value.encode()
        data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n") if mode == "lf_text" else data
    return hashlib.sha256(data).hexdigest()
