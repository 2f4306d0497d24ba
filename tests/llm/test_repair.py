"""Conversation repair against a plain search of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from panelkit.llm import repair
from panelkit.llm.queries import LLM_QUERIES

EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _damage(conv_id, turn, role, text):
    conv, at, role, text = (" " if x is None else x for x in (conv_id, turn, role, text))
    code = zlib.crc32(f"{conv}:{at}".encode()) % 20
    if code == 0:
        return []
    if code == 1:
        text = ""
    if code == 2:
        text = re.sub("[.!?]", "", text)
    if code == 4:
        role = "user"
    return [(turn, role, text)] * (2 if code == 3 else 1)


def _least(rows, most_inserts):
    """(cost, audit, lines) of the cheapest edits by trying all of them: rows of (role, text, must go, is truncated)."""
    best = None
    for ops in itertools.product("KuaD", repeat=len(rows)):
        for inserts in itertools.product(["", "u", "a", "ua", "au", "uau", "aua"], repeat=len(rows) + 1):
            if sum(map(len, inserts)) > most_inserts:
                continue
            cost, audit, lines = 3 * len(inserts[0]), "I" * len(inserts[0]), [({"u": "user", "a": "assistant"}[x], "") for x in inserts[0]]
            for (role, text, must_go, cut_off), op, more in zip(rows, ops, inserts[1:]):
                if must_go and op != "D":
                    break
                cost += {"K": 0, "D": 4}.get(op, 3) + (3 if cut_off and op != "D" else 0) + 3 * len(more)
                audit += ("R" if op in "ua" else op) + "I" * len(more)
                if op != "D":
                    lines.append(({"u": "user", "a": "assistant"}.get(op, role), text))
                lines += [({"u": "user", "a": "assistant"}[x], "") for x in more]
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, lines
    return best


def _plain(rows):
    """The same by dynamic programming over whole strings, for longer conversations: (cost, audit, lines)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(ways):
        for _ in range(2):  # a third insertion in a row never helps
            for state, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        way = cost + 3, audit + "I", lines + [(role, "")]
                        to = step[state, role[0]]
                        if to not in ways or way[:2] < ways[to][:2]:
                            ways[to] = way
        return ways

    ways = inserted({"": (0, "", [])})
    for role, text, must_go, cut_off in rows:
        more = {}
        for state, (cost, audit, lines) in ways.items():
            tries = [(state, 4, "D", [])]
            if not must_go:
                for edit, new, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if (state, new[:1]) in step:
                        tries.append((step[state, new[:1]], price + 3 * cut_off, edit, [(new, text)]))
            for to, price, edit, line in tries:
                way = cost + price, audit + edit, lines + line
                if to not in more or way[:2] < more[to][:2]:
                    more[to] = way
        ways = inserted(more)
    return min((w for s, w in ways.items() if s in ("", "a")), key=lambda w: w[:2])


def _wanted(table, search, dropping=True):
    """Every contract column, from undamaged rows (conv_id, turn, role, text)."""
    out = set()
    for conv in {r[0] for r in table}:
        rows = [x for r in table if r[0] == conv for x in (_damage(*r) if dropping else [r[1:]])]
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, n, faults = set(), [0, 0, 0], []
        for _, role, text in rows:
            shown = re.sub("[\x20\x09-\x0D]", "", text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append((role, text, fault in (0, 1), fault == 2))
            if fault is not None:
                n[fault] += 1
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = search(faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.add((conv, gaps, *n, illegal, cost, audit, digest))
    return out


def _got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _random(r, n, roles=("user", "assistant", "user", "assistant", "system", "tool", "")):
    return [(r.choice(roles), r.choice(["a.", "b?", "cut off", "x", " ", "more."]), r.random() < 0.15, r.random() < 0.2) for _ in range(n)]


def test_plain_searches_agree():
    r = random.Random(1)
    for _ in range(60):
        rows = _random(r, r.randrange(4))
        assert _least(rows, 3)[:2] == _plain(rows)[:2]


def test_cheapest_edits_are_the_least():
    r = random.Random(2)
    faults = {(False, False): repair.PLAIN, (True, False): repair.BLANK, (True, True): repair.DUPLICATE, (False, True): repair.TRUNCATED}
    for _ in range(3000):
        rows = _random(r, r.randrange(12))
        (state, found), = repair.cheapest([(role[:1], faults[gone, off]) for role, _, gone, off in rows]).items()
        assert found == _plain(rows)[:2] and state in repair.ACCEPTED


def test_op11_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        found = LLM_QUERIES["op11_repair"](spark, sf)
        assert found.columns == COLUMNS
        assert _got(found) == _wanted(table, _plain)


def _hard(seed, convs=40, most=60):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for i in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c, r.choice([i, i, i + 1, None]), role, r.choice([None, "", " \n", "ok.", "Yes!", "cut", "same text", f"text {i}.", "wörter? ", "ünd"])))
    return rows + rows[:5]


@pytest.mark.parametrize("chunk", [512, 1, 4])
def test_odd_rows_and_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = _hard(chunk)
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, repeated int")
    # In this process, so that the patched size holds.
    want = _wanted(rows, _plain)
    assert _got(repair.repair(repair.damaged(df), "dropped")) == want
    for conv in {r[0] for r in rows}:
        one = repair.Repair()
        mine = [x for r in rows if r[0] == conv for x in _damage(*r)]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen = set()
        for turn, role, text in mine:
            one.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        assert (conv, *one.result()) in want
    assert repair.repair(df.limit(0)).count() == 0


def test_a_conversation_without_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, turn, "user", "gone.")], "conv_id long, turn long, role string, text string")
    assert _got(repair.repair(repair.damaged(df), "dropped")) == {(7, 0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_repaired_rows_are_what_the_digest_is_of(spark):
    rows = _hard(9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = {}
    for r in sorted(repair.repaired_rows(df).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert (r["edit"] == "I") == (r["edit"] not in "KR") and len(lines[r["conv_id"]]) == r["place"] + 1
    for r in repair.repair(df).collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_one_exchange(spark):
    plan = LLM_QUERIES["op11_repair"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
