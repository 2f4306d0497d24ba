"""Conversation structure repair: cheapest edits of a conversation's rows, by A* on the edit lattice.

A conversation shall be an optional system row and then pairs of a user's and an assistant's row. A node of
the lattice is (rows consumed, what the repaired part ends with); edges keep, rerole, delete or insert a row. The
heuristic is a suffix sum: a blank or repeated row must be deleted, and a truncated one costs its charge at least,
as a deletion is dearer. It is consistent, so a node is settled when it is first taken from the queue; the queue is keyed
by (cost + heuristic, edits' initials), so the initials that it is taken with are the least among the cheapest.

A conversation of any length is read as a stream, in chunks of rows: a chunk is searched from each of the (at
most four) states that it may be entered in to each that it may be left in, and the best way to each state is carried on
with the hash of its repaired text. A digest is one sequential hash, so a conversation's rows pass one task; what that
task holds is a chunk and the edits' initials.

Defined cases: rows are taken by turn (nulls first), then role and text; a null role or text counts as one space, so a
row without text is blank; rows without conversation id are one conversation; a conversation without rows
(all marked as dropped) has zeros, no edits and the empty text's hash; equal rows are duplicates but for the first; very
long texts are hashed whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: Rows that are searched at once.
CHUNK = 512
#: What the repaired part ends with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (NOTHING, ASSISTANT)
#: Faults, and what each costs at least.
PLAIN, BLANK, DUPLICATE, TRUNCATED = range(4)
DUE = (0, 4, 4, 3)
REROLE, DELETE, INSERT = 3, 4, 3
LEGAL = ("su", "ua", "au")
NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {USER: "u", ASSISTANT: "a"}
#: White space. Fixed value.
_BLANKS = " \t\n\v\f\r"


def fault_of(text: str, repeated: bool) -> int:
    """A row's first fault."""
    shown = text.rstrip(_BLANKS)
    if not shown:
        return BLANK
    if repeated:
        return DUPLICATE
    return PLAIN if shown[-1] in ".!?" else TRUNCATED


def cheapest(rows: list[tuple[str, int]], entry: int = NOTHING, final: bool = True) -> dict[int, tuple[int, str]]:
    """{state that the rows are left in: (cost, edits' initials)} of the cheapest edits, ties by initials.

    rows: (role's initial, fault). ``final``: the one cheapest way to an accepted end; otherwise that to each state.
    """
    n = len(rows)
    due = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        due[i] = due[i + 1] + DUE[rows[i][1]]
    queue, settled, exits = [(due[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, state = heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n and (not final or state in ACCEPTED):
            exits[state] = f, audit
            if final:
                break
        after = ASSISTANT if state == USER else USER
        if i < n:
            initial, fault = rows[i]
            if fault in (BLANK, DUPLICATE):
                heappush(queue, (f, audit + "D", i + 1, state))
            else:
                if initial == _INITIAL[after]:
                    heappush(queue, (f, audit + "K", i + 1, after))
                else:
                    if initial == "s" and state == NOTHING:
                        heappush(queue, (f, audit + "K", i + 1, SYSTEM))
                    heappush(queue, (f + REROLE, audit + "R", i + 1, after))
                heappush(queue, (f + DELETE - DUE[fault], audit + "D", i + 1, state))
        heappush(queue, (f + INSERT, audit + "I", i, after))
    return exits


def applied(audit: str, rows: Iterator[tuple], state: int = NOTHING) -> Iterator[tuple[str, tuple | None, int]]:
    """(edit, its row, state behind it) of each edit; an insertion has no row. A row begins with its role."""
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "K" and row[0].startswith("s"):
            state = SYSTEM
        elif edit != "D":
            state = ASSISTANT if state == USER else USER
        yield edit, row, state


class Repair:
    """One conversation, chunk by chunk."""

    def __init__(self):
        self.n = [0, 0, 0, 0]
        self.gaps = self.illegal = 0
        self.lowest = self.highest = None
        self.distinct, self.before = 0, None
        self.held: list[tuple[str, str, int]] = []
        self.common: list[str] = []  # initials on which the ways to all states agree
        self.ways = {NOTHING: (0, "", hashlib.sha256())}

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if len(self.held) == CHUNK:
            self._search(False)
        fault = fault_of(text, repeated)
        self.n[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.highest:  # turns come in their order
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = turn
            self.distinct += 1
        self.held.append((role, text, fault))

    def _search(self, final: bool) -> None:
        rows = [(role[:1], fault) for role, _, fault in self.held]
        found: dict[int, tuple] = {}
        for entry, (cost, audit, _) in self.ways.items():
            for state, (more, edits) in cheapest(rows, entry, final).items():
                way = cost + more, audit + edits, entry, edits
                if state not in found or way < found[state]:
                    found[state] = way
        if final:
            found = dict([min(found.items(), key=lambda x: x[1])])
        ways = {}
        for state, (cost, audit, entry, edits) in found.items():
            digest = self.ways[entry][2].copy()
            at = entry
            for edit, row, after in applied(edits, iter(self.held), entry):
                if edit != "D":
                    role, text = (row[0] if edit == "K" else NAMES[after]), (row[1] if row else "")
                    digest.update((("\n" if at != NOTHING else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                at = after
            ways[state] = cost, audit, digest
        same = os.path.commonprefix([audit for _, audit, _ in ways.values()])
        self.common.append(same)
        self.ways = {state: (cost, audit[len(same) :], digest) for state, (cost, audit, digest) in ways.items()}
        self.held = []

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        self._search(True)
        cost, audit, digest = next(iter(self.ways.values()))
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.distinct
        return (gaps, *self.n[1:], self.illegal, cost, "".join(self.common) + audit, digest.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows damaged by the CRC of ``conv_id:turn`` (nulls: one space)."""
    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.encode(F.concat(told("conv_id"), F.lit(":"), told("turn")), "UTF-8")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), told("role").alias("role"), told("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _marked(conversations: DataFrame, dropped: str | None) -> DataFrame:
    """conv_id, dropped, turn, role, text, repeated: together by conversation and in order. One exchange.

    The window that tells repeated rows is served by the conversations' own partitioning.
    """
    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    rows = conversations.select("conv_id", gone.alias("dropped"), F.col("turn").cast("long").alias("turn"), told("role"), told("text")).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    marked = rows.withColumn("repeated", F.row_number().over(earlier) > 1)
    return marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")


def repair(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """A row a conversation: its faults, the cheapest edits, their cost and the repaired text's digest.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (K, R, D, I in order),
    repaired_sha256 (of ``role:text`` lines). Rows whose ``dropped`` column is true count for nothing but that
    their conversation is listed.
    """
    prepare(conversations.sparkSession)
    kind = conversations.select("conv_id").schema[0].dataType.simpleString()
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, None
        for batch in batches:
            done, ids = [], batch.column(0)
            for conv_id, gone, turn, role, text, again in zip(*(c.to_pylist() for c in batch.columns)):
                if one is None or conv_id != at:
                    if one is not None:
                        done.append((at, *one.result()))
                    at, one = conv_id, Repair()
                if not gone:
                    one.add(turn, role, text, again)
            yield _batch(done, names, ids.type)
        if one is not None:
            yield _batch([(at, *one.result())], names, ids.type)

    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _marked(conversations, dropped).mapInArrow(repaired, schema)


def _batch(rows: list[tuple], names: tuple[str, ...], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * (len(names) - 3), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], list(names))


def repaired_rows(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """The repaired rows themselves: conv_id, place (from 0), edit (K, R or I), turn (null: inserted), role, text."""
    prepare(conversations.sparkSession)
    kind = conversations.select("conv_id").schema[0].dataType.simpleString()
    rows = cut(conversations)
    edits = repair(rows, dropped).select("conv_id", F.lit(False).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(False).alias("repeated"))
    marked = _marked(rows, dropped).where(~F.col("dropped")).select("conv_id", F.lit(True).alias("row"), "turn", "role", "text", "repeated")
    dealt = edits.unionByName(marked).repartition("conv_id").sortWithinPartitions("conv_id", "row", F.col("turn").asc_nulls_first(), "role", "text", "repeated")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, state, place, out = None, iter(()), NOTHING, 0, []

        def put(edit: str, turn: int | None, role: str | None, text: str) -> None:
            nonlocal state, place
            state = SYSTEM if edit == "K" and role.startswith("s") else ASSISTANT if state == USER else USER
            out.append((at, edit, turn, role if edit == "K" else NAMES[state], text, place))
            place += 1

        def inserted() -> str | None:
            """Put what is inserted here; the edit that then comes, if any."""
            for edit in left:
                if edit != "I":
                    return edit
                put("I", None, None, "")
            return None

        for batch in batches:
            for conv_id, is_row, turn, role, text, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if not is_row:
                    inserted()  # behind the last row of the conversation before
                    at, left, state, place = conv_id, iter(text), NOTHING, 0
                elif (edit := inserted()) != "D":
                    put(edit, turn, role, text)
            yield flushed(out, batch.column(0).type)
            out.clear()
        inserted()
        if out:
            yield flushed(out, batch.column(0).type)

    def flushed(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        types = (conv_type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "edit", "turn", "role", "text", "place"])

    return dealt.mapInArrow(streamed, f"conv_id {kind}, edit string, turn long, role string, text string, place long").select("conv_id", "place", "edit", "turn", "role", "text")
