"""Token counts of a piece vocabulary (BPE with byte fallback) by a compiled finite-state transducer.

Which token ends a prefix follows from tokens that ended shorter prefixes: it is the one piece that ends
there and may stand behind the token before it (two tokens may be neighbours if their joined text
is encoded as just these two, and an encoding is right if all its neighbours may be). So a deterministic
transducer reads a text: a state holds the longest suffix that begins a piece and, for each place where a longer
piece may have begun, the token that ends there and how many tokens fewer or more it closes; a transition emits
the change of the count. Changes may be negative, as a longer piece takes several tokens' place.
Transitions are compiled when they are first met and kept in a hash table of bounded size, which numpy looks up
for many places at once.

Two code points that no piece holds side by side are never joined, so the state behind them is known
whatever came before: a *reset*. A run of texts is cut into blocks. A block's state map is constant if
it holds a reset. The map of a block without any is a table over the entry states that may occur there; such
maps are composed by a doubling scan, and where a state turns up that the tables lack, it is added and the scan
repeated. With every block's first state known, all blocks are replayed side by side.

Defined cases: null counts as empty and has no token; only an empty text has none, as white space is counted;
special strings in a text are plain text; repeated rows are counted each; a long text is worked on in
parts, the state of one part's end entering the next; other columns, whatever their names, are kept by
``with_counts``; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import portions
from .common import prepare

BLOCK = 128
#: Code points that are worked on at once; a longer text goes in parts.
PORTION = 1 << 20
#: Transitions that are kept at most; then compiling begins anew.
LIMIT = 1 << 21
ROOT, SKIP = 0, -1
#: The vocabulary's mark of a space. Fixed value.
SPACE = "▁"


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(buf: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(buf, at)
            value, at = buf[at : at + size], at + size
        yield tag >> 3, value


def scores(path: str) -> dict[str, float]:
    """The vocabulary's plain pieces and their scores.

    Raises ValueError for a model of another kind: what is compiled here is BPE with byte fallback that
    leaves texts as they are but for the mark of a space, one more at the beginning.
    """
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    found = {}
    for _, piece in ((n, v) for n, v in parts if n == 1):
        x = dict(_fields(piece))
        if x.get(3, 1) == 1:  # a plain piece
            found[x[1].decode()] = float(np.frombuffer(x[2], "<f4")[0])
    trainer = dict(_fields(next(v for n, v in parts if n == 2)))
    normal = dict(_fields(next(v for n, v in parts if n == 3)))
    if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError(f"{path}: not a BPE model with byte fallback and plain texts")
    return found


class Transducer:
    """The compiled transitions of one vocabulary, grown as texts need them."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.letters = sorted({c for p in pieces for c in p})
        number = {c: i for i, c in enumerate(self.letters)}
        self.n = len(self.letters) + 4  # and the unknown code points of 1 to 4 bytes
        table = np.full(0x110000, len(self.letters), np.int16)
        for least in (0x80, 0x800, 0x10000):
            table[least:] += 1
        for c, i in number.items():
            table[ord(c)] = i
        table[0x20] = number[SPACE]
        self.table = table
        self.joined = np.zeros(self.n * self.n, bool)
        self.begun: set[str] = set()  # texts that a longer piece begins with
        for p in pieces:
            self.begun.update(p[:i] for i in range(1, len(p)))
            for a, b in zip(p, p[1:]):
                self.joined[number[a] * self.n + number[b]] = True
        self.reset()

    def reset(self) -> None:
        """Forget all transitions and states."""
        self.states: list[tuple] = [()]  # ROOT: a reset
        self.number: dict[tuple, int] = {(): ROOT}
        self.lasting: dict[tuple[str, str], bool] = {}
        self.size = 0
        self._room(16)

    def _room(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        self.emits = np.zeros(1 << bits, np.int8)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging best pairs."""
        parts = list(text)
        while True:
            found = [(-self.pieces[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.pieces]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stands(self, before: str, token: str) -> bool:
        """May ``token`` follow the token ``before`` (empty: a reset)?"""
        got = self.lasting.get((before, token))
        if got is None:
            got = self.merged(before + token) == ([before, token] if before else [token])
            self.lasting[before, token] = got
        return got

    def compiled(self, state: int, sym: int) -> tuple[int, int]:
        """(next state, change of the count) of a transition.

        A state is a tuple of (text behind a place, token that ends there, tokens up to there minus
        tokens up to here), nearest place first, for the places where a piece that isn't over may have begun.
        """
        if sym >= len(self.letters):  # joined with nothing: its bytes
            return ROOT, sym - len(self.letters) + 1
        c = self.letters[sym]
        places = self.states[state] or (("", "", 0),)
        for begun, before, fewer in reversed(places):
            token = begun + c
            if token in self.pieces and self.stands(before, token):
                break
        else:
            raise RuntimeError(f"no piece ends behind {places[-1][0] + c!r}")
        change = fewer + 1
        after = [("", token, 0)] + [(b + c, t, k - change) for b, t, k in places if b + c in self.begun]
        at = self.number.setdefault(tuple(after), len(self.states))
        if at == len(self.states):
            self.states.append(tuple(after))
        return at, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or the free slot where it belongs."""
        mask = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[at]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while len(off):
            at[off] = (at[off] + 1) & mask
            held = self.keys[at[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return at

    def _insert(self, keys: np.ndarray, nexts: np.ndarray, emits: np.ndarray) -> None:
        """All at once: of several keys that want a slot one gets it, the others try again."""
        while len(keys):
            at = self._slots(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys
            self.next[at[won]], self.emits[at[won]] = nexts[won], emits[won]
            keys, nexts, emits = keys[~won], nexts[~won], emits[~won]

    def _learn(self, keys: np.ndarray) -> None:
        self.size += len(keys)
        if 2 * self.size > len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.next[held], self.emits[held]
            self._room((4 * self.size).bit_length())
            self._insert(*old)
        made = [self.compiled(*divmod(k, self.n)) for k in keys.tolist()]
        self._insert(keys, *np.array(made, np.int64).T)

    def step(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transitions of many places at once."""
        keys = state * self.n + sym
        at = self._slots(keys)
        missing = self.keys[at] != keys
        if missing.any():
            self._learn(np.unique(keys[missing]))
            at = self._slots(keys)
        return self.next[at].astype(np.int64), self.emits[at]

    # Runs of texts ------------------------------------------------------------------------------------

    def changes(self, points: np.ndarray, firsts: np.ndarray, entry: int = ROOT, before: int = SKIP) -> tuple[np.ndarray, int, int]:
        """The count's change at each code point, the last state and the last symbol.

        firsts: where texts begin. ``entry`` and ``before``: state and symbol of a text whose next part this is.
        """
        n = len(points)
        rows = -(-n // BLOCK)
        sym = np.full(rows * BLOCK, len(self.letters), np.int64)
        sym[:n] = self.table[points]
        fresh = np.ones(rows * BLOCK, bool)
        fresh[1:] = ~self.joined[sym[:-1] * self.n + sym[1:]]
        fresh[0] = before == SKIP or not self.joined[before * self.n + sym[0]]
        fresh[firsts] = True
        last = int(sym[n - 1])
        sym = np.ascontiguousarray(sym.reshape(rows, BLOCK).T)
        fresh = np.ascontiguousarray(fresh.reshape(rows, BLOCK).T)
        out = np.zeros((BLOCK, rows), np.int8)
        # What follows a block's first reset doesn't depend on how the block is entered.
        state, known = np.full(rows, SKIP, np.int64), np.zeros(rows, bool)
        ends = np.full(rows, entry, np.int64)  # the state behind the texts' last code point
        for k in range(BLOCK):
            known |= fresh[k]
            state[fresh[k]] = ROOT
            if known.all():
                state, out[k] = self.step(state, sym[k])
            else:
                at = np.flatnonzero(known)
                state[at], out[k, at] = self.step(state[at], sym[k, at])
            if k == (n - 1) % BLOCK:
                ends[-1] = state[-1]
        enter = np.concatenate([[entry], state[:-1]])
        self._compose(sym, known, enter)
        # Heads: from a block's beginning to its first reset.
        at, state = np.arange(rows), enter
        for k in range(BLOCK):
            going = ~fresh[k, at]
            at, state = at[going], state[going]
            if not len(at):
                break
            state, out[k, at] = self.step(state, sym[k, at])
            if k == (n - 1) % BLOCK and at[-1] == rows - 1:
                ends[-1] = state[-1]
        return out.T.ravel()[:n], int(ends[-1]), last

    def _compose(self, sym: np.ndarray, known: np.ndarray, enter: np.ndarray) -> None:
        """Fill in the entry states of blocks that follow blocks without a reset.

        ``enter`` is right where the block before has a reset, and for the first block. A block's table has a
        row for each entry state that is thought possible; -1 where the next block's table lacks the exit.
        """
        rows = len(known)
        open_ = np.flatnonzero(~known[:-1]) if rows > 1 else np.zeros(0, np.int64)
        if not len(open_):
            return
        follows = np.concatenate([[False], ~known[:-1]])  # its entry isn't known yet
        # Guesses: the states behind the block before, had a text begun at one of its first places.
        guesses: dict[int, list[int]] = {int(b): [] if follows[b] else [int(enter[b])] for b in open_}
        chained = open_[follows[open_]]
        for p in range(16):
            state = np.full(len(chained), ROOT, np.int64)
            for k in range(p, BLOCK):
                state, _ = self.step(state, sym[k, chained - 1])
            for b, s in zip(chained.tolist(), state.tolist()):
                if s not in guesses[b]:
                    guesses[b].append(s)
        while True:
            width = max(map(len, guesses.values()))
            entries = np.full((len(open_), width), SKIP, np.int64)
            for i, b in enumerate(open_.tolist()):
                entries[i, : len(guesses[b])] = guesses[b]
            exits = np.full_like(entries, SKIP)
            i, j = np.nonzero(entries >= 0)
            state = entries[i, j]
            for k in range(BLOCK):
                state, _ = self.step(state, sym[k, open_[i]])
            exits[i, j] = state
            # A map: the place of the exit in the next block's table. Chains are runs of adjacent open blocks.
            chain_first = np.concatenate([[True], np.diff(open_) > 1])
            maps = np.full_like(entries, -1)
            nexts = np.flatnonzero(~chain_first[1:])
            hit = (exits[nexts][:, :, None] == entries[nexts + 1][:, None, :]) & (exits[nexts] >= 0)[:, :, None]
            maps[nexts] = np.where(hit.any(2), hit.argmax(2), -1)
            # Doubling scan: total[i] maps the chain's first entry to block i's entry.
            total = np.full_like(entries, -1)
            total[nexts + 1] = maps[nexts]
            total[chain_first] = np.arange(width)
            reach = np.arange(len(open_)) - np.maximum.accumulate(np.where(chain_first, np.arange(len(open_)), 0))
            shift = 1
            while shift <= reach.max(initial=0):
                far = np.flatnonzero(reach >= shift)
                far = far[reach[far] > 0]
                left, right = total[far - shift], total[far]
                total[far] = np.where(left >= 0, np.take_along_axis(right, np.maximum(left, 0), 1), -1)
                shift *= 2
            place = total[:, 0]
            got = np.where(place >= 0, entries[np.arange(len(open_)), np.maximum(place, 0)], SKIP)
            lost = np.flatnonzero((got == SKIP) & np.concatenate([[False], got[:-1] >= 0]) & ~chain_first)
            if not len(lost):
                break
            for i in lost.tolist():
                j = int(place[i - 1])
                guesses[int(open_[i])].append(int(exits[i - 1, j]))
        enter[open_] = got
        behind = open_[open_ + 1 < rows]
        which = np.searchsorted(open_, behind)
        enter[behind + 1] = exits[which, place[which]]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text, in runs of bounded length."""
        return [n for run in portions(texts, PORTION) for n in self._counts(run)]

    def _counts(self, texts: list[str]) -> list[int]:
        if len(self.states) + self.size > LIMIT:
            self.reset()
        if len(texts) == 1 and len(texts[0]) > PORTION:
            total, state, before, text = 0, ROOT, SKIP, texts[0]
            for at in range(0, len(text), PORTION):
                points = _points((SPACE if at == 0 else "") + text[at : at + PORTION])
                change, state, before = self.changes(points, np.zeros(int(at == 0), np.int64), state, before)
                total += int(change.sum(dtype=np.int64))
            return [total]
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        if not ends.size or not ends[-1]:
            return [0] * len(texts)
        points = _points("".join(SPACE + t for t in texts if t))
        change, _, _ = self.changes(points, (ends - lengths)[lengths > 0])
        upto = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        return (upto[ends] - upto[ends - lengths]).tolist()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def transducer(path: str) -> Transducer:
    """One transducer a process and vocabulary; what it compiles outlives a task."""
    return Transducer(scores(path))


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of a text (null: 0)."""

    @F.pandas_udf("long")
    def counted(texts):
        import pandas as pd

        return pd.Series(transducer(path).counts([t or "" for t in texts]), dtype="int64")

    return counted(text.cast("string"))


def with_counts(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` and the number of tokens of each whole text. Narrow: no shuffle."""
    prepare(docs.sparkSession)
    return docs.withColumn(out, token_count(F.col(text_col), path))


def report(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every document."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = with_counts(picked, path)
    return found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
