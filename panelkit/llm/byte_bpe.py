"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts becomes one array of code points. A class table gives letters, digits,
white space and the rest. Boundaries come from a finite automaton over symbols (the class,
with what the next code points decide): each symbol is a function from state to state,
functions compose associatively, so the array is cut into blocks whose functions are composed
column by column, block totals are combined by a doubling scan, and a last pass replays
each block from its known first state. No regular expression is run. Slices between
boundaries are looked up in a bounded cache, and only new slices are merged.

Defined cases: null counts as empty; empty gives no ids; any valid text decodes to its own
bytes; repeated rows are encoded each; other columns stay as they are; an empty table gives no rows. A batch is worked on in runs of bounded
length. A longer text is encoded in parts that begin with white space behind other text: a slice always begins
there, whatever surrounds it. Only a text without such a place in reach makes longer parts.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# States: what kind of slice is open when the next code point comes.
START, LETTER, DIGIT, OTHER, SPACE, HELD, LAST1, LAST2 = range(8)
# Symbols.
S_LETTER, S_DIGIT, S_OTHER, S_APOS1, S_APOS2, S_SPACE, S_BLANK_LAST, S_SPACE_LAST = range(8)
#: Unicode's White_Space. Fixed values.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLOCK = 128
CACHE_LIMIT = 400_000


@functools.cache
def _classes() -> np.ndarray:
    """0 letter, 1 digit, 2 other, 5 white space, by code point."""
    import regex

    text = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.full(sys.maxunicode + 1, S_OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", S_LETTER), (r"\p{N}+", S_DIGIT)):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = value
    table[[ord(c) for c in WHITE_SPACE]] = S_SPACE
    return table


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]: does a slice begin at this code point?"""
    step, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    plain = {S_LETTER: LETTER, S_DIGIT: DIGIT, S_OTHER: OTHER, S_APOS1: OTHER, S_APOS2: OTHER}
    for state in range(8):
        for sym in range(8):
            if sym in plain:
                kind = plain[sym]
                if state in (LAST1, LAST2):  # inside a contraction
                    step[sym, state] = START if state == LAST1 else LAST1
                elif state == HELD or state == kind:
                    step[sym, state] = kind
                else:
                    begins[sym, state] = True
                    step[sym, state] = {S_APOS1: LAST1, S_APOS2: LAST2}.get(sym, kind)
            elif sym == S_SPACE:  # more white space follows, or the text ends
                begins[sym, state], step[sym, state] = state != SPACE, SPACE
            elif sym == S_BLANK_LAST:  # the run's last, not U+0020: a slice by itself
                begins[sym, state], step[sym, state] = True, START
            else:  # the run's last, U+0020: it opens the slice that follows
                begins[sym, state], step[sym, state] = True, HELD
        # Symbols from 8 on: the same at a text's first code point, whatever came before.
    for sym in range(8):
        step[sym + 8], begins[sym + 8] = step[sym, START], True
    return step, begins


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that runs of symbols can amount to, numbered from the identity on.

    after[f * 16 + symbol]: f, then the symbol; times[f, g]: f, then g; apply[f, state].
    """
    step = _automaton()[0]
    number = {tuple(range(8)): 0}
    found = list(number)
    after: list[int] = []
    for f in found:  # grows while it is walked, until closed
        for sym in range(16):
            g = tuple(int(step[sym, x]) for x in f)
            if g not in number:
                number[g] = len(found)
                found.append(g)
            after.append(number[g])
    apply = np.array(found, np.intp)
    times = np.array([[number[tuple(int(g[x]) for x in f)] for g in found] for f in found], np.intp)
    return np.array(after, np.intp), times, apply


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a slice begins. points: code points of all texts; firsts: where texts begin."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    sym = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    space = sym == S_SPACE
    follows = np.zeros(n, bool)  # a non-space of the same text follows
    follows[:-1] = ~space[1:] & ~first[1:n]
    last = space & follows
    sym[last] = np.where(points[last] == 32, S_SPACE_LAST, S_BLANK_LAST)
    apos = np.flatnonzero(points == 39)
    if len(apos):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[apos + 1], padded[apos + 2]
        one = np.where(first[np.minimum(apos + 1, n)], 0, one)
        two = np.where((one == 0) | first[np.minimum(apos + 2, n)], 0, two)
        sym[apos[np.isin(one, [ord(c) for c in "stmd"])]] = S_APOS1
        pair = np.zeros(len(apos), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        sym[apos[pair]] = S_APOS2
    sym[firsts[firsts < n]] += 8
    after, times, apply = _monoid()
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, S_OTHER, np.intp)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # a column of blocks at a time
    total = np.zeros(rows, np.intp)  # element 0 is the identity
    for k in range(BLOCK):
        total = after.take((total << 4) + grid[k])
    shift = 1  # doubling scan: total[i] becomes all functions of blocks 0 to i, composed
    while shift < rows:
        total[shift:] = times[total[:-shift], total[shift:]]
        shift *= 2
    state = np.concatenate([[START], apply[total[:-1], START]]).astype(np.intp)
    step, begins = (x.ravel() for x in _automaton())
    step = step.astype(np.intp)
    starts = np.empty((BLOCK, rows), bool)
    for k in range(BLOCK):
        at = (grid[k] << 3) + state
        starts[k] = begins.take(at)
        state = step.take(at)
    return starts.T.ravel()[:n]


class ByteBPE:
    """Ranks of a byte-level vocabulary, with a bounded cache of merged slices."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.cache: dict[bytes, bytes] = {}

    def encode(self, texts: list[str], most: int = 1 << 20) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(texts) == 1 and len(texts[0]) > most:
            return [np.concatenate([self._encode([part])[0] for part in parts(texts[0], most)])]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = "".join(texts)
        points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        begins = np.flatnonzero(boundaries(points, firsts))
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        buf = raw.encode("utf-8", "surrogatepass")
        cuts = at[begins].tolist()
        cuts.append(len(buf))
        cache = self.cache
        if len(cache) > CACHE_LIMIT:
            cache.clear()
        pieces = [buf[a:b] for a, b in zip(cuts, cuts[1:])]
        got = list(map(cache.get, pieces))
        for i in [i for i, ids in enumerate(got) if ids is None]:
            piece = pieces[i]
            got[i] = ids = cache.get(piece) or np.array(self.merge(piece), "<u4").tobytes()
            if len(piece) <= 64:
                cache[piece] = ids
        place = np.searchsorted(begins, np.concatenate([firsts, [len(points)]])).tolist()
        return [np.frombuffer(b"".join(got[lo:hi]), "<u4") for lo, hi in zip(place, place[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str) -> ByteBPE:
    """One codec a process and vocabulary; its cache outlives a task."""
    return ByteBPE(path)


_TURN = re.compile(rf"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")


def parts(text: str, most: int) -> Iterator[str]:
    """A long text in parts of ``most`` code points or a little more, cut before white space only."""
    at = 0
    while at < len(text):
        turn = _TURN.search(text, at + most)
        end = turn.start() if turn else len(text)
        yield text[at:end]
        at = end


def portions(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` code points; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. Narrow: no shuffle."""
    prepare(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for run in portions([t or "" for t in batch.column(1).to_pylist()]):
                for ids in bpe.encode(run):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of each whole text (array of long)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def ids(texts):
        import pandas as pd

        bpe = codec(path)
        return pd.Series([x.astype(np.int64) for run in portions([t or "" for t in texts]) for x in bpe.encode(run)], dtype=object)

    return docs.withColumn(out, ids(F.col(text_col).cast("string")))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All columns of ``docs`` and the text that the ids stand for (null ids: empty)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        bpe = codec(path)
        return pd.Series([bpe.decode(np.asarray([] if x is None else x, np.int64)).decode("utf-8", "replace") for x in ids], dtype=object)

    return docs.withColumn(out, text(F.col(ids_col)))
