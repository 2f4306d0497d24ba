"""Best-fit packing of token sequences with exact-complement hashing.

Packing depends on lengths alone, and there are at most ``capacity`` of them. So a plan is
made over the histogram of lengths: a sequence's gap is filled exactly by one, two or three
available lengths where any such sum is indexed, else by the best fit, and each filling is
repeated as often as the counts allow. Pieces then take their places by their rank among
the pieces of the same length. The plan holds at most a few entries per length, whatever
the number of documents.

Defined cases: null text is empty; an empty document is its end mark alone; repeated rows
are packed each; a document over ``capacity`` tokens is cut into full pieces and a last one, whatever its length; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless_rank, prepare
from .word_bpe import codec

CAPACITY = 4096
END_ID = 1
SALTS = 512


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    prepare(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = codec(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(text.as_py() or "") + end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    for column, x in zip(rows, (doc_id, k, lo // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(made, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """How many pieces of each length are left, with the index of sums."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.has = self.left > 0
        #: pair[s]: ordered pairs of available lengths that sum to s.
        self.pair = np.rint(np.fft.irfft(np.fft.rfft(self.has.astype(float), 4 * len(counts)) ** 2, 4 * len(counts)))[: 2 * len(counts)].astype(np.int64)

        # Triples by their sum, likewise: in how many ways three lengths that are left add up to it.
        self.triple = np.rint(np.fft.irfft(np.fft.rfft(self.has.astype(float), 4 * len(counts)) ** 3, 4 * len(counts)))[: len(counts)].astype(np.int64)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] == 0:
            # (h - e)^3 = h^3 - 3 h^2 e + 3 h e^2 - e^3, where e is the length that goes.
            size = len(self.triple)
            self.triple[length:] -= 3 * self.pair[: size - length]
            if 2 * length < size:
                self.triple[2 * length :] += 3 * self.has[: size - 2 * length]
            if 3 * length < size:
                self.triple[3 * length] -= 1
            self.has[length] = False
            others = np.flatnonzero(self.has)
            self.pair[others + length] -= 2
            self.pair[2 * length] -= 1

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three lengths that are left besides ``used`` and sum to gap."""

        def enough(*lengths: int) -> bool:
            return all(self.left[x] >= used.get(x, 0) + lengths.count(x) for x in set(lengths))

        if gap < len(self.has) and self.has[gap] and enough(gap):
            return (gap,)
        two = self._pair(gap, (), enough)
        if two:
            return two
        if gap >= len(self.triple) or not self.triple[gap]:
            return None
        top = min(gap - 2, len(self.has) - 1)
        if top < 1:
            return None
        third = np.flatnonzero(self.has[1 : top + 1] & (self.pair[gap - top : gap][::-1] > 0)) + 1
        for a in third[np.argsort(-self.left[third], kind="stable")].tolist():
            three = self._pair(gap - a, (a,), enough)
            if three:
                return three
        return None

    def _pair(self, gap: int, with_: tuple[int, ...], enough) -> tuple[int, ...] | None:
        if gap < 2 or gap >= len(self.pair) or not self.pair[gap]:
            return None
        lo, hi = max(1, gap - len(self.has) + 1), gap // 2
        a = np.arange(lo, hi + 1)
        a = a[self.has[a] & self.has[gap - a]]
        a = a[np.argsort(-np.minimum(self.left[a], self.left[gap - a]), kind="stable")]
        return next(((*with_, x, gap - x) for x in a.tolist() if enough(*with_, x, gap - x)), None)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings [(length, times), ...] and how many sequences take each.

    counts[l]: pieces of length l, for l from 0 to capacity.
    """
    stock, fillings = _Stock(counts), []
    while stock.has.any():
        largest = int(np.flatnonzero(stock.has)[-1])
        used, gap = {largest: 1}, capacity - largest
        while gap > 0:
            combination = stock.exact(gap, used) if gap <= 3 * largest else None
            if combination:
                for x in combination:
                    used[x] = used.get(x, 0) + 1
                break
            fit = np.flatnonzero(stock.has[: gap + 1])
            x = next((int(x) for x in fit[::-1] if stock.left[x] > used.get(int(x), 0)), None)
            if x is None:
                break
            times = int(max(1, min(stock.left[x] - used.get(x, 0), (gap - 3 * largest) // x)))
            used[x] = used.get(x, 0) + times
            gap -= times * x
        copies = int(min(stock.left[x] // n for x, n in used.items()))
        fillings.append((sorted(used.items(), reverse=True), copies))
        for x, n in used.items():
            stock.take(x, n * copies)
    return fillings


def places(fillings: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: from (length, rank) to sequence and offset."""
    rows, taken, sequence = [], {}, 0
    for filling, copies in fillings:
        offset = 0
        for x, n in filling:
            rows.append((x, taken.get(x, 0), n, sequence, offset))
            taken[x] = taken.get(x, 0) + n * copies
            offset += x * n
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "sequence", "offset"), table.T.copy()))


def pack(parts: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """All columns of ``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = cut(parts)
    # At most `capacity` rows: a histogram, whatever the number of documents.
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():
        counts[length] = n
    shared = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    ranked = gapless_rank(parts, ["length"], ["doc_id", "piece", "ids_crc32"], salts, "_at")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table["length"] << 46) + table["first"]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_at"))
            row = np.searchsorted(key, (length << 46) + rank, side="right") - 1
            copy, slot = np.divmod(rank - table["first"][row], table["times"][row])
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table["sequence"][row] + copy), pa.array(table["offset"][row] + slot * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_at")
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(pieces(docs, path, capacity), capacity)
