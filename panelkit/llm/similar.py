"""Near-duplicates by the similarity of their sets of word shingles, confirmed exactly.

A text's set holds the hashes of its shingles (five words); texts of one set are one node.
A set has a SimHash of 256 bits, as 64 can't tell a similarity of 0.8 from 0.5, and the Gray-order
index links nodes whose fingerprints differ in at most 80 bits: a pair of similarity 0.8 or more
differs in 48 on average at worst (sets of 4 and 5), so one in ten millions is missed. No block of bits
survives so many differences, so here the index's uppermost nodes are bands of min-hashes: with 36
bands of 5, such a pair shares none with a chance of (1 - 0.8^5)^36 < 1e-6.

Those links only gather candidates: connected nodes go to one place, each set once, and there all
pairs' shared shingles are counted; a pair of similarity 0.8 is a link. Groups too large for a task are
dealt in pairs of chunks. Loose links may chain texts that are not alike into one group: a group of more chunks than there are
bands falls apart into the bands' buckets, whose members are nearly alike, so that no set is sent
more often than that and no pair is counted for a chain's sake. Counting costs the square of a group of texts that are nearly alike,
at some nanoseconds a pair and shared shingle; what is shuffled and returned grows with the texts alone.

Defined cases: null texts and texts without a word are one group; fewer words than a shingle make one
shingle of the whole sequence; null and repeated ids see ``simhash.keep_one``; very long texts are hashed in portions;
an empty table gives no rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, min_label_components, prepare
from .simhash import bucket_links, keep_one, majority, ones, shingle_hashes, spanning, text_mark

SHINGLE = 5
#: The least similarity, as a fraction: compared in whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 36, 5
#: Words of a set's fingerprint, and how many bits of alike sets may differ.
WORDS, DISTANCE = 4, 80
#: Candidates are compared in chunks of about so many shingles.
CHUNK = 1 << 20
_RANDOM = np.random.default_rng(0)
_XOR, _ODD = (_RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) for _ in range(2))
_ODD |= np.uint32(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    """A signed name of a set; 0 for the empty one."""
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64)) if len(hashes) else 0


def band_keys(hashes: np.ndarray, step: int = 512) -> np.ndarray:
    """One key a band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = hashes.astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    work = np.empty((BANDS * ROWS, min(step, len(low))), np.uint32)
    for i in range(0, len(low), step):
        part = work[:, : min(step, len(low) - i)]
        np.bitwise_xor(low[i : i + step], _XOR, out=part)
        np.multiply(part, _ODD, out=part)
        np.minimum(least, part.min(1), out=least)
    return np.array([xxhash.xxh3_64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def wide_fingerprint(hashes: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The SimHash of a set: WORDS signed longs. The words' bits come of the hashes by mixing."""
    counts = np.zeros(WORDS * 64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += ones(part ^ (part >> np.uint64(31)))
    return majority(counts, len(hashes)).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, sid, n, keys, w0, w1, ...), a row a document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            wide = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, WORDS)
            cells = [batch.column(0), batch.column(1), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _lists([band_keys(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([*cells, *map(pa.array, wide.T.copy())], ["doc_id", "mark", "sid", "n", "keys", *_WIDE])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(made, "doc_id long, mark string, sid long, n int, keys array<long>, " + ", ".join(f"{w} long" for w in _WIDE))


_WIDE = [f"w{i}" for i in range(WORDS)]


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(sid, label, part, hashes) of the texts that ``wanted`` (mark, label, parts) names."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), *batch.columns[1:], _lists([s.view(np.int64) for s in sets])], ["sid", "label", "part", "hashes"])

    picked = docs.select(text_mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    # One of a text's documents is enough; a chunk pair sees a set once.
    picked = picked.join(wanted, "mark").select("text", "label", "parts")
    own = F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")
    dealt = picked.select("text", "label", "parts", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).where("parts = 1 or own <> other")
    pair = F.when(F.col("parts") == 1, 0).otherwise(F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    return dealt.select("text", "label", pair.cast("long").alias("part")).mapInArrow(made, "sid long, label long, part long, hashes array<long>")


def alike(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of sets whose similarity is LEAST or more, a row i at a time."""
    n = np.array([len(s) for s in sets])
    # From the largest set on: a row need only look at sets that aren't too small for it.
    order = np.argsort(-n, kind="stable")
    size, place = n[order], np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    tokens, holder = np.concatenate(sets), np.repeat(place, n)
    by = np.lexsort((holder, tokens))
    tokens, holder = tokens[by], holder[by]
    begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(tokens)))
    token = np.repeat(np.arange(len(begin)), count)
    shared = count[token] > 1
    at = np.flatnonzero(shared)
    rows = at[np.argsort(holder[at], kind="stable")]  # places of the shared tokens, row by row
    cuts = np.searchsorted(holder[rows], np.arange(len(n) + 1))
    for r in range(len(n)):
        mine = rows[cuts[r] : cuts[r + 1]]
        if not len(mine):
            continue
        # A token's holders are sorted, so those behind r are the rest of its run.
        ends = begin[token[mine]] + count[token[mine]]
        lengths = ends - mine - 1
        behind = holder[np.repeat(mine + 1, lengths) + _run(lengths)]
        if not len(behind):
            continue
        last = int(np.searchsorted(-size, -(size[r] * LEAST[0] / LEAST[1]), side="right"))
        both = np.bincount(behind, minlength=len(n))[r:last]
        near = np.flatnonzero(both * LEAST[1] >= (size[r] + size[r:last] - both) * LEAST[0]) + r
        near = near[near > r]
        if len(near):
            i, j = np.broadcast_to(order[r], len(near)), order[near]
            yield np.minimum(i, j), np.maximum(i, j)


def _run(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _confirmed(sets: DataFrame) -> DataFrame:
    """Spanning links (u, v) of the alike sets of each (label, part)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            names, first = np.unique(np.array(sids, np.int64), return_index=True)
            label = spanning(len(names), alike([held[i] for i in first])) if len(names) > 1 else np.arange(len(names))
            moved = np.flatnonzero(label != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["u", "v"])

        now, sids, held = None, [], []
        for batch in batches:
            for sid, label, part, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if (label, part) != now and sids:
                    yield out(sids, held)
                    sids, held = [], []
                now = (label, part)
                sids.append(sid)
                held.append(hashes.values.to_numpy())
        if sids:
            yield out(sids, held)

    return sets.repartition("label", "part").sortWithinPartitions("label", "part").mapInArrow(found, "u long, v long")


def _dealt(near: DataFrame, met: DataFrame) -> DataFrame:
    """(mark, label, parts): the groups in which sets are compared, and over how many chunks each is dealt.

    near: (sid, mark, label, n), the candidates' groups; met: (sid, key), the bands' buckets.
    """
    def sized(groups: DataFrame) -> DataFrame:
        parts = groups.groupBy("label").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("parts"))
        return cut(attach(groups, cut(parts), "label", ["sid"]))

    groups = sized(near.select("sid", "mark", "n", "label"))
    large = groups.where(F.col("parts") > BANDS)
    if large.isEmpty():
        return groups.select("mark", "label", "parts")
    buckets = attach(met, cut(large.select("sid", "mark", "n", "label")), "sid", ["key"])
    buckets = sized(cut(buckets.select("sid", "mark", "n", F.xxhash64("label", "key").alias("label"))))
    return groups.where(F.col("parts") <= BANDS).unionByName(buckets).select("mark", "label", "parts")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, mark of its text, sid, label (the component's least sid)."""
    prepare(docs.sparkSession)
    marked = cut(_marked(docs, id_col, text_col))
    # Nodes that meet nobody are told by their bands' keys alone; the others' fingerprints are indexed.
    nodes = marked.groupBy("sid").agg(F.min("mark").alias("mark"), F.min("n").alias("n"))
    dealt = marked.select("sid", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y").select("key")
    met = cut(dealt.join(shared, "key", "left_semi").distinct())
    if met.isEmpty():
        return marked.select("doc_id", "mark", "sid", F.col("sid").alias("label"))
    wide = marked.join(met.select("sid").distinct(), "sid", "left_semi").select("sid", *_WIDE).dropDuplicates(["sid"])
    near = min_label_components(bucket_links(attach(met, cut(wide), "sid", ["key"]), ["key"], "sid", _WIDE, DISTANCE))
    near = cut(near.withColumnRenamed("node", "sid").join(nodes, "sid"))
    wanted = _dealt(near, met)
    labels = min_label_components(_confirmed(_sets(docs, cut(wanted), text_col))).withColumnRenamed("node", "sid")
    return attach(marked.select("doc_id", "mark", "sid"), labels, "sid", ["doc_id", "mark"], "left").select("doc_id", "mark", "sid", F.coalesce("label", "sid").alias("label"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component, the one with the smallest id."""
    return keep_one(docs, cut(components(docs, id_col, text_col).select("doc_id", "mark", "label")), id_col, text_col)
