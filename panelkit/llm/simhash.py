"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints are made a document at a time (bytes in, 64 bits out). Linking works on the
distinct fingerprints only. The index's uppermost nodes are masks of some blocks of bits with
the bits found there: any two fingerprints within the distance agree on one mask at least
(pigeonhole), so each is dealt to its node of every mask, and nodes are what tasks work on. Below,
a node's members are sorted by Gray rank and grouped, level by level; a node holds the bits
that all its members share, as (mask, bits). A child's mask adds to its parent's, so a query adds
up differences on the way down and drops a whole group once they exceed the distance. Every link
comes from that descent, however few members a node has.

Defined cases: a null or empty text has no shingle and fingerprint 0, which links like any
other; fewer words than a shingle make one shingle of the whole sequence; equal rows share
a fingerprint; doc_id null stays a row, never a component's name unless all ids are null; very long texts are hashed
in portions; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, min_label_components, prepare

BITS = 64
#: A bucket with more members than this is worked on in pairs of chunks of this size.
BUCKET = 4096
LEAF = 16
#: So many rows are linked at a time at least, and so many pairs of a query and a node held.
RUN, HELD = 1 << 14, 1 << 20
_XX_SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str | None, shingle: int, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in their order, in portions; none without a word."""
    buf = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not buf:
        return
    spaces = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    n = len(spaces) + 1
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(buf)]])
    if n >= shingle:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), step):
        a, b = starts[i : i + step].tolist(), ends[i : i + step].tolist()
        yield np.fromiter((digest(buf[x:y], _XX_SEED) for x, y in zip(a, b)), np.uint64, len(a))


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows (n, words) have each bit set, lowest bit of the first word first."""
    rows = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    at = rows + np.arange(rows.shape[1], dtype=np.intp) * 256
    often = np.bincount(at.ravel(), minlength=rows.shape[1] * 256).reshape(-1, 256)  # how often a byte has a value
    return np.rint(often @ _BYTE_BITS).astype(np.int64).ravel()


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint's words: a bit is 1 if set in over half of n."""
    return np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = 4, step: int = 1 << 16) -> int:
    """The SimHash of a text, unsigned."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, shingle, step):
        counts += ones(h)
        n += len(h)
    return int(majority(counts, n)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, mark_col: str | None = None) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. ``mark_col`` is carried along as mark."""
    prepare(docs.sparkSession)
    names = ["doc_id", "fp", *(["mark"] if mark_col else [])]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(mark_col).alias("mark")] if mark_col else []))
    return picked.mapInArrow(made, "doc_id long, fp long" + (", mark string" if mark_col else ""))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``counts``, one behind the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class GrayIndex:
    """The hierarchical index over many buckets of fingerprints at once, a root each.

    fps: (n, words); bucket: (n,), equal numbers together or not. ``order`` says which input row
    stands at each place of the index.
    """

    def __init__(self, fps: np.ndarray, bucket: np.ndarray | None = None, leaf: int = LEAF, fan: int = LEAF):
        fps = fps[:, None] if fps.ndim == 1 else fps
        bucket = np.zeros(len(fps), np.int64) if bucket is None else bucket
        self.order = np.lexsort((*(gray_rank(w) for w in fps.T[::-1]), bucket))
        self.fps, own = fps[self.order], bucket[self.order]
        #: By level, leaves first: masks, bits, the first child of each node (and an end), the last place below it.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        high, low, last, step = self.fps, ~self.fps, np.arange(len(fps)), leaf
        while len(high):
            fresh = np.concatenate([[True], own[1:] != own[:-1]])
            begin = np.flatnonzero(fresh)
            at = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
            cuts = np.flatnonzero(at % step == 0)
            first = np.append(cuts, len(own))
            high, low = np.bitwise_and.reduceat(high, cuts), np.bitwise_and.reduceat(low, cuts)
            last, own = last[first[1:] - 1], own[cuts]
            self.levels.append((high | low, high, first, last))
            step = fan
            if len(begin) == len(cuts):  # every bucket has its root
                self.root = np.repeat(np.arange(len(own)), np.diff(np.concatenate([[-1], last])))
                break

    def pairs(self, lo: int, hi: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j), i < j, of one bucket, with i in [lo, hi), whose fingerprints are close."""
        q = np.arange(lo, hi)
        if not self.levels:
            return q[:0], q[:0]
        mask, bits, first, _ = self.levels[-1]
        nodes = self.root[q]
        acc = np.bitwise_count((self.fps[q] ^ bits[nodes]) & mask[nodes]).sum(1, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            up, _, first, _ = self.levels[depth]
            keep = acc <= distance
            q, nodes, acc = q[keep], nodes[keep], acc[keep]
            n = first[nodes + 1] - first[nodes]
            child, parent = np.repeat(first[nodes], n) + _spread(n), np.repeat(nodes, n)
            q, acc = np.repeat(q, n), np.repeat(acc, n)
            behind = (child if depth == 0 else self.levels[depth - 1][3][child]) > q
            child, parent, q, acc = child[behind], parent[behind], q[behind], acc[behind]
            if depth == 0:
                acc = acc + np.bitwise_count((self.fps[q] ^ self.fps[child]) & ~up[parent]).sum(1, dtype=np.int64)
            else:
                m, b = self.levels[depth - 1][:2]
                acc = acc + np.bitwise_count((self.fps[q] ^ b[child]) & m[child] & ~up[parent]).sum(1, dtype=np.int64)
            nodes = child
        keep = acc <= distance
        return q[keep], nodes[keep]

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Runs of places whose queries can hold about HELD pairs at most, if nothing is pruned."""
        n, lo = len(self.fps), 0
        sizes = np.bincount(self.root)[self.root] if n else np.zeros(0, np.int64)
        total = np.cumsum(sizes * self.fps.shape[1]) if n else sizes
        while lo < n:
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HELD, side="right"))
            hi = max(hi, lo + 1)
            yield lo, hi
            lo = hi


def spanning(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first place of the group of each of n places, for links (i, j) that come in portions."""
    label = np.arange(n)
    for i, j in found:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def local_links(names: np.ndarray, fps: np.ndarray, distance: int, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links within buckets: (name, its group's least name).

    It keeps which fingerprints of a bucket are connected, and nothing is left out of that. Buckets that share a group
    name one root, so that their links are the same ones.
    """
    index = GrayIndex(fps, bucket)
    label = spanning(len(names), (index.pairs(lo, hi, distance) for lo, hi in index.blocks()))
    names = names[index.order]
    least = names.copy()
    np.minimum.at(least, label, names)
    least = least[label]
    moved = np.flatnonzero(names != least)
    return names[moved], least[moved]


def block_keys(distance: int, count: int, width: int = 2048) -> list[np.ndarray]:
    """Masks of which any two fingerprints within ``distance`` share one at least.

    The bits are cut into b blocks; at most ``distance`` blocks differ, so b - distance agree.
    The smallest b is taken whose buckets hold ``width`` fingerprints on average, or fewer.
    """
    for b in range(distance + 1, distance + 5):
        edges = np.linspace(0, BITS, b + 1).astype(int)
        blocks = [sum(1 << k for k in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
        agree = b - distance
        masks = [sum(c) for c in combinations(blocks, agree)]
        if count / 2 ** min(m.bit_count() for m in masks) <= width:
            break
    return [np.uint64(m) for m in masks]


def _signed(x: int) -> int:
    return int(x) - (1 << 64) if int(x) >= 1 << 63 else int(x)


def in_chunks(members: DataFrame, key: list[str], name: str, bucket: int) -> DataFrame:
    """``members`` with ``part``: buckets over the bound are dealt in pairs of chunks.

    With one chunk there is one part; with m, each pair of chunks sees both whole, so any two
    members meet, and a member stands in m - 1 parts.
    """
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket)
    sizes = cut(sizes.select(*key, F.ceil(F.col("_n") / bucket).cast("int").alias("_m")))
    if sizes.isEmpty():
        return members.withColumn("part", F.lit(0).cast("long"))
    columns = members.columns
    own = F.pmod(F.xxhash64(name), F.col("_m")).cast("int")
    dealt = members.join(sizes, key, "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    dealt = dealt.select(*columns, "_m", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_other"))
    pair = F.when(F.col("_m") == 1, 0).otherwise(F.least("_own", "_other") * F.col("_m") + F.greatest("_own", "_other"))
    return dealt.where("_m = 1 or _own <> _other").select(*columns, pair.cast("long").alias("part"))


def bucket_links(members: DataFrame, key: list[str], name: str, words: list[str], distance: int, bucket: int = BUCKET) -> DataFrame:
    """Spanning links (u, v) among the members (``name``, a long) of each bucket.

    ``key``: longs that tell buckets apart; ``words``: the fingerprint, 64 bits a long. Distinct rows.
    """
    key_n = len(key) + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            fresh = (rows[1:, :key_n] != rows[:-1, :key_n]).any(1)
            place = np.concatenate([[0], np.cumsum(fresh)])
            many = (np.bincount(place) > 1)[place]
            rows, place = rows[many], place[many]
            u, v = local_links(rows[:, key_n], rows[:, key_n + 1 :].view(np.uint64), distance, place)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            n += batch.num_rows
            if n < RUN:
                continue
            rows = np.concatenate(held)
            same = (rows[:, :key_n] == rows[-1, :key_n]).all(1)
            end = int(np.argmin(same[::-1]))  # rows of the last bucket, which may go on
            if not same.all():
                yield out(rows[: n - end])
                rows = rows[n - end :]
            held, n = [rows], len(rows)
        if held:
            yield out(np.concatenate(held))

    dealt = in_chunks(members.select(*key, name, *words), key, name, bucket).select(*key, "part", name, *words)
    return dealt.repartition(*key, "part").sortWithinPartitions(*key, "part").mapInArrow(found, "u long, v long")


def links(fps: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Spanning links (u, v) among distinct fingerprints (column fp)."""
    masks = block_keys(distance, max(fps.count(), 1))
    table = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(table).alias("t")).select("fp", F.col("t.k").alias("k"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("val"), F.col("fp").alias("word"))
    return bucket_links(dealt, ["k", "val"], "fp", ["word"], distance, bucket)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable)."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    # What a fingerprint's documents share goes by way of (fp, salt): no task holds a hot one's rows.
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = min_label_components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    linked = cut(labels.join(distinct, "fp"))
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    named = cut(attach(linked, least, "label", ["fp"]).select("fp", "least"))
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return attach(marked, named, "fp", ["doc_id"]).select("doc_id", "fp", "component_id")


def text_mark(text_col: str = "text") -> Column:
    """What tells texts apart, never null."""
    return F.coalesce(F.md5(F.encode(F.col(text_col).cast("string"), "UTF-8")), F.lit(""))


def keep_one(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each label: the smallest id (nulls last), then the smallest mark.

    ``labelled`` holds doc_id, mark and label, a row a document; only doc_id may be null. It is read
    twice. Rows of the same id and text are one document; only those are shuffled to choose one.
    """
    # Null ids compare equal through two plain keys; a document's own columns travel in a struct.
    on = ["none", "key", "mark"]
    own = F.col("doc_id")
    keyed = labelled.select("label", own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("key"), "mark")
    stay = keyed.groupBy("label").agg(F.min(F.struct(*on)).alias("s")).select("s.*")
    again = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    stay = cut(stay.join(again, on))
    own = F.col(id_col).cast("long")
    rows = docs.select(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("key"), text_mark(text_col).alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(stay, on)
    once = kept.where("n = 1").select("row")
    more = kept.where("n > 1").groupBy(*on).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(more).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The documents that stay: of each component, the one with the smallest id."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_mark(text_col).alias("mark"))
    marked = cut(fingerprints(picked, "doc_id", "text", shingle, "mark"))
    labels = min_label_components(links(marked.select("fp").distinct(), distance)).withColumnRenamed("node", "fp")
    labelled = attach(marked, labels, "fp", ["doc_id", "mark"], "left").select("doc_id", "mark", F.coalesce("label", "fp").alias("label"))
    return keep_one(docs, cut(labelled), id_col, text_col)


def hex_digits(fp: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
