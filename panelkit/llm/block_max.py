"""Exact top-k search by inner product with block-at-a-time pruning.

Documents in the order of their nearest centroid (fitted on a bounded sample; it only sets the order) are cut
into ranges, and a range into small blocks, so that a block's documents are alike. A range's forward
index holds its integer vectors; each block keeps every term's (dimension's) largest and
smallest value, so a block's bound for a query is the sum of the better product per term. A query
takes a range's blocks by falling bound and scores them through the forward index until
the next bound is below its k-th score. Its threshold to start with comes from its own
range, where its like stand; a whole range whose bounds all fall below it is never joined. Queries are gathered in that
order too, so that those of one block need the same ranges. Data without clusters leave little to prune: then
nearly every range is scored, and the result is the same.

Defined cases: null vectors, vectors with null or non-finite components, and vectors of
another length than the commonest take no part; equal rows count once; equal scores go to
the smaller id; fewer candidates than k give fewer rows; rows without id can't be named and take no part; an empty table gives
no rows; other columns are not read. Components are taken as
floor(scale * x); scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare
from .multi_index import _distances, _kmeans, common_length, matrix, usable

RANGE = 4_096
BLOCK = 64
STEP = 8
QUERIES = 256
CHUNK = 1_024
#: At most so many vectors are fitted on, and so many centroids set the order.
SAMPLE, CENTROIDS = 16_384, 64
#: Queries of so many neighbouring partitions of ranges go together.
TOGETHER = 3
_LOWEST = np.iinfo(np.int64).min


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer q @ x.T: by doubles where every sum stays below 2 ** 53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    if top < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): no vector within [low, high] scores more."""
    return _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_range(q: np.ndarray, own: np.ndarray, bar: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: (row, scores, ids) of its best in one range, at or over ``bar``.

    own: each query's id, which is no candidate of its own.
    """
    cuts = np.arange(0, len(x), block)
    bounds = _bounds(q, np.maximum.reduceat(x, cuts), np.minimum.reduceat(x, cuts))
    out = []
    for i in np.flatnonzero(bounds.max(1) >= bar).tolist():
        order = np.argsort(-bounds[i], kind="stable")
        scores, found, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), int(bar[i])
        for at in range(0, len(order), STEP):
            blocks = order[at : at + STEP]
            blocks = blocks[bounds[i, blocks] >= kth]
            if not len(blocks):
                break
            rows = (blocks[:, None] * block + np.arange(block)).ravel()
            rows = rows[rows < len(x)]
            s = _product(q[i], x[rows])
            keep = (s >= kth) & (ids[rows] != own[i])
            scores, found = _best(np.concatenate([scores, s[keep]]), np.concatenate([found, ids[rows[keep]]]), k)
            if len(scores) == k:
                kth = max(kth, int(scores[-1]))
        if len(scores):
            out.append((i, scores, found))
    return out


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, size: int = RANGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest of every query (ids divisible by ``every``)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors, id_col, vec_col, nonzero=False)
    d = common_length(rows)
    if d == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == d).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()
    rows = cut(rows)
    parts = max(1, -(-rows.count() // size))
    fitted = matrix(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"], d).astype(np.float64)
    shared = spark.sparkContext.broadcast(_kmeans(fitted, max(1, min(CENTROIDS, parts, len(fitted)))) if len(fitted) else np.zeros((1, d)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _distances(matrix(b.column(1), d).astype(np.float64), shared.value).argmin(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["id", "v", "near"])

    rows = cut(rows.mapInArrow(put, "id long, v array<long>, near int"))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _ranges(batches, size):
            x, ids = matrix(table.column(1), d), table.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([x.max(0)]), pa.array([x.min(0)])], ["ids", "x", "high", "low"])

    index = rows.repartitionByRange(parts, "near", "id").sortWithinPartitions("near", "id").select("id", "v").mapInArrow(built, "ids binary, x binary, high array<long>, low array<long>")
    index = cut(index.withColumn("range", F.monotonically_increasing_id()))

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, raw_ids, raw in zip(*(c.to_pylist() for c in b.columns)):
                ids, x = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw, "<i8").reshape(-1, d)
                own = np.flatnonzero(ids % every == 0)
                bar = np.full(len(own), _LOWEST)
                for i, scores, _ in search_range(x[own], ids[own], bar.copy(), x, ids, k):
                    if len(scores) == k:
                        bar[i] = scores[-1]
                # The range's number is its partition's, shifted by 33 bits, and its place there.
                block = ((at >> 33) // TOGETHER << 20) + np.arange(len(own)) // QUERIES
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(bar), pa.array(list(x[own]), pa.list_(pa.int64())), pa.array(block, pa.int64())], ["query_id", "bar", "q", "qb"])

    queries = cut(index.select("range", "ids", "x").mapInArrow(started, "query_id long, bar long, q array<long>, qb long"))
    bundle = queries.groupBy("qb").agg(F.collect_list(F.struct("query_id", "bar", "q")).alias("qs"))
    bundle = cut(bundle.select("qb", F.col("qs.query_id").alias("qids"), F.col("qs.bar").alias("bars"), F.flatten("qs.q").alias("q")))
    # Which ranges a block of queries must see, by the ranges' own bounds, a chunk of ranges at a time.
    chunks = max(1, -(-index.count() // CHUNK))
    summary = index.select(F.pmod(F.xxhash64("range"), F.lit(chunks)).cast("int").alias("chunk"), "range", "high", "low").groupBy("chunk")
    summary = summary.agg(F.collect_list(F.struct("range", "high", "low")).alias("rs"))
    summary = summary.select("chunk", F.col("rs.range").alias("ranges"), F.flatten("rs.high").alias("high"), F.flatten("rs.low").alias("low"))
    seen = bundle.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(summary, "chunk")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qb, ranges = [], []
            for i in range(b.num_rows):
                bars, q, rs, high, low = (np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in range(1, 6))
                q, high, low = (v.reshape(-1, d) for v in (q, high, low))
                hit = rs[(_bounds(q, high, low) >= bars[:, None]).any(0)]
                ranges += hit.tolist()
                qb += [b.column(0)[i].as_py()] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(qb, pa.int64()), pa.array(ranges, pa.int64())], ["qb", "range"])

    pairs = seen.select("qb", "bars", "q", "ranges", "high", "low").mapInArrow(needed, "qb long, range long")
    work = pairs.join(bundle, "qb").join(index.select("range", "ids", "x"), "range").select("qids", "bars", "q", "ids", "x")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qids, bars, q = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(3))
                ids, x = np.frombuffer(b.column(3)[i].as_py(), np.int64), np.frombuffer(b.column(4)[i].as_py(), "<i8").reshape(-1, d)
                found = search_range(q.reshape(-1, d), qids, bars, x, ids, k)
                columns = [np.concatenate([np.full(len(s), qids[j]) for j, s, _ in found]), *(np.concatenate([f[c] for f in found]) for c in (2, 1))] if found else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = work.mapInArrow(scored, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Runs of ``size`` rows of a partition; the last may be shorter."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        while sum(x.num_rows for x in held) >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size).combine_chunks()
            held = table.slice(size).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()
