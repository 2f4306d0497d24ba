"""Approximate nearest neighbours by an inverted multi-index.

Each half of a unit vector is quantised by its own centroids, so a cell is a pair of centroids.
A query walks the pairs by summed distance with a heap until the cells walked hold its
candidate budget, and the candidates are ranked again by exact cosine. Centroids are fitted on a
bounded sample; every row is indexed.

The budget is measured, not guessed: for a bounded sample of queries the true neighbours are found among all
rows, and the budget is the walk's length that reaches the wanted share of them. So data with clusters get
short walks, data without any long ones, and the recall is about ``recall`` at every size.

Equal vectors are one entry of the index that holds the few smallest ids, which is exact:
they tie everywhere. Cells are dealt in chunks of bounded size, and a chunk goes out once for each
bounded block of the queries that visit it; a query meets rows of the cells it visits only.

Defined cases: null, zero and non-finite vectors, and vectors of another length than most
(the commonest, the longer of two), take no part; fewer candidates than k give fewer rows;
equal scores go to the smaller id; repeated ids count as one row per vector; rows without id can't be named and take no
part; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: At most so many vectors are fitted on: those with the smallest hash of their id.
SAMPLE = 16_384
CENTROIDS = 64
#: The share of true neighbours that the budget is to reach, and how many queries it is measured on.
RECALL, PROBES = 0.95, 256
CHUNK = 4_096
QUERIES = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, v as doubles) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where((F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def common_length(rows: DataFrame) -> int:
    """The commonest vector length, the longer of two as common; 0 without rows."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(1))[:, None]


def cells_in_order(near1: np.ndarray, near2: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
    """Cells i * k + j by near1[i] + near2[j], until they hold ``budget`` entries."""
    a, b, k = np.argsort(near1, kind="stable"), np.argsort(near2, kind="stable"), len(near2)
    heap, out, held = [(near1[a[0]] + near2[b[0]], 0, 0)], [], 0
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (near1[a[i]] + near2[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (near1[a[i + 1]] + near2[b[0]], i + 1, 0))
    return out


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision: a vector's score depends on the two vectors alone."""
    q, x = q / np.abs(q).max(1, keepdims=True), x / np.abs(x).max(1, keepdims=True)
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def walk_lengths(near1: np.ndarray, near2: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many entries a query's walk holds once it has taken each of ``cells``."""
    far = (near1[:, None] + near2[None, :]).ravel()
    order = np.argsort(far, kind="stable")
    held = np.empty(len(far), np.int64)
    held[order] = np.cumsum(sizes[order])
    return held[cells]


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, ties at the last one included."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, -k, axis=1)[:, -k][:, None] - 1e-9


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, centroids: int = CENTROIDS, recall: float = RECALL, sample: int = SAMPLE, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (ids divisible by ``every``)."""
    spark = vectors.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col, nonzero=True)
    d = common_length(rows)
    if d == 0:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == d)
    # One entry for equal vectors, with the k + 1 smallest ids (a query isn't its own candidate).
    by_vector = Window.partitionBy("v").orderBy("id")
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).drop("r")
    few = few.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    entries = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    half = max(1, d // 2)
    fitted = entries.orderBy(F.xxhash64(F.element_at("ids", 1)), F.element_at("ids", 1)).limit(sample).select("v").toArrow()["v"]
    x = unit(matrix(fitted, d))
    size = max(1, min(centroids, int(np.sqrt(len(x)))))
    c1, c2 = _kmeans(x[:, :half], size), _kmeans(x[:, half:] if d > 1 else x, size)
    shared = spark.sparkContext.broadcast((c1, c2))

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = unit(x)
        return _distances(u[:, :half], shared.value[0]), _distances(u[:, half:] if d > 1 else u, shared.value[1])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = halves(matrix(b.column(0), d)) if b.num_rows else (np.zeros((0, 1)),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((n1.argmin(1) * size + n2.argmin(1)).astype(np.int32))], ["v", "ids", "cell"])

    index = cut(entries.mapInArrow(put, "v array<double>, ids array<long>, cell int"))
    sizes = np.zeros(size * size, np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # centroids squared at most
        sizes[cell] = n
    queries = cut(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct())
    # The budget, from the true neighbours of a bounded number of queries among all rows.
    tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(probes).toArrow()
    asked, asked_id = matrix(tried["q"], d) if tried.num_rows else np.zeros((0, d)), tried["query_id"].to_numpy()
    shared_asked = spark.sparkContext.broadcast((unit(asked) if len(asked) else asked, asked_id))

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, ids = shared_asked.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            s = u @ unit(matrix(b.column(0), d)).T
            alone = b.column(1).value_lengths().to_numpy() == 1
            first = b.column(1).flatten().to_numpy()[np.cumsum(b.column(1).value_lengths().to_numpy()) - b.column(1).value_lengths().to_numpy()]
            s[(first[None, :] == ids[:, None]) & alone[None, :]] = -np.inf  # a query's own entry
            i, j = np.nonzero(best_of(s, k) & np.isfinite(s))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s[i, j]), pa.array(b.column(2).to_numpy()[j])], ["i", "score", "cell"])

    of_query = Window.partitionBy("i").orderBy(F.desc("score"), "cell")
    found = index.mapInArrow(true, "i long, score double, cell int").withColumn("r", F.row_number().over(of_query)).where(F.col("r") <= k).select("i", "cell").toArrow()
    near1, near2 = halves(asked) if len(asked) else (np.zeros((0, 1)),) * 2
    of, cell_of = found["i"].to_numpy(), found["cell"].to_numpy()
    lengths = [walk_lengths(near1[i], near2[i], sizes, cell_of[of == i]) for i in range(len(asked))]
    lengths = np.concatenate([np.zeros(0, np.int64), *lengths])
    budget = int(np.quantile(lengths, recall, method="higher")) if len(lengths) else 1
    # Cells are gathered into bundles of about a chunk, large ones cut into several, by sizes alone.
    parts = np.maximum(1, -(-sizes // CHUNK))
    bundle, held, number = np.zeros(size * size, np.int64), 0, 0
    for cell in range(size * size):
        if held and held + sizes[cell] > CHUNK:
            number, held = number + 1, 0
        bundle[cell] = number
        held += int(sizes[cell])
    shared_sizes = spark.sparkContext.broadcast((sizes, bundle, parts))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bundle, parts = shared_sizes.value
        for whole in batches:
            for b in (whole.slice(i, 32) for i in range(0, whole.num_rows, 32)):
                q, to, most, cells = [], [], [], []
                for i, (near1, near2) in enumerate(zip(*halves(matrix(b.column(1), d)))):
                    got = np.array(cells_in_order(near1, near2, sizes, budget))
                    for name in np.unique(bundle[got]):
                        mine = got[bundle[got] == name]
                        q.append(i)
                        to.append(int(name))
                        most.append(int(parts[mine].max()))
                        cells.append(mine.astype(np.int32))
                at = pa.array(q, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(to, pa.int64()), pa.array(most, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "q", "bundle", "parts", "cells"])

    sent = cut(queries.repartition("query_id").mapInArrow(walk, "query_id long, q array<double>, bundle long, parts int, cells array<int>"))
    # How many blocks of queries visit a bundle: centroids squared rows at most.
    visits = {r["bundle"]: -(-r["count"] // QUERIES) for r in sent.groupBy("bundle").count().collect()}
    blocks = spark.createDataFrame([(int(b), int(n)) for b, n in visits.items()], "bundle long, blocks int")
    table = spark.createDataFrame([(int(c), int(bundle[c]), int(parts[c]), visits.get(int(bundle[c]), 0)) for c in np.flatnonzero(sizes)], "cell int, bundle long, parts int, blocks int")
    sent = sent.join(F.broadcast(blocks), "bundle").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held_rows = index.join(F.broadcast(table.where("blocks > 0")), "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        right = right.sort_values("cell", kind="stable")
        q, x = np.stack(left["q"]), np.stack(right["v"])
        cell, ids = right["cell"].to_numpy(), right["ids"].to_numpy()
        uq, ux = unit(q), unit(x)
        visitors = np.repeat(np.arange(len(left)), left["cells"].map(len).to_numpy())
        visited = np.concatenate(left["cells"].to_list())
        by = np.argsort(visited, kind="stable")
        visitors, visited = visitors[by], visited[by]
        near: list[list] = [[] for _ in range(len(left))]
        for c in np.unique(visited):  # a cell's rows meet the queries that visit it
            lo, hi = np.searchsorted(cell, [c, c + 1])
            a, b = np.searchsorted(visited, [c, c + 1])
            if lo == hi:
                continue
            s = uq[visitors[a:b]] @ ux[lo:hi].T
            for r, m in zip(*np.nonzero(best_of(s, k + 1))):
                near[visitors[a + r]].append((s[r, m], lo + m))
        out = []
        for i, (qid, got) in enumerate(zip(left["query_id"], near)):
            if not got:
                continue
            s, m = np.array([g[0] for g in got]), np.array([g[1] for g in got])
            m = m[best_of(s[None], k + 1)[0]]
            exact = cosine(np.broadcast_to(q[i], (len(m), d)), x[m])
            pairs = [(-v, int(c)) for v, r in zip(exact.tolist(), m.tolist()) for c in ids[r] if c != qid]
            out += [(qid, c, -v) for v, c in heapq.nsmallest(k, pairs)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    key = ["bundle", "part", "qb"]
    sent, held_rows = (x.select([F.col(c).alias(c) for c in (*key, *more)]) for x, more in ((sent, ("query_id", "q", "cells")), (held_rows, ("cell", "v", "ids"))))
    scored = sent.groupBy(*key).cogroup(held_rows.groupBy(*key)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
