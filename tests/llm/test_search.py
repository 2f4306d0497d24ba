"""Vector searches against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from panelkit.llm import block_max, multi_index

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, id string, v int"
ODD = [
    (0, [1.0, 0.0], "a", 1), (50, [0.0, 2.0], None, 2), (100, [0.0, 0.0], "b", None), (1, [1.0, 1.0], "c", 3), (2, [2.0, 2.0], "c", 3), (3, None, "d", 4),
    (4, [float("nan"), 1.0], "e", 5), (5, [None, 1.0], "f", 6), (6, [1.0], "g", 7), (7, [-1.0, 0.5], "h", 8), (8, [1.0, 0.0], "i", 9), (8, [1.0, 0.0], "i", 9), (150, [1.0, 0.0], "j", 9), (None, [3.0, 3.0], "k", 1),
]


def _brute(ids, x, k, score):
    out = {}
    for i, q in zip(ids, x):
        if i % 50 == 0:
            s = sorted((-score(q, c), j) for j, c in zip(ids, x) if j != i)[:k]
            out[i] = [(j, -v) for v, j in s]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def _cos(q, c):
    return float(q @ c / np.sqrt(q @ q) / np.sqrt(c @ c))


def _table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    return t["vec_id"].tolist(), np.stack(t["embedding"]).astype(np.float64)


def test_multi_index_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, x = _table(spark)
    want, at = _brute(ids, x, 5, _cos), dict(zip(ids, x))
    got = _got(multi_index.nearest(df))
    assert got.keys() == want.keys()
    assert all(abs(_cos(at[q], at[c]) - s) < 1e-12 for q, found in got.items() for c, s in found)
    hit = sum(len({c for c, _ in got[q]} & {c for c, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("spread", [None, 0.3])
def test_multi_index_recall_at_shipped_settings(spark, spread, tmp_path):
    """50,000 vectors: without any clusters, and in 500 of them with a hot vector."""
    r = np.random.default_rng(1)
    x = r.standard_normal((50_000, 32)) if spread is None else r.standard_normal((500, 32))[r.integers(0, 500, 50_000)] + spread * r.standard_normal((50_000, 32))
    if spread is not None:
        x[20_001:35_000] = x[20_000]
    column = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": column}), tmp_path / "v.parquet", row_group_size=10_000)
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = _got(multi_index.nearest(df))
    u = x / np.sqrt((x * x).sum(1))[:, None]
    s = u[::50] @ u.T
    s[np.arange(1000), np.arange(0, 50_000, 50)] = -2
    fifth = np.sort(s, 1)[:, -5]
    assert len(got) == 1000 and all(len(v) == 5 for v in got.values())
    hit = sum(score >= fifth[q // 50] - 1e-12 for q, found in got.items() for _, score in found)
    assert hit >= 0.9 * 5 * 1000


def test_walk_lengths_are_those_of_the_heap():
    r = np.random.default_rng(2)
    a, b, sizes = r.random(6), r.random(6), r.integers(1, 4, 36)
    for cell, length in enumerate(multi_index.walk_lengths(a, b, sizes, np.arange(36)).tolist()):
        walked = multi_index.cells_in_order(a, b, sizes, length)
        assert walked[-1] == cell and sizes[walked].sum() == length


def test_heap_walks_cells_by_summed_distance():
    r = np.random.default_rng(0)
    a, b, sizes = r.random(7), r.random(7), r.integers(0, 4, 49)
    order = np.argsort((a[:, None] + b[None, :]).ravel())
    assert multi_index.cells_in_order(a, b, sizes, 10**9) == [c for c in order.tolist() if sizes[c]]


@pytest.mark.parametrize("op", ["cosine", "product"])
def test_odd_rows_and_ties(spark, op):
    df = spark.createDataFrame(ODD, SCHEMA)
    keep = [(i, np.array(e, np.float64)) for i, e, *_ in ODD if i is not None and e is not None and len(e) == 2 and None not in e and np.isfinite(e).all() and (any(e) or op == "product")]
    ids, x = zip(*dict((i, (i, v)) for i, v in keep).values())
    if op == "cosine":
        got, want = _got(multi_index.nearest(df)), _brute(ids, x, 5, lambda q, c: round(_cos(q, c), 12))
        assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items()}
    else:
        got, want = _got(block_max.top_products(df, size=3)), _brute(ids, [np.floor(256 * v).astype(int) for v in x], 5, lambda q, c: int(q @ c))
        assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert multi_index.nearest(none).count() == 0
    assert block_max.top_products(none).count() == 0


def test_block_max_is_exact(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, x = _table(spark)
    want = _brute(ids, [np.floor(256 * v).astype(np.int64) for v in x], 5, lambda q, c: int(q @ c))
    assert _got(block_max.top_products(df, size=100)) == want


def test_block_max_prunes_what_cannot_reach_the_bar():
    x = np.repeat(np.array([[1, 1], [100, 100]]), 64, 0)
    q = np.array([[1, 1]])
    seen = []
    product = block_max._product
    block_max._product = lambda a, b: (seen.append(b.shape), product(a, b))[1]
    try:
        [(_, s, ids)] = block_max.search_range(q, np.array([-1]), np.array([150]), x, np.arange(128), 5)
    finally:
        block_max._product = product
    assert s.tolist() == [200] * 5 and ids.tolist() == [64, 65, 66, 67, 68]
    assert seen[2:] == [(64, 2)]  # the first two are the bounds
