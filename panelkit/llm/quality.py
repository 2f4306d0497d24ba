"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes a short vector of statistics of its whole text (never its id, language,
source or labels). Trees are grown level by level on binned values from gradient
histograms, on a bounded sample of labelled rows, and flattened into arrays (feature, cut, child)
that are walked for a whole batch of documents at once.

Defined cases: a null or empty text has all statistics 0 and still gets a score; without
any labelled row, or with labels of one kind only, every score is that share (0.5 without rows); a null id
gets a score and is never learnt from; repeated ids are scored each; statistics are of whole texts whatever their
length; an empty table gives no rows; ``classify`` doesn't read other columns, ``keep_good`` keeps them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

#: At most so many labelled rows are fitted on: those with the smallest hash of their id.
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
_MARKS = b"|#$%&*!?.,;:\"'()<>{}[]/\\=_-@+"
FEATURES = 21 + len(_MARKS)
_SEGMENT = 4096


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)] + [0, 0, 0]
    lines = raw.split(b"\n")
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    tens = [len(set(words[i : i + 100])) / len(words[i : i + 100]) for i in range(0, len(words), 100)] or [0.0]
    same = sum(a == b for a, b in zip(words, words[1:])) / k
    full = [x for x in lines if x.strip()]
    out[:21] = (
        np.log1p(n), np.log1p(k), lengths.mean(), lengths.std(), lengths.max(), len(counts) / k, pairs, same,
        top[0] / k, sum(top[:3]) / k, np.mean(tens), np.min(tens), len(full) / k * 100, len(set(full)) / max(len(full), 1),
        hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[128:].sum(), hist[32], hist[10],
        sum(w[-1:] in (b".", b"!", b"?") for w in words) / k,
    )
    out[21:] = hist[list(_MARKS)]
    return out


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (the statistics), read off each whole text. Narrow: no shuffle."""
    prepare(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([statistics(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, FEATURES), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "x"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(made, "doc_id long, x array<float>")


@dataclass
class Trees:
    """Trees of one depth, flattened: node i of a tree has children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # go right above it
    leaf: np.ndarray  # (trees, 2 ** depth)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for a batch, a level of a tree at a time for all rows."""
        total, row = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, cuts, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cuts[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Grow trees on the logistic loss with histograms of gradients and hessians."""
    share = float(y.mean()) if len(y) else 0.5
    empty = Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0)
    if share in (0.0, 1.0) or not len(y):
        empty.start = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return empty
    x = x.astype(np.float64)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    wide = binned + np.arange(x.shape[1]) * bins
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    inner, features, cuts, leaves = 2**depth - 1, [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, feature, cut_at = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (x.shape[1] * bins) + wide).ravel()
            size = width * x.shape[1] * bins
            G, H = (np.bincount(at, np.repeat(v, x.shape[1]), size).reshape(width, x.shape[1], bins).cumsum(2) for v in (g, h))
            gt, ht = G[:, :1, -1:], H[:, :1, -1:]
            gain = G**2 / (H + ridge) + (gt - G) ** 2 / (ht - H + ridge) - gt**2 / (ht + ridge)
            gain[(H < least) | (ht - H < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, i = divmod(b, bins)
                if gain[k, j, i] > 1e-9 and i < len(edges[j]):
                    feature[first + k], cut_at[first + k] = j, edges[j][i]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut_at[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[at]
        features.append(feature)
        cuts.append(cut_at)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), start)


def held_out(doc_id):
    """True for the fold that no label is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def chosen(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of the rows that are fitted on: outside the held-out fold, at most ``sample``."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def train(features: DataFrame, rows: DataFrame) -> Trees:
    """Fit on the ``chosen`` rows' statistics; an id that stands for several documents counts once."""
    # The chosen rows are bounded by their parameter, so is one row an id of them.
    found = features.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    found = found.orderBy("doc_id").select("x", "y").toArrow()
    x = found["x"].combine_chunks()
    x = (x.flatten() if len(x) else pa.array([], pa.float32())).to_numpy().reshape(-1, FEATURES)
    return fit(x, found["y"].to_numpy().astype(np.float64))


def score(features: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES)
            p = shared.value.score(x)
            fold = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fold), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return features.select("doc_id", "x").mapInArrow(made, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of all documents by a model learnt from ``labels``."""
    features = cut(featurise(docs))
    return score(features, train(features, chosen(labels, sample)), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns. Training looks at the chosen rows' documents only."""
    rows = cut(chosen(labels, sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")  # whatever else the documents hold
    model = train(featurise(texts.join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi")), rows)
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype=bool)
        return pd.Series(shared.value.score(np.stack([statistics(t) for t in texts])) >= threshold)

    return docs.where(good(F.col("text").cast("string")))
