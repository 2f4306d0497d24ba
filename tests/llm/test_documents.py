"""Document operators against brute force, round trips and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from panelkit.llm import byte_bpe, packing, quality, sharding, simhash, similar, word_bpe
from panelkit.llm.common import attach, gapless_rank, min_label_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard int, slot string, fp string, length string"
LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [(0, None), (1, ""), (2, "  \n "), (3, "one"), (4, "One"), (5, "one two three four five"), (5, "one two three four five"), (6, LONG), (None, "no id"), (7, "n"), (8, "n"), (9, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows):
    ids, fps = [i for i, _ in rows], [f for _, f in rows]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return Counter((ids[i], fps[i], least.get(find(i))) for i in range(len(ids)))


def test_near_duplicates_equal_brute_force(docs, odd):
    for df in (docs, odd):
        want = _components([(r["doc_id"], _fingerprint(r["text"])) for r in df.collect()])
        got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect())
        assert got == want


def test_keep_first_keeps_one_row_of_each_group(docs, odd):
    for df in (docs, odd):
        marked = simhash.near_duplicates(df)
        kept = simhash.keep_first(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in marked.select("component_id").distinct().collect()), key=str)


def test_links_split_large_buckets_and_lose_none(spark):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 2**62))
    fps = sorted({base ^ sum(1 << int(b) for b in r.choice(64, 5, replace=False)) for _ in range(400)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = min_label_components(simhash.links(df, bucket=32))
    got = {r["node"] % (1 << 64): r["label"] % (1 << 64) for r in found.collect()}
    want = _components([(i, f) for i, f in enumerate(fps)])
    groups = {}
    for (i, f, c), _ in want.items():
        groups.setdefault(c, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_gray_index_finds_every_pair():
    r = np.random.default_rng(2)
    x = np.unique(r.integers(0, 2**14, 3000).astype(np.uint64) << np.uint64(25))
    index = simhash.GrayIndex(x)
    i, j = index.pairs(0, len(x), 4)
    assert len(index.levels) >= 3
    want = np.triu(np.bitwise_count(index.fps[:, 0, None] ^ index.fps[None, :, 0]) <= 4, 1)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(want))))
    assert (np.diff(simhash.gray_rank(index.fps[:, 0]).astype(object)) > 0).all()


@pytest.mark.parametrize("words, distance, n, buckets", [(1, 4, 3000, 40), (4, 80, 500, 3), (1, 4, 5, 5), (1, 64, 70, 2), (1, 4, 1, 1), (1, 4, 0, 1)])
def test_gray_index_keeps_buckets_apart(words, distance, n, buckets):
    r = np.random.default_rng(3)
    fps = r.integers(0, 2**63, (max(1, n // 10), words)).astype(np.uint64)[r.integers(0, max(1, n // 10), n)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << r.integers(0, 64, (n, words)).astype(np.uint64))
    bucket, got = r.integers(0, buckets, n), set()
    index = simhash.GrayIndex(fps, bucket)
    for lo, hi in index.blocks():
        i, j = index.pairs(lo, hi, distance)
        got |= {tuple(sorted(x)) for x in zip(index.order[i].tolist(), index.order[j].tolist())}
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) if n else np.zeros((0, 0))
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= distance, 1))) if bucket[i] == bucket[j]}


def test_every_link_comes_from_the_gray_index(monkeypatch):
    """With an index that finds nothing there is no link at all, however small a bucket is."""
    fps = np.array([1, 3, 31 << 40], np.uint64)
    assert len(simhash.local_links(fps, fps, 4)[0]) == 1
    monkeypatch.setattr(simhash.GrayIndex, "pairs", lambda self, lo, hi, distance: (np.zeros(0, np.int64),) * 2)
    assert len(simhash.local_links(fps, fps, 4)[0]) == 0


def test_buckets_of_one_group_make_few_edges(spark, monkeypatch):
    """Sixty nodes of one group meet in twenty buckets in different company: rounds join few rows a node."""
    from panelkit.llm import common

    r = random.Random(3)
    edges = [(m[0], x) for _ in range(20) for m in [r.sample(range(60), 40)] for x in m]
    tables, held = [], common.written
    monkeypatch.setattr(common, "written", lambda df: tables.append(held(df)) or tables[-1])
    got = {x["node"]: x["label"] for x in min_label_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(60), 0)
    assert tables[0].count() > 2 * tables[1].count() > 0


def test_a_bucket_group_links_to_its_least_name():
    fps = np.array([7, 3, 1, 5], np.uint64)
    u, v = simhash.local_links(np.array([40, 10, 30, 20]), fps, 4)
    assert sorted(zip(u.tolist(), v.tolist())) == [(20, 10), (30, 10), (40, 10)]


def test_alike_sets_equal_brute_force():
    r = np.random.default_rng(4)
    for _ in range(20):
        sets = [np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert {x for i, j in similar.alike(sets) for x in zip(i.tolist(), j.tolist())} == want


def test_attach_and_components_with_a_hot_key(spark):
    big = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("k"), "id")
    facts = spark.createDataFrame([(1, "a"), (250, "b")], "k long, x string")
    got = Counter(r["x"] for r in attach(big, facts, "k", ["id"], "left").collect())
    assert got == {"a": 200, "b": 1, None: 99}
    star = spark.range(1, 400).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    assert {r["label"] for r in min_label_components(star).collect()} == {0}


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, "a b c d e f", "x", 5, "m", True), (2, "a b c d e f", "y", 6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string, key int, label string, none boolean")
    for keep in (simhash.keep_first, similar.keep_first):
        kept = keep(df)
        assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == rows[:1]
        assert keep(df.where("doc_id > 5")).count() == 0


@pytest.mark.parametrize("count", [1, 10**8, 10**13])
def test_any_close_pair_shares_a_block_key(count):
    r = random.Random(3)
    masks = [int(m) for m in simhash.block_keys(4, count)]
    for _ in range(200):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "u long, v long")
    got = {r["node"]: r["label"] for r in min_label_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_gapless_rank(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    rows = gapless_rank(df, ["k"], ["id"], 16, "r").collect()
    for k in {r["k"] for r in rows}:
        assert sorted(r["r"] for r in rows if r["k"] == k) == list(range(sum(r["k"] == k for r in rows)))


ALPHABET = ["'", "s", "t", "re", "v", "ll", " ", "  ", "\n", "a", "1", "é", "é", "!", "中", "́", "😀", "\xa0", "S", "٣", "Σ", "İ", "ing", "ẞ", "\x1c", "\x85", "<|endoftext|>"]


def _random_texts(n):
    r = random.Random(4)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_byte_bpe_equals_the_library(docs):
    import tiktoken

    bpe = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [*_random_texts(4000), *(r["text"] for r in docs.collect()), "", "'", "a'", LONG]
    for run in byte_bpe.portions(texts, 3000):
        for text, ids in zip(run, bpe.encode(run)):
            assert ids.tolist() == library.encode_ordinary(text)
            assert bpe.decode(ids) == text.encode()


def test_long_texts_are_encoded_in_parts_as_a_whole():
    bpe, r = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(60, 200)))
        assert bpe.encode([text], most=r.randint(1, 30))[0].tolist() == bpe.encode([text])[0].tolist()
        assert "".join(byte_bpe.parts(text, 7)) == text
    assert max(map(len, byte_bpe.parts("word " * 1000, 50))) <= 60


def test_byte_bpe_digests_and_round_trip(odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.codec(path).ranks, special_tokens={})
    ids = {t: np.array(library.encode_ordinary(t or ""), "<u4") for _, t in ODD}
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.digests(odd, path).collect())
    assert got == Counter((i, len(ids[t]), hashlib.sha256(ids[t].tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    back = byte_bpe.decode(byte_bpe.encode(odd, path), path, out="again")
    assert all(r["again"] == (r["text"] or "") and r["slot"] == "x" for r in back.collect())


def test_word_bpe_equals_the_library(docs):
    bpe = word_bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*_random_texts(4000), *(r["text"] for r in docs.collect())]
    for text, want in zip(texts, bpe.library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want.ids


def test_packing_holds_every_piece_once_without_gaps(docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    bpe = word_bpe.codec(path)
    for df in (docs, odd):
        rows = packing.pack_documents(df, path).collect()
        want = Counter()
        for r in df.collect():
            ids = bpe.encode(r["text"] or "") + b"\1\0\0\0"
            for k, lo in enumerate(range(0, len(ids), 4 * 4096)):
                want[r["doc_id"], k, lo // 4, len(ids[lo : lo + 4 * 4096]) // 4, zlib.crc32(ids[lo : lo + 4 * 4096])] += 1
        assert Counter(tuple(r)[:5] for r in rows) == want
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 4096
        total = sum(r["length"] for r in rows)
        assert len(bins) <= -(-total // 4096) + 1


def test_plan_fills_gaps_exactly_and_uses_the_counts():
    r = np.random.default_rng(5)
    for cap, kinds in ((20, 6), (100, 30), (4096, 900)):
        counts = np.zeros(cap + 1, np.int64)
        np.add.at(counts, r.integers(1, cap + 1, kinds), r.integers(1, 50, kinds))
        used = np.zeros(cap + 1, np.int64)
        fillings = packing.plan(counts, cap)
        for filling, copies in fillings:
            assert sum(x * n for x, n in filling) <= cap
            for x, n in filling:
                used[x] += n * copies
        assert (used == counts).all()
    one = np.zeros(11, np.int64)
    one[[2, 3, 5, 9, 1, 7]] = 1
    assert sorted(sum(x * n for x, n in f) for f, _ in packing.plan(one, 10)) == [7, 10, 10]


def test_shards_differ_by_one_row_and_keep_copies_together(docs, odd, spark):
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "hot").when(F.col("id") < 300, F.concat(F.lit("p"), (F.col("id") % 25).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    for df in (docs, odd, many):
        rows = sharding.assign(df).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        shards = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(40)}
        assert all(v == list(range(len(v))) for v in shards.values())
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    where = {}
    for r in rows:
        where.setdefault(r["text_crc32"], []).append(r["shard"])
    assert len(set(where[zlib.crc32(b"hot")])) <= 18  # 200 rows; a shard holds 15
    assert sum(len(set(where[zlib.crc32(f"p{i}".encode())])) == 1 for i in range(25)) >= 20


def _pairs_cut(rows, links):
    of_text, of_id = {}, {}
    for r in rows:
        of_text.setdefault(r["text_crc32"], []).append(r["shard"])
        of_id[r["doc_id"]] = r["shard"]
    copies = sum(a != b for v in of_text.values() for i, a in enumerate(v) for b in v[:i])
    return copies + sum(of_id[u] != of_id[v] for u, v in links)


def test_linked_documents_move_to_their_neighbours(spark):
    """Chains of ten linked documents and pairs of copies, besides unlinked ones."""
    df = spark.range(800).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60, F.concat(F.lit("p"), (F.col("id") % 30).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    pairs = [(i, i + 1) for i in range(100, 300) if i % 10 != 9]
    links = spark.createDataFrame([*pairs, pairs[0][::-1], (5, 5), (7, 10**6)], "u long, v long")
    report = {}
    rows = sharding.assign(df, links=links, report=report).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes.values()) == {20} and len(sizes) == 40
    first = [{"doc_id": r["doc_id"], "text_crc32": r["text_crc32"], "shard": s} for r, s in zip(rows, (x["s"] for x in spark.createDataFrame([(r["doc_id"],) for r in rows], "i long").select(F.pmod(F.xxhash64("i"), F.lit(40)).alias("s")).collect()))]
    assert report["pairs"] == len(pairs) + 30 and report["cut_before"] == _pairs_cut(first, pairs)
    assert report["cut_after"] < 0.5 * report["cut_before"] and _pairs_cut(rows, pairs) <= report["cut_after"] + 5


def test_quality_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(d, labels).where("held_out").join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.93


def test_quality_learns_nothing_from_the_held_out_fold(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    flipped = [spark.createDataFrame([(i, int(x if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2)) for i in range(60)], "doc_id long, quality int") for x in (0, 1)]
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(d, y).collect()} for y in flipped)
    assert a == b


def test_quality_odd_rows(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, none).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert quality.keep_good(odd, none).columns == odd.columns


def test_quality_counts_a_repeated_id_once_and_keeps_what_is_scored_well(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    often = d.unionByName(d.where("doc_id = 3").withColumn("n_chars", F.explode(F.array_repeat("n_chars", 50))))
    scored = {(r["doc_id"]): r["predicted"] for r in quality.classify(d, labels).collect()}
    kept = Counter(r["doc_id"] for r in quality.keep_good(often, labels).collect())
    assert kept == Counter({i: 51 if i == 3 else 1 for i, p in scored.items() if p})


def test_flat_trees_equal_a_node_by_node_walk():
    r = np.random.default_rng(6)
    x = r.random((400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=10, depth=3)
    for row, got in zip(x[:50], model.score(x[:50])):
        total = model.start
        for feature, cuts, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[feature[node]] > cuts[node])
            total += leaf[node - 7]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert simhash.near_duplicates(none).count() == 0
    assert byte_bpe.digests(none, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    assert packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert sharding.assign(none).count() == 0
    assert quality.classify(none, labels).count() == 0


def _similar_groups(rows):
    """Groups of rows (id, text) by exact similarity of five-word shingles, as sorted lists."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s or {b""} for j in holders.setdefault(x, [])}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                root[find(i)] = find(j)
        for x in s or {b""}:
            holders[x].append(i)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def _first(group):
    return min(group, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else ""))


def test_pipeline_links_every_pair_of_similarity_four_fifths(spark, odd):
    r = random.Random(9)
    made = []
    for k in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([30, 100, 400]))]
        made.append(" ".join(words))
        for _ in range(2):  # edits by which about a tenth of the shingles differ
            edited = words[:]
            for p in r.sample(range(len(words)), max(1, len(words) // 50)):
                edited[p] = "edited" + str(r.random())
            made.append(" ".join(edited))
    planted = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    tables = (planted, odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for df in tables:
        groups = _similar_groups([(x["doc_id"], x["text"]) for x in df.collect()])
        kept = Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.near_dedup(spark, df, SF).collect())
        assert kept == Counter(map(_first, groups))
    assert len(_similar_groups(list(enumerate(made)))) < 120


def test_chained_groups_fall_apart_into_buckets(spark, monkeypatch):
    """Texts that slide on: neighbours are candidates, few are alike. Groups are bounded, nothing is lost."""
    r = random.Random(11)
    made = []
    for chain in range(3):
        words = [f"c{chain}w{i}" for i in range(2000)]
        at = 0
        for _ in range(60):
            made.append(" ".join(words[at : at + 60]))
            at += r.choice([4, 5, 6, 7, 12])
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want = Counter(map(_first, _similar_groups(list(enumerate(made)))))
    assert 10 < len(want) < len(made)
    monkeypatch.setattr(similar, "CHUNK", 64)  # a set or two a chunk: the chains' groups are over 36 chunks
    dealt = []
    plain = similar._dealt
    monkeypatch.setattr(similar, "_dealt", lambda near, met: dealt.append((near.groupBy("label").sum("n").toPandas()["sum(n)"].max(), plain(near, met))) or dealt[-1][1])
    assert Counter((x["doc_id"], x["text"]) for x in similar.keep_first(df).collect()) == want
    largest, groups = dealt[0]
    assert largest > 64 * similar.BANDS and max(x["parts"] for x in groups.collect()) <= similar.BANDS


def test_triples_are_indexed_by_their_sums():
    r = np.random.default_rng(3)
    counts = np.zeros(65, np.int64)
    counts[1:] = r.integers(0, 3, 64)
    stock = packing._Stock(counts)
    while stock.has.any():
        left = np.flatnonzero(stock.has)
        want = Counter(int(a + b + c) for a in left for b in left for c in left)
        assert all(stock.triple[s] == want[s] for s in range(65))
        stock.take(int(r.choice(left)), 1)


@pytest.mark.parametrize("keep", [simhash.keep_first, similar.keep_first])
def test_different_texts_under_null_and_repeated_ids_stay(spark, keep):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, words[2]), (3, words[3]), (3, words[4]), (5, words[4]), (4, words[5])]
    got = keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(None, words[0]), (None, words[1]), (None, words[2]), (3, words[3]), (3, words[4]), (4, words[5])])
