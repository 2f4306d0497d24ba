"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from panelkit.llm import spelling
from panelkit.llm.queries import LLM_QUERIES

LONG = "wonderful wonderfull marvellous " * 30_000


def _brute_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for m in re.finditer("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in m.group())
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def _distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute_forms(n):
    near = {w: [] for w in n}
    words = sorted(n)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for size in (len(w), len(w) + 1):
            for v in by_length.get(size, ()):
                if (size > len(w) or v > w) and _distance_one(w, v):
                    near[w].append(v)
                    near[v].append(w)
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in words}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in words}


def _rows(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_op13_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = _brute_forms(_brute_counts(docs))
    got = _rows(LLM_QUERIES["op13_spelling"](spark, sf))
    assert got == want and any(x[1] for x in got)


def _crowd(seed, n=700):
    """Words that share halves, with chains of forms and ties."""
    r = random.Random(seed)
    stems = ["international", "aaaaaaa", "aaaaaaaa", "überfälle", "interne"]
    words = {}
    for i in range(n):
        w = list(r.choice(stems))
        for _ in range(r.choice([1, 1, 2, 3])):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1])] = r.choice(["", "x", "y", "a", "é"])
        if len(w) >= 7:
            words["".join(w)] = r.choice([2, 3, 30, 31, 400, 400, 5000])
    return words | {"chainaaa": 2, "chainaab": 20, "chainabb": 200, "chainbbb": 2000, "chainbbbb": 20_000}


def test_hot_segments_are_dealt_over_parts_and_lose_no_link(spark, monkeypatch):
    words = _crowd(1)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = _brute_forms(words)
    assert _rows(spelling.forms(df)) == want
    monkeypatch.setattr(spelling, "HOT", 20)
    assert _rows(spelling.forms(df)) == want
    found = spelling.links(df).collect()
    assert len(found) == len({(r["word"], r["near"]) for r in found}) == sum(x[4] for x in want)
    assert {x[0]: x[2] for x in want}["chainaaa"] == "chainbbbb"


def test_indexed_owners_equal_plain_ones(monkeypatch):
    words = _crowd(2)
    shard = [(second, w[len(w) // 2 :] if second else w[: len(w) // 2], w, n) for w, n in words.items() for second in (False, True)]
    plain = {w: sorted(spelling.Shard(shard).near(w)) for w in words}
    monkeypatch.setattr(spelling, "INDEXED", 10_000)
    assert {w: sorted(spelling.Shard(shard).near(w)) for w in words} == plain
    assert list(spelling.Shard([]).near("anything")) == []


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("ab", "abc", True), ("abc", "acb", False), ("", "a", True), ("", "", False), ("abc", "a", False)])
def test_one_edit(a, b, near):
    assert spelling.one_edit(a, b) is near


def test_words_have_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "  \n 12345678 "), (4, "Größere größere GRÖßERE"), (5, "naïveté-naïveté"), (5, "naïveté-naïveté"), (None, "nothing nothing"), (6, LONG), (7, "ÀÉÎÕÜÀÉ×÷ ÀÉÎÕÜÀÉ×÷")]
    rows += [(i, "encyclopaedia Encyclopaedias") for i in range(200)]
    docs = spark.createDataFrame([(i, t, 5, "w", "s") for i, t in rows], "doc_id long, text string, n int, word string, shard string")
    want = _brute_counts(rows)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == want and "naïveté" in want
    assert _rows(spelling.variants(docs)) == _brute_forms(want)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_counts_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_FLUSH", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == _brute_counts(docs.select("doc_id", "text").collect())
