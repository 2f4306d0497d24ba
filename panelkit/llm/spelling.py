"""Spelling variants: words one edit apart, found by automatons over the words' halves.

An edit leaves one half of a word as it is. So each word files its two segments, the first ``length // 2`` code
points and the rest, in a shard that the segment's hash gives; a shard is an Aho-Corasick automaton over its
segments. Every word is scanned by the shards that can hold a segment which stands in it at the right place: a
first segment at offset 0, a second one at the word's end, of a word whose length differs by one at most. Each
match of such offset and length is verified by the exact distance. A link is found from both sides, once each.

A shard's automaton is of bounded size: a segment with more than ``HOT`` owners is dealt over parts, each of which
scans the words that hold it. The words of a shard are read as a stream. A segment with many owners looks
them up by what remains without one code point, so that no two owners are compared for sharing it.

Defined cases: null and empty texts hold no word; a null doc_id counts as the empty text; long texts are read as
a stream of runs; repeated rows are counted each; ties of the most frequent near word go to the smallest word
in code-point order; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

#: Runs that words are made of. Fixed value.
LETTERS = "A-Za-zÀ-ÿ"
#: Segments a shard holds, owners a segment's part holds, and owners from which on a segment is indexed.
SHARD, HOT, INDEXED = 20_000, 2048, 24
_FLUSH = 1 << 17


def damaged(run: bytes, key: int) -> bytes:
    """A run (UTF-8), without one code point if 31 divides the CRC of ``<doc_id>:<run>``; key: CRC of what stands before the run."""
    h = zlib.crc32(run, key)
    if h % 31:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n: the words of ``least_length`` code points and ``least_count`` occurrences or more."""
    prepare(docs.sparkSession)
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for m in run.finditer(text.as_py() or ""):
                    w = damaged(m.group().encode().lower(), key)  # of bytes: only A-Z
                    if len(w) >= least_length and (len(w) > 2 * least_length or len(w.decode()) >= least_length):
                        found[w] += 1
                if len(found) > _FLUSH:
                    yield flushed()
        yield flushed()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Do the texts differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else at < len(a) and a[at + 1 :] == b[at + 1 :]


class _Owners:
    """The words that file one segment, by what remains of them beside it."""

    def __init__(self):
        self.words: list[tuple[str, str, int]] = []  # rest, word, its n
        self.index: dict[str, list[int]] | None = None

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        """The owners whose rest is one edit away."""
        words = self.words
        if len(words) > INDEXED:
            if self.index is None:
                self.index = defaultdict(list)
                for i, (r, _, _) in enumerate(words):
                    for form in _shortened(r):
                        self.index[form].append(i)
            words = [words[i] for i in {i for form in _shortened(rest) for i in self.index.get(form, ())}]
        for r, word, n in words:
            if one_edit(r, rest):
                yield word, n


def _shortened(rest: str) -> set[str]:
    """A text and what it is without one code point: two texts an edit apart have one of these in common."""
    return {rest} | {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


class Shard:
    """The automaton over a shard's segments."""

    def __init__(self, filed: list[tuple[bool, str, str, int]]):
        """filed: (is it the second segment?, segment, word, the word's n)."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for second, segment, word, n in filed:
            owners = self.automaton.get(segment, None)
            if owners is None:
                owners = (len(segment), _Owners(), _Owners())
                self.automaton.add_word(segment, owners)
            owners[1 + second].words.append((word[: -len(segment)] if second else word[len(segment) :], word, n))
        if filed:
            self.automaton.make_automaton()
        self.empty = not filed

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The owners one edit from ``word`` that this shard's segments find; each link by its first segment if that stands in both."""
        if self.empty:
            return
        last = len(word) - 1
        for end, (size, first, second) in self.automaton.iter(word):
            if end == size - 1:
                yield from first.near(word[size:])
            if end == last:
                for other, n in second.near(word[:-size]):
                    if not word.startswith(other[: len(other) // 2]):
                        yield other, n


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, scans, segment, second, word, n), by shard, owners before scans -> links (word, near, near_n)."""
    shard, filed, automaton = None, [], None
    for batch in batches:
        out: list[tuple[str, str, int]] = []
        for at, scans, segment, second, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if at != shard:
                shard, filed, automaton = at, [], None
            if not scans:
                filed.append((second, segment, word, n))
                continue
            if automaton is None:
                automaton = Shard(filed)
                filed = []
            out.extend((word, near, k) for near, k in automaton.near(word))
        words, nears, ns = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(nears, pa.string()), pa.array(ns, pa.int64())], ["word", "near", "near_n"])


def _filed(segment: str) -> Column:
    """Both segments of ``word``, or those that may stand in it, as (second, segment)."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    if segment == "own":
        return F.array(F.struct(F.lit(False).alias("second"), F.substr("word", F.lit(1), half).alias("segment")), F.struct(F.lit(True).alias("second"), F.substr("word", half + 1).alias("segment")))
    places = [F.struct(F.lit(False).alias("second"), F.substr("word", F.lit(1), F.floor((size + d) / 2).cast("int")).alias("segment")) for d in (-1, 0, 1)]
    places += [F.struct(F.lit(True).alias("second"), F.substr("word", size - F.ceil((size + d) / 2).cast("int") + 1).alias("segment")) for d in (-1, 0, 1)]
    return F.array_distinct(F.array(*places))


def links(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of near words of ``words`` (word, n; a word once, of two code points or more)."""
    spark = words.sparkSession
    words = cut(words.select("word", "n"))
    # So many shards that tasks are even, and so many that each is of bounded size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shards = max(8 * tasks, -(-2 * words.count() // SHARD))
    own = words.select("word", "n", F.explode(_filed("own")).alias("s")).select("word", "n", "s.*")
    seen = words.select("word", "n", F.explode(_filed("seen")).alias("s")).select("word", "n", "s.*")
    hot = cut(own.groupBy("second", "segment").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).where("parts > 1"))
    if hot.isEmpty():
        own, seen = own.withColumn("part", F.lit(0)), seen.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        own = own.join(hot, ["second", "segment"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
        seen = seen.join(hot, ["second", "segment"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    shard = F.pmod(F.xxhash64("second", "segment", "part"), F.lit(shards)).cast("int").alias("shard")
    owners = own.select(shard, F.lit(False).alias("scans"), "segment", "second", "word", "n")
    scans = seen.select(shard, F.lit(True).alias("scans"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("boolean").alias("second"), "word", F.lit(None).cast("long").alias("n")).distinct()
    dealt = owners.unionByName(scans).repartition("shard").sortWithinPartitions("shard", "scans")
    return dealt.mapInArrow(_scanned, "word string, near string, near_n long")


def forms(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n).

    A word's form is its most frequent near word, if that is ``times`` as frequent or more; its root is where the
    forms lead in the end.
    """
    words = cut(words.select("word", "n"))
    best = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    has = -F.col("best.less") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    found = cut(found)
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the forms followed; each form is ``times`` as frequent as the one before
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        step = cut(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spelling forms of all words of the documents."""
    return forms(word_counts(docs, id_col, text_col))
