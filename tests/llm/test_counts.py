"""Token counts against the tokenizer's own library."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelkit.llm import token_counts
from panelkit.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  ", "a\x00b\n▁b", "<s> <0x41> </s><unk>", "aaaa" * 1000, "=-" * 900 + "=" * 3000, " " * 5000, "日本語" * 500, "x" * 129, "é😀́" * 100, "﻿​", "_" * 1025]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _wanted(library, texts):
    return [len(ids) for ids in library.encode(texts, num_threads=1)]


def _random_texts(n, seed):
    r = random.Random(seed)
    kinds = [token_counts.transducer(PATH).letters, "abcdefgh", "the ing", "ab", "01 =-", "a", " \n\t", "strength ofthe", "日本の 東京"]
    return ["".join(r.choices(r.choice(kinds), k=r.choice([1, 3, 20, 127, 128, 129, 1500]))) for _ in range(n)]


def test_counts_equal_the_library(library):
    texts = ODD + _random_texts(600, 1)
    assert token_counts.transducer(PATH).counts(texts) == _wanted(library, texts)
    assert token_counts.transducer(PATH).counts([]) == []


def test_long_texts_go_in_parts_whose_states_compose(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PORTION", 700)
    texts = _random_texts(60, 2) + ["ab" * 7777, "=" * 9000, "".join(random.Random(3).choices("the ing of", k=20_000))]
    assert token_counts.transducer(PATH).counts(texts) == _wanted(library, texts)


def test_a_full_table_is_compiled_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "LIMIT", 50)
    found = token_counts.Transducer(token_counts.scores(PATH))
    for seed in range(3):
        texts = _random_texts(40, seed)
        assert found.counts(texts) == _wanted(library, texts)


def test_blocks_without_a_reset_are_composed(library):
    # Two letters with pieces of many lengths: no reset anywhere, entry states that guesses may miss.
    r = random.Random(5)
    texts = ["".join(r.choices(kind, k=n)) for kind in ("e", "on", "ing", "-", "=", "at") for n in (128, 129, 1000, 40_000)]
    found = token_counts.Transducer(token_counts.scores(PATH))
    assert [found.counts([t])[0] for t in texts] == _wanted(library, texts)
    assert found.counts(texts) == _wanted(library, texts)


def test_report_has_defined_cases(spark, library):
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (2, "", 2, "b"), (None, "no id", 3, "c"), (3, "word " * 5000, 4, "d"), (4, "word " * 4000, 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string")
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.report(docs, PATH).collect()}
    want = {(i, len((t or "").encode()), n, n > 4096) for (i, t, _, _), n in zip(rows, _wanted(library, [r[1] or "" for r in rows]))}
    assert got == want and any(x[3] for x in got)
    assert token_counts.report(docs, PATH).count() == len(rows)
    kept = token_counts.with_counts(docs, PATH, out="n")
    assert kept.columns == [*docs.columns, "n"]
    assert token_counts.report(docs.limit(0), PATH).count() == 0


def test_op12_counts_every_document_without_a_shuffle(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = LLM_QUERIES["op12_token_counts"](spark, sf)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect()}
    assert got == {i: (len(t.encode()), n, n > 4096) for (i, t), n in zip(docs.items(), _wanted(library, list(docs.values())))}


def test_another_kind_of_model_is_refused(tmp_path):
    with open(PATH, "rb") as f:
        raw = f.read()
    at = raw.rindex(b"identity")
    other = tmp_path / "other.model"
    other.write_bytes(raw[: at + 8] + raw[at + 8 :].replace(b"\x20\x00", b"\x20\x01", 1))
    with pytest.raises(ValueError):
        token_counts.scores(str(other))


def test_counts_are_a_column(spark):
    one = spark.range(1).select(token_counts.token_count(F.lit("a b"), PATH).alias("n"))
    assert one.first()["n"] == 2
