"""Columns that clash with internal names, scripts, check digits, and a key that no plan shows."""

import pathlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelkit import llm
from panelkit.llm import byte_bpe, licences, packing, quality, repair, sharding, simhash, similar, spelling, surrogates, token_counts

HERE = pathlib.Path(llm.__path__[0])
SF = "/root/testdata/sf0.001"


def _internal_names():
    """Every name of a column that the operators' sources write."""
    found = set()
    for path in HERE.glob("*.py"):
        found |= set(re.findall(r'"(_?[a-z][a-z0-9_]{0,15})"', path.read_text()))
    return sorted(found - {"doc_id", "text", "conv_id", "turn", "role"})


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).cache()
    more = docs.select("*", *[F.lit(i % 7).alias(n) for i, n in enumerate(_internal_names())])
    return docs, more, spark.read.parquet(f"{SF}/labels.parquet")


WORD, PIECE, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
OPERATORS = {
    "simhash": lambda d, _: simhash.near_duplicates(d).select("doc_id", "component_id"),
    "simhash first": lambda d, _: simhash.keep_first(d).select("doc_id"),
    "packing": lambda d, _: packing.pack_documents(d, WORD).select("doc_id", "piece", "length"),
    "sharding": lambda d, _: sharding.assign(d).select("doc_id", "size"),
    "classify": lambda d, labels: quality.classify(d, labels).select("doc_id", F.round("score", 9)),
    "keep_good": lambda d, labels: quality.keep_good(d, labels).select("doc_id"),
    "surrogates": lambda d, _: surrogates.replace(d, "k").select("doc_id", "text"),
    "similar": lambda d, _: similar.keep_first(d).select("doc_id"),
    "licences": lambda d, _: licences.scan(d),
    "byte_bpe": lambda d, _: byte_bpe.digests(d, BYTE),
    "token_counts": lambda d, _: token_counts.report(d, PIECE),
    "spelling": lambda d, _: spelling.word_counts(d),
    "repair": lambda d, _: repair.repair(d.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), *[c for c in d.columns if c not in ("doc_id", "conv_id", "turn", "role")])),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_may_stand_beside(frames, name):
    docs, more, labels = frames
    assert len(more.columns) > 150
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(OPERATORS[name](more, labels)) == rows(OPERATORS[name](docs, labels))


SCRIPTS = {"Greek": "νικος@παραδειγμα.gr", "Arabic": "سالم@مثال.com", "Hebrew": "שלום@דוגמה.com", "Han": "田中@例子.com", "Hangul": "김철수@보기.com", "Katakana": "タナカ@レイ.com", "Cyrillic": "иван@пример.ru", "Thai": "สมชาย@ตวอยาง.com", "Ethiopic": "አበበ@ምሳሌ.com"}


def test_letters_stay_in_their_script(spark):
    import regex

    rows = [(i, f"write to {a} now") for i, a in enumerate(SCRIPTS.values())] + [(50, "Mr Παπαδόπουλος und Frau Αλεξίου"), (51, "Mr Սարգսյան")]
    out = {r["doc_id"]: r["text"] for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (script, address) in enumerate(SCRIPTS.items()):
        got = out[i].removeprefix("write to ").removesuffix(" now")
        assert got != address and len(got) == len(address) and got.rpartition(".")[2] == address.rpartition(".")[2]
        assert all(bool(regex.match(rf"\p{{{script}}}", a)) == bool(regex.match(rf"\p{{{script}}}", b)) for a, b in zip(address, got)), (address, got)
    assert regex.fullmatch(r"Mr \p{Greek}+ und Frau \p{Greek}+α", out[50]) and "Παπαδόπουλος" not in out[50]
    assert regex.fullmatch(r"Mr \p{Armenian}+", out[51]) and out[51] != "Mr Սարգսյան"


def _mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_valid_ibans_stay_valid(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        body = "".join(r.choice("0123456789") for _ in range(18))
        check = 98 - _mod97("DE00" + body) if i % 3 else r.randint(2, 97)
        rows.append((i, f"pay DE{check:02d}{body} today"))
    out = {x["doc_id"]: x["text"] for x in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, text in rows:
        old, new = text.split()[1], out[i].split()[1]
        assert new != old and new[:2] == "DE" and len(new) == len(old)
        assert _mod97(old) != 1 or _mod97(new) == 1
    assert _mod97("DE89370400440532013000") == 1


def test_the_key_stands_in_no_plan(spark):
    key = "0123456789abcdefkey"
    docs = spark.createDataFrame([(1, "Mr J. Smith, a@b.org, 10.1.2.3")], "doc_id long, text string")
    made = surrogates.replace(docs, key)
    plan = made._jdf.queryExecution().toString()
    drawn = surrogates.drawn(spark.createDataFrame([("ip", "10.1.2.3", 0)], "type string, canon string, attempt int"), key)
    subkeys = [r["type_key"] for r in surrogates.type_keys(spark, key).collect()]
    for text in (plan, drawn._jdf.queryExecution().toString()):
        assert not any(k in text for k in (key, *subkeys))
    # Spark redacts values whose name says "secret".
    spark.conf.set("spark.panelkit.surrogates.secret", key)
    try:
        assert surrogates.session_key(spark) == key
    finally:
        spark.conf.unset("spark.panelkit.surrogates.secret")
    assert surrogates.session_key(spark) != surrogates.session_key(spark)
