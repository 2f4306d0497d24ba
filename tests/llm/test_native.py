"""The operators on DataFrame functions alone, against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelkit.llm import chats, licences, surrogates

SF = "/root/testdata/sf0.001"
PRIVATE = [
    (1, "Write to ann.b-12@mail3.example.com or ANN.B-12@MAIL3.EXAMPLE.COM, not bob@x.org.", 1, "a"),
    (2, "Call +1 (017) 555-7713 or (017) 555-7713; card 4111 1111 1111 1111, 4111111111111111 from 10.1.2.3!", 1, "a"),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 24BE64439E3E49CF46B2D7C90F3602A3D0B907FF', 1, "a"),
    (4, "Frau Müller and Herr Schmidt met Mrs Müller; Господин Иванов. SSN 123-45-6789, DE89 3704 0044 0532 0130 00.", 1, "a"),
    (5, "A clean text: 12:30, 3.14, 1,000,000 and v1.2.3, a-b@c, May 5 2024 (2023-12-31).", 1, "a"),
    (8, "password=435d4f3a6837d2cbdd. Then db_pwd='435d4f3a6837d2cbdd' and API-Key: x7Kq-22zz; token=ann.b-12@mail3.example.com, PASSWORD=HUNTERS", 1, "a"),
    (9, "The token: a word; secret = makeKey1(x), password=****** and token=call2get(1).", 1, "a"),
    (6, "", 1, "a"), (7, None, 1, "a"), (1, "bob@x.org", 2, "b"), (1, "bob@x.org", 2, "b"), (None, "bob@x.org 152.143.123.131%%%", 3, None),
]


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


@pytest.fixture(scope="module")
def replaced(spark):
    df = spark.createDataFrame(PRIVATE, "doc_id long, text string, surrogate int, type string")
    out = surrogates.replace(df, "k", count_col="n")
    assert out.columns == ["doc_id", "text", "surrogate", "type", "n"]
    return out.collect()


def test_every_entity_goes_and_clean_texts_stay(replaced):
    assert len(replaced) == len(PRIVATE)
    whole = "\n".join(r["text"] or "" for r in replaced)
    for secret in ("ann.b-12", "ANN.B-12", "bob@x", "017", "7713", "4111 1111 1111 1111", "10.1.2.3", "24be6443", "435d4f", "x7Kq", "HUNTERS", "Müller", "Schmidt", "Иванов", "123-45", "DE89 3704", "152.143.123.131"):
        assert secret not in whole
    clean = {t for i, t, *_ in PRIVATE if i in (5, 6, 7, 9)}
    assert {r["text"] for r in replaced if r["n"] == 0} == clean


def test_types_formats_and_coreference_are_kept(replaced):
    text = {(r["doc_id"], r["n"]): r["text"] for r in replaced}
    low, high, bob = re.findall(r"[\w.-]+@[\w.-]+\w", text[1, 3])
    assert low.upper() == high and re.fullmatch(r"[a-z]{3}\.[a-z]-\d\d@[a-z]{4}\d\.[a-z]{7}\.com", low)
    assert text[1, 1] == bob
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", text[2, 5])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", text[2, 5])
    assert len(phones) == 2 and "+1 (" in text[2, 5]
    assert cards[0].replace(" ", "") == cards[1] and _luhn(cards[1]) and cards[1][0] == "4"
    a, b = re.findall(r"[0-9a-fA-F]{40}", text[3, 2])
    assert a.upper() == b and a == a.lower()
    names = re.search(r"Frau (\w+) and Herr (\w+) met Mrs (\w+); Господин (\w+)\.", text[4, 6])
    assert names[1] == names[3] and names[1].endswith("a") and not names[2].endswith("a") and re.fullmatch("[А-я]+", names[4])


def test_assigned_credentials_keep_name_and_form(replaced):
    (text,) = (r["text"] for r in replaced if r["doc_id"] == 8)
    found = re.fullmatch(r"password=([0-9a-f]{18})\. Then db_pwd='([0-9a-f]{18})' and API-Key: ([a-z]\d[A-Z][a-z]-\d\d[a-z]{2}); token=(\S+@\S+), PASSWORD=([A-Z]{7})", text)
    assert found and found[1] == found[2]
    assert found[4] in next(r["text"] for r in replaced if r["doc_id"] == 1 and r["n"] == 3)


def test_assigned_credentials_are_read_to_their_end(spark):
    r = random.Random(1)
    value = "".join(r.choice("abcdefghijkXYZ/+") for _ in range(800))
    jwt = f"eyJ{value}.{value}9.{value}"
    texts = [f'token = "{value}7" end', f"secret: {jwt}...", f"password={value}", f"api_key: {'9' * 300}{value}!", f"token={value}.call2(x)", f"token = {value}", f"secret={value}1@mail.example.org", "pwd=" + "a1" * 20_000 + "."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in surrogates.replace(df, "k").collect()}
    assert re.fullmatch(r'token = "[\w/+]{801}" end', out[0]) and re.fullmatch(r"secret: [\w/+.]{2406}\.\.\.", out[1])
    assert re.fullmatch(r"password=[\w/+]{800}", out[2]) and re.fullmatch(r"api_key: \d{300}[\w/+]{800}!", out[3]) and len(out[7]) == len(texts[7])
    pieces = {t[i : i + 12] for t in (value, jwt) for i in range(len(t) - 12)} | {"9" * 12, "a1" * 12}
    for i in (0, 1, 2, 3, 7):
        assert not any(out[i][k : k + 12] in pieces for k in range(len(out[i])))
    assert out[4] == texts[4] and out[5] == texts[5]  # a call; no digit behind a loose "="


def test_short_forms_do_not_run_out(spark):
    df = spark.range(26).select(F.lit("secret").alias("type"), F.concat(F.lit("*****"), F.expr("char(97 + id)")).alias("canon"))
    rows = surrogates.surrogates(df, "k").collect()
    assert len({r["surrogate"] for r in rows} | {r["canon"] for r in rows}) == 52


def test_prefilter_loses_no_entity_without_digits(spark):
    stems = [f"{h} {w}" for h in (*surrogates.FEMALE, *surrogates.MALE, *surrogates.NEUTRAL) for w in ("Abel", "Иванов")]
    keys = [f"{p}{m}{'x' * 16}" for p in ("sk", "ghp", "gho", "xoxb") for m in "-_"]
    texts = [*stems, *keys, "a@b.org", "password=HUNTERS", "abcdefab" * 4, "ABCDEFAB" * 4, "AKIA" + "QWERTYUIOPASDFGH"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", F.col("text").rlike(surrogates.PATTERN).alias("full"), surrogates.holds_entity(F.col("text")).alias("told")).collect()
    assert [r["text"] for r in found if not (r["full"] and r["told"])] == []


def test_names_do_not_run_out(spark):
    spelt = F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij")
    df = spark.range(30_000).select(F.lit("name").alias("type"), F.concat(F.lit("m Q"), spelt).alias("canon"))
    rows = surrogates.surrogates(df, "k").collect()
    assert len({r["surrogate"] for r in rows}) == 30_000 and all(re.fullmatch("m [A-Z][a-z]+", r["surrogate"]) for r in rows)


NAMED = [
    "Mr McDonald met Mrs O'Brien and Dr Jane Roe. McDonald left; Roe's and MCDONALD's too. Ms Roe came.",
    "Frau Müller-Lüdenscheidt, Frau Müller und Müller; Mr John Smith, Mr Smith, Smith. A smithy, Smiths.",
    "Prof. Dr. Herr J. von der Heide sah Herrn nicht; Herr Will will, Will geht.",
    "Miss Ada Bea Cor Dee Eva Fay Gil Hal Ida spoke.",
    "Host 2001:0db8::ff00:42:8329 or 2001:DB8::FF00:42:8329, 2001:db8:0:0:0:ff00:42:8329; std::vector a::b ::1 at 12:30:45.",
    "Smith alone is no entity. Господин Иванов и Иванов.",
    "+1 12 12 and +1 13 13",
]


def test_names_corefer_in_all_their_forms(spark):
    df = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in surrogates.replace(df, "k").collect()}
    a = re.fullmatch(r"Mr (\w+) met Mrs ([A-Z]'[A-Z]\w+) and Dr (\w+) (\w+)\. (\w+) left; (\w+)'s and (\w+)'s too\. Ms (\w+) came\.", out[0])
    assert a and a[1] == a[5] and a[7] == a[1].upper() and a[4] == a[6] == a[8] and a[2].endswith("a") and a[8].endswith("a")
    b = re.fullmatch(r"Frau (\w+)-(\w+), Frau (\w+) und (\w+); Mr (\w+) (\w+), Mr (\w+), (\w+)\. A smithy, Smiths\.", out[1])
    assert b and b[1] == b[3] == b[4] and b[6] == b[7] == b[8] != b[5] and "Müller" not in out[1]
    c = re.fullmatch(r"Prof\. Dr\. Herr ([A-Z])\. von der (\w+) sah Herrn nicht; Herr (\w+) will, Will geht\.", out[2])
    assert c and "Heide" not in out[2] and c[3] != "Will"
    assert re.fullmatch(r"Miss (?:[A-Z]\w+a ){9}spoke\.", out[3])
    six = re.findall(r"[0-9a-fA-F:]{9,}", out[4].split("; std")[0])
    assert six[0].lower() == six[1].lower().replace(":" + six[1].split(":")[1].lower(), ":" + six[1].split(":")[1].lower().zfill(4)) or six[0].count(":") == 5
    assert six[1] == six[1].upper() and six[2].count(":") == 7 and six[2].split(":")[2:5] == ["0", "0", "0"] and int(six[2].split(":")[0], 16) == int(six[0].split(":")[0], 16)
    assert "std::vector a::b" in out[4] and "at 12:30:45." in out[4] and "::1 " not in out[4] and "8329" not in out[4]
    d = re.fullmatch(r"Smith alone is no entity\. Господин (\w+) и (\w+)\.", out[5])
    assert d and d[1] == d[2] and "Иванов" not in out[5]


def test_every_short_form_may_run_out(spark):
    """All numbers of a form, all one-digit addresses: surrogates grow and stay distinct."""
    n = F.col("id").cast("string")
    forms = {"phone": F.lpad(n, 3, "0"), "ssn": F.lpad(n, 3, "0"), "iban": F.concat(F.lit("DE"), F.lpad(n, 3, "0")), "ip6": F.concat(F.lit("0:0:0:0:0:0:0:"), F.lower(F.hex(F.col("id") % 15 + 1)))}
    df = spark.range(1000).select(F.explode(F.array(*[F.struct(F.lit(t).alias("type"), c.alias("canon")) for t, c in forms.items()])).alias("e")).select("e.*").distinct()
    rows = surrogates.surrogates(df, "k").collect()
    assert len(rows) == 3015 == len({(r["type"], r["surrogate"]) for r in rows})
    assert not {(r["type"], r["surrogate"]) for r in rows} & {(r["type"], r["canon"]) for r in rows}


def test_a_key_is_required_and_tells(spark):
    df = spark.createDataFrame([(1, "Mr Abel")], "doc_id long, text string")
    with pytest.raises(ValueError):
        surrogates.replace(df, "")
    one, two, again = (surrogates.replace(df, k).first()["text"] for k in ("a", "b", "a"))
    assert one == again != two and surrogates.session_key(spark) != surrogates.session_key(spark)


def test_odd_texts_and_columns_with_clashing_names(spark):
    long = "clean words " * 100_000 + "Mr Abel bob@x.org " * 2_000
    rows = [("bob@x.org", "a", 1, "m", "w", 7), (long, "b", 2, None, None, None), (None, "c", 3, "", "", 1), ("", "d", 4, "", "", 1)]
    df = spark.createDataFrame(rows, "text string, id string, n int, _mark string, units string, row int")
    out = surrogates.replace(df, "k", count_col="n_entities")
    assert out.columns == [*df.columns, "n_entities"]
    got = {r["id"]: r for r in out.collect()}
    for text, name, *rest in rows:
        assert list(got[name])[2:6] == rest
    assert got["b"]["n_entities"] == 4_000 and "Abel" not in got["b"]["text"] and got["b"]["text"].count(got["a"]["text"]) == 2_000
    assert got["b"]["text"].startswith("clean words " * 100_000) and got["c"]["text"] is None and got["d"]["text"] == ""
    only = surrogates.replace(df.select("text"), "k")
    assert only.columns == ["text"] and only.count() == 4


def test_surrogates_are_distinct_and_meet_no_real_entity(spark):
    df = spark.range(300).select(F.lit("ssn").alias("type"), F.lpad(F.col("id").cast("string"), 3, "0").alias("canon"))
    rows = surrogates.surrogates(df, "k").collect()
    assert len({r["surrogate"] for r in rows}) == 300
    assert not {r["surrogate"] for r in rows} & {r["canon"] for r in rows}


def test_nothing_left_in_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = df.select(F.explode(F.regexp_extract_all("text", F.lit(surrogates.PATTERN), F.lit(0))).alias("e")).distinct()
    out = surrogates.replace(df, "k")
    after = out.select(F.explode(F.regexp_extract_all("text", F.lit(surrogates.PATTERN), F.lit(0))).alias("e")).distinct()
    assert before.count() > 0 and before.count() == after.count() and before.join(after, "e").isEmpty()
    same = df.where(~F.col("text").rlike(surrogates.PATTERN)).select("doc_id", "text")
    assert same.exceptAll(out.select("doc_id", "text")).isEmpty()


def _python_chats(rows):
    talks = {}
    for c, t, role, text in set(rows):
        key = (c is None, c or 0, (t, role, text) if c is None else None)  # without an id each row stands alone
        talks.setdefault(key, []).append((t is not None, t or 0, "unknown" if role is None else role, text or ""))
    talks = {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}
    out = Counter()
    for c, v in talks.items():
        if any(len(w) > len(v) and w[: len(v)] == v for w in talks.values()):
            continue
        if any(w == v and (d[:2], str(d)) < (c[:2], str(c)) for d, w in talks.items()):
            continue
        out[None if c[0] else c[1], len(v), "".join(f"<|{r}|>\n{t}\n" for r, t in v)] += 1
    return out


CHATS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"),
    (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
    (3, 0, "user", "a"), (3, 1, "assistant", "x"),
    (4, 5, "user", "a"), (4, 9, "assistant", "b"), (4, 9, "assistant", "b"),
    (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "c"),
    (6, 0, None, None), (7, None, "user", "z"), (7, 0, "user", "zz"), (8, 0, "user", ""), (8, 1, "use", "r"), (9, 0, "user", None), (None, 0, "user", "n"), (None, 1, "user", "m"), (None, 7, "user", "m"), (None, 3, "user", "a"),
    *[(10, i, "user", f"turn {i}") for i in range(3_000)], *[(11, i, "user", f"turn {i}") for i in range(2_999)],
]


def test_snapshots_collapse(spark):
    df = spark.createDataFrame([(*r, "x", True) for r in CHATS], "conv_id long, turn long, role string, text string, key string, last boolean")
    got = Counter(map(tuple, chats.collapse(df).collect()))
    assert got == _python_chats(CHATS)
    assert sorted((r[0] for r in got), key=str) == [10, 2, 3, 6, 7, 8, None, None] and max(n for _, n, _ in got) == 3_000


GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation."
SIBLINGS = [
    (20, "Licensed under CC BY-SA 4.0."), (21, GPL), (22, "This software was released under the new license of the trust"), (23, GPL.replace("program", "library").replace("General", "Lesser General")),
    (24, "Licensed under CC BY-NC-SA 4.0."), (25, " ".join(f"word{i} under the terms of this license" for i in range(300))), (26, "x " * 500 + "released under the MIT License. " + "y " * 500),
]


def test_licence_siblings_are_told_apart(spark):
    got = {r["doc_id"]: r["labels"] for r in licences.scan(spark.createDataFrame(SIBLINGS, "doc_id long, text string")).collect()}
    assert got == {20: "cc-by,cc-by-sa", 21: "gpl", 22: "", 23: "lgpl", 24: "cc-by,cc-by-nc-sa", 25: "", 26: "mit"}


def _plain_blocks(words, text, times, threshold):
    """Of each stretch the best block that holds enough of a template's words: (containment, matched, start, width)."""
    tokens = set(re.findall("[a-z0-9]+", text.lower()))
    width = times * len(re.findall("[a-z0-9]+", text.lower()))
    best = {}
    for k, w in enumerate(words):
        if w in tokens:
            n = len(tokens & set(words[k : k + width]))
            if n >= threshold * len(tokens) - 1e-9 and (n, -k) > best.get(k // width, (0, 0)):
                best[k // width] = n, -k
    return [(n / len(tokens), n, -k, width) for n, k in best.values()]


LICENCES = [
    (0, None), (1, ""), (2, "..."), (3, "Released under the MIT License."), (4, "mit-license MIT\tLicense, the apache license"), (5, "cc by-nc 4.0 cc  by"),
    (6, "x\nThis work is licenced under GNU General Public License, version 3.\ny"), (7, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files to deal in the Software without restriction\n\nmore"),
    (8, "the of and in to software license " * 8000), (9, "é apache licensed é apache license"), (None, "apache license"), (3, "Released under the MIT License."), (10, "Licensed under CC BY-NC 4.0."), *SIBLINGS,
    (10030, " ".join(t.replace("\n", "\n * ") for _, t in licences.TEXTS)), (10031, "\n".join(t for _, t in licences.NOTICES)), (10032, "# " + licences.TEXTS[2][1] + " x" * 400 + licences.TEXTS[3][1]),
    (10033, " ".join(licences.TEXTS[0][1].split()[:130])), (10034, " ".join(w for i, w in enumerate(licences.TEXTS[8][1].split()) if i % 7)), (10035, "licensed under the mo\u212ailla public license M\u212a"),
    (10036, "Licensed under CC BY-NC-SA 4.0. " + "and " * 40 + "Licensed under CC BY-NC 4.0."),
]


def test_licence_blocks_equal_brute_force(spark):
    sep = re.compile(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    rows = LICENCES
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = [set(re.findall("[a-z0-9]+", text.lower())) for _, text, _, _ in licences.TEMPLATES]
    want, pairs = Counter(), Counter()
    for i, t in rows + docs:
        body = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in sep.split(body) if w]
        places = sorted((p, label) for phrase, label in licences.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        labels, found = {label for _, label in places}, []
        for k, (label, text, times, threshold) in enumerate(licences.TEMPLATES):
            found += [(*x, k, label) for x in _plain_blocks(words, text, times, threshold)]
        pairs.update((i, x[5], x[4], x[2], x[3], x[1]) for x in found)
        beats = lambda y, x: y[:2] > x[:2] and y[5] != x[5] and y[2] < x[2] + x[3] and x[2] < y[2] + y[3] and 2 * len(sets[x[4]] & sets[y[4]]) >= max(len(sets[x[4]]), len(sets[y[4]]))
        own = labels | {x[5] for x in found if not any(beats(y, x) for y in found)}
        best = 1.0 if places else max((x[0] for x in found), default=0.0)
        want[i, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(labels)), ",".join(sorted(own)), round(best, 9)] += 1
    df = spark.createDataFrame([(i, t, 1, "x", []) for i, t in rows + docs], "doc_id long, text string, score int, a string, at array<int>")
    got = Counter((*tuple(r)[:7], round(r["score"], 9)) for r in licences.scan(df).collect())
    assert got - want == Counter() and want - got == Counter()
    found = Counter(tuple(r)[:6] for r in licences.matches(df).collect())
    assert found == pairs and len({x[2] for x in found}) == len(licences.TEMPLATES)
    told = {x[0]: x[6] for x in want}
    assert told[10032] == "bsd-2-clause,bsd-3-clause" and told[10036] == "cc-by,cc-by-nc,cc-by-nc-sa" and "mit" in told[10033] and "apache" in told[10034]


def test_empty_tables(spark):
    assert surrogates.replace(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0
    assert chats.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _planted(r, kind):
    """A random entity of a type, made without the operator's patterns."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: r.choice("BCDFGHJKLMNPRSTVWZ") + "".join(r.choice("aeiourstln") for _ in range(r.randint(4, 9)))
    return {
        "email": lambda: f"{word().lower()}.{word().lower()}{digits(2)}@{word().lower()}.org",
        "key": lambda: "sk-" + "".join(r.choice("abcdefghij0123456789XYZ") for _ in range(24)),
        "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "ip6": lambda: ":".join(f"{r.randint(1, 65535):x}" for _ in range(8)),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        "name": lambda: f"{r.choice(['Mr', 'Mrs', 'Dr'])} {word()} {word()}",
    }[kind]()


def test_planted_entities_go_and_stay_apart(spark):
    r = random.Random(7)
    kinds = ("email", "key", "ip", "ip6", "ssn", "phone", "name")
    pool = {k: sorted({_planted(r, k) for _ in range(60)}) for k in kinds}
    rows, plain = [], "the lorem ipsum dolor sit amet and, so; it goes."
    for i in range(300):
        picks = [(k, r.choice(pool[k])) for k in r.sample(kinds, 3)]
        rows.append((i, f"{plain} {picks[0][1]} | {plain} {picks[1][1]} | {picks[2][1]} {plain}", picks))
    out = {x["doc_id"]: x["text"] for x in surrogates.replace(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), "k").collect()}
    shape = lambda s: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", s)))
    told = {}
    for i, _, picks in rows:
        a, b, c = re.fullmatch(rf"{re.escape(plain)} (.+) \| {re.escape(plain)} (.+) \| (.+) {re.escape(plain)}", out[i]).groups()
        for (kind, was), now in zip(picks, (a, b, c)):
            assert now != was and told.setdefault((kind, was), now) == now  # coreference over the corpus
            if kind in ("email", "key", "ssn", "phone"):
                assert shape(now) == shape(was)
            assert kind != "key" or now.startswith("sk-")
            if kind in ("ip", "ip6"):
                assert len(re.split("[.:]", now)) == len(re.split("[.:]", was))
            if kind == "name":
                assert now.split()[0] == was.split()[0] and now.endswith("a") == (was.split()[0] == "Mrs")
    for kind in kinds:
        now = [v for (k, _), v in told.items() if k == kind]
        assert len(set(now)) == len(now) and not set(now) & set(pool[kind])


def test_pipeline_stages_one_by_one_equal_brute_force(spark, tmp_path):
    """Each stage on odd rows too: null and repeated ids, null, empty and long texts, columns with clashing names."""
    import corpus_pipeline
    import numpy as np
    import public_tokenizers

    from panelkit.llm import quality, word_bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(f"w{i}" for i in range(60))
    odd = [(None, words, "a"), (None, words + " x", "b"), (None, None, "c"), (None, "", "d"), (7, "Mr Abel bob@x.org " + " ".join(f"u{i}" for i in range(40)), "e"), (7, "other text of the same id", "f"), (10**9, "long text of many words " * 30_000, "g"), (10**9 + 1, words, "h")]
    more = spark.createDataFrame([(i, t, "en", "s", n, 1) for i, t, n in odd], "doc_id long, text string, lang string, source string, none string, label int").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(more, allowMissingColumns=True)
    quality_stage, near_stage, private_stage, pack_stage = (stage for _, stage in corpus_pipeline.STAGES)
    good = quality_stage(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    x = lambda rows: np.stack([quality.statistics(r["text"]) for r in rows])
    all_rows, known = docs.collect(), {r["doc_id"]: r["y"] for r in quality.chosen(labels).collect()}
    fitted = sorted({r["doc_id"]: (tuple(quality.statistics(r["text"])), r) for r in sorted(all_rows, key=lambda r: tuple(-quality.statistics(r["text"]))) if r["doc_id"] in known}.items())
    model = quality.fit(np.array([v[0] for _, v in fitted], np.float32), np.array([known[i] for i, _ in fitted], float))
    keep = model.score(x(all_rows)) >= 0.3
    key = lambda r: (r["doc_id"], r["text"], r["none"], r["label"])
    got = good.collect()
    assert good.columns == docs.columns and Counter(map(key, got)) == Counter(key(r) for r, k in zip(all_rows, keep) if k)
    # The later stages are held against brute force on all rows, whatever the classifier keeps.
    one = near_stage(spark, docs, SF).collect()
    names = Counter(r["none"] for r in one if r["none"])
    assert all(names[n] == 1 for n in "efgh") and not names["a"] and not names["b"] and names["c"] + names["d"] <= 1
    clean = private_stage(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = {r["none"]: r for r in clean.where("none is not null").collect()}
    assert "Abel" not in text["e"]["text"] and "bob@x" not in text["e"]["text"] and text["e"]["n_chars"] == len(text["e"]["text"])
    assert all(text[n]["text"] == t for _, t, n in odd if n != "e")
    bpe, packed = word_bpe.codec(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in pack_stage(spark, docs, SF).collect():
        packed[r["doc_id"]] += r["length"]
    want = Counter()
    for r in all_rows:
        want[r["doc_id"]] += len(bpe.encode(r["text"] or "")) // 4 + 1
    assert packed == want
    empty = docs.limit(0)
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_stages_on_what_the_one_before_kept(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    assert kept < docs and len(kept) > 0.6 * len(docs)
    ends = Counter()
    for r in rows:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
