"""License scans by an exact set-similarity join, with DataFrame functions only.

Templates are license texts and one-line notices. A text's blocks are its windows of consecutive words: for a license
text twice as many words as it has, for a notice as many. A block matches a template if it holds at least
the template's threshold of its distinct words: 0.8 of a text, all of a notice, as one other word there makes another
license. Every block that does is found; it is enough to try those that begin with one of the template's words.

The templates' words are ordered by the number of documents that hold them, over the whole corpus. The rarest
of each template, so many that a match must hold one, are its postings (prefix filter). The words of a document that
occur in postings are joined to them on the word; a pair goes on by the first word of the order that both have, and only if
what the order leaves behind that word is enough (positional filter), and if enough of the template's
words stand in the document (length filter). Equal texts are compared once. What passes is dealt by
stretches of one block's length, so that a long text's blocks are counted in many tasks; counting is exact.

Where blocks of siblings (templates that share half of their words) overlap, the larger containment wins, then the larger
number of words. Beside the join, phrases of the base list are counted and placed in the whole text.

Defined cases: null text is empty; empty texts have no words, no labels and score 0; an empty table gives no rows;
repeated rows are scanned each; no size of text or line is exempt; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut

#: Words of either case; the separators are all other ASCII. Fixed value.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and labels. Fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License texts, by label. Fixed values.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation"""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
Software Foundation"""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
Software Foundation"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at http://mozilla.org/MPL/2.0/."""),
)
#: One-line notices, by label. Fixed values.
NOTICES = (
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("mpl", "licensed under the Mozilla Public License"),
)
#: A block of a text has so many times its words.
WINDOW = 2
THRESHOLD = 0.8
#: (label, template, words of a block in multiples of the template's, threshold).
TEMPLATES = tuple((label, text, WINDOW, THRESHOLD) for label, text in TEXTS) + tuple((label, text, 1, 1.0) for label, text in NOTICES)


def spaced(text: Column) -> Column:
    """The words of a text between single spaces, one before and one behind as well."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _BREAK, " ")), F.lit(" "))


def _split(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _words(text: str) -> list[str]:
    return sorted(set(_split(text)))


def lower_words(body: Column) -> Column:
    """The words of a spaced text, in lower case as far as ASCII goes: no other letter becomes one of ASCII's."""
    return F.split(F.trim(F.lower(F.replace(body, F.lit("\u212a"), F.lit("\u212b")))), " ")


def _count_spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def frequencies(docs: DataFrame, words: list[str], text_col: str) -> dict[str, int]:
    """In how many documents each of the templates' words occurs; one row a word at most."""
    body = spaced(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held = F.array_intersect(F.array(*map(F.lit, words)), lower_words(body))
    found = docs.select(F.explode(held).alias("w")).groupBy("w").count()
    return {w: 0 for w in words} | {r["w"]: r["count"] for r in found.collect()}


class Templates:
    """Templates with their words in the corpus's order, the rarest first."""

    def __init__(self, templates: tuple, often: dict[str, int]):
        self.order = sorted(often, key=lambda w: (often[w], w))
        place = {w: i for i, w in enumerate(self.order)}
        self.rows = []  # template, label, words, rarest words, how many are needed, words of a block
        for t, (label, text, times, threshold) in enumerate(templates):
            words = sorted(_words(text), key=place.get)
            need = math.ceil(threshold * len(words) - 1e-9)
            self.rows.append((t, label, words, words[: len(words) - need + 1], need, times * len(_split(text))))
        self.prefixes = sorted({w for r in self.rows for w in r[3]}, key=place.get)
        sets = [set(r[2]) for r in self.rows]
        self.siblings = [f"{a} {b}" for a, x in enumerate(sets) for b, y in enumerate(sets) if self.rows[a][1] != self.rows[b][1] and 2 * len(x & y) >= max(len(x), len(y))]

    def postings(self, spark: SparkSession) -> DataFrame:
        """word, place in the template's order and the template, for each template's rarest words."""
        rows = [(w, j, *r) for r in self.rows for j, w in enumerate(r[3])]
        return spark.createDataFrame(rows, "word string, place int, template int, label string, words array<string>, rarest array<string>, need int, width int")


def _base(docs: DataFrame, id_col: str, text_col: str, told: Templates) -> DataFrame:
    """A row a document: base columns, the text's digest (a, b), and the places of template words where a rare one is among them."""
    phrase = r"(?i)(?<= )(?:" + "|".join(BASE) + r")(?= )"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t")).withColumn("_s", spaced(F.col("_t")))
    base = base.withColumns({"_has": F.col("_s").rlike(phrase), "_w": lower_words(F.col("_s"))})
    whole = F.array(*map(F.lit, told.order))
    at = F.filter(F.transform("_w", lambda w, i: F.when(F.array_contains(whole, w), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    base_labels = F.when(F.col("_has"), F.array_compact(F.array(*[F.when(F.col("_s").rlike(rf"(?i)(?<= ){p}(?= )"), F.lit(label)) for p, label in BASE.items()])))
    ahead = F.element_at(F.split("_s", phrase, 2), 1)
    behind = F.regexp_extract("_s", r"(?is)^(.*)(?<= )(?=(?:" + "|".join(BASE) + ") )", 1)
    return base.select(
        "doc_id",
        F.when(F.col("_s") == "  ", 0).otherwise(_count_spaces(F.col("_s")) - 1).cast("long").alias("n_words"),
        F.when(F.col("_has"), F.regexp_count("_s", F.lit(phrase))).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("_has"), _count_spaces(ahead) - 1).alias("first_word"),
        F.when(F.col("_has"), _count_spaces(behind) - 1).alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(base_labels)), F.array().cast("array<string>")).alias("base"),
        F.xxhash64("_t").alias("a"), F.xxhash64(F.lit(1), "_t").alias("b"),
        F.when(F.arrays_overlap(F.array(*map(F.lit, told.prefixes)), F.col("_w")), at).alias("at"),
    )


def blocks(base: DataFrame, told: Templates) -> DataFrame:
    """a, b, template, label, start, width, matched, containment: of each stretch of a text the best block that matches."""
    texts = base.where("at IS NOT NULL").groupBy("a", "b").agg(F.any_value("at").alias("at"))
    texts = texts.withColumn("held", F.array_distinct(F.transform("at", lambda x: x["w"])))
    seen = texts.withColumn("word", F.explode(F.array_intersect(F.array(*map(F.lit, told.prefixes)), F.col("held"))))
    pairs = seen.join(F.broadcast(told.postings(base.sparkSession)), "word")  # as many rows as the templates have rare words
    first = ~F.arrays_overlap(F.slice("words", F.lit(1), F.col("place")), F.col("held")) | (F.col("place") == 0)
    pairs = pairs.where(first & (F.size("words") - F.col("place") >= F.col("need")) & (F.size(F.array_intersect("words", "held")) >= F.col("need")))
    mine = pairs.select("a", "b", "template", "label", "words", "rarest", "need", "width", F.explode(F.filter("at", lambda x: F.array_contains(F.col("words"), x["w"]))).alias("x"))
    stretch = F.floor(F.col("x.i") / F.col("width")).cast("int")
    # A block that begins in a stretch ends in the next one at most.
    dealt = mine.withColumn("stretch", F.explode(F.array(stretch, stretch - 1))).groupBy("a", "b", "template", "label", "words", "rarest", "need", "width", "stretch").agg(F.collect_list("x").alias("at"))
    held = F.transform("at", lambda x: x["w"])
    dealt = dealt.where(F.arrays_overlap("rarest", held) & (F.size(F.array_intersect("words", held)) >= F.col("need")))

    def block(x: Column) -> Column:
        inside = F.filter("at", lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + F.col("width")))
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda y: y["w"]))).alias("matched"), (-x["i"]).alias("less"))

    starts = F.filter("at", lambda x: F.floor(x["i"] / F.col("width")) == F.col("stretch"))
    best = dealt.withColumn("best", F.array_max(F.transform(starts, block))).where(F.col("best.matched") >= F.col("need"))
    return best.select("a", "b", "template", "label", (-F.col("best.less")).alias("start"), "width", F.col("best.matched").alias("matched"), (F.col("best.matched") / F.size("words").cast("double")).alias("containment"))


def _told(docs: DataFrame, text_col: str, templates: tuple) -> Templates:
    vocabulary = sorted({w for _, text, _, _ in templates for w in _words(text)})
    return Templates(templates, frequencies(docs, vocabulary, text_col))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, label, template, start, width, matched, containment: every match, of each stretch the best block."""
    told = _told(docs, text_col, templates)
    base = cut(_base(docs, id_col, text_col, told))
    found = blocks(base, told).groupBy("a", "b").agg(F.collect_list(F.struct("label", "template", "start", "width", "matched", "containment")).alias("m"))
    return attach(base.select("doc_id", "a", "b"), found, ["a", "b"], ["doc_id"]).select("doc_id", F.inline("m"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    told = _told(docs, text_col, templates)
    base = cut(_base(docs, id_col, text_col, told))
    found = blocks(base, told).groupBy("a", "b").agg(F.collect_list(F.struct("containment", "matched", "template", "label", "start", "width")).alias("m"))
    siblings = F.array(*map(F.lit, told.siblings)) if told.siblings else F.array().cast("array<string>")

    def beaten(x: Column) -> Column:
        apart = lambda y: F.array_contains(siblings, F.concat_ws(" ", x["template"].cast("string"), y["template"].cast("string")))
        more = lambda y: (y["containment"] > x["containment"]) | ((y["containment"] == x["containment"]) & (y["matched"] > x["matched"]))
        return F.exists("m", lambda y: more(y) & (y["start"] < x["start"] + x["width"]) & (x["start"] < y["start"] + y["width"]) & apart(y))

    own = F.transform(F.filter("m", lambda x: ~beaten(x)), lambda x: x["label"])
    found = found.select("a", "b", F.array_distinct(own).alias("own"), F.array_max(F.transform("m", lambda x: x["containment"])).alias("most"))
    joined = attach(base.drop("at"), found, ["a", "b"], ["doc_id"], how="left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
