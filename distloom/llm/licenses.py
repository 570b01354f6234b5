"""Licence scans with a positional rare-token index. DataFrame functions only.

A template is a run of words with a mandatory key phrase in it. Its postings are the places of the words of its key
phrase. The documents that hold these words are counted over the corpus. Of each file, the licence words are ordered by inverse
document frequency; for every template whose key words all stand in the file, the file's RARE highest ones are looked up. Each
of their places in the text and in the template's postings names a relative position, and the positions on which all
looked-up words agree are intersected. There the whole key phrase is verified, and the template counts where enough of its other
words stand at their places too. Since a match needs the key phrase, and so its rarest words, no match is lost.

Edge cases: a null text is empty: no words, no labels, score 0. Places may overlap and all count. Words of equal frequency
are ordered by themselves. Rows that repeat a doc_id or have none are scanned each for itself; extra columns are ignored;
nothing is shuffled but the word counts. Very long texts take time in proportion to their length and to the places of
licence words. An empty table works.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distloom.llm.common import ascii_lower, words_between

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # stands in text

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


#: Phrases that count as they stand.
BASE = [
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
]

# The wording of public licences and of their usual notices, lower-cased and without punctuation.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software"""
_AS_IS = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following
disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_3 = """3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in
writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either
express or implied see the license for the specific language governing permissions and limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation either version {} of the license or at your option any later version this program is
distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness
for a particular purpose see the gnu general public license for more details"""
_LGPL = """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
as published by the free software foundation"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
all warranties with regard to this software including all implied warranties of merchantability and fitness"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by
any means"""
_ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
applications and to alter it and redistribute it freely"""

NOTICES = [
    Template("mit", _MIT, "hereby granted free of charge to any person"),
    Template("mit", "released under the mit license", "mit license"),
    Template("as-is", _AS_IS, "software is provided as is without warranty of any kind"),
    Template("bsd", _BSD, "redistribution and use in source and binary forms"),
    Template("bsd-3", _BSD_3, "may be used to endorse or promote products"),
    Template("apache-2", _APACHE, "may not use this file except in compliance with the license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl-2", _GPL.format(2), "either version 2 of the license"),
    Template("gpl-3", _GPL.format(3), "either version 3 of the license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", _LGPL, "gnu lesser general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", _ISC, "permission to use copy modify and or distribute this software"),
    Template("unlicense", _UNLICENSE, "free and unencumbered software"),
    Template("zlib", _ZLIB, "authors be held liable for any damages arising from the use of this software"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "has waived all copyright and related or neighboring rights"),
]

#: The share of a notice's words that must stand at their places.
COVERAGE = 0.6
#: Words of a key phrase that are looked up.
RARE = 2


def words(text: Column) -> Column:
    return words_between(ascii_lower(text), SEPARATORS)


def document_frequencies(tokens: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents (column words) each word of the vocabulary stands; at most one row a word reaches the driver."""
    found = tokens.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def by_rarity(templates: list[Template], frequency: Mapping[str, int]) -> list[str]:
    """The words of all key phrases, highest inverse document frequency first."""
    return sorted({w for t in templates for w in t.key_words}, key=lambda w: (frequency.get(w, 0), w))


def _index(templates: list[Template]) -> Column:
    """The templates as an array of structs, a constant of the plan."""
    fields = [
        F.struct(
            F.lit(i).alias("id"), F.lit(t.label).alias("label"), F.lit(t.words).alias("words"), F.lit(t.key_words).alias("key"), F.lit(sorted(set(t.key_words))).alias("distinct"), F.lit(t.key_at).alias("key_at")
        )
        for i, t in enumerate(templates)
    ]
    return F.array(*fields)


def _steps(templates: list[Template], order: list[str]) -> tuple:
    """The steps of a scan: a file's licence words, the templates they allow, the words looked up, places, and coverage there."""
    own = F.array_intersect(F.lit(order), F.col("words"))  # the file's licence words, rarest first
    possible = F.filter(_index(templates), lambda t: F.size(F.array_except(t.distinct, F.col("own"))) == 0)
    looked_up = lambda t: F.slice(F.filter("own", lambda w: F.array_contains(t.distinct, w)), 1, RARE)
    postings = lambda t, w: F.filter(F.transform(t.key, lambda k, i: F.when(k == w, i)), lambda i: i.isNotNull())

    def starts(t: Column, w: Column) -> Column:
        """Where the key phrase would begin, from the places of one word in text and template."""
        at = F.transform(F.filter("hits", lambda h: h.word == w), lambda h: h.at)
        return F.flatten(F.transform(postings(t, w), lambda p: F.transform(at, lambda i: i - p)))

    def places(t: Column) -> Column:
        words = looked_up(t)
        first = F.array_distinct(starts(t, F.get(words, 0)))
        agreed = F.when(F.size(words) > 1, F.array_intersect(first, starts(t, F.get(words, 1)))).otherwise(first)
        return F.filter(agreed, lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, F.size(t.key)) == t.key))

    def coverage(t: Column, at: Column) -> Column:
        same = lambda s: F.size(F.filter(F.transform(t.words, lambda w, j: F.get("words", s - t.key_at + j).eqNullSafe(w)), lambda x: x)) / F.size(t.words)
        return F.coalesce(F.array_max(F.transform(at, same)), F.lit(0.0))

    return own, possible, looked_up, places, coverage


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base (places of base phrases), their first and last word, base_labels, labels and score."""
    templates = [*BASE, *NOTICES]
    tokens = docs.select("doc_id", words(F.col("text")).alias("words"))
    order = by_rarity(templates, document_frequencies(tokens, sorted({w for t in templates for w in t.key_words})))
    own, possible, looked_up, places, coverage = _steps(templates, order)
    # Each step is a column that later ones read more than once, so that it is computed once a row.
    rows = tokens.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), own.alias("own"))
    rows = rows.withColumn("possible", possible)
    chosen = F.array_distinct(F.flatten(F.transform("possible", looked_up)))
    rows = rows.withColumn("chosen", chosen)
    every = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    none = F.array().cast("array<struct<word:string,at:int>>")
    rows = rows.withColumn("hits", F.when(F.size("chosen") > 0, F.filter(every, lambda h: F.array_contains("chosen", h.word))).otherwise(none))
    rows = rows.withColumn("found", F.transform("possible", lambda t: F.struct(t.id.alias("id"), t.label.alias("label"), places(t).alias("at"), t.alias("template"))))
    rows = rows.withColumn("found", F.filter("found", lambda f: F.size(f["at"]) > 0))
    rows = rows.select("doc_id", "n_words", F.transform("found", lambda f: F.struct(f.id.alias("id"), f.label.alias("label"), f["at"].alias("at"), coverage(f.template, f["at"]).alias("cover"))).alias("found"))
    base = F.filter("found", lambda f: f.id < len(BASE))
    rows = rows.withColumn("base", base).withColumn("at", F.flatten(F.transform("base", lambda f: f["at"])))
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f.label))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        labels("base").alias("base_labels"),
        labels(F.filter("found", lambda f: f.cover >= COVERAGE)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f.cover)), F.lit(0.0)).alias("score"),
    )
