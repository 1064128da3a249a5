"""Licence scan with a positional index of rare words.

The index has, for every word of the templates, its postings: template and position. Of a file its rarest licence words, by document frequency over all
files, are looked up (and the rarest word of each base phrase, so that those are never missed). A posting at relative
position i of a word at place p proposes that the template starts at p - i; where two words propose the same start the postings meet. There the template's
mandatory key phrase must stand in full, and enough of its weight around it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import NOT_ALNUM, ascii_lower, let, words

LEAST_SHARE = 0.6        # of a template's weight that must be found at its place
RAREST = 16              # licence words of a file that are looked up
_PLACES, _SHIFT = 1 << 32, 1 << 16    # a proposal is template * _PLACES + start + _SHIFT; starts lie above -_SHIFT


@dataclass(frozen=True)
class Notice:
    """The words of a notice and, within them, the key phrase that must stand in full."""
    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        key = self.key.split()
        return next(i for i in range(len(self.words)) if self.words[i:i + len(key)] == key)


# The base phrases and their labels.
BASE = (
    Notice("cc-by", "cc by", "cc by"),
    Notice("gpl", "general public license", "general public license"),
    Notice("reserved", "all rights reserved", "all rights reserved"),
)

# Usual wordings of licence notices, as words.
NOTICES = (
    Notice("mit", "released under the mit license", "mit license"),
    Notice("mit", "licensed under the mit license", "mit license"),
    Notice("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Notice("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Notice("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Notice("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Notice("cc0", "to the extent possible under law waived all copyright cc0 1 0 universal", "cc0 1 0 universal"),
    Notice("copyright", "copyright c all rights reserved", "all rights reserved"),
)

# The texts and file headers of licences, as words.
TEXTS = (
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
           "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
           "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
           "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
           "noninfringement", "permission is hereby granted free of charge to any person obtaining"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
           "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard "
           "to this software including all implied warranties of merchantability and fitness", "for any purpose with or without fee is hereby granted"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
           "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary "
           "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
           "provided with the distribution", "redistribution and use in source and binary forms"),
    Notice("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
           "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
           "and redistribute it freely", "permission is granted to anyone to use this software for any purpose"),
    Notice("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
           "covered by this license the software to use reproduce display distribute execute and transmit the software", "person or organization obtaining a copy"),
    Notice("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
           "a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
           "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
           "you may not use this file except in compliance with the license"),
    Notice("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
           "the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will "
           "be useful but without any warranty", "either version 2 of the license"),
    Notice("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
           "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will "
           "be useful but without any warranty", "either version 3 of the license"),
    Notice("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
           "by the free software foundation", "gnu lesser general public license as published"),
    Notice("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
           "by the free software foundation", "gnu affero general public license as published"),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
           "you can obtain one at", "terms of the mozilla public license"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
           "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
           "unencumbered software released into the public domain"),
    Notice("wtfpl", "do what the fuck you want to public license terms and conditions for copying distribution and modification", "want to public license"),
)


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and how many have each word of the templates: a row per word at most."""
    listed = F.array(*map(F.lit, vocabulary))
    has = words(ascii_lower(F.col(text_col)), NOT_ALNUM)
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(has, listed))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


def _index(templates: tuple[Notice, ...]) -> Column:
    """The postings of every word: a map from the word to numbers that give, with a place added, template and start (see `_PLACES`)."""
    postings: dict[str, list[Column]] = {}
    for k, t in enumerate(templates):
        for i, x in enumerate(t.words):
            postings.setdefault(x, []).append(F.lit(k * _PLACES + _SHIFT - i).cast("long"))
    return F.map_from_arrays(F.array(*map(F.lit, postings)), F.array(*[F.array(*own) for own in postings.values()]))


def _facts(templates: tuple[Notice, ...], idf: dict[str, float]) -> Column:
    """Of every template, by number: its words, their share of its weight, its key phrase and where that stands."""
    rows = []
    for t in templates:
        total = sum(idf[x] + 1e-9 for x in t.words)
        rows.append(F.struct(F.array(*map(F.lit, t.words)).alias("words"), F.array(*[F.lit((idf[x] + 1e-9) / total) for x in t.words]).alias("weights"),
                             F.array(*map(F.lit, t.key.split())).alias("key"), F.lit(t.key_at).alias("key_at"), F.lit(t.label).alias("label")))
    return F.array(*rows)


def _share(w: Column, start: Column, fact: Column) -> Column:
    """The part of a template's weight that stands at a start."""
    there = F.transform(fact["words"], lambda x, i: F.coalesce(F.get(w, start + i) == x, F.lit(False)))
    return F.aggregate(F.zip_with(there, fact["weights"], lambda t, x: F.when(t, x).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Notice, ...] = BASE,
         notices: tuple[Notice, ...] = (*NOTICES, *TEXTS), rarest: int = RAREST) -> DataFrame:
    """`id, n_words, n_base, first_word, last_word, base_labels, labels, score` for every row.

    Base phrases count wherever their words stand consecutively. `labels` adds the templates that two of the file's `rarest` licence words place
    at one start, whose key phrase stands there and of whose weight at least LEAST_SHARE is found. `score` is 1 with a base phrase, else the
    best share of a labelled template, else 0. Words of equal document frequency go by the alphabet. A null or
    empty text has no words, no labels and score 0. Each row is judged alone, so repeated rows and null ids change nothing
    but the document frequencies. No column but the two named ones is read.
    """
    every = (*base, *notices)
    n_docs, df = frequencies(docs, sorted({x for n in every for x in n.words}), text_col)
    idf = {x: math.log((n_docs + 1) / (n + 1)) for x, n in df.items()}
    by_rarity = sorted(df, key=lambda x: (df[x], x))
    always = sorted({min(t.words, key=by_rarity.index) for t in base})
    w, none = F.col("w"), F.array().cast("array<bigint>")
    nowhere = F.array().cast("array<struct<k:int,start:int>>")
    split = docs.select(F.col(id_col).alias("id"), words(ascii_lower(F.col(text_col)), NOT_ALNUM).alias("w"))
    known = F.array(*map(F.lit, by_rarity))
    asked = F.array_union(F.slice(F.array_intersect(known, w), 1, rarest), F.array_intersect(F.array(*map(F.lit, always)), w))
    looked = split.select("id", "w", F.size("w").cast("long").alias("n_words"), asked.alias("asked"))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda p: F.array_contains("asked", F.get(w, p)))
    index = _index(every)
    proposed = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(index, F.get(w, p)), lambda q: q + p)))
    met = looked.select("id", "w", "n_words", F.when(F.size("asked") > 0, F.sort_array(proposed)).otherwise(none).alias("proposed"))
    # As one number each, proposals are sorted and told apart natively.
    twice = F.array_distinct(F.filter("proposed", lambda c, i: (c < len(base) * _PLACES) | F.coalesce(F.get(F.col("proposed"), i + 1) == c, F.lit(False))))
    twice = F.transform(twice, lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("k"), (F.pmod(c, F.lit(_PLACES)) - _SHIFT).cast("int").alias("start")))
    facts = _facts(every, idf)

    def whole_key(c: Column) -> Column:
        def stands(fact: Column) -> Column:
            first = c["start"] + fact["key_at"]
            return (first >= 0) & (F.slice(w, F.greatest(first, F.lit(0)) + 1, F.size(fact["key"])) == fact["key"])
        return let(F.get(facts, c["k"]), stands)

    sure = met.select("id", "w", "n_words", F.when(F.size("proposed") > 0, F.filter(twice, whole_key)).otherwise(nowhere).alias("sure"))
    shares = F.transform(F.filter("sure", lambda c: c["k"] >= len(base)), lambda c: let(F.get(facts, c["k"]), lambda f: F.struct(
        f["label"].alias("label"), _share(w, c["start"], f).alias("share"))))
    found = sure.select("id", "n_words", F.filter("sure", lambda c: c["k"] < len(base)).alias("base"),
                        F.filter(shares, lambda x: x["share"] >= LEAST_SHARE).alias("more"))
    starts = F.transform("base", lambda c: c["start"])
    own = F.transform("base", lambda c: F.get(F.array(*[F.lit(t.label) for t in base]), c["k"]))

    def shown(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    best = F.coalesce(F.array_max(F.transform("more", lambda x: x["share"])), F.lit(0.0))
    return found.select("id", "n_words", F.size("base").cast("long").alias("n_base"),
                        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                        shown(own).alias("base_labels"), shown(F.concat(own, F.transform("more", lambda x: x["label"]))).alias("labels"),
                        F.when(F.size("base") > 0, 1.0).otherwise(F.round(F.least(best, F.lit(1.0)), 6)).alias("score"))


def _sql() -> str:
    rows = []
    for k, n in enumerate((*BASE, *NOTICES, *TEXTS)):
        key = range(n.key_at, n.key_at + len(n.key.split()))
        rows += [f"({k}, '{n.label}', {k < len(BASE)}, {i}, '{x}', {i in key})" for i, x in enumerate(n.words)]
    return rf"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
notice(k, label, base, pos, word, in_key) AS (VALUES {', '.join(rows)}),
stands AS (
  SELECT * FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM doc) WHERE word IN (SELECT word FROM notice)),
df AS (
  SELECT v.word, coalesce(n, 0) AS df, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (coalesce(n, 0) + 1)) AS idf
  FROM (SELECT DISTINCT word FROM notice) v LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS n FROM stands GROUP BY word) USING (word)),
always AS (
  SELECT DISTINCT word FROM (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY df, word) AS r FROM notice JOIN df USING (word) WHERE base) WHERE r = 1),
held AS (SELECT DISTINCT doc_id, word, df FROM stands JOIN df USING (word)),
asked AS (
  SELECT doc_id, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, word) AS r FROM held) WHERE r <= {RAREST}
  UNION SELECT doc_id, word FROM held WHERE word IN (SELECT word FROM always)),
proposed AS (
  SELECT s.doc_id, n.k, any_value(n.base) AS base, s.place - n.pos AS start, count(*) AS m
  FROM stands s JOIN asked USING (doc_id, word) JOIN notice n USING (word) GROUP BY s.doc_id, n.k, s.place - n.pos),
whole AS (SELECT k, sum(idf + 1e-9) AS weight, count(*) FILTER (WHERE in_key) AS n_key FROM notice JOIN df USING (word) GROUP BY k),
met AS (
  SELECT p.doc_id, p.k, p.start, any_value(n.label) AS label, any_value(n.base) AS base, count(*) FILTER (WHERE n.in_key) AS n_key, sum(d.idf + 1e-9) AS weight
  FROM proposed p JOIN notice n USING (k) JOIN df d USING (word) JOIN stands s ON s.doc_id = p.doc_id AND s.place = p.start + n.pos AND s.word = n.word
  WHERE p.base OR p.m >= 2 GROUP BY p.doc_id, p.k, p.start),
found AS (
  SELECT doc_id, label, base, start, met.weight / whole.weight AS share FROM met JOIN whole USING (k)
  WHERE met.n_key = whole.n_key AND (base OR met.weight / whole.weight >= {LEAST_SHARE})),
labelled AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels
  FROM (SELECT doc_id, label, bool_or(base) AS base FROM found GROUP BY doc_id, label) GROUP BY doc_id),
counted AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE round(least(coalesce(share, 0), 1), 6) END AS score
FROM doc d LEFT JOIN labelled USING (doc_id) LEFT JOIN counted USING (doc_id)
"""


SQL = _sql()
