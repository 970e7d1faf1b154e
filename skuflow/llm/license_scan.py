"""Licence scan by DataFrame functions only: a positional index of rare words over licence templates.

Every word of every template is indexed: word to (template, position). Document frequencies of these words are counted
over the whole corpus. Of each template a file looks up the ``LOOKUPS`` words of highest IDF that it holds (ties by the
word). Each of their occurrences says where the template would begin in the file; places that at least two different words
agree on are intersections of the postings, and one is kept if the template's mandatory phrase stands where it then should. The share
of the template's words that stand at their relative positions is the score; the best place counts. No word is too
frequent to be looked up, and the templates of a file don't compete.

Words are runs of ASCII letters and digits and of anything beyond ASCII, letters A-Z lowered. Besides, plain phrases
are counted: places where their words stand one after another.

Defined cases: a null text is an empty one (no words, no labels, score 0); repeated rows count as documents of their
own and get the same result; a null id is passed through. Only the id and text columns are read, so that others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    label: str
    text: str
    phrase: str

    @property
    def words(self) -> list[str]:
        return re.sub("[^0-9a-z]+", " ", self.text.lower()).split()


#: Headers, notices and bodies of well-known licences, and the phrase without which they are not that licence. Fixed values.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    Template("apache-2.0", "you may not use this file except in compliance with the License", "in compliance with the license"),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "you may not use this file except in compliance with the license",
    ),
    Template("mit", "Released under the MIT License", "mit license"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "hereby granted free of charge",
    ),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "to deal in the software without restriction",
    ),
    Template(
        "gpl-3.0", "This work is licensed under the GNU General Public License version 3", "gnu general public license version 3"
    ),
    Template(
        "gpl-2.0", "This work is licensed under the GNU General Public License version 2", "gnu general public license version 2"
    ),
    Template(
        "gpl", "redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general public license"
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
        "it under the terms of the gnu general public license",
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", "gnu lesser general public license"),
    Template("agpl", "under the terms of the GNU Affero General Public License", "gnu affero general public license"),
    Template(
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "creative commons attribution 4 0",
    ),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "source and binary forms",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        "redistributions of source code must retain the above copyright notice",
    ),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "subject to the terms of the mozilla public license",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "for any purpose with or without fee is hereby granted",
    ),
    Template(
        "unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"
    ),
)

#: Phrases that are counted in any case, and their labels. Fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Words of a template that a file looks up.
LOOKUPS = 4

_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def vocabulary() -> list[str]:
    return sorted({word for template in TEMPLATES for word in template.words})


def file_words(text: str) -> Column:
    """The words of a text. The Kelvin sign, which would lower to a plain k, gives way to another letter beyond ASCII."""
    plain = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\u00e5"))
    return F.filter(F.split(F.lower(F.regexp_replace(plain, _BREAKS, " ")), " "), lambda w: w != "")


def word_frequencies(files: DataFrame, words: str) -> list[str]:
    """The licence words that occur in the corpus, in fewest documents first; at most the templates' vocabulary."""
    known = F.array(*map(F.lit, vocabulary()))
    counted = files.select(F.explode(F.array_intersect(words, known)).alias("word")).groupBy("word").count()
    return [row["word"] for row in sorted(counted.collect(), key=lambda row: (row["count"], row["word"]))]


def phrase_places(words: str, phrase: str) -> Column:
    """First words of the places where the phrase's words stand one after another."""
    parts = phrase.split()
    places = F.transform(words, lambda w, i: F.when(w == parts[0], i))
    stands = F.filter(places, lambda i: i.isNotNull())
    for step, part in enumerate(parts[1:], 1):
        stands = _followed(stands, words, step, part)
    return stands


def _followed(places: Column, words: str, step: int, word: str) -> Column:
    return F.filter(places, lambda i: F.coalesce(F.get(words, i + step) == word, F.lit(False)))


def _phrase_at(template: Template) -> int:
    parts, phrase = template.words, template.phrase.split()
    return next(k for k in range(len(parts)) if parts[k : k + len(phrase)] == phrase)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _agreed(begins: Column) -> Column:
    """Places that at least two of the sorted ones share."""
    return _let(F.array_sort(begins), lambda s: F.array_distinct(F.filter(s, lambda b, i: (i > 0) & (F.get(s, i - 1) == b))))


def _found(template: Template, known: list[str], words: str, hits: Column, held: Column) -> Column:
    """(label, score) of the template in a file, or null; ``hits`` are the file's licence words with their places, ``held`` the distinct ones."""
    parts, phrase = template.words, template.phrase.split()
    ranked = F.array(*[F.lit(w) for w in known if w in set(parts)])
    places = F.create_map(*[x for w in dict.fromkeys(parts) for x in (F.lit(w), F.array(*[F.lit(k) for k, p in enumerate(parts) if p == w]))])

    def standing(looked_up: Column) -> Column:
        own = F.filter(hits, lambda h: F.array_contains(looked_up, h["w"]))
        begins = F.flatten(F.transform(own, lambda h: F.transform(places[h["w"]], lambda p: F.struct((h["i"] - p).alias("b"), h["w"].alias("w")))))
        at = _agreed(F.transform(F.array_distinct(begins), lambda x: x["b"]))
        for step, word in enumerate(phrase, _phrase_at(template)):
            at = _followed(at, words, step, word)
        right = F.transform(at, lambda b: sum((F.when(F.get(words, b + k) == w, 1).otherwise(0) for k, w in enumerate(parts)), F.lit(0)))
        return F.array_max(right)

    best = _let(F.slice(F.array_intersect(ranked, held), 1, LOOKUPS), standing)
    complete = F.size(F.array_intersect(F.array(*map(F.lit, dict.fromkeys(phrase))), held)) == len(set(phrase))
    return F.when(complete, _let(best, lambda n: F.when(n.isNotNull(), F.struct(F.lit(template.label).alias("label"), (n / float(len(parts))).alias("score")))))


def scan(known: list[str], words: str) -> Column:
    """Array of (label, score) of the templates found in a file; ``known`` are the corpus's licence words, highest IDF first."""
    nothing = F.expr("cast(array() as array<struct<label:string,score:double>>)")
    templates = [t for t in TEMPLATES if set(t.phrase.split()) <= set(known)]
    if not templates:
        return nothing
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*known))

    def all_templates(own: Column) -> Column:
        held = F.array_distinct(F.transform(own, lambda h: h["w"]))
        return _let(held, lambda v: F.filter(F.array(*[_found(t, known, words, own, v) for t in templates]), lambda x: x.isNotNull()))

    needed = [F.array_contains(words, max(t.phrase.split(), key=lambda w: -known.index(w))) for t in templates]
    return F.when(reduce(or_, needed), _let(hits, all_templates)).otherwise(nothing)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, an array of places for each of ``PHRASES``, and ``templates``: labels and scores of the method.

    Two passes over the text, for the frequencies and for the scan; nothing but a count per licence word is shuffled.
    """
    files = docs.select(id_col, file_words(text_col).alias("__words"))
    known = word_frequencies(files, "__words")
    nowhere = F.expr("cast(array() as array<int>)")
    places = [F.when(F.array_contains("__words", phrase.split()[0]), phrase_places("__words", phrase)).otherwise(nowhere).alias(label) for phrase, label in PHRASES]
    return files.select(id_col, F.size("__words").alias("n_words"), *places, scan(known, "__words").alias("templates"))
