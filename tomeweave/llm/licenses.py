"""License scans with a positional rare-token index.

Words are ASCII letters and digits (A-Z lower-cased) and all characters beyond ASCII. Base: the
places where the words of a phrase of BASE stand one after the other.

How rare a licence word is (IDF) is counted over all documents. Of each notice in TEMPLATES the
`rarest` words of highest IDF are its anchors; the index holds, for each anchor, the notices and
positions where it stands. Every occurrence of an anchor in a document votes for (notice, start of
the notice in the document), so that postings are intersected by relative position however many
notices a file holds. Starts on which two anchors agree are verified: the notice's mandatory
phrases must stand at their place, and `share` of its words. What passes adds the notice's label; its
share is the score, and 1 where a base phrase stands.

Everything is an expression over one row, so nothing is shuffled but the counts per licence
word. The templates are part of the program, so the index has a fixed size.

Null and empty texts have no words, labels or places (score 0). Repeated rows are scanned each,
texts of any length as a whole; votes are counted by one sort, so long files with many notices
cost no more per word. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, table

#: phrase, label
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: label, notice in short, mandatory phrases
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "this software is distributed under the terms of the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under apache 2 0", ("apache 2 0",)),
    ("bsd-2", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd-3", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ("endorse or promote",)),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    ("isc", "licensed under the isc license", ("isc license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("deal in the software without restriction", "substantial portions of the software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("bsd-2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("must retain the above copyright notice", "must reproduce the above copyright notice")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache license version 2", "required by applicable law")),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish",)),
)
#: Words too general to be looked up.
GENERAL = frozenset("a an and any are as be by for from in is it its may nor not of on or the this to use used with you 0 1 2 3 4 under".split())


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - GENERAL)


def with_words(documents: DataFrame) -> DataFrame:
    """documents with `_w`, the words, and `_hits`, place and word of each licence word."""
    plain = F.trim(F.regexp_replace(lowered(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    words = F.when(F.col("_plain") == "", F.array().cast("array<string>")).otherwise(F.split("_plain", " "))
    placed = F.transform("_w", lambda w, i: F.when(w.isin(vocabulary()), F.struct(i.alias("p"), w.alias("w"))))
    return documents.withColumn("_plain", plain).withColumn("_w", words).withColumn("_hits", F.filter(placed, lambda h: h.isNotNull())).drop("_plain")


def rarity(documents: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all documents."""
    spread = with_words(documents.select("text")).select(F.explode(F.array_distinct(F.transform("_hits", lambda h: h.w))).alias("w"))
    count = {r.w: r.n for r in spread.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per licence word
    total = documents.count()
    return {w: math.log((total + 1) / (count.get(w, 0) + 1)) for w in vocabulary()}


def constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def anchors(idf: dict[str, float], rarest: int) -> list[list[str]]:
    """The words of each notice by which it is looked up."""
    return [sorted({w for w in text.split() if w in idf}, key=lambda w: (-idf[w], w))[:rarest] for _, text, _ in TEMPLATES]


def scanned(documents: DataFrame, rarest: int = 3, share: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of documents."""
    idf = rarity(documents)
    postings: dict[str, list] = {}
    for t, own in enumerate(anchors(idf, rarest)):
        for p, w in enumerate(TEMPLATES[t][1].split()):
            if w in own:
                postings.setdefault(w, []).append({"t": t, "p": p})
    notices = [{"label": label, "words": text.split(), "keys": [{"at": _place(text, k), "words": k.split()} for k in keys]} for label, text, keys in TEMPLATES]
    index = constant(postings, "map<string,array<struct<t:int,p:int>>>")
    known = constant(notices, "array<struct<label:string,words:array<string>,keys:array<struct<at:int,words:array<string>>>>>")
    at = lambda start, words: (start >= 0) & (F.slice("_w", F.greatest(start, F.lit(0)) + 1, F.size(words)) == words)

    df = with_words(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_w", "_hits")

    def places(phrase: str) -> Column:
        words = phrase.split()
        anchor = next(i for i, w in enumerate(words) if w not in GENERAL)
        wanted = F.array(*map(F.lit, words))
        return F.transform(F.filter("_hits", lambda h: (h.w == words[anchor]) & at(h.p - anchor, wanted)), lambda h: h.p - anchor)

    df = df.withColumn("_base", F.array(*[places(phrase) for phrase, _ in BASE]))
    chosen = F.filter("_hits", lambda h: h.w.isin(sorted(postings)))
    # each anchor votes once for a start
    votes = F.array_distinct(F.flatten(F.transform(chosen, lambda h: F.transform(F.element_at(index, h.w), lambda v: F.struct(v.t.alias("t"), (h.p - v.p).alias("start"), h.w.alias("w"))))))
    votes = F.transform(votes, lambda v: F.struct(v.t.alias("t"), v.start.alias("start")))
    df = df.withColumn("_votes", F.when(F.size("_hits") > 1, F.array_sort(votes)))
    vote = lambda i: F.get(F.col("_votes"), i)
    df = df.withColumn("_starts", F.filter("_votes", lambda v, i: (i > 0) & (v == vote(i - 1)) & ((i < 2) | (v != F.coalesce(vote(i - 2), v)))))
    notice = lambda v: F.element_at(known, v.t + 1)
    agreed = lambda v: F.size(F.filter(F.zip_with(F.slice("_w", F.greatest(v.start, F.lit(0)) + 1, F.size(notice(v).words)), notice(v).words, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)) / F.size(notice(v).words)
    stands = lambda v: (v.start >= 0) & F.forall(notice(v).keys, lambda k: at(v.start + k["at"], k["words"]))
    df = df.withColumn("_found", F.transform(F.filter("_starts", stands), lambda v: F.struct(agreed(v).alias("share"), notice(v).label.alias("label"))))
    df = df.withColumn("_passed", F.coalesce(F.filter("_found", lambda f: f.share >= share), F.array().cast("array<struct<share:double,label:string>>")))
    starts = F.flatten("_base")
    base = F.array_sort(F.filter(F.array(*[F.when(F.size(F.element_at("_base", i + 1)) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull()))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("_passed", lambda f: f.label))))
    score = F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_passed", lambda f: f.share)), F.lit(0.0)))
    return df.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.cast("double").alias("score"),
    )


def _place(text: str, phrase: str) -> int:
    return len(text[: f" {text} ".index(f" {phrase} ")].split())


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
