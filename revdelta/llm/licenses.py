"""License scans by a positional index of rare words.

Templates are clauses of licence texts and notices. Counting their words over all
documents gives each word's rarity. The index is a table from word to postings, (template,
position), and holds each template's rarest words. A file's words that stand in it, its
rarest licence words, are looked up: each posting says at which word of the file its
template would start. Starts proposed alike by several words are verified against the
whole clause, and the template's mandatory phrases must stand there word for word.

Counting is a partial aggregate over at most as many rows per task as templates have
words; the index is as large as the templates, whatever the data; looking up and verifying
stays within a row, so nothing is shuffled for it. Every row costs its words plus its hits.

Null texts count as empty; a text without words has no places. Repeated rows are
scanned each for itself; columns that clash with the result are replaced. An empty table
gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revdelta.llm.common import free, hidden

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: phrases of the wording that must stand word for word; all of it, if none is given
    keys: tuple[str, ...] = ()

    @property
    def sequence(self) -> list[str]:
        return self.words.split()

    def phrases(self) -> list[tuple[int, list[str]]]:
        """(place in the wording, words) of the mandatory phrases."""
        own = self.sequence
        found = [k.split() for k in self.keys] or [own]
        return [(next(i for i in range(len(own)) if own[i : i + len(p)] == p), p) for p in found]


#: The base phrases.
BASE = (
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
)
#: Clauses that licences and their notices prescribe.
WORDINGS = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("this permission notice shall be included",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee",),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    Template(
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on"
        " an as is basis without warranties or conditions of any kind",
        ("required by applicable law",),
    ),
    Template("gpl", "licensed under the gnu general public license version 3", ("general public license",)),
    Template("gpl", "under the terms of the gnu general public license", ("general public license",)),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation",
        ("gnu general public license",),
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted",
        ("source and binary forms",),
    ),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("must retain the above copyright notice",),
    ),
    Template(
        "bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission",
        ("endorse or promote products",),
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("epl", "under the terms of the eclipse public license", ("eclipse public license",)),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template(
        "zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        ("authors be held liable",),
    ),
    Template(
        "unlicense", "this is free and unencumbered software released into the public domain",
        ("unencumbered software", "public domain"),
    ),
    Template("cc-by", "licensed under cc by 4 0", ("cc by",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "waived all copyright and related or neighboring rights", ("related or neighboring rights",)),
    Template("public-domain", "released into the public domain", ("public domain",)),
)
#: Rarest words by which one template is indexed, and how many of them must agree on a start.
ANCHORS, AGREE = 6, 2
#: Share of a wording's words that must stand in place.
LEAST_SCORE = 0.6


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    lower = F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    bare = F.regexp_replace(lower, rf"\A{_NOT_WORD}|{_NOT_WORD}\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _NOT_WORD, -1))


def rarity(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many documents each word of the templates stands, over all documents."""
    vocabulary = sorted({w for t in templates for w in t.sequence})
    found = F.array_intersect(F.lit(vocabulary), words_of(F.col(f"`{text}`")))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counts.collect()}  # a row per template word


def postings(
    templates: tuple[Template, ...], counts: dict[str, int], most: tuple[int, ...]
) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position): each template's rarest words, `most` of them, rarest first;
    places break ties."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, (template, size) in enumerate(zip(templates, most)):
        first = {w: i for i, w in reversed(list(enumerate(template.sequence)))}
        for word, at in sorted(first.items(), key=lambda x: (counts[x[0]], x[1]))[:size]:
            index.setdefault(word, []).append((k, at))
    return index


PLACE = "struct<template:int,start:int,score:double>"


def scan(
    docs: DataFrame,
    text: str = "text",
    base: tuple[Template, ...] = BASE,
    wordings: tuple[Template, ...] = WORDINGS,
) -> DataFrame:
    """docs plus n_words, base_places, places and score.

    base_places: (label, start) of every place where a base phrase stands; places:
    (label, start, score) of wordings; starts are word numbers from 0. score is the best
    share of a wording that stands in place, 1 where a base phrase stands, else 0.
    """
    docs = free(docs, "n_words", "base_places", "places", "score")
    templates = (*base, *wordings)
    most = tuple(1 if k < len(base) else ANCHORS for k in range(len(templates)))
    index = postings(templates, rarity(docs, text, templates), most)
    rare = sorted(index)
    own = [F.col(f"`{c}`") for c in docs.columns]
    words, at, starts, found = (F.col(hidden(docs, n)) for n in ("words", "at", "starts", "found"))
    name = lambda n: hidden(docs, n)

    def literal(values: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), kind)

    wordings_of = literal([t.sequence for t in templates], "array<array<string>>")
    keys_of = literal([[{"at": i, "words": p} for i, p in t.phrases()] for t in templates], "array<array<struct<at:int,words:array<string>>>>")
    labels_of = F.lit([t.label for t in templates])
    need = F.lit([min(AGREE, m) for m in most])
    entries = literal([[{"k": k, "at": i} for k, i in index[w]] for w in rare], "array<array<struct<k:int,at:int>>>")

    # one pass over the words keeps the numbers of rare ones; most texts have none
    numbers = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(rare), i)))
    rows = docs.select(*own, words_of(F.col(f"`{text}`")).alias(name("words")))
    rows = rows.select("*", F.when(F.arrays_overlap(words, F.lit(rare)), numbers).alias(name("at")))
    # every posting of a rare word proposes a start: template and start in one number
    proposed = F.flatten(F.transform(at, lambda p: F.transform(
        F.get(entries, F.array_position(F.lit(rare), F.get(words, p)).cast("int") - 1),
        lambda e: F.when(p >= e["at"], F.struct(e["k"].alias("k"), (p - e["at"]).alias("start"))),
    )))
    rows = rows.select("*", F.when(F.size(at) > 0, F.array_sort(F.array_compact(proposed))).alias(name("starts")))
    # sorted, a start that `need` words propose equals the one need - 1 places on
    agreed = F.array_distinct(F.filter(starts, lambda s, i: F.get(starts, i + F.get(need, s["k"]) - 1) == s))

    def stands(start: Column, phrase: Column) -> Column:
        return F.slice(words, start + 1, F.size(phrase)) == phrase

    def place(s: Column) -> Column:
        wording = F.get(wordings_of, s["k"])
        here = F.slice(words, s["start"] + 1, F.size(wording))
        same = F.size(F.filter(F.zip_with(here, wording, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
        keys = F.forall(F.get(keys_of, s["k"]), lambda p: stands(s["start"] + p["at"], p["words"]))
        score = F.when(keys, same / F.size(wording)).otherwise(0.0)
        return F.struct(s["k"].alias("template"), s["start"].alias("start"), score.alias("score")).cast(PLACE)

    places = F.filter(F.transform(agreed, place), lambda p: p["score"] >= F.when(p["template"] < len(base), 1.0).otherwise(LEAST_SCORE))
    nothing = F.array().cast(f"array<{PLACE}>")
    rows = rows.select(
        *own, F.size(words).cast("long").alias("n_words"), F.when(F.size(starts) > 0, places).otherwise(nothing).alias(name("found"))
    )
    told = lambda p: F.struct(
        F.get(labels_of, p["template"]).alias("label"), p["start"].cast("long").alias("start"), p["score"].alias("score")
    )
    best = F.array_max(F.transform(found, lambda p: p["score"]))
    return rows.select(
        *own, "n_words",
        F.transform(F.filter(found, lambda p: p["template"] < len(base)), told).alias("base_places"),
        F.transform(F.filter(found, lambda p: p["template"] >= len(base)), told).alias("places"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def labels(places: Column) -> Column:
    """The distinct labels of places, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
