"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame expressions only.

Blocks are the lines of a text and its paragraphs (parts between blank lines). A block B meets a
template T when |B and T| >= threshold * |T|, over their sets of words. Words have one global order,
rarest in the corpus first (then by spelling), counted over all documents. From it come

* the prefix filter: B must hold one of the |T| - need + 1 rarest words of T;
* the length filter: B must hold at least `need` words of the templates at all;
* the positional filter: what remains after the first common prefix word, on either side, must
  still reach `need`;

and what passes is verified by intersection. The prefix words form an inverted index: a word leads to
the templates whose prefix it is in, so a block looks at those alone, however many templates there are.
Templates are a parameter (a dict, or a table by templates_of), at most MOST_BYTES, which is checked: so
that side is a literal in the expression: no row is exploded, shuffled or joined, and a text that
holds no prefix word costs one lookup a word. What is collected is one count for each template word.

Base places: where a phrase's words stand consecutively. Base labels stay whatever the method says.

Edge cases: a null text has no words, no places and empty labels; an empty table gives an empty
result; repeated rows are scanned each on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: License notices and the labels of this method.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "artistic-2.0": "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0",
    "boost-1.0": "distributed under the boost software license version 1 0",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-released": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "copyright all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib-notice": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
#: Bytes of templates that may go into an expression.
MOST_BYTES = 1 << 20
THRESHOLD = 0.9
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _texts(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates of a table (label, text), lower-cased and cut into words; more than MOST_BYTES are an error. Of rows with one label the first in order counts."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("label")), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of templates, more than {MOST_BYTES}")
    words = F.array_join(_words(F.translate("text", UPPER, LOWER)), " ")
    rows = table.where("label is not null and text is not null").select("label", words.alias("t")).groupBy("label").agg(F.min("t").alias("t")).collect()
    return {r["label"]: r["t"] for r in rows if r["t"]}


def word_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, rarest in the documents first."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    counts = docs.select(F.explode(F.array_intersect(_words(lowered), _texts(vocabulary))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counts.collect()}  # at most one row for each template word
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _matches(text: Column, order: list[str], templates: dict[str, str], threshold: float) -> Column:
    """Array of (label, score): the best score of each template that some block meets."""
    rank = {w: i for i, w in enumerate(order)}
    rows, postings = [], {}
    for k, (label, t) in enumerate(sorted(templates.items())):
        words = sorted(set(t.split()), key=rank.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        prefix = words[: len(words) - need + 1]
        rows.append(F.struct(F.lit(label).alias("label"), _texts(words).alias("words"), _texts(prefix).alias("prefix"), F.lit(need).alias("need")))
        for w in prefix:
            postings.setdefault(w, []).append(k)
    index = F.array(*rows)
    led = sorted(postings, key=rank.__getitem__)
    lists = F.array(*[F.array(*[F.lit(k) for k in postings[w]]) for w in led])

    def against(block: Column) -> Column:
        def candidates(b: Column) -> Column:
            def possible(t: Column) -> Column:
                return let(
                    F.get(F.array_intersect(t["prefix"], b), F.lit(0)),
                    lambda w: w.isNotNull() & (F.least(F.size(t["words"]) - F.array_position(t["words"], w), F.size(b) - F.array_position(b, w)) + 1 >= t["need"]),
                )

            # the inverted index: only templates that a word of the block leads to
            met = F.array_distinct(F.flatten(F.transform(F.array_intersect(b, _texts(led)), lambda w: F.get(lists, (F.array_position(_texts(led), w) - 1).cast("int")))))
            reached = F.transform(met, lambda k: F.get(index, k))
            found = F.filter(reached, lambda t: (F.size(b) >= t["need"]) & possible(t))
            scored = F.transform(found, lambda t: F.struct(t["label"].alias("label"), F.size(F.array_intersect(t["words"], b)).alias("common"), t["need"].alias("need"), F.size(t["words"]).alias("n")))
            return F.transform(F.filter(scored, lambda x: x["common"] >= x["need"]), lambda x: F.struct(x["label"].alias("label"), (x["common"] / x["n"]).alias("score")))

        # the intersection keeps the order of its first array: words by global frequency
        return let(F.array_intersect(_texts(order), _words(block)), candidates)

    blocks = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n")))
    return F.flatten(F.transform(blocks, against))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs with a struct column license: n_words, places (array of (word, label)), matches (array of (label, score))."""
    if sum(len(k) + len(t) for k, t in templates.items()) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes of templates")
    order = word_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    prefixes = set()
    for t in templates.values():
        words = sorted(set(t.split()), key=rank.__getitem__)
        prefixes.update(words[: len(words) - math.ceil(threshold * len(words) - 1e-9) + 1])
    places_type = "array<struct<word:int,label:string>>"
    matches_type = "array<struct<label:string,score:double>>"

    def of(text: Column, w: Column) -> Column:
        def at(phrase: str, label: str) -> Column:
            def here(i: Column) -> Column:
                test = F.lit(True)
                for k, x in enumerate(phrase.split()):
                    test = test & (F.get(w, i + k) == x)
                return test

            starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)
            none = F.lit(None).cast(places_type)
            found = F.transform(starts, lambda i: F.struct(i.alias("word"), F.lit(label).alias("label")))
            return F.when(F.array_contains(w, phrase.split()[-1]), found).otherwise(F.coalesce(none, F.array().cast(places_type)))

        places = F.concat(*[at(p, label) for p, label in phrases.items()])
        matches = F.when(F.arrays_overlap(w, _texts(sorted(prefixes))), _matches(text, order, templates, threshold)).otherwise(F.array().cast(matches_type))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), places.alias("places"), matches.alias("matches"))

    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.withColumn("license", let(lowered, lambda t: let(_words(t), lambda w: of(t, w))))


def license_scan(docs: DataFrame) -> DataFrame:
    """The digest of scan(): one row for each row of docs (doc_id, text)."""
    x = F.col("license")
    starts = F.transform(x["places"], lambda p: p["word"].cast("bigint"))
    base = F.array_sort(F.array_distinct(F.transform(x["places"], lambda p: p["label"])))
    own = F.transform(x["matches"], lambda m: m["label"])
    score = F.when(F.size(x["places"]) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(x["matches"], lambda m: m["score"])), F.lit(0.0)))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        x["n_words"].alias("n_words"),
        F.size(x["places"]).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        score.alias("score"),
    )
