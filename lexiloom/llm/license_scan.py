"""License scans by a positional rare-token index.

Templates are licence phrases with a label and a mandatory key phrase. The document frequency
of every template word is counted over all texts. The index lists, for each rare template word
(its frequency is at most COMMON of the texts, or it is its template's rarest), the templates
and places where it stands. A file's rare licence words are looked up; each lookup proposes a
template at a relative position (place in the file less place in the template), where the
postings of the template's words are intersected with the file's words. A proposal counts once,
for the first of its rare words. It is accepted if the key phrase stands whole in its place and
the words that agree weigh at least COVER of the template's inverse document frequencies.

The base phrases are templates that must agree in every word; all their places are counted.
All of it is one projection of each file: no shuffle, and no Python on the executors.

Defined cases: a null text counts as empty; a text without words has n_words 0, no places and
no labels; a very long text is scanned whole; repeated rows are scanned each, null ids stay null;
labels are sorted; of equal agreements all places count; score is the best accepted agreement, 0
without any; other columns, whatever their names, are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table

#: What separates words: ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A template word in at most this share of the texts is rare.
COMMON = 0.05
#: Share of a template's weight that must agree.
COVER = 0.6
#: Label and phrase whose every place is counted.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Label, text and mandatory key phrase of the method's own templates.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc0", "released under cc0 1 0 universal", "cc0 1"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("reserved", "all rights reserved", "all rights reserved"),
]


def _texts(c: Column) -> Column:
    """The words of a text, ASCII capitals lowered."""
    lowered = F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _strings(words: list[str | None]) -> Column:
    return F.array(*[F.lit(w).cast("string") for w in words])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of texts, and in how many each template word stands; at most one row for each template word is gathered."""
    vocabulary = sorted({w for _, t, *_ in [*BASE, *TEMPLATES] for w in t.split()})
    words = F.filter(_texts(F.col(text_col)), lambda w: w.isin(vocabulary))
    found = docs.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").count().collect()
    return docs.count(), {r["w"]: r["count"] for r in found}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places: every accepted (label, start, base, cover)."""
    n, frequency = document_frequencies(docs, text_col)
    weigh = {w: math.log((n + 1) / (frequency.get(w, 0) + 0.5)) for _, t, *_ in [*BASE, *TEMPLATES] for w in t.split()}
    templates = [(label, text.split(), text.split(), True) for label, text in BASE]
    templates += [(label, text.split(), key.split(), False) for label, text, key in TEMPLATES]
    rare = {w for w in weigh if frequency.get(w, 0) <= COMMON * n} | {max(words, key=lambda w: (weigh[w], w)) for _, words, *_ in templates}

    index: dict[str, list[Column]] = {}
    rows = []
    for t, (label, words, key, base) in enumerate(templates):
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        weights = [weigh[w] for w in words]
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                F.lit(base).alias("base"),
                _strings(words).alias("words"),
                _strings([w if w in rare else None for w in words]).alias("rare"),
                F.array(*[F.lit(float(x)) for x in weights]).alias("weights"),
                F.lit(float(sum(weights))).alias("weight"),
                F.lit(at + 1).alias("key_at"),
                _strings(key).alias("key"),
            )
        )
        for i, w in enumerate(words):
            if w in rare:
                index.setdefault(w, []).append(F.struct(F.lit(t + 1).alias("t"), F.lit(i).alias("i"), F.lit(len(words)).alias("n")))
    table_of = F.array(*rows)
    postings = F.create_map(*[c for w, p in sorted(index.items()) for c in (F.lit(w), F.array(*p))])

    def proposals(words: Column) -> Column:
        """For each rare word and posting: the template, where it would start, and the file's words there."""

        def window(at: Column, n: Column) -> Column:
            before = F.greatest(-at, F.lit(0))  # places before the file's first word
            here = F.slice(words, F.greatest(at, F.lit(0)) + 1, F.greatest(n - before, F.lit(0)))
            return F.concat(F.array_repeat(F.lit(""), before), here)

        lookups = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(rare)))
        return F.flatten(
            F.transform(
                lookups,
                lambda x: F.transform(
                    F.try_element_at(postings, x["w"]),
                    lambda p: F.struct(F.try_element_at(table_of, p["t"]).alias("t"), (x["i"] - p["i"]).alias("start"), p["i"].alias("i"), window(x["i"] - p["i"], p["n"]).alias("window")),
                ),
            )
        )

    def judged(p: Column) -> Column:
        t, window = p["t"], p["window"]
        same = F.zip_with(window, t["words"], lambda a, b: a.eqNullSafe(b))
        agreed = F.aggregate(F.zip_with(same, t["weights"], lambda s, w: F.when(s, w).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        return F.struct(
            t["label"].alias("label"),
            p["start"].alias("start"),
            t["base"].alias("base"),
            F.least(agreed / t["weight"], F.lit(1.0)).alias("cover"),
            (F.slice(window, t["key_at"], F.size(t["key"])) == t["key"]).alias("whole_key"),
            (F.array_position(F.zip_with(window, t["rare"], lambda a, b: b.isNotNull() & a.eqNullSafe(b)), True) == p["i"] + 1).alias("first"),
        )

    def accepted(words: Column) -> Column:
        good = F.filter(F.transform(proposals(words), judged), lambda c: c["whole_key"] & c["first"] & (c["base"] | (c["cover"] >= COVER)))
        return F.transform(good, lambda c: F.struct(c["label"].alias("label"), c["start"].alias("start"), c["base"].alias("base"), c["cover"].alias("cover")))

    # one lambda variable holds the words, so that a text is split once
    whole = F.transform(F.array(_texts(F.col(text_col))), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), accepted(words).alias("places")))
    found = docs.select(F.col(id_col).alias("doc_id"), F.inline(whole))
    base = F.filter("places", lambda c: c["base"])
    starts = F.transform(base, lambda c: c["start"].cast("long"))

    def names(places: Column | str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda c: c["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda c: c["cover"])), F.lit(0.0)).alias("score"),
        "places",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("places")
