"""Licence scan with a positional rare-token index, in DataFrame functions only.

Every template is a sequence of words with a label and mandatory key phrases.
The corpus gives each template word its inverse document frequency; the index
holds, for every template, the positions of its ``RARE`` words of highest IDF.
A file's occurrences of those words are looked up, each posting proposes the
place where the template would begin, the proposals of a template's rare words
are intersected, and at each place left the key phrases are compared word by
word. The score is the best IDF-weighted share of a template found in place.

Defined results: null and empty texts have no words, no label and score 0;
repeated rows get equal results; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import text_or_empty

#: What separates words (before lower-casing A-Z, which are word characters).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Label, words of the template, key phrases (all of them must
#: stand in place). The first four are the base phrases.
BASE_TEMPLATES = [
    ("gpl", "gnu general public license", ["gnu general public license"]),
    ("apache", "apache license", ["apache license"]),
    ("cc-by", "cc by", ["cc by"]),
    ("mit", "mit license", ["mit license"]),
]
MORE_TEMPLATES = [
    ("gpl-2.0", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
    ("creative-commons", "creative commons attribution", ["creative commons attribution"]),
    ("mpl", "mozilla public license", ["mozilla public license"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("spdx", "spdx license identifier", ["spdx license identifier"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "are permitted provided that"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files",
     ["permission is hereby granted free of charge", "any person obtaining a copy"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software released into the public domain"]),
]
#: Words of each template that the index holds.
RARE = 2


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]   # word ranges of the key phrases
    base: bool

    @classmethod
    def of(cls, label: str, text: str, phrases: list[str], base: bool) -> Template:
        words, keys = text.split(), []
        for p in phrases:
            part = p.split()
            at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
            keys.append((at, at + len(part)))
        return cls(label, tuple(words), tuple(keys), base)


TEMPLATES = [Template.of(*t, True) for t in BASE_TEMPLATES] + [Template.of(*t, False) for t in MORE_TEMPLATES]


def _lowered(word: Column) -> Column:
    """A-Z in lower case; null where other letters would become ASCII ones (their
    UTF-8 length changes), as those are other words."""
    low = F.lower(word)
    return F.when(F.octet_length(low) == F.octet_length(word), low)


def with_words(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``__w`` (the words as written) and ``__n`` (their number)."""
    return (df.withColumn("__w", F.filter(F.split(text_or_empty(text_col), SEPARATORS), lambda w: w != ""))
            .withColumn("__n", F.size("__w")))


def _places(vocabulary: list[str]) -> Column:
    """Positions of the words of ``vocabulary``."""
    return F.when(F.col("__n") > 0, F.filter(F.sequence(F.lit(0), F.col("__n") - 1),
                                             lambda i: F.coalesce(_lowered(F.get("__w", i)).isin(vocabulary), F.lit(False)))
                  ).otherwise(F.array().cast("array<int>"))


def word_idf(docs: DataFrame, templates: list[Template], text_col: str) -> dict[str, float]:
    """IDF over all documents of every template word (a fixed number of groups)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = (with_words(docs.select(text_col), text_col)
            .select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
                _places(vocabulary), lambda i: F.lower(F.get("__w", i)))))).alias("word")))
    rows = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = rows.get("", 0)
    return {w: math.log((total + 1) / (rows.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def _found(t: Template, idf: dict[str, float], rare: int) -> Column:
    """``(start, share)`` of every proposed place of a template with its key phrases."""
    order = sorted(range(len(t.words)), key=lambda j: (-idf[t.words[j]], j))[:rare]
    def starts(j):
        return F.transform(F.filter("__hits", lambda h: h["word"] == t.words[j]), lambda h: h["at"] - j)

    places = F.array_distinct(starts(order[0]))
    for j in order[1:]:
        places = F.array_intersect(places, starts(j))

    def same(start, j):
        return F.coalesce(_lowered(F.get("__w", start + F.lit(j))) == t.words[j], F.lit(False))

    def keys_hold(start):
        held = (start >= 0)
        for j in sorted({j for a, b in t.keys for j in range(a, b)}):
            held = held & same(start, j)
        return held

    whole = sum(idf[w] for w in t.words)
    if {j for a, b in t.keys for j in range(a, b)} == set(range(len(t.words))):
        def share(start):
            return F.lit(1.0)
    else:
        def share(start):
            total = F.lit(0.0)
            for j, w in enumerate(t.words):
                total = total + F.when(same(start, j), F.lit(idf[w])).otherwise(0.0)
            return F.least(total / whole, F.lit(1.0))
    return F.transform(F.filter(places, keys_hold), lambda s: F.struct(s.alias("start"), share(s).alias("share")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[Template] | None = None, rare: int = RARE,
                  min_share: float = 0.8) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.
    A template other than a base one counts from ``min_share`` of its weight on."""
    templates = TEMPLATES if templates is None else templates
    idf = word_idf(docs, templates, text_col)
    anchors = sorted({t.words[j] for t in templates
                      for j in sorted(range(len(t.words)), key=lambda j: (-idf[t.words[j]], j))[:rare]})
    df = with_words(docs.select(F.col(id_col), text_col), text_col)
    df = df.select(id_col, "__w", "__n", F.transform(_places(anchors), lambda i: F.struct(
        F.lower(F.get("__w", i)).alias("word"), i.alias("at"))).alias("__hits"))
    df = df.select(id_col, "__n", *(F.when(F.size("__hits") > 0, _found(t, idf, rare))
                                    .otherwise(F.array().cast("array<struct<start:int,share:double>>")).alias(f"__t{k}")
                                    for k, t in enumerate(templates)))

    def names(cols):
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*cols), lambda x: x.isNotNull()))), ",")

    base = [k for k, t in enumerate(templates) if t.base]
    starts = F.concat(*(F.transform(f"__t{k}", lambda x: x["start"]) for k in base))
    shares = F.concat(F.array(F.lit(0.0)), *(F.transform(f"__t{k}", lambda x: x["share"]) for k in range(len(templates))))
    held = {k: (F.size(f"__t{k}") > 0) if t.base else
            F.exists(f"__t{k}", lambda x: x["share"] >= min_share) for k, t in enumerate(templates)}
    label = {k: F.when(held[k], F.lit(t.label)) for k, t in enumerate(templates)}
    return (df.withColumn("__s", starts)
            .select(id_col, F.col("__n").cast("long").alias("n_words"), F.size("__s").cast("long").alias("n_base"),
                    F.array_min("__s").cast("long").alias("first_word"), F.array_max("__s").cast("long").alias("last_word"),
                    names([label[k] for k in base]).alias("base_labels"),
                    names(list(label.values())).alias("labels"), F.array_max(shares).alias("score")))
