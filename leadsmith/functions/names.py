"""Person-name expressions: split (T8) and salutation.

Native array expressions only; no per-row Python. Titles and particles are
parameters. The title list is ours (the original relied on a parser library).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsmith.functions.text import _c, quote_regex, strip_ws
from leadsmith.sources.lookups import (
    NAME_PARTICLES,
    SALUTATION_FEMALE,
    SALUTATION_MALE,
    SALUTATION_NEUTRAL,
)

# Honorifics and academic titles dropped before splitting (our own list).
DEFAULT_TITLES = ["dr", "prof", "herr", "frau", "mr", "mrs", "ms", "dipl", "ing", "mag", "sir"]


# Degrees and generations that follow a name (our own list).
DEFAULT_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "ph.d", "mba", "msc", "m.sc", "bsc", "b.sc", "md", "m.d", "esq"]


def _without_suffixes(raw: Column, suffixes: Sequence[str]) -> Column:
    """The name without the suffixes at its end, unless nothing else is left."""
    if not suffixes:
        return raw
    listed = "|".join(quote_regex(x) for x in sorted(suffixes, key=lambda x: (-len(x), x)))
    return F.coalesce(F.nullif(F.regexp_replace(raw, rf"(?i)(?:[,\s]+(?:{listed})\.?)+$", ""), F.lit("")), raw)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def split_name(c, titles: Sequence[str] = DEFAULT_TITLES,
               particles: Sequence[str] = NAME_PARTICLES, suffixes: Sequence[str] = DEFAULT_SUFFIXES) -> Column:
    """``struct(first_name, last_name)`` as a single expression.

    Prefer ``with_split_name`` on DataFrames: it stages the intermediate
    arrays as columns, so the array lambdas never re-evaluate the parsing.
    """
    raw = _without_suffixes(strip_ws(_c(c)), suffixes)
    toks, raw_toks, before, comma = _parse_parts(raw, titles)
    return _assemble(raw, toks, raw_toks, before, comma, particles)


def _parse_parts(raw: Column, titles: Sequence[str]):
    title_set = F.array(*[F.lit(t) for t in titles])
    comma = F.instr(raw, ",")
    before = F.nullif(strip_ws(F.substring_index(raw, ",", 1)), F.lit(""))
    body = F.when(comma > 0, F.substr(raw, comma + 1)).otherwise(raw)
    toks = F.filter(
        _tokens(body),
        lambda x: ~F.array_contains(title_set, F.lower(F.regexp_replace(x, r"\.$", ""))),
    )
    raw_toks = _tokens(F.replace(raw, F.lit(","), F.lit(" ")))
    return toks, raw_toks, before, comma


def _assemble(raw, toks, raw_toks, before, comma, particles):
    particle_set = F.array(*[F.lit(p) for p in particles])
    n = F.size(toks)
    first = F.nullif(F.try_element_at(toks, F.lit(1)), F.lit(""))
    mid = F.slice(toks, 2, F.greatest(n - 2, F.lit(0)))
    m = F.size(mid)
    # index of the last middle word that is not a particle (0 if none)
    j = F.coalesce(F.array_max(F.filter(
        F.transform(mid, lambda x, i: F.when(~F.array_contains(particle_set, F.lower(x)), i + 1)),
        lambda i: i.isNotNull())), F.lit(0))
    tail = F.concat(F.slice(mid, j + 1, m - j), F.array(F.try_element_at(toks, n)))
    last_plain = F.when(n >= 2, F.array_join(tail, " "))
    last = F.when(comma > 0, before).otherwise(last_plain)
    fallback = last.isNull() & (F.size(raw_toks) >= 2)
    first_out = F.when(fallback, F.coalesce(first, F.try_element_at(raw_toks, F.lit(1)))).otherwise(first)
    last_out = F.when(
        fallback, F.array_join(F.slice(raw_toks, 2, F.size(raw_toks) - 1), " ")
    ).otherwise(last)
    empty = raw.isNull() | (raw == "")
    null = F.lit(None).cast("string")
    return F.struct(
        F.when(empty, null).otherwise(first_out).alias("first_name"),
        F.when(empty, null).otherwise(last_out).alias("last_name"),
    )


def with_split_name(df, person_col: str, first_col: str = "first_name", last_col: str = "last_name",
                    titles: Sequence[str] = DEFAULT_TITLES,
                    particles: Sequence[str] = NAME_PARTICLES,
                    suffixes: Sequence[str] = DEFAULT_SUFFIXES):
    """T8 on a DataFrame: adds ``first_col`` and ``last_col``.

    * null / blank -> both null
    * ``Last, First ...`` -> the whole text before the comma is the last name
    * otherwise first word / last word; middle words that are all particles
      at the end of the middle (``von der``) join the last name
    * suffixes at the end, with or without a comma, are dropped first
    * titles are dropped; when no last name is left but the raw text has at
      least two words, word 1 / the rest
    """
    cols = [c for c in df.columns if c not in (first_col, last_col)]
    staged = df.withColumn("__raw", _without_suffixes(strip_ws(F.col(person_col)), suffixes))
    toks, raw_toks, before, comma = _parse_parts(F.col("__raw"), titles)
    staged = staged.select(*cols, "__raw", toks.alias("__toks"), raw_toks.alias("__raw_toks"),
                           before.alias("__before"), comma.alias("__comma"))
    parsed = _assemble(F.col("__raw"), F.col("__toks"), F.col("__raw_toks"), F.col("__before"),
                       F.col("__comma"), particles)
    staged = staged.select(*cols, parsed.alias("__n"))
    return staged.select(*cols, F.col("__n.first_name").alias(first_col),
                         F.col("__n.last_name").alias(last_col))


def salutation(gender) -> Column:
    g = _c(gender)
    return (F.when(g == "male", F.lit(SALUTATION_MALE))
            .when(g == "female", F.lit(SALUTATION_FEMALE))
            .otherwise(F.lit(SALUTATION_NEUTRAL)))


def addressed_name(gender, last_name) -> Column:
    """The name put after the salutation: empty for the neutral form or a null name."""
    g, n = _c(gender), _c(last_name)
    return F.when(g.isin("male", "female") & n.isNotNull(), n).otherwise(F.lit(""))


def salutation_safe(gender, last_name) -> Column:
    """Q15: a null last name falls back to the neutral salutation."""
    g, n = _c(gender), _c(last_name)
    return F.when(n.isNull(), F.lit(SALUTATION_NEUTRAL)).otherwise(salutation(g))
