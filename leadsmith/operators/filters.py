"""Row filters.

A list given in Python becomes one predicate; a list given as a table, of any
length, is joined and never collected. Both are normalised alike (``\\s`` of
Java's patterns stripped at either end, lower case) and keep the same rows.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.functions.text import (
    _c,
    email_domain_last,
    literal_alternation,
    norm_str,
)
from leadsmith.sources.lookups import RECENCY_PERIODS

# What Java's ``\\s`` matches: the characters ``norm_str`` strips.
_SPACES = " \t\n\x0b\f\r"


def _normalised(terms: Sequence[str]) -> list[str]:
    return [t.strip(_SPACES).lower() for t in terms if t is not None and t.strip(_SPACES) != ""]


# --------------------------------------------------------------------------- P2


def recency_days(period: int, as_of: str | _dt.date) -> tuple[_dt.date, _dt.date]:
    """First and last day of a period: the as-of day (0), the day before (1), or the
    last 7 days (7)."""
    if period not in RECENCY_PERIODS:
        raise ValueError(f"period must be one of {RECENCY_PERIODS}, got {period!r}")
    day = _dt.date.fromisoformat(str(as_of))
    first = {0: day, 1: day - _dt.timedelta(days=1), 7: day - _dt.timedelta(days=7)}[period]
    return first, first if period == 1 else day


def recency_filter(df: DataFrame, ts_col: str, period: int, as_of: str | _dt.date) -> DataFrame:
    """Rows of the as-of day (0), the day before (1), or the last 7 days (7).

    ``as_of`` is always a parameter (never the wall clock); edges are inclusive.
    The predicate is a range on ``ts`` itself so it reaches the parquet scan.
    """
    start, last = recency_days(period, as_of)
    end = last + _dt.timedelta(days=1)
    ts = F.col(ts_col)
    # Bounds are built from text and cast to the column's own type: no Python
    # time zone is involved (TIMESTAMP_NTZ stays wall-clock, TIMESTAMP uses
    # the session time zone), and the range reaches the scan as a pushed filter.
    dtype = df.schema[ts_col].dataType
    lo = F.lit(f"{start.isoformat()} 00:00:00").cast(dtype)
    hi = F.lit(f"{end.isoformat()} 00:00:00").cast(dtype)
    return df.where((ts >= lo) & (ts < hi))


# --------------------------------------------------------------------------- P3


def drop_any_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop a row if any (or any of ``subset``) column is null."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


# --------------------------------------------------------------------------- P4 / P6

# Lengths of the character runs that terms are found by: a term is keyed on runs of the
# longest of these that it can hold.
GRAM_CLASSES = (1, 2, 4, 8, 16)

# Size of the bitmap of all terms' runs, a power of two: 2 MB of bits.
RUN_BITS = 1 << 24


def _grams(value: Column, k: Column) -> Column:
    """All runs of ``k`` characters of a value (none if it is shorter)."""
    starts = F.when(F.length(value) >= k, F.sequence(F.lit(1), F.length(value) - k + 1))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substr(value, i, k))


def term_index(terms: DataFrame, term_column: str = "term") -> DataFrame:
    """``(__term, __k, __gram)``: every distinct term once, keyed on one of its runs of
    ``__k`` characters: the one that the fewest terms of that class hold."""
    t = terms.select(norm_str(term_column).alias("__term")).where(F.col("__term") != "").distinct()
    k = F.lit(GRAM_CLASSES[0])
    for c in GRAM_CLASSES[1:]:
        k = F.when(F.length("__term") >= c, F.lit(c)).otherwise(k)
    runs = t.withColumn("__k", k).select("__term", "__k", F.explode(F.array_distinct(_grams(F.col("__term"), F.col("__k")))).alias("__gram"))
    held = runs.groupBy("__k", "__gram").agg(F.count(F.lit(1)).alias("__n"))
    # Spark takes exploded runs to be as small as the terms: without the hint it broadcasts them.
    return (runs.hint("merge").join(held, ["__k", "__gram"]).groupBy("__term", "__k")
            .agg(F.min(F.struct("__n", "__gram")).alias("__least")).select("__term", "__k", F.col("__least.__gram").alias("__gram")))


def _run_bits(index: DataFrame) -> DataFrame:
    """``(__word, __bits)``: a bitmap of the index's runs by hash, at most ``RUN_BITS / 64``
    rows however many terms there are."""
    return (index.select(_run_bit().alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit").bitwiseAND(63).cast("int"))).alias("__bits")))


def _run_bit() -> Column:
    return F.xxhash64("__k", "__gram").bitwiseAND(RUN_BITS - 1)


def term_candidates(values: DataFrame, value_col: str, index: DataFrame) -> DataFrame:
    """``(value, __term)`` pairs that share the term's run: the value's runs, of the
    lengths that the index has, meet the index. Not yet the pairs that match.

    Only the runs whose bit is in the index's bitmap are shuffled, with the value's hash
    in place of the value; values of one hash share their pairs."""
    hashed = values.select(value_col, F.xxhash64(value_col).alias("__hash"))
    classes = index.agg(F.array_sort(F.collect_set("__k"))).scalar()
    runs = (hashed.select("__hash", value_col, F.explode(classes).alias("__k"))
            .select("__hash", "__k", F.explode(F.array_distinct(_grams(F.col(value_col), F.col("__k")))).alias("__gram"))
            .withColumn("__bit", _run_bit()).withColumn("__word", F.shiftright("__bit", 6))
            .join(F.broadcast(_run_bits(index)), "__word")
            .where(F.getbit("__bits", F.col("__bit").bitwiseAND(63).cast("int")) == 1).select("__hash", "__k", "__gram"))
    pairs = runs.hint("merge").join(index, ["__k", "__gram"]).select("__hash", "__term")
    return hashed.join(pairs, "__hash").select(value_col, "__term")


def _term_hits(keyed: DataFrame, terms: DataFrame, term_column: str) -> DataFrame:
    """The distinct ``__row_value`` that contain a term of the table."""
    pairs = term_candidates(keyed.select("__row_value").where(F.col("__row_value").isNotNull()).distinct(),
                            "__row_value", term_index(terms, term_column))
    return pairs.where(F.contains(F.col("__row_value"), F.col("__term"))).select("__row_value").distinct()


def _has_term(value: Column, terms: Sequence[str]) -> Column:
    pattern = literal_alternation(_normalised(terms))
    return F.coalesce(value.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def exclude_terms(df: DataFrame, column: str, terms: DataFrame | Sequence[str],
                  term_column: str = "term") -> DataFrame:
    """Drop rows whose ``column`` contains any term (case-insensitive
    substring, terms taken literally). Null values are kept."""
    if not isinstance(terms, DataFrame):
        return df.where(~_has_term(norm_str(column), terms))
    keyed = df.withColumn("__row_value", norm_str(column))
    return keyed.join(_term_hits(keyed, terms, term_column), "__row_value", "left_anti").drop("__row_value")


def with_term_flag(df: DataFrame, column: str, terms: DataFrame | Sequence[str], flag: str,
                   term_column: str = "term") -> DataFrame:
    """All rows, with ``flag`` true for those that ``exclude_terms`` would drop."""
    if not isinstance(terms, DataFrame):
        return df.withColumn(flag, _has_term(norm_str(column), terms))
    keyed = df.withColumn("__row_value", norm_str(column))
    hits = _term_hits(keyed, terms, term_column).withColumn("__hit", F.lit(True))
    return (keyed.join(hits, "__row_value", "left").withColumn(flag, F.coalesce("__hit", F.lit(False)))
            .select(*df.columns, flag))


# --------------------------------------------------------------------------- P5


def _split_blocklist(terms: Sequence[str]) -> tuple[list[str], list[str]]:
    items = _normalised(terms)
    full = sorted({t for t in items if "@" in t})
    domains = sorted({t.lstrip(".") for t in items if "@" not in t} - {""})
    return full, domains


def domain_suffixes(domain: Column, lengths: Column, boundary: bool) -> Column:
    """The suffixes of a domain that have one of the ``lengths`` of the terms, so as
    many as there are lengths, however long the value; with ``boundary`` only those
    that begin a label."""
    n = F.length(domain)
    able = F.filter(lengths, lambda k: k <= n)
    if boundary:
        able = F.filter(able, lambda k: (k == n) | (F.substr(domain, n - k, F.lit(1)) == "."))
    return F.transform(able, lambda k: F.right(domain, k))


def _is_blocked(email: Column, blocklist: Sequence[str], boundary: bool) -> Column:
    domain = email_domain_last(email)
    full, domains = _split_blocklist(blocklist)
    hit = email.isin(full) if full else F.lit(False)
    if domains:
        listed = F.array(*(F.lit(d) for d in domains))
        suffix = F.concat(F.lit("."), domain) if boundary else domain
        hit = hit | F.exists(listed, lambda d: F.endswith(suffix, F.concat(F.lit("."), d) if boundary else d))
    return F.coalesce(hit, F.lit(False))


def _blocked_keys(keyed: DataFrame, blocklist: DataFrame, term_column: str, boundary: bool) -> tuple[DataFrame, DataFrame]:
    """The blocked addresses, and those of the ``__domain`` values that are blocked."""
    t = blocklist.select(norm_str(term_column).alias("__t")).where(F.col("__t") != "")
    full = t.where(F.col("__t").contains("@")).select(F.col("__t").alias("__email")).distinct()
    ends = (t.where(~F.col("__t").contains("@"))
            .select(F.regexp_replace("__t", r"^\.+", "").alias("__suffix")).where(F.col("__suffix") != "").distinct())
    lengths = ends.agg(F.collect_set(F.length("__suffix"))).scalar()
    domains = (keyed.select("__domain").where(F.col("__domain").isNotNull()).distinct()
               .select("__domain", lengths.alias("__lengths"))
               .select("__domain", F.explode(domain_suffixes(F.col("__domain"), F.col("__lengths"), boundary)).alias("__suffix"))
               .join(ends, "__suffix", "left_semi").select("__domain").distinct())
    return full, domains


def email_blocklist(df: DataFrame, column: str, blocklist: DataFrame | Sequence[str],
                    term_column: str = "term", boundary: bool = False) -> DataFrame:
    """P5: drop rows whose e-mail is blocked.

    Terms with ``@`` match the whole stripped, lower-cased address; other terms
    match as a suffix of the text after the last ``@`` (a value without ``@`` is
    tested whole). ``boundary=True`` requires the match to start at a label.
    Null e-mails are kept.
    """
    email = norm_str(column)
    if not isinstance(blocklist, DataFrame):
        return df.where(~_is_blocked(email, blocklist, boundary))
    # Equi anti-joins: Spark picks the join from the list's size in bytes.
    keyed = df.withColumn("__email", email).withColumn("__domain", email_domain_last(email))
    full, domains = _blocked_keys(keyed, blocklist, term_column, boundary)
    return (keyed.join(full, "__email", "left_anti").join(domains, "__domain", "left_anti")
            .drop("__email", "__domain"))


def with_blocked_flag(df: DataFrame, column: str, blocklist: DataFrame | Sequence[str], flag: str,
                      term_column: str = "term", boundary: bool = False) -> DataFrame:
    """All rows, with ``flag`` true for those that ``email_blocklist`` would drop."""
    email = norm_str(column)
    if not isinstance(blocklist, DataFrame):
        return df.withColumn(flag, _is_blocked(email, blocklist, boundary))
    keyed = df.withColumn("__email", email).withColumn("__domain", email_domain_last(email))
    full, domains = _blocked_keys(keyed, blocklist, term_column, boundary)
    return (keyed.join(full.withColumn("__whole", F.lit(True)), "__email", "left")
            .join(domains.withColumn("__end", F.lit(True)), "__domain", "left")
            .withColumn(flag, F.coalesce("__whole", "__end", F.lit(False))).select(*df.columns, flag))


# --------------------------------------------------------------------------- P7 / P9 / P10


def where_in_place(df: DataFrame, predicate) -> DataFrame:
    """Filter rows with ``predicate(row_struct)`` evaluated where it stands.

    A plain ``where`` on columns just computed from expensive expressions
    (regex extraction, text cleaning) is pushed below the projection, and even
    below a repartition, by the optimizer, which then evaluates every such
    expression twice. Running the test inside one generator (``inline`` of a
    filtered one-element array) keeps it after the projection."""
    cols = df.columns
    row = F.array(F.struct(*[F.col(c) for c in cols]))
    return df.select(F.inline(F.filter(row, predicate))).select(*cols)


def drop_incomplete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Keep rows where every required field is present (not null, not blank)."""
    def complete(s):
        cond = F.lit(True)
        for c in required:
            cond = cond & s[c].isNotNull() & (F.trim(s[c]) != "")
        return cond
    return where_in_place(df, complete)


def missing_fields(required: Sequence[str]) -> Column:
    """The names of the required fields that are null or blank."""
    return F.filter(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c)) == ""), F.lit(c)) for c in required)),
                    lambda name: name.isNotNull())


def valid_domain(c) -> Column:
    """Non-empty and containing a dot."""
    col = _c(c)
    return F.coalesce((col != "") & col.contains("."), F.lit(False))


def non_empty_link(c) -> Column:
    """P10: the link exists and its href is not empty."""
    col = _c(c)
    return col.isNotNull() & (col != "")
