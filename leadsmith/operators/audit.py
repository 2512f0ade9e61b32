"""Funnel audit (A1): how many rows each cleaning step removed.

A clean-up marks its rows with flags and filters on them at the end. Two things
read the flags: ``*_funnel`` sums them in an aggregate of its own, and
``observed`` sums them in the very pass that writes the result
(``pyspark.sql.Observation``). The steps count in the reference's order, a row in
the first step that drops it, so ``removed`` is their sum.

An observation's numbers are there once the result was written. They belong into
the last stage of the plan, after its last shuffle: there a task's numbers count
once, also if the task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("long")


def _rows(cond: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")


def contact_steps() -> dict[str, Column]:
    """The steps of C1 over one row per address with ``n`` (its rows), ``known``, ``blocked``."""
    known, blocked = F.coalesce(F.col("known"), F.lit(False)), F.coalesce(F.col("blocked"), F.lit(False))
    n = F.col("n").cast("long")
    return {
        "input": _rows(F.lit(True), n),
        "duplicates": _rows(F.lit(True), n - 1),
        "already_known": _count_if(known),
        "excluded": _count_if(~known & blocked),
        "removed": _rows(F.lit(True), F.when(known | blocked, n).otherwise(n - 1)),
        "left": _count_if(~known & ~blocked),
    }


def posting_steps() -> dict[str, Column]:
    """The steps of C2 over the raw rows with ``complete`` and ``excluded``."""
    complete, excluded = F.col("complete"), F.coalesce(F.col("excluded"), F.lit(False))
    return {
        "input": F.count(F.lit(1)).cast("long"),
        "incomplete": _count_if(~complete),
        "excluded": _count_if(complete & excluded),
        "left": _count_if(complete & ~excluded),
    }


def domain_steps() -> dict[str, Column]:
    """The steps of C5 up to the search over one row per domain with ``n`` (its
    contacts), ``listed`` (P6), ``known`` (J2) and ``valid`` (P9)."""
    listed, known, valid = F.col("listed"), F.col("known"), F.col("valid")
    n = F.col("n").cast("long")
    new = ~listed & ~known
    return {
        "input": _rows(F.lit(True), n),
        "excluded": _rows(listed, n),
        "already_known": _rows(~listed & known, n),
        "duplicates": _rows(new, n - 1),
        "invalid": _count_if(new & ~valid),
        "removed": _rows(F.lit(True), F.when(new & valid, n - 1).otherwise(n)),
        "left": _count_if(new & valid),
    }


def record_steps(required: Sequence[str], missing: str = "missing") -> dict[str, Column]:
    """The steps of P7 over the records with the array ``missing``: all records, those
    left, and for each required field how many records lack it (a record may lack
    several)."""
    lost = F.col(missing)
    return {
        "input": F.count(F.lit(1)).cast("long"),
        **{f"without_{c}": _count_if(F.array_contains(lost, c)) for c in required},
        "removed": _count_if(F.size(lost) > 0),
        "left": _count_if(F.size(lost) == 0),
    }


def funnel(flagged: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """The steps as one row, by an aggregate over the flagged rows."""
    return flagged.agg(*(c.alias(name) for name, c in steps.items()))


def observed(flagged: DataFrame, steps: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The flagged rows, and the observation that sums the steps while they are
    written."""
    seen = Observation()
    return flagged.observe(seen, *(c.alias(name) for name, c in steps.items())), seen


def observation_row(spark: SparkSession, seen: Observation, steps: dict[str, Column]) -> DataFrame:
    """What was observed, as one row. Call it after the rows were written; of a table
    without any row or partition nothing was observed, so every step is 0."""
    counts = seen.get
    return spark.createDataFrame([[counts.get(name) or 0 for name in steps]], ", ".join(f"`{name}` long" for name in steps))
