"""Keep-first de-duplication (W1, W2) and master anti-joins.

Keep-first is an aggregate, not a window: ``min_by(row, order)`` per key is
combined map-side (partial aggregation), so a key holding a third of all rows
is reduced to one row per input partition before the shuffle, and no task
ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.functions.text import norm_str


def keep_first(df: DataFrame, keys: Sequence[str] | str, order_by: Sequence[str] | str,
               normalize_key: bool = False) -> DataFrame:
    """One row per key, the one with the smallest ``order_by``.

    Nulls in the key form one group (as in pandas ``drop_duplicates``).
    ``normalize_key=True`` groups on the stripped, lower-cased key instead of
    the raw value (Q6); the kept row keeps its raw value.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    cols = df.columns
    group = [(norm_str(k) if normalize_key else F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)]
    order = F.struct(*[F.col(c) for c in order_by])
    row = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*group)
            .agg(F.min_by(row, order).alias("__row"))
            .select(*[F.col("__row")[c].alias(c) for c in cols]))


def anti_master(df: DataFrame, master: DataFrame, on: str | Sequence[str],
                master_on: str | Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose key is in the master; null matches null.

    No ``distinct`` on the master: repeats do not change an anti-join, and
    de-duplicating first would cost a shuffle of its own."""
    on = [on] if isinstance(on, str) else list(on)
    master_on = on if master_on is None else ([master_on] if isinstance(master_on, str) else list(master_on))
    m = master.select(*[F.col(mc).alias(f"__m{i}") for i, mc in enumerate(master_on)])
    cond = None
    for i, c in enumerate(on):
        term = df[c].eqNullSafe(m[f"__m{i}"])
        cond = term if cond is None else cond & term
    return df.join(m, cond, "left_anti")
