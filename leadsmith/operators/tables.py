"""Set operations and keyed table changes.

* ``accumulate_merge`` (U1): base ∪ new by name, whole-row de-duplication
  keeping the first occurrence, stable sort on the lead column.
* ``append_union`` (U2): union by name, duplicates kept.
* ``apply_changes`` (U4 + U6): a batch of ``(seq, key, column, value)``
  changes applied at once: one pivot aggregate (last change per key and
  column wins), a left join on the key for existing rows and an anti-join
  for keys the table lacks (no full outer join, which AQE cannot split
  when one key is hot). New keys become new rows;
  new columns are added; a change to null is told apart from "not changed".
* ``delete_keys`` (U5): anti-join; rows with a null key stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.operators.dedupe import keep_first

def append_union(full: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, matched by column name; missing columns are null."""
    return full.unionByName(new, allowMissingColumns=True)


def accumulate_merge(base: DataFrame, new: DataFrame, order_col: str | None = None,
                     sort_col: str | None = None, lead_name: str = "Firma", sort: bool = True) -> DataFrame:
    """U1 + W3 + O1.

    Columns are the base's, then the new ones; equal rows are kept once (the
    first occurrence: base before new, then ``order_col``); rows are sorted by
    ``sort_col`` (default: ``lead_name`` if present, else the first column),
    compared as text, nulls last. Ties keep first-occurrence order: base
    before new, then ``order_col``; a DataFrame has no row order of its own,
    so without ``order_col`` the remaining ties are broken by the other
    columns (nulls last) to stay deterministic. The sort column is stored as
    text, whatever the inputs hold. ``sort=False`` leaves the order to a later step.
    """
    cols = base.columns + [c for c in new.columns if c not in base.columns]
    tag = [F.lit(0).alias("__src")] + ([F.col(order_col).alias("__seq")] if order_col else [])
    tag_new = [F.lit(1).alias("__src")] + ([F.col(order_col).alias("__seq")] if order_col else [])
    b = base.select(*base.columns, *tag)
    n = new.select(*new.columns, *tag_new)
    order = ["__src"] + (["__seq"] if order_col else [])
    both = b.unionByName(n, allowMissingColumns=True).select(*cols, *order)
    if order_col:
        firsts = keep_first(both, cols, order)
    else:
        # Only base-before-new matters: a fixed-width min per distinct row,
        # which Spark runs as a (partial) hash aggregate.
        firsts = both.groupBy(*cols).agg(F.min("__src").alias("__src"))
    key = sort_col or (lead_name if lead_name in cols else (cols[0] if cols else None))
    if key is None:
        return firsts.drop(*order)
    out = firsts.withColumn(key, F.col(key).cast("string"))
    if not sort:
        return out.drop(*order)
    ties = [F.col(o).asc() for o in order]
    if not order_col:
        ties += [F.col(c).asc_nulls_last() for c in cols if c != key]
    return out.orderBy(F.col(key).asc_nulls_last(), *ties).drop(*order)


def change_columns(changes: DataFrame, column_col: str = "column") -> list[str]:
    """The columns a batch of changes names: they become part of the schema, so
    they are read before the plan is built. A caller that knows them passes them."""
    return sorted(r[0] for r in changes.select(column_col).where(F.col(column_col).isNotNull()).distinct().collect())


def _fits(value: Column, kind: T.DataType) -> Column:
    return value.isNull() | value.try_cast(kind).isNotNull()


def rejected_changes(base: DataFrame, changes: DataFrame, key: str = "url", column_col: str = "column",
                     value_col: str = "value") -> DataFrame:
    """The changes that ``apply_changes`` leaves out: no key, no column, or a value
    that the existing column's type cannot hold."""
    bad = F.col(key).isNull() | F.col(column_col).isNull()
    for f in base.schema.fields:
        bad = bad | ((F.col(column_col) == f.name) & ~_fits(F.col(value_col), f.dataType))
    return changes.where(F.coalesce(bad, F.lit(False)))


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "url", seq_col: str = "seq",
                  column_col: str = "column", value_col: str = "value",
                  columns: Sequence[str] | None = None) -> DataFrame:
    """U4 + U6: set ``column`` to ``value`` on every row with the key; a key
    with no row becomes a new row holding only the key and that column.

    Within the batch the change with the highest ``seq`` per (key, column)
    wins. Values are cast to the existing column's type; new columns are
    strings. Base rows with a null key never match (they stay as they are);
    changes with a null key, and those whose value does not fit the column's
    type, are left out (``rejected_changes`` returns them). ``columns`` names
    the columns to change; by default they are looked up in the batch.
    """
    names = sorted(columns) if columns is not None else change_columns(changes, column_col)
    if not names:
        return base
    base_types = {f.name: f.dataType for f in base.schema.fields}
    ch = changes.where(F.col(key).isNotNull() & F.col(column_col).isin(names))
    for n in names:
        if n in base_types:
            ch = ch.where((F.col(column_col) != n) | _fits(F.col(value_col), base_types[n]))
    pivoted = (ch.groupBy(key).pivot(column_col, names)
               .agg(F.max_by(F.struct(F.col(value_col).alias("v")), F.col(seq_col))))
    pv = pivoted.select(F.col(key).alias("__ck"), *[F.col(n).alias(f"__set_{i}") for i, n in enumerate(names)])

    # Existing rows: a left join (AQE can split a hot key on the base side;
    # the change side has one row per key). New keys: changes whose key no
    # base row has, found with an anti-join against the base's distinct keys.
    updated = base.join(pv, base[key] == pv["__ck"], "left")
    base_keys = base.select(F.col(key).alias("__bk")).where(F.col("__bk").isNotNull()).distinct()
    new_keys = pv.join(base_keys, pv["__ck"] == base_keys["__bk"], "left_anti")

    def assemble(frame: DataFrame, is_new: bool) -> DataFrame:
        out = []
        for f in base.schema.fields:
            if f.name == key:
                out.append((F.col("__ck") if is_new else F.col(key)).cast(f.dataType).alias(key))
            elif f.name in names:
                s_ = F.col(f"__set_{names.index(f.name)}")
                old = F.lit(None).cast(f.dataType) if is_new else F.col(f.name)
                out.append(F.when(s_.isNotNull(), s_["v"].try_cast(f.dataType)).otherwise(old).alias(f.name))
            else:
                out.append((F.lit(None).cast(f.dataType) if is_new else F.col(f.name)).alias(f.name))
        for i, n in enumerate(names):
            if n not in base_types:
                s_ = F.col(f"__set_{i}")
                out.append(F.when(s_.isNotNull(), s_["v"].cast(T.StringType())).alias(n))
        return frame.select(*out)

    return assemble(updated, False).unionByName(assemble(new_keys, True))


def delete_keys(base: DataFrame, keys: DataFrame | Sequence[str], key: str = "url") -> DataFrame:
    """Remove every row whose key is listed; null keys stay."""
    if not isinstance(keys, DataFrame):
        keys = base.sparkSession.createDataFrame([(k,) for k in keys], f"{key} string")
    k = keys.select(F.col(key).alias("__dk")).where(F.col("__dk").isNotNull()).distinct()
    return base.join(k, base[key] == k["__dk"], "left_anti")
