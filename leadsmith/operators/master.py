"""A master table laid out for anti-joins.

The master is a catalog table in parquet, bucketed and sorted on its key, in a folder
of the caller's choice. A batch that is anti-joined with it is shuffled into the
master's buckets; the master itself is read where it lies, without an exchange,
however large it has grown. Appends add files to the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def open_master(spark: SparkSession, name: str, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The master table at ``path`` under ``name`` in the session's catalog; made if it is
    in neither. Layout and key must be those it was made with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}) USING parquet CLUSTERED BY (`{key}`) "
              f"SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def append_to_master(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """U2 on the laid-out master: rows are dealt to the buckets' writers first, so each
    bucket gets one new file. The columns are matched by name."""
    table = df.sparkSession.table(name)
    rows = df.select(*(F.col(c) for c in table.columns)).repartition(buckets, key)
    rows.write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def not_in_master(df: DataFrame, master: DataFrame, key: str, master_key: str | None = None) -> DataFrame:
    """J1/J2 as ``anti_master`` (a null key is dropped only if the master has one), stated
    so that the layout can be used: an equality join, which leaves null keys alone, and
    one look at whether the master holds a null key."""
    m = master.select(F.col(master_key or key).alias("__m"))
    has_null = m.where(F.col("__m").isNull()).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    kept = df.join(m.where(F.col("__m").isNotNull()), F.col(key) == F.col("__m"), "left_anti")
    return kept.where(F.col(key).isNotNull() | ~has_null)
