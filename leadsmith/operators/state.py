"""Keyed tables that change by batches: only the touched buckets are rewritten.

A state table is a parquet table partitioned by ``of`` and ``bucket``: the number of
buckets and the hash bucket of the key. A batch of upserts and deletes (U4-U6) reads
the buckets that its keys fall into, and writes them back with Spark's dynamic
partition overwrite; all others stay as they are. Columns that a batch adds are
written in its buckets; a reader sees the columns of all buckets (``mergeSchema``).

The new buckets are first written beside the table (below the checkpoint folder),
then moved in: an update that breaks off there is finished by ``put_buckets`` from
those files, so no row is lost. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.operators.dedupe import anti_master
from leadsmith.operators.tables import apply_changes, delete_keys
from leadsmith.session import scratch_path

#: Partition columns of a state table.
LAYOUT = ["of", "bucket"]


def bucket_of(keys: Sequence[str] | str, buckets: int) -> Column:
    """Hash bucket of a key (null keys have one too)."""
    return F.pmod(F.xxhash64(*([keys] if isinstance(keys, str) else keys)), F.lit(buckets)).cast("int")


def laid_out(df: DataFrame, keys: Sequence[str] | str, buckets: int) -> DataFrame:
    """``df`` with the partition columns, its rows dealt to writers by bucket. The
    rebalance lets Spark split a bucket that a hot key makes large, and join small ones."""
    return (df.withColumn("of", F.lit(buckets)).withColumn("bucket", bucket_of(keys, buckets))
            .hint("rebalance", "bucket"))


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _empty_bucket(spark: SparkSession, schema: T.StructType, root: str, buckets: int, bucket: int) -> None:
    """A bucket without rows keeps the table's columns in an empty file."""
    none = spark.createDataFrame([], T.StructType([f for f in schema.fields if f.name not in LAYOUT]))
    none.write.mode("overwrite").parquet(f"{root.rstrip('/')}/of={buckets}/bucket={bucket}")


def state_create(root: str, initial: DataFrame, key: str = "url", buckets: int = 256) -> None:
    """A new state table. Fails if there is one already."""
    spark = initial.sparkSession
    laid_out(initial, key, buckets).write.mode("errorifexists").partitionBy(*LAYOUT).parquet(root)
    fs, folder = _folder(spark, f"{root.rstrip('/')}/of={buckets}")
    if not fs.exists(folder):
        _empty_bucket(spark, initial.schema, root, buckets, 0)


def _stored(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.option("mergeSchema", "true").parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no state table at {root}") from e


def state_load(spark: SparkSession, root: str) -> DataFrame:
    """All rows and columns of the table. A table that is missing is an error."""
    return _stored(spark, root).drop(*LAYOUT)


def _bucket_count(spark: SparkSession, root: str) -> int:
    """As the folder's name says."""
    fs, folder = _folder(spark, root)
    return next(int(p.getPath().getName()[3:]) for p in fs.listStatus(folder) if p.getPath().getName().startswith("of="))


def touched_buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that a batch's keys fall into: at most ``buckets`` numbers."""
    return sorted(r[0] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect())


def put_buckets(spark: SparkSession, staged: str, schema: T.StructType, root: str, buckets: int,
                touched: Sequence[int]) -> None:
    """Replace the touched buckets by the staged ones; those that have become empty are
    emptied. Running it again with the same staged files changes nothing."""
    rows = spark.read.schema(schema).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(root)
    left = {r[0] for r in rows.select("bucket").distinct().collect()}
    for b in sorted(set(touched) - left):
        _empty_bucket(spark, schema, root, buckets, b)


def state_update(root: str, changes: DataFrame | None = None, deletes: DataFrame | None = None, key: str = "url",
                 columns: Sequence[str] | None = None) -> list[int]:
    """Apply a batch of upserts (``apply_changes``), then deletes (``delete_keys``), to the
    buckets that it touches, and return their numbers."""
    if changes is None and deletes is None:
        raise ValueError("nothing to apply")
    spark = (changes if changes is not None else deletes).sparkSession
    table = _stored(spark, root)
    buckets = _bucket_count(spark, root)
    batch = [d.select(F.col(key).cast(table.schema[key].dataType).alias(key)).where(F.col(key).isNotNull())
             for d in (changes, deletes) if d is not None]
    touched = touched_buckets(batch[0] if len(batch) == 1 else batch[0].unionByName(batch[1]), key, buckets)
    if not touched:
        return []
    state = table.where((F.col("of") == buckets) & F.col("bucket").isin(touched)).drop(*LAYOUT)
    if changes is not None:
        state = apply_changes(state, changes, key=key, columns=columns)
    if deletes is not None:
        state = delete_keys(state, deletes, key=key)
    staged = scratch_path(spark, "state_update")
    out = laid_out(state, key, buckets)
    out.write.partitionBy(*LAYOUT).parquet(staged)
    put_buckets(spark, staged, out.schema, root, buckets, touched)
    return touched


def state_replace(root: str, rows: DataFrame, keys: Sequence[str], buckets: int = 256) -> list[int]:
    """Put rows in the place of those with their keys (null equals null), in a table that
    is made if there is none. Returns the touched buckets."""
    spark = rows.sparkSession
    try:
        table = _stored(spark, root)
    except FileNotFoundError:
        laid_out(rows, keys, buckets).write.mode("errorifexists").partitionBy(*LAYOUT).parquet(root)
        return list(range(buckets))
    buckets = _bucket_count(spark, root)
    touched = sorted(r[0] for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect())
    if touched:
        old = table.where((F.col("of") == buckets) & F.col("bucket").isin(touched)).drop(*LAYOUT)
        out = laid_out(anti_master(old, rows, keys).unionByName(rows, allowMissingColumns=True), keys, buckets)
        staged = scratch_path(spark, "state_replace")
        out.write.partitionBy(*LAYOUT).parquet(staged)
        put_buckets(spark, staged, out.schema, root, buckets, touched)
    return touched
