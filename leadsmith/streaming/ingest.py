"""Incremental ingest (S1) and streaming keep-first.

S1: new raw rows land as files; ``readStream`` picks them up,
``trigger(availableNow=True)`` processes what is there and stops, and each
micro-batch runs the contact clean-up against the current master and appends
the survivors. The master is a folder partitioned by a hash bucket of the key
(``bucket=``): a batch reads only the buckets its keys fall into.

S2: into a table, every micro-batch keeps one row per key and drops the keys that
are in the table already, so a repeat in any later batch adds nothing and no event
is too late. ``streaming_keep_first`` gives a stream instead: one row per key while
the watermark holds the key's state, without what is older than the watermark.
``earliest_to_table`` keeps the earliest row of each key over all batches, with a
state store.

Both are safe to repeat: a batch that runs again after a failure finds its
rows in the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.operators.dedupe import anti_master, keep_first
from leadsmith.operators.state import bucket_of, state_replace

#: Buckets of a table written by this module, if the caller names no number: with more, a
#: batch of few keys reads less; the number must stay the same for a table.
BUCKETS = 64


def _known(spark: SparkSession, table_path: str, schema: T.StructType, keys: Sequence[str],
           batch: DataFrame, buckets: int) -> DataFrame:
    """Keys of the table in the buckets that the batch touches (at most all of them)."""
    touched = sorted(r[0] for r in batch.select(bucket_of(keys, buckets).alias("b")).distinct().collect())
    empty = spark.createDataFrame([], T.StructType([schema[k] for k in keys]))
    try:
        table = spark.read.option("basePath", table_path).schema(
            T.StructType([*[schema[k] for k in keys], T.StructField("bucket", T.IntegerType())])).parquet(table_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    return table.where(F.col("bucket").isin(touched)).select(*keys)


def _append(rows: DataFrame, keys: Sequence[str], table_path: str, buckets: int) -> None:
    # Rebalanced: Spark splits a large bucket over several writers and joins small ones.
    (rows.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", "bucket")
     .write.mode("append").partitionBy("bucket").parquet(table_path))


def ingest_contacts(spark: SparkSession, source_path: str, schema: T.StructType, master_path: str,
                    checkpoint_path: str, clean: Callable[[DataFrame, DataFrame], DataFrame],
                    prepare: Callable[[DataFrame], DataFrame] | None = None,
                    key: str = "email", max_files_per_trigger: int | None = None,
                    base_path: str | None = None, buckets: int = BUCKETS) -> None:
    """Run the incremental ingest until the landed files are consumed.

    ``prepare`` turns landed rows into contact rows (for example an
    extraction); ``clean(batch, master)`` is the batch clean-up (C1); the
    master at ``master_path`` is a parquet dataset only ever appended to.
    """
    stream = landed_files(spark, source_path, schema, base_path, max_files_per_trigger)
    rows = prepare(stream) if prepare else stream

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()     # prepared once; a lost part is computed again
        try:
            master = _known(batch.sparkSession, master_path, batch.schema, [key], batch, buckets)
            _append(clean(batch, master).withColumn("batch_id", F.lit(batch_id).cast("long")), [key], master_path, buckets)
        finally:
            batch.unpersist()

    query = (rows.writeStream.foreachBatch(run_batch)
             .option("checkpointLocation", checkpoint_path)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()


def _as_timestamp(stream: DataFrame, event_time: str) -> DataFrame:
    if isinstance(stream.schema[event_time].dataType, T.TimestampNTZType):
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return stream


def streaming_keep_first(stream: DataFrame, keys: Sequence[str], event_time: str,
                         delay: str = "1 day") -> DataFrame:
    """Drop repeats of ``keys`` that arrive while the watermark holds the
    first one. ``TIMESTAMP_NTZ`` event times are cast to ``TIMESTAMP`` first
    (watermarks need the latter)."""
    return _as_timestamp(stream, event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def keep_first_to_table(stream: DataFrame, keys: Sequence[str], event_time: str, table_path: str,
                        checkpoint_path: str, buckets: int = BUCKETS) -> None:
    """S2 into a parquet table: one row per key over all micro-batches, however late
    it comes; of a key's rows in one micro-batch the earliest. ``TIMESTAMP_NTZ``
    event times are stored as ``TIMESTAMP``."""
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        batch = keep_first(batch, keys, event_time).persist()
        try:
            known = _known(batch.sparkSession, table_path, batch.schema, keys, batch, buckets)
            _append(anti_master(batch, known, keys), keys, table_path, buckets)
        finally:
            batch.unpersist()

    q = (_as_timestamp(stream, event_time).writeStream.foreachBatch(run_batch)
         .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
    q.awaitTermination()


#: Keeps the state of a stream on the executors' disks and in the checkpoint folder.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def earliest_to_table(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], table_root: str,
                      checkpoint_path: str, buckets: int = 64) -> None:
    """S2, defined over all micro-batches: of each key the row with the smallest
    ``order_by``, whenever it comes. The state store holds the smallest row of each key;
    a micro-batch hands on the keys whose row has changed, and they replace theirs in
    the state table (``operators.state``), in the buckets that they touch. No event is
    too late, so none is dropped. The state grows with the number of keys."""
    spark = stream.sparkSession
    others = [c for c in stream.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order_by]))
    rows = stream.groupBy(*keys).agg(first.alias("__row"))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        state_replace(table_root, batch.select(*keys, *(F.col("__row")[c].alias(c) for c in others)), keys, buckets)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        query = (rows.writeStream.foreachBatch(run_batch).outputMode("update")
                 .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def landed_files(spark: SparkSession, path: str, schema: T.StructType, base_path: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming read of parquet files under ``path`` (a folder, or a file
    or glob with ``base_path`` naming the folder)."""
    reader = spark.readStream.schema(schema)
    if base_path:
        reader = reader.option("basePath", base_path)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)
