"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.session import scratch_path

#: Bytes of text that one step of a worker handles at a time. A single longer
#: text forms a step of its own.
SLICE_BYTES = 1024 * 1024


#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Bound what is in flight to a Python worker, whatever the rows' lengths; the
    default bound is sized for larger workers. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def crc_of_id(id_col: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of (id, text): equal for repeated rows, which get equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def with_fields(fields: list[T.StructField], ddl: str) -> T.StructType:
    """A schema of kept fields, whatever their names and types, and new ones."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def lead_columns(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], *more) -> tuple[DataFrame, int, int]:
    """``docs`` cut to the id, the ``carry`` columns, ``more`` and the text; how many
    columns to keep, and the number of the text's column (one of them if carried)."""
    kept = [F.col(id_col), *(F.col(c) for c in carry), *more]
    if text_col in carry:
        return docs.select(*kept), len(kept), 1 + carry.index(text_col)
    return docs.select(*kept, F.col(text_col).alias("__text")), len(kept), len(kept)


def stored(df: DataFrame, *name: str) -> DataFrame:
    """Write ``df`` as a parquet table below the shared checkpoint folder and
    read it back: cuts the lineage in a way that survives lost executors."""
    return stored_at(df, *name)[0]


def stored_at(df: DataFrame, *name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the table's folder."""
    path = scratch_path(df.sparkSession, "llm", *name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing will read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: int,
                max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut record batches into runs of rows with about ``max_bytes`` of text and
    yield each with its texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        lo, size = 0, 0
        lengths = [len(b) if b is not None else 0 for b in (x.as_buffer() for x in texts)] \
            if batch.num_rows else []
        for i, n in enumerate(lengths):
            if size and size + n > max_bytes:
                yield batch.slice(lo, i - lo), [b or b"" for b in texts.slice(lo, i - lo).to_pylist()]
                lo, size = i, 0
            size += n
        if lo < batch.num_rows:
            yield batch.slice(lo), [b or b"" for b in texts.slice(lo).to_pylist()]


def worker_memory() -> dict:
    """What a Python worker keeps from one task to the next. Functions are shipped
    by value, so the globals of this package are new in every task."""
    holder = sys.modules.setdefault("_leadsmith_worker_memory", types.ModuleType("_leadsmith_worker_memory"))
    return holder.__dict__


def prior(n: list[int]) -> float:
    """Share of class 1 among n[0] and n[1] rows, kept off 0 and 1; 0.5 for none."""
    return 0.5 if not sum(n) else min(max(n[1] / sum(n), 0.01), 0.99)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """``(id, text, label)`` for about ``per_class`` rows of ``labels(id, label)`` of
    each class 0 and 1 (all if there are fewer), and the classes' row counts.

    Rows are taken by the hash of their id, so the sample needs no sort; its size
    is bounded by the parameter, which makes the broadcast of its ids safe. Rows
    with a null id or another label are no training rows."""
    usable = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    found = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [found.get(0, 0), found.get(1, 0)]
    share = F.when(F.col("label") == 1, per_class / max(n[1], 1)).otherwise(per_class / max(n[0], 1))
    picked = usable.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    rows = (texts.join(F.broadcast(picked.select("id", "label")), F.col("__id") == F.col("id"))
            .select("id", "text", "label"))
    return rows, n


def ranked(df: DataFrame, order: list[Column], rows: str | None = None) -> DataFrame:
    """``df`` with ``rank``, its place from 0 on in the order given: the rows are dealt
    by ranges of the order, counted in each range, and begin where the ranges before
    them end. A record may stand for as many rows as its column ``rows`` tells; its
    rank is then that of its first row. The order should name all that tells records
    apart, as equal keys share a range."""
    dealt = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .select("*", F.spark_partition_id().alias("__range"),
                     (F.col(rows).cast("long") if rows else F.lit(1).cast("long")).alias("__rows")))
    schema = with_fields(dealt.schema.fields, "__at long")

    def run(batches):
        at = 0
        for batch in batches:
            ends = at + np.cumsum(batch.column("__rows").to_numpy())
            if len(ends):
                at = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - batch.column("__rows").to_numpy(), pa.int64())],
                names=[*batch.schema.names, "__at"])

    placed = stored(dealt.mapInArrow(run, schema), "ranked")
    # One number for each range: as many as there are shuffle partitions.
    sizes = sorted((r["__range"], r["n"]) for r in placed.groupBy("__range").agg(F.sum("__rows").alias("n")).collect())
    begins, at = [], 0
    for k, n in sizes:
        begins.append((k, at))
        at += n
    begin = df.sparkSession.createDataFrame(begins, "__of int, __begin long")
    return (placed.join(F.broadcast(begin), F.col("__range") == F.col("__of"))
            .select(*df.columns, (F.col("__begin") + F.col("__at")).alias("rank")))


def copies(df: DataFrame, rows: str, chunk: int = 10_000) -> DataFrame:
    """A row ``__copy`` (0, 1, ..) for each of the ``rows`` that a record stands for,
    dealt out in chunks, so that no task writes all copies of a record."""
    each = (df.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(rows) - 1, F.lit(chunk).cast("long"))))
            .repartition(*[F.col(c) for c in df.columns], F.col("__from")))
    return each.withColumn("__copy", F.explode(F.sequence(
        F.col("__from"), F.least(F.col("__from") + chunk, F.col(rows)) - 1))).drop("__from")
