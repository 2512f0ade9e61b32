"""Table sources and sinks.

* Reads always take an explicit schema (no inference) and map blanks to null.
* Overwrites never touch a path the plan may be reading: each write is a new
  numbered folder of the table, and the highest complete number is current.
* Appends are plain ``mode("append")`` writes (no read-rewrite of the master).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsmith.functions.text import blank_to_null

# Words read as missing values by spreadsheet-style loaders.
NA_WORDS = ["NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "#N/A", "<NA>", "None"]


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition a scan that yields fewer partitions than the
    cluster can run at once (a small file with few row groups), so CPU-heavy
    text work uses every core. A large scan is left as it is (no shuffle)."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD access (e.g. a remote session): leave the scan as is
        return df
    if current < target:
        return df.repartition(target)
    return df


def read_text_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Read only ``columns`` of a text-heavy table, spread over the cores."""
    return spread(read_parquet(spark, sf_dir, name).select(*columns))


# --------------------------------------------------------------------------- L1


def load_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               na_words: Sequence[str] = (), header: bool = True) -> DataFrame:
    """L1: read with a fixed schema; blank strings (and NA words) become null."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", str(header).lower()).option("multiLine", "true") \
            .option("escape", '"')
    df = reader.format(fmt).load(path)
    return with_blank_nulls(df, na_words)


#: Column in which Spark keeps a line that does not fit the schema.
BROKEN = "_corrupt_record"


def load_with_rejects(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", na_words: Sequence[str] = (),
                      header: bool = True) -> tuple[DataFrame, DataFrame]:
    """L1 without losing lines: the rows that fit the schema (as ``load_table``), and the
    others as ``(file, line)``. JSON and CSV; together they are all records of the files
    (a JSON line that is an array stands for as many records as it holds)."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"only csv and json keep broken records, not {fmt!r}")
    reader = (spark.read.schema(T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())]))
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN))
    if fmt == "csv":
        # Every column is parsed, whatever is selected: a line is broken or not.
        reader = reader.option("header", str(header).lower()).option("escape", '"').option("columnPruning", "false")
    read = reader.format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("__file"))
    # Spark refuses to look at the broken records alone: the test also reads a column, and is always true of it.
    a_column = F.length(F.coalesce(F.col(schema.fields[0].name).cast("string"), F.lit(""))) >= 0
    fits = read.where(F.col(BROKEN).isNull() & a_column)
    rows = with_blank_nulls(fits.select(*(F.col(f.name) for f in schema.fields)), na_words)
    rejects = read.where(F.col(BROKEN).isNotNull() & a_column).select(F.col("__file").alias("file"), F.col(BROKEN).alias("line"))
    return rows, rejects


def with_blank_nulls(df: DataFrame, na_words: Sequence[str] = ()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(blank_to_null(F.col(f.name), na_words).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --------------------------------------------------------------------------- L2 / L3 / L4


def _versions(spark: SparkSession, table_root: str) -> list[int]:
    """Numbers of the complete versions (``v=1``, ``v=2``, ..) below a table's folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table_root)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [(p.getPath().getName(), p.getPath()) for p in fs.listStatus(root) if p.isDirectory()]
    return sorted(int(name[2:]) for name, path in found if name.startswith("v=") and name[2:].isdigit()
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")))


def version_path(table_root: str, version: int) -> str:
    return f"{table_root.rstrip('/')}/v={version}"


def write_version(df: DataFrame, table_root: str, version: int, fmt: str = "parquet",
                  partition_by: Sequence[str] = ()) -> str:
    """L3: write ``df`` as the table's version ``version``. A version is a plain
    folder, written once: a second writer of the same number fails instead of
    replacing it, and earlier versions stay readable, so a plan may read the
    version before the one it writes."""
    path = version_path(table_root, version)
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def load_latest(spark: SparkSession, table_root: str, fmt: str = "parquet") -> tuple[DataFrame, int]:
    """L2: the table's latest complete version, with all columns stored in it, and
    its number. A table without any version is an error, not an empty table."""
    versions = _versions(spark, table_root)
    if not versions:
        raise FileNotFoundError(f"no complete version of a table below {table_root}")
    return spark.read.format(fmt).load(version_path(table_root, versions[-1])), versions[-1]


def load_or_create(spark: SparkSession, table_root: str, schema: T.StructType,
                   fmt: str = "parquet") -> tuple[DataFrame, int]:
    """L2: like ``load_latest``; a folder that does not exist or is empty gets an
    empty version 1 with ``schema``."""
    if not _versions(spark, table_root):
        write_version(spark.createDataFrame([], schema), table_root, 1, fmt)
    return load_latest(spark, table_root, fmt)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    """L4: append without rewriting what is there (duplicates are kept)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# --------------------------------------------------------------------------- by day


def append_by_day(df: DataFrame, path: str, ts_col: str, day_col: str = "day") -> None:
    """L4 for captured rows: appended in one folder for each day of ``ts_col``."""
    (df.withColumn(day_col, F.to_date(ts_col)).hint("rebalance", day_col)
     .write.mode("append").partitionBy(day_col).parquet(path))


def load_period(spark: SparkSession, path: str, period: int, as_of, day_col: str = "day") -> DataFrame:
    """P2 on such a table: only the folders of the period's days are read."""
    from leadsmith.operators.filters import recency_days
    first, last = recency_days(period, as_of)
    table = spark.read.parquet(path)
    day = F.col(day_col)
    return table.where((day >= F.lit(first)) & (day <= F.lit(last))).drop(day_col)


# --------------------------------------------------------------------------- L5


def captured_pages(pages: DataFrame) -> DataFrame:
    """Admit pages like a fetch would (status < 400, an HTML content type,
    when those columns exist). Pages are processed whole."""
    cols = set(pages.columns)
    if "status" in cols:
        pages = pages.where(F.col("status") < 400)
    if "content_type" in cols:
        pages = pages.where(F.coalesce(F.col("content_type").contains("text/html"), F.lit(False)))
    return pages
