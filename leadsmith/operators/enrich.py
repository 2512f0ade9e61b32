"""Contact enrichment: first/last name (T8) and gender lookup.

The gender dictionary is a table ``(first_name, gender)``; the lookup is a
left equi-join on the lower-cased first name; Spark broadcasts the dictionary if
its size in bytes allows. A miss (or a null name) gives ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.functions.names import with_split_name


def gender_lookup(df: DataFrame, name_gender: DataFrame, first_col: str = "first_name",
                  out_col: str = "gender") -> DataFrame:
    """Case-insensitive dictionary lookup; one entry per name (the
    smallest gender value if the dictionary repeats a name)."""
    dic = (name_gender.select(F.lower(F.trim("first_name")).alias("__fn"), F.col("gender"))
           .where(F.col("__fn").isNotNull())
           .groupBy("__fn").agg(F.min("gender").alias("__g")))
    keyed = df.withColumn("__fn", F.lower(F.col(first_col)))
    return (keyed.join(dic, "__fn", "left")
            .withColumn(out_col, F.coalesce(F.col("__g"), F.lit("unknown")))
            .drop("__fn", "__g"))


def enrich_contacts(df: DataFrame, name_gender: DataFrame, person_col: str = "person") -> DataFrame:
    """Add ``gender``, ``first_name``, ``last_name`` (in that order)."""
    cols = df.columns
    named = with_split_name(df, person_col, "__first", "__last")
    out = gender_lookup(named, name_gender, first_col="__first")
    return out.select(*cols, "gender", F.col("__first").alias("first_name"),
                      F.col("__last").alias("last_name"))
