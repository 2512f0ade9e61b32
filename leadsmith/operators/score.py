"""Weighted keyword score per document and profile (A6) with per-profile
exclusion terms (A7).

A profile is a term table ``(profile, grp, term, weight)`` with groups ``mini`` /
``top`` (weighted share of the group's terms found in the body), ``heading``
(the largest weight of a heading term in the first line, as a share of the
group's largest) and ``exclude`` (any hit drops the document for that profile).
A null weight counts as 1. The score is the weighted sum of the group shares;
``passes`` compares it (in percent) with the threshold.

The profiles' terms form one array (a term table is a person's search profile)
that a scalar subquery hands to every row, so scoring is one lambda over that
array per document, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.sources.lookups import SCORE_GROUP_WEIGHTS, SCORE_THRESHOLD

TERM_SCHEMA = "profile string, grp string, term string, weight double"


def _profiles(spark, terms) -> DataFrame:
    """One row per profile with its terms as an array."""
    if not isinstance(terms, DataFrame):
        terms = spark.createDataFrame([tuple(t) for t in terms], TERM_SCHEMA)
    t = terms.select("profile", "grp", F.lower(F.trim("term")).alias("term"),
                     F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    t = t.where(F.col("term").isNotNull() & (F.col("term") != ""))
    return t.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("grp", "term", "weight"))).alias("terms"))


def keyword_scores(docs: DataFrame, terms, id_col: str = "doc_id", text_col: str = "text",
                   weights: dict[str, float] | None = None,
                   threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """``(id, profile, score, passes)`` for every document not excluded."""
    w = dict(SCORE_GROUP_WEIGHTS)
    w.update(weights or {})
    profiles = _profiles(docs.sparkSession, terms).agg(F.array_sort(F.collect_list(
        F.struct("profile", "terms"))).alias("__profiles"))
    # Staged once per row: the term lambdas then only read these columns.
    docs = docs.select(id_col, F.lower(F.col(text_col)).alias("__body"),
                       F.lower(F.split_part(F.col(text_col), F.lit("\n"), F.lit(1))).alias("__heading"))
    rows = docs.select(id_col, "__body", "__heading", F.explode(profiles.scalar()).alias("__p"))
    found = rows.select(id_col, F.col("__p.profile").alias("profile"), F.col("__p.terms").alias("__terms"),
                        F.filter("__p.terms", lambda t: F.when(t["grp"] == "heading", F.contains(F.col("__heading"), t["term"]))
                                 .otherwise(F.contains(F.col("__body"), t["term"]))).alias("__hits"))

    def weight_of(terms, grp):
        return F.aggregate(F.filter(terms, lambda t: t["grp"] == grp), F.lit(0.0), lambda a, t: a + t["weight"])

    def largest(terms, grp):
        return F.coalesce(F.array_max(F.transform(F.filter(terms, lambda t: t["grp"] == grp), lambda t: t["weight"])),
                          F.lit(0.0))

    def share(measure, grp):
        whole = measure("__terms", grp)
        return F.when(whole > 0, F.lit(w[grp]) * measure("__hits", grp) / whole).otherwise(0.0)

    scored = found.where(~F.exists("__hits", lambda t: t["grp"] == "exclude")).select(
        id_col, "profile", (share(weight_of, "mini") + share(weight_of, "top") + share(largest, "heading")).alias("score"))
    return scored.select(id_col, "profile", F.round("score", 6).alias("score"),
                         (F.col("score") * 100 >= F.lit(threshold)).alias("passes"))
