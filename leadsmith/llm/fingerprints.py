"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A sketch (``with_scaled_sketch``) is a limit and every distinct shingle hash of 32 bits up
to it. The limit is a fixed fraction of the hash range; where that leaves fewer than
``floor`` hashes it is the hash of that number, and a text with no more shingles keeps
all of them under the highest limit. As a sketch states up to where it is complete,
sketches of parts or of documents merge (``merge_sketches``, ``merged``): the lower limit,
and the hashes of both up to it. The share of a document's shingles that another one
holds is estimated on the hashes up to the lower of both limits, however unequal the
documents are (``contained_share``). Where none of the own hashes is below it the
sketches tell nothing, and the value given as ``unknown`` is returned.

``with_sketch``, ``containment`` and ``share`` are the earlier form with 64-bit hashes in
plain arrays, which do not state their limit and so do not merge.

Defined results: a null text counts as empty; a text of fewer words than a
shingle is one shingle; without words the fingerprint is empty, which is like
another empty one (1.0) and unlike any other (0.0).

``edited_pairs`` pairs every document with the next one in descending order of
(id, text), null ids last, and the last with the first. Repeated rows follow
each other; a single row follows itself. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadsmith.llm.common import text_or_empty

SHINGLE_WORDS = 5
FRACTION = 1 / 2
AT_LEAST = 64
LOWEST = -(1 << 63)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where lambdas in it read it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def word_hashes(text: str) -> Column:
    return F.transform(F.filter(F.split(text_or_empty(text), r"[ \t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes: str | Column) -> Column:
    """Hashes of all shingles of a text with the given ``word_hashes``."""
    k, n = SHINGLE_WORDS, F.size(hashes)
    return (F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k),
                                       lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))))
            .when(n > 0, F.array(F.xxhash64(hashes)))
            .otherwise(F.array().cast("array<long>")))


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, at_least: int = AT_LEAST) -> DataFrame:
    """Adds ``out``: the sorted sketch (signed hashes) of column ``text``."""
    limit = LOWEST + int(2 ** 64 * fraction)
    low = F.array_sort(F.array_distinct(F.filter("__s", lambda h: h < limit)))
    return (df.withColumn("__h", word_hashes(text)).withColumn("__s", shingles("__h")).withColumn("__l", low)
            .withColumn(out, F.when(F.size("__l") >= at_least, F.col("__l"))
                        .otherwise(F.slice(F.array_sort(F.array_distinct("__s")), 1, at_least)))
            .drop("__h", "__s", "__l"))


#: The scaled sketch keeps this share of the range of 32-bit hashes, and at least so many.
SCALE, FLOOR, TOP = 1 / 4, 64, (1 << 32) - 1


def with_scaled_sketch(df: DataFrame, text: str, out: str, fraction: float = SCALE, floor: int = FLOOR) -> DataFrame:
    """Adds ``out``: ``limit`` and the sorted ``hashes`` up to it of column ``text``."""
    limit = int(TOP * fraction)
    staged = (df.withColumn("__h", word_hashes(text)).withColumn("__s", shingles("__h"))
              .withColumn("__s", F.transform("__s", lambda h: h.bitwiseAND(F.lit(TOP))))
              .withColumn("__l", F.array_sort(F.array_distinct(F.filter("__s", lambda h: h <= limit))))
              .withColumn("__all", F.when(F.size("__l") < floor, F.array_sort(F.array_distinct("__s")))))
    sketch = F.struct(
        F.when(F.size("__l") >= floor, F.lit(limit)).when(F.size("__all") <= floor, F.lit(TOP))
        .otherwise(F.get("__all", F.lit(floor - 1))).cast("long").alias("limit"),
        F.when(F.size("__l") >= floor, F.col("__l")).otherwise(F.slice("__all", 1, floor)).alias("hashes"))
    return staged.withColumn(out, sketch).drop("__h", "__s", "__l", "__all")


def merge_sketches(a: str, b: str) -> Column:
    """The sketch of what two sketches were made of, taken together."""
    limit = F.least(F.col(a)["limit"], F.col(b)["limit"])
    both = F.concat(F.col(a)["hashes"], F.col(b)["hashes"])
    return _once(limit, lambda top: F.struct(
        top.alias("limit"), F.array_sort(F.array_distinct(F.filter(both, lambda h: h <= top))).alias("hashes")))


def merged(df: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """``keys`` and the merged ``sketch`` of each group. The hashes are made distinct one by
    one before they are gathered, so copies of a document weigh nothing."""
    limits = df.groupBy(*keys).agg(F.min(F.col(sketch)["limit"]).alias("__limit"))
    of = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    each = df.select(*of, F.explode(F.col(sketch)["hashes"]).alias("__hash")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (limits.join(each, cond & (F.col("__hash") <= F.col("__limit")), "left").groupBy(*keys, "__limit")
            .agg(F.array_sort(F.collect_list("__hash")).alias("__hashes"))
            .select(*keys, F.struct(F.col("__limit").alias("limit"), F.col("__hashes").alias("hashes")).alias(sketch)))


def contained_share(own: str, other: str, unknown: Column | None = None) -> Column:
    """Estimated share of ``own``'s shingles that ``other`` holds too; ``unknown`` (null if not
    given) where none of ``own``'s hashes is up to the common limit."""
    mine, theirs = F.col(own), F.col(other)
    below = _once(F.least(mine["limit"], theirs["limit"]), lambda top: F.filter(mine["hashes"], lambda h: h <= top))
    return (F.when(mine == theirs, F.lit(1.0))
            .when((F.size(mine["hashes"]) == 0) | (F.size(theirs["hashes"]) == 0), F.lit(0.0))
            .otherwise(_once(below, lambda m: F.when(F.size(m) == 0, F.lit(None).cast("double") if unknown is None else unknown)
                             .otherwise(F.size(F.array_intersect(m, theirs["hashes"])) / F.size(m)))))


def sketch_string(sketch: str) -> Column:
    """Limit and hashes, four bytes each, in base64; empty for a text without words."""
    def digits(h):
        return F.lpad(F.hex(h), 8, "0")

    s = F.col(sketch)
    return F.when(F.size(s["hashes"]) == 0, "").otherwise(F.base64(F.unhex(F.concat(
        digits(s["limit"]), F.array_join(F.transform(s["hashes"], digits), "")))))


def sketch_text(sketch: str) -> Column:
    """Hashes as fixed-width hexadecimal numbers in ascending order."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h.bitwiseXOR(F.lit(LOWEST))), 16, "0"))), ",")


def _limit(sketch: str, fraction: float, at_least: int) -> Column:
    """The largest hash up to which a sketch is complete."""
    return (F.when(F.size(sketch) < at_least, F.lit((1 << 63) - 1))
            .otherwise(F.greatest(F.lit(LOWEST + int(2 ** 64 * fraction) - 1), F.element_at(sketch, -1))))


def containment(own: str, other: str, fraction: float = FRACTION, at_least: int = AT_LEAST,
                unknown: Column | None = None) -> Column:
    """Estimated share of ``own``'s shingles that ``other`` holds too; ``unknown`` (0.0 if
    not given) where none of ``own``'s hashes is below the common limit."""
    limit = F.least(_limit(own, fraction, at_least), _limit(other, fraction, at_least))
    mine = _once(limit, lambda top: F.filter(own, lambda h: h <= top))
    return (F.when(F.col(own) == F.col(other), F.lit(1.0))
            .when((F.size(own) == 0) | (F.size(other) == 0), F.lit(0.0))
            .otherwise(_once(mine, lambda m: F.when(F.size(m) == 0, F.lit(0.0) if unknown is None else unknown)
                             .otherwise(F.size(F.array_intersect(m, F.col(other))) / F.size(m)))))


def share(own: str, other: str, own_text: str, other_text: str) -> Column:
    """``containment`` of two sketches; the exact share of the texts' shingles where they tell nothing."""
    mine, theirs = (F.array_distinct(_once(word_hashes(t), shingles)) for t in (own_text, other_text))
    exact = _once(mine, lambda m: F.size(F.array_intersect(m, theirs)) / F.size(m))
    return containment(own, other, unknown=exact)


def _range_number(place: Column, cuts: list[Column]) -> Column:
    """How many of the sorted ``cuts`` are below the place, in two steps of about
    the square root of their number each."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*cuts[::step])
    fine = F.array(*(F.array(*cuts[i:i + step]) for i in range(0, len(cuts), step)))
    return _once(place, lambda p: _once(F.size(F.filter(coarse, lambda c: c < p)), lambda block: F.when(block == 0, 0).otherwise(
        (block - 1) * step + F.size(F.filter(F.element_at(fine, block), lambda c: c < p)))))


#: Characters of a text that decide its range beside the id.
PLACE_CHARS = 32


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1_000,
                 max_ranges: int = 65_536,
                 sketch: Callable[[DataFrame, str, str], DataFrame] = with_sketch) -> DataFrame:
    """``(id, text, sketch, next_text, next_sketch)`` in descending order of (id, text).

    Rows are split into ranges of about ``rows_per_range`` by id and the beginning of
    the text, so the rows of one id are split too (at most ``max_ranges`` ranges; larger
    ones spill while they are sorted). Texts are shuffled once, by range; the first row of
    each range is also added to the end of the range before it, so every row finds its
    successor in its range. ``sketch`` adds a sketch of a text column."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # Places in ascending order; a null id stands below all others, as in Spark's order of structs.
    place = F.struct("id", F.left("text", F.lit(PLACE_CHARS)).alias("head"))
    places = rows.select(place.alias("p"))
    ranges = max(1, min(max_ranges, -(-places.count() // rows_per_range)))
    tops = [r["m"] for r in places.repartitionByRange(ranges, "p").groupBy(F.spark_partition_id().alias("k"))
            .agg(F.max("p").alias("m")).orderBy("m").collect()]
    kind = docs.schema[id_col].dataType
    cuts = [F.struct(F.lit(t["id"]).cast(kind).alias("id"), F.lit(t["head"]).alias("head")) for t in tops]
    # Range k holds the places above tops[k-1] up to tops[k].
    rows = rows.withColumn("range", _range_number(place, cuts[:-1])).withColumn("extra", F.lit(False))
    # The highest row of range k follows the lowest one of range k + 1; that of the last range, the lowest of all.
    # Few rows stand at the top of a range: their places, one for each range, are known.
    known = spark.createDataFrame([(t["id"], t["head"]) for t in tops], f"__id {kind.simpleString()}, __head string")
    at_top = rows.join(F.broadcast(known), F.col("id").eqNullSafe(F.col("__id")) & (place["head"] == F.col("__head")))
    firsts = (at_top.groupBy("range").agg(F.max(F.struct("id", "text")).alias("__top"))
              .select(F.col("__top")["id"].alias("id"), F.col("__top")["text"].alias("text"),
                      F.pmod(F.col("range") + 1, F.lit(max(len(tops), 1))).alias("range"), F.lit(True).alias("extra")))
    by = ["extra", F.col("id").desc_nulls_last(), F.col("text").desc()]
    order = Window.partitionBy("range").orderBy(*by)
    # Sketches are made of rows that are dealt out and sorted, so none is shuffled or spilled.
    dealt = rows.unionByName(firsts).repartition("range").sortWithinPartitions("range", *by)
    return (sketch(dealt, "text", "sketch")
            .select("*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
            .where(~F.col("extra")).select(F.col("id").alias(id_col), "text", "sketch", "next_text", "next_sketch"))


def edited_text(text: str, other: str) -> Column:
    """``text`` with its last half replaced by as much of the start of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(F.col(text), F.length(text) - half), F.left(F.col(other), half))
