"""Importance resampling towards a target distribution on hashed n-grams.

A text's words are joined by single spaces. An overlapped regex scan then emits,
at every word, the span of the longest run of at most ``max_words`` words; the
shorter runs at that word end where the words inside it end. The CRC of each span's
bytes gives the feature's bucket. How often the buckets occur in all texts and in
the target's texts gives every bucket a gain (a scaled log ratio, rounded down); a
document's weight is the sum of the gains of its features. Adding Gumbel noise that
only the id decides and taking the highest scores draws documents in proportion to
their weights, without replacement.

The texts are scanned once: the buckets of their features are stored (two bytes a
feature), counted, and weighed in a second pass over the stored numbers. The driver
holds one number for each bucket. Scores are ranked in ranges.

Defined results: null and empty texts and texts without a word have no features and
the weight 0; a null id draws its noise as the empty text; repeated rows have equal
scores and take successive ranks, ties go to the smaller id (a null id first); an
empty table draws nothing, an empty target gives gains from its smoothing alone;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import copies, lead_columns, ranked, stored, text_slices, with_fields

#: Maps A-Z to a-z and every byte that is not part of a word to a space.
SEPARATORS_TO_SPACE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))
#: Bytes of a text that are scanned at a time.
PART_BYTES = 1 << 20


def run_pattern(max_words: int):
    """At every word, the run of at most ``max_words`` words that begins there."""
    import regex
    return regex.compile(rb" [^ ]++(?: [^ ]++){0,%d}+(?= )" % (max_words - 1))


def parts_of(text: bytes, max_words: int):
    """``(part, words)``: parts of a text of single-spaced words, with a space at both
    ends, and how many of the words are its own (-1: all). The words after those are
    the next part's, there to end the runs that begin before."""
    lo = 0
    while len(text) - lo > PART_BYTES:
        cut = text.find(b" ", lo + PART_BYTES)
        if cut < 0 or cut == len(text) - 1:
            break
        end = cut
        for _ in range(max_words - 1):
            more = text.find(b" ", end + 1)
            if more < 0:
                break
            end = more
        yield text[lo:end + 1], text.count(b" ", lo, cut)
        lo = cut
    yield text[lo:], -1


def feature_crcs(text: bytes, pattern, max_words: int) -> tuple[int, list[np.ndarray]]:
    """Number of words and the CRCs of all runs of 1 to ``max_words`` words."""
    words = text.translate(SEPARATORS_TO_SPACE).split()
    if not words:
        return 0, []
    crc, found = zlib.crc32, []
    for part, own in parts_of(b" " + b" ".join(words) + b" ", max_words):
        spans = [m.span() for m in pattern.finditer(part, overlapped=True)]
        own = len(spans) if own < 0 else own
        begin = [a + 1 for a, _ in spans]
        stop = [*[a for a, _ in spans], len(part) - 1]      # the space that ends word i is stop[i + 1]
        for n in range(1, max_words):
            ends = stop[n:]
            found.append(np.array([crc(part[a:b]) for a, b in zip(begin[:own], ends, strict=False)], np.uint32))
        whole = spans[:min(own, len(spans) - max_words + 1)] if len(spans) >= max_words else []
        found.append(np.array([crc(part[a + 1:b]) for a, b in whole], np.uint32))
    return len(words), found


def hashed_features(docs: DataFrame, id_col: str, text_col: str, buckets: int, max_words: int,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, carry.., n_words, n_features, features)``; ``features`` are the buckets
    of all features as unsigned integers of two bytes (four, if there are more buckets)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    lead, kept, text_at = lead_columns(docs, id_col, text_col, carry)
    fields = lead.schema.fields[:kept]

    def run(batches):
        pattern = run_pattern(max_words)
        for batch, texts in text_slices(batches, text_at):
            n_words, n_features, features = [], [], []
            for text in texts:
                n, crcs = feature_crcs(text, pattern, max_words)
                all_crcs = np.concatenate(crcs) if crcs else np.zeros(0, np.uint32)
                n_words.append(n)
                n_features.append(len(all_crcs))
                features.append((all_crcs % np.uint32(buckets)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j) for j in range(kept)), pa.array(n_words, pa.int64()),
                 pa.array(n_features, pa.int64()), pa.array(features, pa.binary())],
                names=[*(f.name for f in fields), "n_words", "n_features", "features"])

    return lead.mapInArrow(run, with_fields(fields, "n_words long, n_features long, features binary"))


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: one row of a task for each bucket it has met."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for features in batch.column(0):
                counts += np.bincount(np.frombuffer(features.as_buffer(), kind), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met], pa.int64())],
                                         names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in hashed.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(scale * math.log((float(t + 1) * all_source) / (float(s + 1) * all_target)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(hashed: DataFrame, gains: np.ndarray) -> DataFrame:
    """The columns of ``hashed`` without the features, and ``weight``."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"
    fields = [f for f in hashed.schema.fields if f.name != "features"]

    def run(batches):
        for batch in batches:
            weight = [int(gains[np.frombuffer(f.as_buffer(), kind)].sum()) for f in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())],
                                             names=[*(f.name for f in fields), "weight"])

    return hashed.select(*[f.name for f in fields], "features").mapInArrow(run, with_fields(fields, "weight long"))


def gumbel_noise(id_col: str, seed: int, scale: int = 1000):
    """floor(-scale * ln(-ln(u))), where the SHA-256 of ``seed:id`` decides u."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_id_col: str = "item_id", target_text_col: str = "text", buckets: int = 10_000,
                        max_words: int = 3, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` of every document. ``rank``
    counts the drawn documents from 1 on; it is null for the others. Drawn are
    ``percent`` of the documents with at least ``min_words`` words, rounded down."""
    hashed = stored(hashed_features(docs, id_col, text_col, buckets, max_words), "hashed")
    aimed = hashed_features(target, target_id_col, target_text_col, buckets, max_words)
    gains = bucket_gains(bucket_counts(hashed, buckets), bucket_counts(aimed, buckets))
    # Repeated rows are one record until their ranks are known.
    scored = stored(
        weighed(hashed, gains).withColumnRenamed(id_col, "id")
        .withColumn("score", F.col("weight") + gumbel_noise("id", seed))
        .groupBy("id", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("rows")), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = (able.agg(F.sum("rows")).first()[0] or 0) * percent // 100
    placed = ranked(able, [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("weight"), F.col("n_features"),
                           F.col("n_words")], "rows")
    every = placed.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    place = F.col("rank") + F.col("__copy") + 1
    return copies(every, "rows").select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score",
                                        F.when(place <= drawn, place).alias("rank"))
