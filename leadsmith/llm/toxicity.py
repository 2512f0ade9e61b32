"""Toxicity classifier: character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed character n-grams it contains. Over
a bounded sample of the labelled rows the ratio r of smoothed feature
frequencies in the two classes is counted; a logistic regression on r-scaled
binary features is fitted on a part of it and scores whole texts.

Defined results: null and empty texts have no feature and score the model's
intercept; repeated rows get equal scores; ids with several label rows count
once per row; without labels of both classes every score is the prior (0.5
where there is none); other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import labelled_sample, prior, stored, text_slices

GRAMS = (4, 5, 6, 7)
BIN_BITS = 20
#: Characters whose n-grams a worker holds at a time.
PIECE_CHARS = 1 << 19


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Runs of about PIECE_CHARS characters with the number of the text each string
    comes from; a longer text is cut, with an overlap that keeps its n-grams."""
    numbers, run, size = [], [], 0
    for i, raw in enumerate(texts):
        text = raw.decode().lower()
        for lo in range(0, max(len(text), 1), PIECE_CHARS):
            part = text[lo:lo + PIECE_CHARS + max(GRAMS) - 1]
            if run and size + len(part) > PIECE_CHARS:
                yield np.array(numbers), run
                numbers, run, size = [], [], 0
            numbers.append(i)
            run.append(part)
            size += len(part)
    if run:
        yield np.array(numbers), run


def hashed_grams(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n of GRAMS: string number and bin of every n-gram."""
    chars = np.frombuffer("\0".join([*strings, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in strings])
    number = np.repeat(np.arange(len(strings), dtype=np.int32), np.diff(ends, prepend=0))
    final = np.zeros(len(chars), bool)
    final[ends - 1] = True
    prime = np.uint32(0x01000193)
    h = chars * np.uint32(0x9E3779B1)
    for n in range(2, max(GRAMS) + 1):
        if len(chars) < n:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * prime + chars[n - 1:]
        if n in GRAMS:
            ok = (number[:-n + 1] == number[n - 1:]) & ~final[n - 1:]
            bins = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BIN_BITS)).astype(np.int32)
            yield number[:-n + 1][ok], bins[ok]


def distinct_features(texts: list[bytes], place: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, sorted. ``place`` maps a bin to a
    feature number or -1; None keeps the bins themselves."""
    found = []
    for numbers, run in pieces(texts):
        keys = []
        for number, bins in hashed_grams(run):
            if place is not None:
                bins = place[bins]
                keep = bins >= 0
                number, bins = number[keep], bins[keep]
            keys.append(numbers[number].astype(np.int64) * width + bins)
        found.append(_sorted_distinct(keys))
    pairs = _sorted_distinct(found)
    return pairs // width, pairs % width


def _sorted_distinct(keys: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    pairs.sort()
    return pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs


@dataclass
class ToxicityModel:
    bins: np.ndarray      # feature bins, sorted
    weights: np.ndarray   # weight of each, the log-count ratio included
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        place = np.full(1 << BIN_BITS, -1, np.int32)
        place[self.bins] = np.arange(len(self.bins), dtype=np.int32)
        number, feature = distinct_features(texts, place, max(len(self.bins), 1))
        z = self.intercept + np.bincount(number, self.weights[feature] if len(feature) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def feature_counts(train: DataFrame) -> DataFrame:
    """``(bin, toxic, clean)``: in how many rows of each class a bin occurs. Every
    task adds up its own rows first (a table of fixed size)."""
    width = 1 << BIN_BITS

    def run(batches):
        counts = np.zeros((2, width), np.int64)
        for batch, texts in text_slices(batches, 1):
            label = np.asarray(batch.column(0).to_pylist(), np.int64)
            number, bins = distinct_features(texts, None, width)
            for c in (0, 1):
                counts[c] += np.bincount(bins[label[number] == c], minlength=width)
        seen = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(counts[1][seen]), pa.array(counts[0][seen])],
            names=["bin", "toxic", "clean"])

    each = train.select("label", "text").mapInArrow(run, "bin int, toxic long, clean long")
    return each.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 20_000, regression_per_class: int = 3_000,
        max_features: int = 8_192, min_rows: int = 3, smoothing: float = 1.0, l2: float = 3e-4,
        id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on the texts of ``labels(id, label)``. Bounds, all parameters: the counts
    see about ``per_class`` rows of each class, the regression about
    ``regression_per_class`` of them and ``max_features`` features."""
    labelled, n = labelled_sample(docs, labels, per_class, id_col, text_col)
    constant = ToxicityModel(np.zeros(0, np.int32), np.zeros(0), float(np.log(prior(n) / (1 - prior(n)))))
    if not n[0] or not n[1]:
        return constant

    counts = stored(feature_counts(labelled), "toxicity_counts")
    sums = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    width = float(1 << BIN_BITS)
    ratio = (F.log((F.col("toxic") + smoothing) / ((sums["t"] or 0) + smoothing * width))
             - F.log((F.col("clean") + smoothing) / ((sums["c"] or 0) + smoothing * width)))
    # Features with the surest ratios: in units of its standard error.
    error = F.sqrt(1 / (F.col("toxic") + smoothing) + 1 / (F.col("clean") + smoothing))
    chosen = (counts.where(F.col("toxic") + F.col("clean") >= min_rows)
              .select("bin", ratio.alias("r"), F.abs(ratio / error).alias("z"))
              .orderBy(F.col("z").desc(), "bin").limit(max_features).toPandas().sort_values("bin"))
    bins, r = chosen["bin"].to_numpy(np.int32), chosen["r"].to_numpy(np.float64)
    if not len(bins):
        return constant
    place = np.full(1 << BIN_BITS, -1, np.int32)
    place[bins] = np.arange(len(bins), dtype=np.int32)

    def features(batches):
        for batch, texts in text_slices(batches, 1):
            number, feature = distinct_features(texts, place, len(bins))
            cuts = np.searchsorted(number, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))],
                names=["label", "features"])

    few, _ = labelled_sample(docs, labels, regression_per_class, id_col, text_col)
    rows = few.select("label", "text").mapInArrow(features, "label long, features array<int>")
    sample = rows.toPandas()
    y = sample["label"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:
        return constant
    lengths = sample["features"].map(len).to_numpy()
    flat = np.concatenate([np.asarray(f, np.int64) for f in sample["features"]] or [np.zeros(0, np.int64)])
    # Rows weigh as much as their class does in all labelled rows.
    m = [max((y == c).sum(), 1) for c in (0, 1)]
    weight = np.where(y == 1, n[1] / m[1], n[0] / m[0])
    w, b = _logistic(flat, np.repeat(np.arange(len(y)), lengths), r, y, weight / weight.sum(), l2)
    return ToxicityModel(bins, w * r, b)


def _logistic(feature, row, r, y, weight, l2, steps: int = 300, rate: float = 0.05):
    """Adam on the weighted logistic loss of r-scaled binary features."""
    w, b = np.zeros(len(r)), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    scaled = r[feature]
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[feature] * scaled, minlength=len(y))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(np.bincount(feature, g[row] * scaled, minlength=len(r)) + l2 * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """``(id, score, predicted)`` of every whole text."""
    lead = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = lead.schema.fields[0].dataType.simpleString()

    def run(batches):
        for batch, texts in text_slices(batches, 1):
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "score", "predicted"])

    return lead.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
