"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an
item with fewer words is one window). For all patterns of one length there is
a shift table on blocks of words: the block that ends at the current position
tells how far the search may jump without missing an occurrence. At shift 0 the
block's bucket lists the patterns that end in it, and their words are compared
directly.

The patterns are handled in blocks of at most ``block_windows`` windows, one after the
other, so the driver and a task hold a bounded table however large the benchmark is;
the documents are scanned once per block, and of each scan only the hits are written.

Defined results: null and empty texts have no words and are clean; items
without words have no window; a window that occurs in several items counts for
each of them; repeated rows get equal results; an empty benchmark leaves every
document clean; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import lead_columns, stored, text_slices, with_fields

#: Maps A-Z to a-z and every byte that is not part of a word to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else
             b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
             for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]


class WuManber:
    """Search for many patterns of the same number of words."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], block: int = 2):
        patterns = list(patterns)
        self.length = len(patterns[0])
        self.block = min(block, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
        for p in patterns:
            for end in range(self.block, self.length + 1):
                key = p[end - self.block:end]
                left = self.length - end
                if left < self.shift.get(key, self.jump):
                    self.shift[key] = left
            self.bucket.setdefault(p[-self.block:], []).append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """``(start, pattern)`` of every occurrence."""
        shift, bucket, block, jump, length = self.shift, self.bucket, self.block, self.jump, self.length
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block:end])
            step = shift.get(key, jump)
            if step:
                end += step
                continue
            found = tuple(words[end - length:end])
            for p in bucket[key]:
                if p == found:
                    yield end - length, p
            end += 1


def scan(words: list[bytes], searches: list[WuManber],
         items: dict[tuple[bytes, ...], list[str]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges covered by occurrences, and the ids of their items."""
    spans, ids = [], set()
    for search in searches:
        for start, pattern in search.find(words):
            spans.append((start, start + search.length))
            ids.update(items[pattern])
    return merge_spans(spans), ids


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            if hi > merged[-1][1]:
                merged[-1] = (merged[-1][0], hi)
        else:
            merged.append((lo, hi))
    return merged


def ids_digest(ids: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``(words, item_ids)``: every distinct window with the items that have it."""
    def run(batches):
        for batch, texts in text_slices(batches, 1):
            ids = batch.column(0).to_pylist()
            out_w, out_i = [], []
            for i, text in zip(ids, texts, strict=True):
                for w in dict.fromkeys(item_windows(words_of(text), window)):
                    out_w.append(b" ".join(w))
                    out_i.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.binary()), pa.array(out_i, pa.string())],
                                             names=["words", "item_id"])

    each = (benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col))
            .mapInArrow(run, "words binary, item_id string"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 13,
                  block_windows: int = 200_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, the
    ``carry`` columns, ``hit_spans`` (word ranges, sorted) and ``hit_items``."""
    windows = stored(benchmark_windows(benchmark, window, item_col, item_text_col), "windows")
    blocks = max(1, -(-windows.count() // block_windows))

    def patterns(b: int) -> dict[tuple[bytes, ...], list[str]]:
        # At most about block_windows windows (hash-dealt): a bounded pattern table.
        mine = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        return {tuple(bytes(r["words"]).split(b" ")): list(r["item_ids"]) for r in mine.toLocalIterator()}

    if blocks == 1:
        return _finish(_scan_block(docs, patterns(0), id_col, text_col, carry), id_col, carry)
    # One block after the other: its patterns are in the driver and the tasks only while
    # its hits are written, under two hashes of the row's id and text.
    keys = ["__k1", "__k2"]
    keyed = docs.select("*", F.xxhash64(id_col, text_col).alias("__k1"),
                        F.xxhash64(F.lit("row"), text_col, id_col).alias("__k2"))
    found = None
    for b in range(blocks):
        part = stored(_scan_block(keyed, patterns(b), id_col, text_col, tuple(keys))
                      .where(F.size("hit_items") > 0).select(*keys, "hit_spans", "hit_items"), "hits")
        found = part if found is None else found.unionByName(part)
    # Repeated rows have written the same hits; a set keeps them once.
    hits = (found.groupBy(*keys).agg(F.flatten(F.collect_set("hit_spans")).alias("hit_spans"),
                                     F.array_distinct(F.flatten(F.collect_set("hit_items"))).alias("hit_items")))
    every = _scan_block(keyed, {}, id_col, text_col, (*carry, *keys)).drop("hit_spans", "hit_items")
    none = {"hit_spans": F.array().cast(hits.schema["hit_spans"].dataType), "hit_items": F.array().cast("array<string>")}
    return _finish(every.join(hits, keys, "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()}), id_col, carry)


def _scan_block(docs, items, id_col, text_col, carry):
    def run(batches):
        by_length: dict[int, list] = {}
        for p in items:
            by_length.setdefault(len(p), []).append(p)
        searches = [WuManber(ps) for ps in by_length.values()]
        for batch, texts in text_slices(batches, text_at):
            n_words, spans, ids = [], [], []
            for text in texts:
                words = words_of(text)
                s, i = scan(words, searches, items) if searches else ([], set())
                n_words.append(len(words))
                spans.append([{"lo": a, "hi": b} for a, b in s])
                ids.append(sorted(i))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j) for j in range(kept)), pa.array(n_words, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(ids, pa.list_(pa.string()))],
                names=[*(f.name for f in fields), "n_words", "hit_spans", "hit_items"])

    lead, kept, text_at = lead_columns(docs, id_col, text_col, carry)
    fields = lead.schema.fields[:kept]
    return lead.mapInArrow(run, with_fields(fields, "n_words long, hit_spans array<struct<lo: int, hi: int>>, hit_items array<string>"))


def _finish(hits, id_col, carry):
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def cover(acc, span):
        """Spans in order of their start: what reaches beyond those before counts."""
        return F.struct(F.greatest(acc["end"], span["hi"]).alias("end"),
                        (acc["words"] + F.greatest(span["hi"] - F.greatest(span["lo"], acc["end"]), F.lit(0))).alias("words"))

    done = (hits.withColumn("hit_spans", F.array_sort("hit_spans"))
            .withColumn("__hit", F.aggregate("hit_spans", start, cover, lambda acc: acc["words"])))
    n_hit = F.col("__hit")
    return done.select(
        id_col, *carry, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        "hit_spans", F.array_sort("hit_items").alias("hit_items"))
