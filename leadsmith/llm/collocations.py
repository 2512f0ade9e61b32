"""Phrase collocations by direct-address tiling over frequency-ranked ids.

Words that occur often enough get ids by falling frequency, over all languages
together, so an id names its language too. The texts are stored as ids; a -1 stands
for every word that is too rare and for every break between pieces. Pairs of
neighbouring ids are counted in tiles: the tile of the most frequent ids is an
array addressed by the pair itself and counted with ``bincount``; the others hold few
of their pairs, which are sorted and counted as coordinates. The tasks hand their
coordinates on in parts, by a hash of the pair; each part is summed by one task, and
there are as many parts as keep it small.

The pairs that are frequent enough are ranked again and become ids themselves; with
the ids of the words after them they form the next pairs, and so on up to the
longest phrase. A phrase can only be frequent if its beginning and its rest are.

No task holds a whole vocabulary. The words of the first ``head_words`` ranks are looked
up in a dictionary, the others meet the vocabulary in a join; frequent phrases are
looked up in blocks of ``block_phrases``, one pass over the ids for each block.

Defined results: a null text is empty, a null language counts as ``und``; repeated rows
count like separate rows; an empty table or one without a frequent phrase gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadsmith.llm.common import discard, ranked, stored, stored_at, text_slices, worker_memory

#: A-Z become a-z, a tab becomes a space, everything that ends a piece a line feed.
PIECES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else
               0x0A if b in b".,;:!?" or 0x0A <= b <= 0x0D else b for b in range(256))
#: Distinct words that a task counts before it hands them on.
WORDS_HELD = 300_000
#: Pairs of a task that are sorted and counted at a time.
PAIRS_HELD = 1_000_000
#: Words of the corpus for each part that the counted pairs are dealt to.
WORDS_PER_PART = 2_000_000
#: Pairs in one row that a task hands on.
PAIRS_PER_ROW = 65_536
#: The tile of the most frequent ids is as wide and as high.
TILE = 1_024


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, word, f)``: how often every word occurs in the texts of a language."""
    lead = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def rows(counts):
        langs, words, n = [], [], []
        for lang, own in counts.items():
            langs += [lang] * len(own)
            words += own.keys()
            n += own.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                                           pa.array(n, pa.int64())], names=["lang", "word", "f"])

    def run(batches):
        counts: dict[str, Counter] = {}
        for batch, texts in text_slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                counts.setdefault(lang, Counter()).update(text.translate(PIECES).split())
            if sum(map(len, counts.values())) > WORDS_HELD:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    return lead.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def encoded(docs: DataFrame, words: DataFrame, text_col: str, lang_col: str, head_words: int, kind: str) -> DataFrame:
    """The ``ids`` of every text, as signed integers of a ``kind``."""
    head = words.where(F.col("rank") < head_words).select("lang", "word", "rank").toArrow()
    key, langs = uuid.uuid4().hex, head.column("lang").to_pylist()
    text_of, ranks = pa.array(head.column("word").combine_chunks(), pa.large_string()), head.column("rank").to_numpy()
    tail = words.where(F.col("rank") >= head_words)
    has_tail = bool(tail.limit(1).count())
    lead = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def dictionary() -> dict[str, dict[bytes, int]]:
        kept = worker_memory()
        if kept.get("vocabulary", ("",))[0] != key:
            own: dict[str, dict[bytes, int]] = {}
            for lang, word, rank in zip(langs, text_of.to_pylist(), ranks.tolist(), strict=True):
                own.setdefault(lang, {})[word.encode()] = rank
            kept["vocabulary"] = (key, own)
        return kept["vocabulary"][1]

    def run(batches):
        own, missing = dictionary(), -2 if has_tail else -1
        for batch, texts in text_slices(batches, 1):
            names, all_ids, unknown = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                get, ids, others = own.get(lang, {}).get, [], []
                for piece in text.translate(PIECES).split(b"\n"):
                    tokens = piece.split()
                    found = [get(t, missing) for t in tokens]
                    if has_tail:
                        others += [t for t, i in zip(tokens, found, strict=True) if i == -2]
                    ids += found
                    ids.append(-1)
                names.append(lang)
                all_ids.append(np.array(ids, kind).tobytes())
                unknown.append(others)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(all_ids, pa.binary()),
                 pa.array(unknown, pa.list_(pa.binary()))], names=["lang", "ids", "unknown"])

    out = lead.mapInArrow(run, "lang string, ids binary, unknown array<binary>")
    if not has_tail:
        return out.select("ids")
    # Words of the lower ranks are looked up by a join; each is rare, so no key is hot.
    texts = stored(out, "texts").withColumn("row", F.monotonically_increasing_id())
    asked = texts.select("row", "lang", F.posexplode("unknown").alias("at", "word")).withColumn("word", F.col("word").cast("string"))
    known = (asked.join(tail.select("lang", "word", "rank"), ["lang", "word"])
             .groupBy("row").agg(F.collect_list(F.struct("at", "rank")).alias("known")))

    def fill(batches):
        for batch in batches:
            filled = []
            for ids, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, kind).copy()
                places = np.flatnonzero(ids == -2)
                ids[places] = -1
                for k in known or ():
                    ids[places[k["at"]]] = k["rank"]
                filled.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.binary())], names=["ids"])

    return texts.select("row", "ids").join(known, "row", "left").select("ids", "known").mapInArrow(fill, "ids binary")


class PairCounter:
    """Counts of pairs of ids, in bounded memory."""

    def __init__(self, tile: int):
        self.tile, self.waiting, self.held = tile, [], 0
        self.dense = np.zeros(tile * tile, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray):
        inner = (a < self.tile) & (b < self.tile)
        self.dense += np.bincount(a[inner] * self.tile + b[inner], minlength=self.tile * self.tile)
        self.waiting.append((a[~inner], b[~inner]))
        self.held += len(self.waiting[-1][0])
        return self.sparse() if self.held > PAIRS_HELD else None

    def sparse(self):
        """Coordinates and counts of the pairs outside the tile, sorted."""
        a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True)) if self.waiting else (np.zeros(0, np.int64),) * 2
        self.waiting, self.held = [], 0
        if not len(a):
            return a, b, a
        width = int(b.max()) + 1
        if int(a.max()) < (1 << 62) // width:
            key, n = np.unique(a * width + b, return_counts=True)
            return key // width, key % width, n
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[first], b[first], np.diff(np.append(first, len(a)))

    def inside(self):
        met = np.flatnonzero(self.dense)
        return met // self.tile, met % self.tile, self.dense[met]


def pair_places(starts: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Where a phrase of n + 1 words may be frequent: frequent phrases of n words begin
    here and one word on, so a frequent word follows."""
    if len(ids) <= n:
        return np.zeros(0, np.int64)
    return np.flatnonzero((starts[:-1] >= 0) & (starts[1:] >= 0)) if n > 1 \
        else np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))


def id_kind(n: int) -> str:
    """The integers that ids below n and the -1 are stored in."""
    return "<i4" if n < 1 << 31 else "<i8"


def pair_counts(corpus: DataFrame, n: int, kinds: tuple[str, str], parts: int, min_count: int) -> DataFrame:
    """``(a, b, f)``: how often the phrase ``a`` of n words is followed by the word ``b``,
    if it is ``min_count`` times. ``kinds``: the integers of the ids and of the starts."""
    ids_kind, starts_kind = kinds

    def rows(found):
        """The pairs, dealt to the parts, as binaries of sorted coordinates."""
        a, b, f = found
        with np.errstate(over="ignore"):
            mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        a, b, f, part = a[order], b[order], f[order], part[order]
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), np.arange(0, len(part), PAIRS_PER_ROW)]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[lo])], pa.int32()), pa.array([a[lo:hi].astype(starts_kind).tobytes()], pa.binary()),
                 pa.array([b[lo:hi].astype(ids_kind).tobytes()], pa.binary()),
                 pa.array([f[lo:hi].astype("<i8").tobytes()], pa.binary())], names=["part", "a", "b", "f"])

    def run(batches):
        counter = PairCounter(TILE)
        for batch in batches:
            some_a, some_b = [], []
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[row].as_buffer(), ids_kind)
                starts = ids if n == 1 else np.frombuffer(batch.column(1)[row].as_buffer(), starts_kind)
                at = pair_places(starts, ids, n)
                some_a.append(starts[at])
                some_b.append(ids[at + n])
            if some_a and (found := counter.add(np.concatenate(some_a).astype(np.int64), np.concatenate(some_b).astype(np.int64))):
                yield from rows(found)
        for found in (counter.sparse(), counter.inside()):
            if len(found[0]):
                yield from rows(found)

    def total(part: pa.Table) -> pa.Table:
        a, b, f = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part.column(c)])
                   for c, kind in (("a", starts_kind), ("b", ids_kind), ("f", "<i8")))
        order = np.lexsort((b, a))
        a, b, f = a[order].astype(np.int64), b[order].astype(np.int64), f[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        f = np.add.reduceat(f, first)
        able = f >= min_count
        return pa.table({"a": pa.array(a[first][able], pa.int64()), "b": pa.array(b[first][able], pa.int64()),
                         "f": pa.array(f[able], pa.int64())})

    return (corpus.mapInArrow(run, "part int, a binary, b binary, f binary")
            .groupBy("part").applyInArrow(total, "a long, b long, f long"))


def with_starts(corpus: DataFrame, path: str, phrases: DataFrame, n: int, kinds: tuple[str, str], n_phrases: int,
                block_phrases: int) -> tuple[DataFrame, str]:
    """``(ids, starts)`` and its folder: the rank of the frequent phrase of n + 1 words that
    begins at each place, or -1; rows without any go. One pass for each block of
    phrases; a pass replaces the table of the one before."""
    spark, (ids_kind, before_kind), new_kind = corpus.sparkSession, kinds, id_kind(n_phrases)
    blocks = -(-n_phrases // block_phrases)
    for k in range(blocks):
        lo = k * block_phrases
        block = phrases.where((F.col("rank") >= lo) & (F.col("rank") < lo + block_phrases)).select("a", "b", "rank").toArrow()
        a, b, rank = (block.column(c).to_numpy() for c in ("a", "b", "rank"))
        order = np.lexsort((b, a))
        a, b, rank = a[order], b[order], rank[order]
        # Ids of the block's first parts, numbered densely: the pair fits one number.
        firsts, width = np.unique(a), int(b.max()) + 1
        keys = np.searchsorted(firsts, a) * width + b
        last = k + 1 == blocks

        def run(batches, k=k, firsts=firsts, keys=keys, rank=rank, width=width, last=last):
            for batch in batches:
                out_ids, out_before, out_new = [], [], []
                for row in range(batch.num_rows):
                    ids = np.frombuffer(batch.column(0)[row].as_buffer(), ids_kind)
                    before = ids if n == 1 else np.frombuffer(batch.column(1)[row].as_buffer(), before_kind)
                    new = np.frombuffer(batch.column(2)[row].as_buffer(), new_kind).copy() if k else np.full(len(ids), -1, new_kind)
                    at = pair_places(before, ids, n)
                    if len(at):
                        x, y = before[at], ids[at + n]
                        f = np.searchsorted(firsts, x)
                        f[f == len(firsts)] = 0
                        right = (firsts[f] == x) & (y < width)
                        at, key = at[right], f[right] * width + y[right]
                        place = np.searchsorted(keys, key)
                        place[place == len(keys)] = 0
                        right = keys[place] == key
                        new[at[right]] = rank[place[right]]
                    if last and not (new >= 0).any():
                        continue
                    out_ids.append(ids.tobytes())
                    out_before.append(b"" if last or n == 1 else before.tobytes())
                    out_new.append(new.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (out_ids, out_before, out_new)],
                                                 names=["ids", "starts", "new"])

        columns = ["ids", "starts", "new"] if k else ["ids"] if n == 1 else ["ids", "starts"]
        corpus, new_path = stored_at(corpus.select(*columns).mapInArrow(run, "ids binary, starts binary, new binary"), "starts")
        discard(spark, path)
        path = new_path
    return corpus.select("ids", F.col("new").alias("starts")), path


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int, text_col: str, lang_col: str,
                     head_words: int, block_phrases: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)`` and ``(lang, words, f)`` of all phrases of 1 to ``max_words`` words
    that occur ``min_count`` times."""
    spark = docs.sparkSession
    counts, counts_path = stored_at(word_counts(docs, text_col, lang_col), "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = stored(ranked(counts.where(F.col("f") >= min_count), [F.col("f").desc(), F.col("lang"), F.col("word")]), "ranked_words")
    discard(spark, counts_path)
    parts = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // WORDS_PER_PART))
    vocabulary = words.select(F.col("rank").alias("b"), F.col("word").alias("next"))
    ids_kind = kind = id_kind(words.count())
    corpus, path = stored_at(encoded(docs, words, text_col, lang_col, head_words, ids_kind), "ids")
    level = words.select("lang", F.array("word").alias("words"), "f", "rank")
    levels = [level]
    for n in range(1, max_words):
        pairs = pair_counts(corpus, n, (ids_kind, kind), parts, min_count)
        level = stored(ranked(
            pairs.join(level.select(F.col("rank").alias("a"), "lang", "words"), "a").join(vocabulary, "b")
            .select("lang", F.concat("words", F.array("next")).alias("words"), "f", "a", "b"),
            [F.col("f").desc(), F.col("a"), F.col("b")]), "phrases")
        found = level.count()
        if not found:
            break
        levels.append(level)
        if n + 1 < max_words:
            corpus, path = with_starts(corpus, path, level, n, (ids_kind, kind), found, block_phrases)
            kind = id_kind(found)
    discard(spark, path)
    whole = levels[0].select("lang", "words", "f")
    for more in levels[1:]:
        whole = whole.unionByName(more.select("lang", "words", "f"))
    return totals, whole


def top_per_key(df: DataFrame, key: str, order: list, top: int, parts: int = 64) -> DataFrame:
    """The first ``top`` rows of each key with ``rank``; a key's rows are cut in parts first."""
    part = Window.partitionBy(key, "__part").orderBy(*order)
    few = (df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
           .withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= top).drop("__r", "__part"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return few.withColumn("rank", rank).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100,
                 max_words: int = 5, percent: int = 100, top: int = 2_000, head_words: int = 500_000,
                 block_phrases: int = 2_000_000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    A phrase goes if a longer frequent one holds its words in a row and occurs at least
    ``percent`` per cent as often. As every phrase between the two occurs at least as
    often as the longer one, only phrases with one word more need to be looked at."""
    totals, whole = frequent_phrases(docs, min_count, max_words, text_col, lang_col, head_words, block_phrases)
    size = F.size("words")
    longer = (whole.where(size > 2).select("lang", "f", F.explode(F.array(
        F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"))
        .groupBy("lang", "words").agg(F.max("f").alias("longer")))
    left = (whole.where(size > 1).join(longer, ["lang", "words"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * percent))
            .select("lang", "words", F.col("f").alias("a")))
    cuts = (left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
            .withColumn("front", F.slice(F.col("words"), F.lit(1), F.col("k")))
            .withColumn("back", F.slice(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k"))))
    # Decimals of 38 digits hold the products; `div` gives the whole part of the exact quotient.
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    scored = (cuts.join(whole.select("lang", F.col("words").alias("front"), F.col("f").alias("l")), ["lang", "front"])
              .join(whole.select("lang", F.col("words").alias("back"), F.col("f").alias("r")), ["lang", "back"])
              .join(totals, "lang")
              .withColumn("over", (F.col("a") * 1000).cast("decimal(19,0)") * big["n"])
              .withColumn("under", big["l"] * big["r"])
              .withColumn("score", F.expr("over div under"))
              .groupBy("lang", "words", "a", "n")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    phrases = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("cut.l").alias("l"),
                            F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    best = top_per_key(phrases, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
