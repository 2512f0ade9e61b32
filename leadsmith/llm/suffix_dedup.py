"""Removal of repeated passages with a Burrows-Wheeler transform.

A byte goes if it is covered by a ``min_length``-byte string that starts earlier
too: in a document of a smaller id, or before it in the same document.

1. Dealing out. Every string of ``min_length`` bytes has an anchor, the leftmost
   of its ``SEED_BYTES``-byte substrings with the smallest hash. Equal strings
   have equal anchors at the same place, so it is enough to look among the
   contexts (the runs of bytes whose strings share one anchor) with the same
   anchor hash. Of equal contexts all but the first are repeated throughout;
   each task keeps only its own first ones, so a passage in a third of all
   documents is one row per task.
2. Different contexts with the same anchor are compared as text: a bounded batch
   of them is suffix-sorted, and a breadth-first backward extension over the
   intervals of its Burrows-Wheeler transform sets the common prefix lengths 0, 1,
   2, .. in turn and stops at ``min_length``. Neighbours that have got no length
   by then share at least ``min_length`` bytes.
3. A frequent anchor (a line that many documents share, in different surroundings)
   would bring all its contexts to one task. Anchors found frequent in a bounded
   sample, and any other with more than ``max_contexts`` different contexts, are
   dealt out by the hash of each of their strings instead. Equal strings have equal
   anchors, so whichever anchors are chosen, no repeat is lost.

Defined results: a null text counts as empty; rows with the same id and text are
one document, looked at once however often it stands there, and get equal results; of rows with the same id and other texts the
smaller start is the earlier one, equal starts both stay; a null id is smaller
than any other; ids are integers; an empty table gives an empty result; other
columns of the input are ignored (``carry`` keeps those named).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import stored, text_slices, with_fields

SEED_BYTES = 32
#: Bytes of text whose windows a worker handles at a time.
PIECE_BYTES = 1 << 20
POSITION_BITS = 26
#: Bytes of contexts that are suffix-sorted together, at least (one anchor's contexts stay together).
BATCH_BYTES = 1 << 19
NO_ID = -(1 << 63)
#: Different contexts in the sample that make an anchor frequent, at least.
FREQUENT_LEAST = 50
#: Contexts that a task remembers from one piece of text to the next.
SEEN_MOST = 50_000
_BYTE_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
ROW = "mh long, ctx long, id long, tag long, start long, strings int"
SPAN = "id long, tag long, start long, stop long"


def seed_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the SEED_BYTES bytes from every position on."""
    h, span = _BYTE_HASH[raw], 1
    while span < SEED_BYTES:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + (h[span:] ^ (h[span:] >> np.uint64(29)))
        span *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(30))


def contexts(raw: np.ndarray, ends: np.ndarray, min_length: int):
    """``(document, start, strings, anchor hash)`` of the contexts in concatenated
    documents that end at ``ends``; starts count from the begin of ``raw``."""
    n = len(raw) - min_length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    h = seed_hashes(raw)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width, span = min_length - SEED_BYTES + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    anchor = (low[:n] & mask).astype(np.int64)
    at = np.arange(n)
    document = np.searchsorted(ends, at, side="right")
    ok = at + min_length <= ends[np.minimum(document, len(ends) - 1)]
    new = np.flatnonzero(ok & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
                                              | ~ok[:-1]]))
    last = np.flatnonzero(ok & np.concatenate([(anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
                                               | ~ok[1:], [True]]))
    return document[new], new, last - new + 1, h[anchor[new]].view(np.int64)


def _pieces(texts: list[bytes], min_length: int):
    """Runs of texts, and parts of a very long one: ``(first text, offset, texts)``."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if len(t) > PIECE_BYTES:
            if lo < i:
                yield lo, 0, texts[lo:i]
            for s in range(0, max(len(t) - min_length + 1, 1), PIECE_BYTES):
                yield i, s, [t[s:s + PIECE_BYTES + min_length - 1]]
            lo, size = i + 1, 0
            continue
        size += len(t)
        if size > PIECE_BYTES:
            yield lo, 0, texts[lo:i]
            lo, size = i, len(t)
    if lo < len(texts):
        yield lo, 0, texts[lo:]


def copies(cols: list[np.ndarray], last: list | None = None) -> np.ndarray:
    """Marks the rows equal to the one before them (at first to ``last``) in mh, ctx, id, tag
    and start: the same place of a repeated row."""
    out = np.zeros(len(cols[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:5]])
        out[0] = last is not None and all(c[0] == x for c, x in zip(cols[:5], last, strict=True))
    return out


def first_rows(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """cols: mh, ctx, id, tag, start, .., sorted by (mh, ctx, id, start). Marks the rows that
    start a group of (mh, ctx), and those with the group's first (id, start)."""
    mh, ctx, ids, start = cols[0], cols[1], cols[2], cols[4]
    lead = np.ones(len(mh), bool)
    lead[1:] = (mh[1:] != mh[:-1]) | (ctx[1:] != ctx[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(mh)), 0))
    return lead, (ids == ids[head]) & (start == start[head])


class Seen:
    """Where the contexts that repeat inside a piece of text stand first, as far as a task has
    met them: of a context that stands in every piece, a task hands on the rows that
    come before the one it has handed on, not one for each piece."""

    def __init__(self):
        self.first: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.known = np.zeros(0, np.int64)

    def later(self, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Marks the rows that come after an equal context handed on, and those that are
        that very place of a repeated row."""
        after, same = np.zeros(len(cols[0]), bool), np.zeros(len(cols[0]), bool)
        at = np.searchsorted(self.known, cols[1])
        at[at == len(self.known)] = 0
        maybe = np.flatnonzero(self.known[at] == cols[1]) if len(self.known) else at[:0]
        for k in maybe.tolist():
            key, place = (int(cols[0][k]), int(cols[1][k])), (int(cols[2][k]), int(cols[4][k]), int(cols[3][k]))
            best = self.first.get(key)
            if best is None:
                continue
            if place[:2] > best[:2]:
                after[k] = True
            elif place == best:
                same[k] = True
            elif place[:2] < best[:2]:
                self.first[key] = place
        return after, same

    def add(self, cols: list[np.ndarray]) -> None:
        """Remember rows that are handed on."""
        room = SEEN_MOST - len(self.first)
        if not room or not len(cols[0]):
            return
        for mh, ctx, i, tag, start in zip(*(c[:room].tolist() for c in cols[:5]), strict=True):
            self.first.setdefault((mh, ctx), (i, start, tag))
        self.known = np.sort(np.array([ctx for _, ctx in self.first], np.int64))


def merged(ids, tags, start, stop):
    """Union of spans per document."""
    order = np.lexsort((start, tags, ids))
    ids, tags, start, stop = ids[order], tags[order], start[order], stop[order]
    if not len(ids):
        return ids, tags, start, stop
    # stops of one document never shrink the running maximum of another: shift by document.
    doc = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))])
    width = int(stop.max()) + 2
    reach = np.maximum.accumulate(doc * width + stop)
    new = np.concatenate([[True], doc[1:] * width + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    return ids[first], tags[first], start[first], reach[last] - doc[last] * width


# ------------------------------------------------------------------ the transform

def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by their next ``length`` symbols at least (prefix doubling)."""
    n = len(symbols)
    packed, h = np.zeros(n, np.int64), 0
    while h < 6:
        packed = packed * 257
        packed[:max(n - h, 0)] += symbols[h:]
        h += 1
    order = np.argsort(packed)
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(packed[order][1:] != packed[order][:-1])])
    while h < length and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:max(n - h, 0)] += rank[h:] + 1
        order = np.argsort(key)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        h *= 2
    return order


def unset_boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Breadth-first backward extension. ``out[j]`` tells whether the suffixes ranked
    j-1 and j have no common prefix length below ``length``. Symbol 0 separates
    texts and is never extended with."""
    n = len(symbols)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    following, before = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = hi - lo
        which = np.repeat(np.arange(len(lo)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which]
        real = bwt[at] != 0
        at, which = at[real], which[real]
        first, last = before[at] < lo[which], following[at] >= hi[which]
        starts, stops = np.sort(lf[at[first]]), np.sort(lf[at[last]] + 1)
        fresh = unset[stops] | (stops == n)
        unset[stops] = False
        lo, hi = starts[fresh], stops[fresh]
        if not len(lo):
            break
    return unset


def repeated_strings(texts: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int):
    """``(text number, offset)`` of every string of ``length`` bytes in ``texts`` that
    occurs at a smaller (id, start) too."""
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = joined.astype(np.int64) + 1
    symbols[begins + sizes] = 0
    order = suffix_order(symbols, length + 1)
    unset = unset_boundaries(symbols, order, length)
    text = np.searchsorted(begins, order, side="right") - 1
    offset = order - begins[text]
    whole = sizes[text] - offset >= length
    linked = unset[1:-1] & whole[1:] & whole[:-1]
    group = np.concatenate([[0], np.cumsum(~linked)])
    many = np.concatenate([linked, [False]]) | np.concatenate([[False], linked])
    text, offset, group = text[many], offset[many], group[many]
    who, where = ids[text], starts[text] + offset
    by = np.lexsort((where, who, group))
    text, offset, group, who, where = text[by], offset[by], group[by], who[by], where[by]
    lead = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
    later = (who != who[head]) | (where != where[head])
    return text[later], offset[later]


# ------------------------------------------------------------------ the Spark jobs

def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
            F.xxhash64(text).alias("tag"), text.alias("text")]


def frequent_anchors(docs: DataFrame, min_length: int, sample: int, share: float) -> np.ndarray:
    """Anchor hashes with different contexts in at least ``share`` of about ``sample``
    documents (taken by a hash): at most contexts in the sample / (share * sample)."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.int64)
    part = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
    found = (context_rows(part, min_length, np.zeros(0, np.int64)).where("strings > 0")
             .groupBy("mh", "ctx").agg(F.lit(1).alias("one")).groupBy("mh").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= max(FREQUENT_LEAST, share * min(n, sample))))
    return np.sort(np.array([r["mh"] for r in found.select("mh").collect()], np.int64))


def context_rows(docs: DataFrame, min_length: int, frequent: np.ndarray) -> DataFrame:
    """Contexts of ``docs(id, tag, text)``: rows with strings > 0 are the first of
    their kind in a run of texts (of ``frequent`` anchors: single strings); spans of
    the others follow with strings = -length."""
    def collapsed(cols, seen):
        """First rows of each kind, and the spans of the others."""
        order = np.lexsort((cols[3], cols[4], cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        again = copies(cols)
        cols = [c[~again] for c in cols]
        lead, keep = first_rows(cols)
        after, same = seen.later(cols)
        gone = [c[(~keep | after) & ~same] for c in cols]
        if not keep.all():
            repeats = np.add.reduceat(~keep, np.flatnonzero(lead)) > 0
            new = np.flatnonzero(lead)[repeats & ~(after | same)[lead]]
            seen.add([c[new] for c in cols])
        hand_on = keep & ~after & ~same
        return [c[hand_on] for c in cols], (gone[2], gone[3], gone[4], gone[4] + gone[5] + min_length - 1)

    def run(batches):
        seen, seen_strings = Seen(), Seen()
        digest = xxhash.xxh3_64_intdigest
        for batch, texts in text_slices(batches, 2, PIECE_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for first, offset, part in _pieces(texts, min_length):
                joined = b"".join(part)
                ends = np.cumsum([len(t) for t in part])
                begins = np.concatenate([[0], ends[:-1]])
                doc, at, strings, mh = contexts(np.frombuffer(joined, np.uint8), ends, min_length)
                ctx = np.array([digest(joined[a:b]) for a, b in zip(at.tolist(), (at + strings + min_length - 1).tolist(),
                                                                    strict=True)], np.uint64).view(np.int64)
                cols, gone = collapsed([mh, ctx, ids[first + doc], tags[first + doc], at - begins[doc] + offset, strings, at], seen)
                many = np.isin(cols[0], frequent)
                if many.any():
                    few, more = [c[~many] for c in cols], [c[many] for c in cols]
                    row = np.repeat(np.arange(len(more[0])), more[5])
                    step = np.arange(len(row)) - np.repeat(np.cumsum(more[5]) - more[5], more[5])
                    begin = (more[6][row] + step).tolist()
                    single = [np.array([f(joined[b:b + min_length]) for b in begin], np.uint64).view(np.int64)
                              for f in (xxhash.xxh64_intdigest, digest)]
                    single, repeats = collapsed([*single, more[2][row], more[3][row], more[4][row] + step,
                                                 np.ones(len(row), np.int64), more[6][row] + step], seen_strings)
                    cols = [np.concatenate(c) for c in zip(few, single, strict=True)]
                    gone = tuple(np.concatenate(c) for c in zip(gone, repeats, strict=True))
                s_id, s_tag, s_lo, s_hi = merged(*gone)
                zero = np.zeros(len(s_id), np.int64)
                # A span's row is dealt by its document's hash, away from any one task.
                out = [np.concatenate([c, s]) for c, s in zip(
                    cols[:6], [s_id * 31 + s_lo, zero, s_id, s_tag, s_lo, s_lo - s_hi], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(t)) for c, t in zip(out, "i8 i8 i8 i8 i8 i4".split(), strict=True)],
                    names=["mh", "ctx", "id", "tag", "start", "strings"])

    return docs.mapInArrow(run, ROW)


def resolve(rows: DataFrame, min_length: int) -> DataFrame:
    """Rows dealt by anchor: spans (``stop`` set) of all but the first of equal
    contexts, and the first ones of anchors that have several (``strings`` set)."""
    def run(batches):
        kept = None     # the last context's first row, and whether its anchor has another
        last = None     # the last row
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            span = cols[5] < 0
            spans = [c[span] for c in cols]
            cols = [c[~span] for c in cols]
            again = copies(cols, last)
            if len(again):
                last = [c[-1] for c in cols[:5]]
            cols = [c[~again] for c in cols]
            held = 0
            if kept is not None:
                cols, held = [np.concatenate([[k], c]) for k, c in zip(kept[0], cols, strict=True)], 1
            if not len(cols[0]):
                yield _resolved(spans[2], spans[3], spans[4], spans[4] - spans[5], cols, min_length)
                continue
            lead, keep = first_rows(cols)
            gone = [c[~keep] for c in cols]
            at = np.flatnonzero(lead)
            mh = cols[0][at]
            paired = np.zeros(len(at), bool)
            paired[1:] |= mh[1:] == mh[:-1]
            paired[:-1] |= mh[1:] == mh[:-1]
            if held:
                paired[0] |= kept[1]
            # Rows equal to the first one in (id, start) belong to it: same id, other text.
            group = np.cumsum(lead) - 1
            ask = keep & paired[group]
            if held and kept[1]:
                ask[0] = False          # asked for already
            kept = ([c[at[-1]] for c in cols], bool(paired[-1]))
            yield _resolved(np.concatenate([gone[2], spans[2]]), np.concatenate([gone[3], spans[3]]),
                            np.concatenate([gone[4], spans[4]]),
                            np.concatenate([gone[4] + gone[5] + min_length - 1, spans[4] - spans[5]]),
                            [c[ask] for c in cols], min_length)

    order = ["mh", "ctx", "id", "start", "tag"]
    dealt = rows.repartition("mh").sortWithinPartitions(*order).select(*ROW_NAMES)
    return dealt.mapInArrow(run, SPAN + ", mh long, strings int")


ROW_NAMES = ["mh", "ctx", "id", "tag", "start", "strings"]


def _resolved(ids, tags, start, stop, asked, min_length):
    ids, tags, start, stop = merged(ids, tags, start, stop)
    n, k = len(ids), len(asked[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ids, asked[2]]).astype(np.int64)), pa.array(np.concatenate([tags, asked[3]]).astype(np.int64)),
         pa.array(np.concatenate([start, asked[4]]).astype(np.int64)),
         pa.array(np.concatenate([stop, asked[4] + asked[5] + min_length - 1]).astype(np.int64)),
         pa.array(np.concatenate([np.zeros(n, np.int64), asked[0]]).astype(np.int64)),
         pa.array(np.concatenate([np.zeros(n, np.int32), asked[5]]).astype(np.int32))],
        names=["id", "tag", "start", "stop", "mh", "strings"])


def asked_texts(docs: DataFrame, asked: DataFrame, max_contexts: int, min_length: int) -> tuple[DataFrame, DataFrame]:
    """Text of the contexts in ``asked``: whole ones, and the single strings of
    anchors that have more than ``max_contexts``."""
    full = asked.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_contexts).select(
        F.col("mh").alias("f_mh"))
    marked = asked.join(full, F.col("mh") == F.col("f_mh"), "left").select(
        "id", "tag", F.struct("start", "stop", "mh", F.col("f_mh").isNotNull().alias("full")).alias("c"))
    per_doc = marked.groupBy("id", "tag").agg(F.collect_list("c").alias("cs"))
    # One row of a repeated one: dealt out as the join needs it, so texts are shuffled once.
    joined = docs.dropDuplicates(["id", "tag"]).join(per_doc, ["id", "tag"])

    def run(batches):
        for batch, texts in text_slices(batches, 2):
            out = [[], [], [], [], [], []]
            for i, t, text, cs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts,
                                      batch.column(3).to_pylist(), strict=True):
                for c in cs:
                    if c["full"]:
                        for s in range(c["start"], c["stop"] - min_length + 1):
                            string = text[s:s + min_length]
                            row = (xxhash.xxh64_intdigest(string, 7) - (1 << 63), i, t, s,
                                   xxhash.xxh3_64_intdigest(string) - (1 << 63), None)
                            for o, v in zip(out, row, strict=True):
                                o.append(v)
                    else:
                        for o, v in zip(out, (c["mh"], i, t, c["start"], 0, text[c["start"]:c["stop"]]), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())],
                names=["mh", "id", "tag", "start", "ctx", "context"])

    found = stored(joined.select("id", "tag", "text", "cs").mapInArrow(
        run, "mh long, id long, tag long, start long, ctx long, context binary"), "contexts")
    strings = found.where("context is null").select("mh", "ctx", "id", "tag", "start", F.lit(1).alias("strings"))
    return found.where("context is not null").drop("ctx"), strings


def compared(found: DataFrame, min_length: int) -> DataFrame:
    """Spans of repeated strings among different contexts of the same anchors."""
    def run(batches):
        pending, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH_BYTES and row[0] != pending[-1][0]:
                    yield spans(pending)
                    pending, size = [], 0
                pending.append(row)
                size += len(row[4])
        if pending:
            yield spans(pending)

    def spans(rows):
        ids, tags = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        starts = np.array([r[3] for r in rows], np.int64)
        text, offset = repeated_strings([r[4] for r in rows], ids, starts, min_length)
        at = starts[text] + offset
        out = merged(ids[text], tags[text], at, at + min_length)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(out, "i8 i8 i8 i8".split(), strict=True)],
                                          names=["id", "tag", "start", "stop"])

    dealt = found.repartition("mh").sortWithinPartitions("mh").select("mh", "id", "tag", "start", "context")
    return dealt.mapInArrow(run, SPAN)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 100,
                   max_contexts: int = 8_000, sample: int = 20_000, share: float = 0.02) -> DataFrame:
    """``(id, tag, spans)``: the bytes to remove from each document that has any, as
    sorted disjoint runs."""
    if min_length < SEED_BYTES:
        raise ValueError(f"min_length must be at least {SEED_BYTES}")
    own = docs.select(*_keys(id_col, text_col))
    frequent = frequent_anchors(own, min_length, sample, share)
    first = stored(resolve(context_rows(own, min_length, frequent), min_length), "spans")
    found, strings = asked_texts(own, first.where("strings > 0").select("id", "tag", "start", "stop", "mh"),
                                 max_contexts, min_length)
    spans = (first.where("strings = 0").select("id", "tag", "start", "stop")
             .unionByName(compared(found, min_length))
             .unionByName(resolve(strings, min_length).select("id", "tag", "start", "stop")))
    return spans.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 100,
                   max_contexts: int = 8_000, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row: ``carry``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    kept_text (bytes that no longer form a whole character are left out)."""
    spans = repeated_spans(docs, id_col, text_col, min_length, max_contexts)
    lead = docs.select(F.col(id_col), *carry, *(c.alias(f"__{n}") for c, n in zip(
        _keys(id_col, text_col), ("id", "tag", "text"), strict=True)))
    spans = spans.select(F.col("id").alias("__s_id"), F.col("tag").alias("__s_tag"), F.col("spans").alias("__spans"))
    joined = lead.join(spans, (F.col("__id") == F.col("__s_id")) & (F.col("__tag") == F.col("__s_tag")), "left")
    fields = lead.schema.fields[:-3]
    at = len(fields)

    def run(batches):
        for batch, texts in text_slices(batches, at):
            cols = [[], [], [], [], []]
            for text, spans in zip(texts, batch.column(at + 1).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in spans or ():
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                cuts = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                row = (len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(),
                       kept.decode(errors="ignore"))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(at)), *arrays[:4 + with_text]],
                                             names=[*(f.name for f in fields), *RESULT[:4 + with_text]])

    kinds = ["long", "long", "long", "string", "string"]
    schema = with_fields(fields, ", ".join(f"{n} {k}" for n, k in list(zip(RESULT, kinds, strict=True))[:4 + with_text]))
    return joined.select(*(F.col(f.name) for f in fields), "__text", "__spans").mapInArrow(run, schema)


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
