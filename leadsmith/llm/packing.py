"""Packing of tokenised documents into sequences by bounded-space best fit.

Every document becomes its token ids and an end id; one longer than a sequence is
cut into pieces of full length, of which the first may be shorter. Pieces of full
length are sequences of their own. All others are dealt at random into groups of
about ``group_rows`` and packed there: a piece goes into the open bin with the least
free space that holds it. The open bins are found by a bitset keyed by free space.
There are at most ``open_bins`` of them; where one more is needed, the fullest
closes first.

The bins that are still open at a group's end are not closed half empty: their
pieces are dealt again, with those of other groups, into fewer groups, until one
group is left. A group hands on at most a quarter of its pieces (the fullest bins
close beyond that), so the rounds are few, and a task holds one group.

Ids are those of the ``tokenizers`` library for the vocabulary file; they are made by
``tiktoken`` from the same file, which encodes several times faster and agrees on
every code point (tested). Strings of special tokens in a text are ordinary text.

Defined results: null and empty texts are one end id; repeated rows are packed one
by one; an empty table gives an empty result; columns that are not named in
``carry`` are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import lead_columns, stored, text_slices, with_fields, worker_memory


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as
    themselves, the others, in order, as the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


def load_encoding(path: str, pattern: str):
    """A ``tiktoken`` encoding of the vocabulary of a ``tokenizers`` file."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    letters = byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str, pattern: str):
    """The worker's encoding, read once."""
    kept = worker_memory().setdefault("encodings", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = load_encoding(path, pattern)
    return kept[path, pattern]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of n ids."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", carry: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """``(id, carry.., piece, start, length, ids_crc32)`` and, if asked for, ``ids``
    (little-endian unsigned 32-bit integers) of every piece."""
    lead, kept, text_at = lead_columns(docs, id_col, text_col, carry)
    fields = lead.schema.fields[:kept]
    end = np.array([end_id], "<u4")

    def run(batches):
        own = encoding(path, pattern)
        for batch, texts in text_slices(batches, text_at):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(texts):
                raw = np.concatenate([own.encode_to_numpy(text.decode(), disallowed_special=()), end]).astype("<u4").tobytes()
                for k, (a, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * a:4 * (a + n)]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j).take(rows) for j in range(kept)), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc)), *([pa.array(ids, pa.binary())] * with_ids)],
                names=[*(f.name for f in fields), "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)])

    return lead.mapInArrow(run, with_fields(
        fields, "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids))


class BestFit:
    """Open bins, found by a bitset whose bit f tells that a bin has f free places."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.at, self.n_open, self.n_bins = 0, {}, 0, 0

    def take(self, free: int) -> int:
        bins = self.at[free]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n_open -= 1
        return b

    def put(self, b: int, free: int) -> None:
        self.at.setdefault(free, []).append(b)
        self.bits |= 1 << free
        self.n_open += 1

    def close_fullest(self) -> int:
        return self.take((self.bits & -self.bits).bit_length() - 1)

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self.take(free)
        else:
            if self.n_open == self.open_bins:
                self.close_fullest()
            free, b = self.capacity, self.n_bins
            self.n_bins += 1
        if free > length:
            self.put(b, free - length)
        return b, self.capacity - free


def pack_group(lengths: list[int], capacity: int, open_bins: int, last: bool) -> tuple[list[int], list[int], set[int]]:
    """Bins and offsets of the pieces in their order, and the bins whose pieces are
    dealt again: those still open, as far as they hold a quarter of the pieces."""
    fit = BestFit(capacity, open_bins)
    placed = [fit.add(n) for n in lengths]
    bins, offsets = [b for b, _ in placed], [o for _, o in placed]
    if last:
        return bins, offsets, set()
    held = np.bincount(np.array(bins, np.int64), minlength=fit.n_bins)
    left = sum(int(held[b]) for some in fit.at.values() for b in some)
    while left > len(lengths) // 4:
        left -= int(held[fit.close_fullest()])
    return bins, offsets, {b for some in fit.at.values() for b in some}


def pack(items: DataFrame, capacity: int = 2048, open_bins: int = 256, group_rows: int = 16_384) -> DataFrame:
    """``items`` (with ``length`` from 1 to the capacity) with ``sequence_id`` and ``offset``."""
    names = items.columns
    # A stored table: its rows keep their numbers, and nothing is tokenised twice.
    base = stored(items, "pieces").select("*", F.monotonically_increasing_id().alias("__n"))
    done = [base.where(F.col("length") == capacity)
            .select(*names, (-F.col("__n") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    waiting, turn = base.where(F.col("length") < capacity), 0
    n = waiting.count()
    while n:
        groups = -(-n // group_rows)
        out = stored(_pack_round(waiting, turn, groups, capacity, open_bins), "packed")
        done.append(out.where(F.col("sequence_id").isNotNull()).select(*names, "sequence_id", "offset"))
        if groups == 1:
            break
        waiting, turn = out.where(F.col("sequence_id").isNull()).select(*names, "__n"), turn + 1
        n = waiting.count()
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def _pack_round(waiting: DataFrame, turn: int, groups: int, capacity: int, open_bins: int) -> DataFrame:
    """One round. In a group the pieces come in the order of a hash of their numbers:
    a task that is run again packs them the same way."""
    dealt = (waiting.withColumn("__h", F.xxhash64(F.lit(turn), "__n"))
             .withColumn("__g", F.pmod("__h", F.lit(groups))))
    schema = with_fields(dealt.schema.fields, "sequence_id long, offset long")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("__h", "ascending"), ("__n", "ascending")])
        bins, offsets, open_still = pack_group(group.column("length").to_pylist(), capacity, open_bins, groups == 1)
        first = (turn << 56) + (group.column("__g")[0].as_py() << 24)
        sequence = [None if b in open_still else first + b for b in bins]
        return (group.append_column("sequence_id", pa.array(sequence, pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    return dealt.groupBy("__g").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_ids: bool = False,
                   open_bins: int = 256, group_rows: int = 16_384) -> DataFrame:
    """Per piece: ``id, carry.., piece, start, length, ids_crc32, [ids,] sequence_id, offset``."""
    if group_rows >= 1 << 24:
        raise ValueError("group_rows must stay below 2^24")
    # Own names, so that carried columns of the same names meet nothing.
    others = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    lead = docs.select(others.alias("__row"), F.col(text_col).alias("__text"))
    cut_up = pieces(lead, path, pattern, capacity, end_id, "__row", "__text", with_ids=with_ids)
    packed = pack(cut_up, capacity, open_bins, group_rows)
    return packed.select(F.col("__row.id").alias(id_col), *(F.col(f"__row.c{k}").alias(c) for k, c in enumerate(carry)),
                         *[c for c in packed.columns if c != "__row"])
