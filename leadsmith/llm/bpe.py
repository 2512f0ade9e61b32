"""Byte-level BPE encoding and decoding with a rank file.

Pre-tokenising is done on overlapping chunks: a scan that starts anywhere is
right from the first position on at which it agrees with the scan of the
chunk before, because a match depends only on what follows its start. So every
chunk is scanned for itself, neighbouring scans are stitched at the first
common boundary in their overlap, and the pieces between two stitches are
encoded for themselves. Where an overlap holds no common boundary (a piece
longer than the overlap), the scan of the left chunk goes on into the right
one until they meet.

Texts of one chunk are encoded where they are read. Longer texts are cut
into chunks that are dealt over all tasks, stitched per text, and dealt again
for the encoding. Decoding joins the raw bytes of the ids.

Defined results: a null text counts as empty; an empty text has no ids and the
digest of nothing; repeated rows get equal results; other columns of the input
are ignored (``carry`` keeps those named).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import text_slices, with_fields, worker_memory

#: A match that ends this close to a chunk's end may look different with more
#: text: a contraction needs two more characters, a run of spaces one.
LOOK_AHEAD = 4
#: Up to so many bytes, scanning the list of pairs is quicker than a heap.
SHORT_PIECE = 48
NO_RANK = 1 << 40
#: Pieces kept in a worker's memory with their ids.
CACHE_PIECES = 200_000
#: Texts above this many pieces' bytes are never kept.
CACHE_PIECE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair with the lowest rank is merged first,
    the leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT_PIECE:
        get, parts = ranks.get, [piece[i:i + 1] for i in range(n)]
        pairs = [get(piece[i:i + 2], NO_RANK) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < NO_RANK:
            i = pairs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        return [ranks[p] for p in parts]
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i:end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (k := prv[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = nxt[i]
    return ids


class Codec:
    """Piece encoder and id decoder of one rank file, with a bounded cache."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def piece_ids(self, piece: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.cache.get(piece)
        if known is None:
            raw = piece.encode()
            ids = merge_piece(raw, self.ranks)
            known = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) <= CACHE_PIECE_BYTES and len(self.cache) < CACHE_PIECES:
                self.cache[piece] = known
        return known

    def encode_pieces(self, pieces: Iterable[str]) -> bytes:
        cache, slow = self.cache, self.piece_ids
        return b"".join([cache.get(p) or slow(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.find.findall(text))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; its cache of pieces outlives the task."""
    kept = worker_memory().setdefault("codecs", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = Codec(path, pattern)
    return kept[path, pattern]


def chunk_bounds(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, stop)`` of the overlapping chunks of a text of n characters."""
    return [(s, min(n, s + chunk + overlap)) for s in range(0, max(n, 1), chunk)]


def piece_starts(find, text: str, offset: int, last: bool) -> list[int]:
    """Boundaries of a chunk's scan, as positions in the text; only those that
    no text after the chunk can change."""
    spans = [m.span() for m in find.finditer(text)]
    if not last:
        while spans and spans[-1][1] > len(text) - LOOK_AHEAD:
            spans.pop()
    starts = [offset + a for a, _ in spans]
    if spans:
        starts.append(offset + spans[-1][1])
    return starts


def stitch(find, text: str, scans: list[list[int]]) -> list[list[int]]:
    """For each chunk the true boundaries from its stitch to the next one, both
    included. ``scans`` are the chunks' boundaries in order."""
    out, at = [], 0
    for k, mine in enumerate(scans):
        true = [p for p in mine if p >= at] if at in set(mine) or not k else [at]
        if not true:
            true = [at]
        if k + 1 == len(scans):
            out.append(_scan_on(find, text, true, None))
            break
        right = set(scans[k + 1])
        meet = next((i for i, p in enumerate(true) if p in right), None)
        if meet is None:
            true = _scan_on(find, text, true, right)
            meet = len(true) - 1
        out.append(true[:meet + 1])
        at = out[-1][-1]
    return out


def _scan_on(find, text: str, starts: list[int], until: set[int] | None) -> list[int]:
    """Go on scanning from the last true boundary until a boundary in ``until``."""
    starts = list(starts)
    for m in find.finditer(text, starts[-1]):
        if m.end() > starts[-1]:
            starts.append(m.end())
        if until is not None and starts[-1] in until:
            break
    return starts


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     chunk_chars: int = 32_768, overlap_chars: int = 1_024, with_ids: bool = False,
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``carry``, n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, the ids themselves (little-endian unsigned 32-bit integers)."""
    lead = docs.select(F.col(id_col), *carry, F.col(text_col).alias("__text"))
    names = lead.columns[:-1]
    result = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] \
        + [("ids", "binary")] * with_ids
    schema = with_fields(lead.schema.fields[:-1], ", ".join(f"{n} {t}" for n, t in result))
    long_text = F.coalesce(F.length("__text") > chunk_chars + overlap_chars, F.lit(False))

    def digests(ids_list):
        own = codec(path, pattern)
        cols = [pa.array([len(i) // 4 for i in ids_list], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids_list], pa.string()),
                pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids_list], pa.string())]
        return cols + [pa.array(ids_list, pa.binary())] * with_ids

    def encode_short(batches):
        own, at = codec(path, pattern), len(names)
        for batch, texts in text_slices(batches, at):
            ids = [own.encode(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(at)), *digests(ids)],
                                             names=[*names, *(n for n, _ in result)])

    short = lead.where(~long_text).mapInArrow(encode_short, schema)

    # Long texts: equal rows are encoded once and multiplied at the end.
    long_rows = (lead.where(long_text).groupBy(*lead.columns).agg(F.count(F.lit(1)).alias("__n"))
                 .withColumn("__key", F.xxhash64(*lead.columns)))

    def cut(batches):
        for batch, texts in text_slices(batches, 1):
            keys = batch.column(0).to_pylist()
            for key, raw in zip(keys, texts, strict=True):
                text = raw.decode()
                bounds = chunk_bounds(len(text), chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(bounds), pa.int64()), pa.array(range(len(bounds)), pa.int32()),
                     pa.array([a for a, _ in bounds], pa.int64()), pa.array([b == len(text) for _, b in bounds]),
                     pa.array([text[a:b] for a, b in bounds], pa.string())],
                    names=["key", "k", "start", "last", "chunk"])

    def pretokenise(batches):
        find = codec(path, pattern).find
        for batch, texts in text_slices(batches, 4):
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts, strict=True)
            starts = [piece_starts(find, t.decode(), s, last) for s, last, t in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.list_(pa.int64()))],
                                             names=["key", "k", "start", "last", "chunk", "starts"])

    def stitch_text(rows):
        rows = rows.sort_by("k").to_pylist()
        text = "".join(r["chunk"][:chunk_chars] if not r["last"] or k + 1 < len(rows) else r["chunk"]
                       for k, r in enumerate(rows))
        runs = stitch(codec(path, pattern).find, text, [r["starts"] for r in rows])
        runs = [r for r in runs if len(r) > 1]
        return pa.table({"key": pa.array([rows[0]["key"]] * len(runs), pa.int64()),
                         "k": pa.array(range(len(runs)), pa.int32()),
                         "pieces": pa.array([[text[a:b] for a, b in zip(r, r[1:], strict=False)] for r in runs],
                                            pa.list_(pa.string()))})

    def encode_run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), one.column(1),
                     pa.array([own.encode_pieces(one.column(2)[0].as_py())], pa.binary())],
                    names=["key", "k", "ids"])

    def join_ids(rows):
        rows = rows.sort_by("k")
        return pa.Table.from_arrays(
            [rows.column("key").slice(0, 1), *digests([b"".join(rows.column("ids").to_pylist())])],
            names=["__key", *(n for n, _ in result)])

    encoded = (long_rows.select("__key", "__text").mapInArrow(cut, "key long, k int, start long, last boolean, chunk string")
               .repartition("key", "k")
               .mapInArrow(pretokenise, "key long, k int, start long, last boolean, chunk string, starts array<long>")
               .groupBy("key").applyInArrow(stitch_text, "key long, k int, pieces array<string>")
               .repartition("key", "k").mapInArrow(encode_run, "key long, k int, ids binary")
               .groupBy("key").applyInArrow(join_ids, ", ".join(["__key long", *(f"{n} {t}" for n, t in result)])))
    long = (long_rows.drop("__text").join(encoded, "__key")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
            .select(*names, *(n for n, _ in result)))
    return short.unionByName(long)
