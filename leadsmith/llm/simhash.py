"""Near-duplicates by SimHash and the generalised pigeonhole principle.

A fingerprint has a bit set where more than half of the shingle hashes have
it. To find all pairs of distinct fingerprints that differ in at most
``max_distance`` bits, correlated bits are grouped into m partitions. If each
partition i gets a threshold t_i (-1: not searched) and the thresholds sum to
max_distance - m + 1, every such pair agrees within t_i bits in some partition.
Each fingerprint gets its own thresholds: a dynamic programme spreads the sum
so that probes plus estimated candidates (from the counts of partition values)
are fewest, which keeps common values out of the search. Candidates are then
compared in full.

Equal fingerprints are one from the start. Full buckets are cut into blocks
that are compared block against block in different tasks; a task hands on a
spanning forest of the links it has verified, never all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like
any others; a text of fewer words than a shingle is one shingle; repeated rows
share a fingerprint; an empty table gives an empty result; null ids count as
the largest id; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import row_key, stored, text_slices, with_fields
from leadsmith.llm.graph import connected_components, star_forest

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SEED = 42
#: Largest threshold of one partition; the number of probes grows with its power.
MAX_THRESHOLD = 2
#: Bits of one table of value counts.
TABLE_BITS = 16
#: Cost of a probe (a shuffled row) in comparisons of two fingerprints.
PROBE_COST = 20.0
#: Rows of a bucket's block, and comparisons done at a time.
BLOCK_ROWS = 4_096
CHUNK_PAIRS = 1 << 19
#: Expected candidates a bucket may hold by chance before partitions get wider.
CHANCE_ROWS = 64


def simhash(text: bytes, shingle_words: int = 3) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        part = hashes[lo:lo + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(id, key, fp)``: a key of (id, text), and the fingerprint as a signed number."""
    lead = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches):
        for batch, texts in text_slices(batches, 2):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([simhash(t, shingle_words) for t in texts], pa.int64())],
                names=["id", "key", "fp"])

    return lead.mapInArrow(run, with_fields(lead.schema.fields[:2], "fp long"))


# ------------------------------------------------------------------ partitions and thresholds

def bit_pairs(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, over all of them."""
    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for lo in range(0, len(v), 16384):
                bits = np.unpackbits(v[lo:lo + 16384].view(np.uint8).reshape(-1, 8), axis=1,
                                     bitorder="little").astype(np.float32)
                total += bits.T @ bits
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array((i * 64 + j).astype(np.int32)),
                                          pa.array(total[i, j].astype(np.int64))], names=["ij", "n"])

    out = np.zeros((64, 64))
    for r in fps.select("fp").mapInArrow(run, "ij int, n long").groupBy("ij").agg(F.sum("n").alias("n")).collect():
        out[r["ij"] // 64, r["ij"] % 64] = out[r["ij"] % 64, r["ij"] // 64] = r["n"]
    return out


def group_bits(pairs: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in m partitions of nearly equal width: a partition starts with the bit
    most correlated with the free ones and takes the bit most correlated with it."""
    p = pairs.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(pairs / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, parts = list(range(64)), []
    for k in range(m):
        width = len(free) // (m - k)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        while len(part) < width:
            rest = [b for b in free if b not in part]
            part.append(max(rest, key=lambda b: (corr[b, part].sum(), -b)))
        free = [b for b in free if b not in part]
        parts.append(sorted(part))
    return parts


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    v = fps.view(np.uint64)
    out = np.zeros(len(v), np.int64)
    for j, b in enumerate(bits):
        out |= (((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)).astype(np.int64)
    return out


@dataclass
class Plan:
    """Partitions, and for each of their pieces of at most TABLE_BITS bits the share
    of fingerprints at distance 0, 1, .. from each value."""
    parts: list[list[int]]
    pieces: list[list[tuple[list[int], list[np.ndarray]]]]
    rows: int
    total: int   # what the thresholds sum to

    def candidates(self, fps: np.ndarray, part: int) -> list[np.ndarray]:
        """Estimated rows within 0, 1, .. MAX_THRESHOLD bits in a partition."""
        exact = [np.ones(len(fps))] + [np.zeros(len(fps))] * MAX_THRESHOLD
        for bits, shares in self.pieces[part]:
            v = part_values(fps, bits)
            at = [s[v] for s in shares]
            exact = [sum(exact[a] * at[r - a] for a in range(r + 1)) for r in range(MAX_THRESHOLD + 1)]
        return list(np.cumsum(exact, axis=0) * self.rows)

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of every fingerprint (rows) for the partitions."""
        n, m = len(fps), len(self.parts)
        lowest, highest = -m, m * MAX_THRESHOLD
        best = {0: (np.zeros(n), np.zeros((n, 0), np.int8))}
        for part in range(m):
            width, cands = len(self.parts[part]), self.candidates(fps, part)
            cost = {-1: np.zeros(n)} | {t: PROBE_COST * sum(math.comb(width, r) for r in range(t + 1)) + cands[t]
                                        for t in range(MAX_THRESHOLD + 1)}
            new: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for s, (c, chosen) in best.items():
                for t, extra in cost.items():
                    rest = m - part - 1
                    if not s + t - rest <= self.total <= s + t + rest * MAX_THRESHOLD or not lowest <= s + t <= highest:
                        continue
                    with_t = np.concatenate([chosen, np.full((n, 1), t, np.int8)], axis=1)
                    if s + t not in new:
                        new[s + t] = (c + extra, with_t)
                    else:
                        old, had = new[s + t]
                        less = c + extra < old
                        new[s + t] = (np.where(less, c + extra, old), np.where(less[:, None], with_t, had))
            best = new
        return best[self.total][1]


def make_plan(fps: DataFrame, max_distance: int) -> Plan:
    n = fps.count()
    m = max_distance + 1
    while m > max(1, -(-max_distance // (MAX_THRESHOLD + 1)), 2) and n / 2 ** (64 // m) > CHANCE_ROWS:
        m -= 1
    parts = group_bits(bit_pairs(fps), n, m)
    pieces = [[p[i:i + TABLE_BITS] for i in range(0, len(p), TABLE_BITS)] for p in parts]
    flat = [b for p in pieces for b in p]

    def run(batches):
        counts = np.zeros((len(flat), 1 << TABLE_BITS), np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for k, bits in enumerate(flat):
                counts[k] += np.bincount(part_values(v, bits), minlength=1 << TABLE_BITS)
        k, value = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(value.astype(np.int32)),
                                          pa.array(counts[k, value])], names=["k", "value", "n"])

    # At most len(flat) tables of 2^16 values, whatever the number of documents.
    found = (fps.select("fp").mapInArrow(run, "k int, value int, n long")
             .groupBy("k", "value").agg(F.sum("n").alias("n")).toPandas())
    tables = []
    for k, bits in enumerate(flat):
        mine = found[found["k"] == k]
        at = np.zeros(1 << len(bits))
        at[mine["value"].to_numpy()] = mine["n"].to_numpy() / max(n, 1)
        tables.append((bits, _by_distance(at, len(bits))))
    at, out = 0, []
    for p in pieces:
        out.append(tables[at:at + len(p)])
        at += len(p)
    return Plan(parts, out, n, max_distance - m + 1)


def _by_distance(share: np.ndarray, width: int) -> list[np.ndarray]:
    """For every value the share of rows at distance 0 .. MAX_THRESHOLD from it: bit
    by bit, ``out[r]`` turns into the share at distance r in the bits seen so far."""
    values = np.arange(len(share))
    out = [share] + [np.zeros_like(share) for _ in range(MAX_THRESHOLD)]
    for b in range(width):
        flip = values ^ (1 << b)
        out = [out[r] + (out[r - 1][flip] if r else 0) for r in range(MAX_THRESHOLD + 1)]
    return out


# ------------------------------------------------------------------ probe and verify

def _flips(width: int, radius: int) -> np.ndarray:
    masks = [0]
    if radius >= 1:
        masks += [1 << a for a in range(width)]
    if radius >= 2:
        masks += [1 << a | 1 << b for a in range(width) for b in range(a)]
    return np.array(masks, np.int64)


def probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """``(part, value, fp, probe)``: each fingerprint once in every partition, and
    its probes with every value within its threshold there."""
    def run(batches):
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for lo in range(0, len(v), 8192):
                own = v[lo:lo + 8192]
                chosen = plan.thresholds(own)
                for part, bits in enumerate(plan.parts):
                    value = part_values(own, bits)
                    cols = [(value, own, np.zeros(len(own), bool))]
                    for t in range(MAX_THRESHOLD + 1):
                        pick = chosen[:, part] == t
                        masks = _flips(len(bits), t)
                        near = (value[pick][:, None] ^ masks).ravel()
                        cols.append((near, np.repeat(own[pick], len(masks)), np.ones(len(near), bool)))
                    values, who, probe = (np.concatenate(c) for c in zip(*cols, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), part, np.int32)), pa.array(values), pa.array(who), pa.array(probe)],
                        names=["part", "value", "fp", "probe"])

    return fps.select("fp").mapInArrow(run, "part int, value long, fp long, probe boolean")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def compare_bucket(data: np.ndarray, asks: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large bucket: a probe is linked to one member of each
    component of those it matches."""
    label = np.arange(len(data))
    a, b = [], []
    for q in asks:
        near = np.flatnonzero(distance(data, q) <= max_distance)
        if len(near):
            labels, first = np.unique(label[near], return_index=True)
            a.extend([q] * len(first))
            b.extend(data[near[first]])
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
    return np.array(a, np.int64), np.array(b, np.int64)


def links(rows: DataFrame, max_distance: int) -> DataFrame:
    """Verified links ``(a, b)`` that connect whatever the probes connect."""
    size = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK_ROWS)
    size = size.select(F.col("part").alias("s_part"), F.col("value").alias("s_value"),
                       F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks"))
    cut = rows.join(size, (F.col("part") == F.col("s_part")) & (F.col("value") == F.col("s_value")), "left")
    n = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), n.cast("long")).cast("int")
    # Block i of the members meets block j of the probes in cell i * blocks + j.
    dealt = cut.select("part", "value", "fp", "probe", F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), n - 1), lambda k: F.when(F.col("probe"), k * n + mine).otherwise(mine * n + k)))).alias("cell"))

    def run(batches):
        kept = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            part, value, cell = now[0], now[1], now[4]
            new = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (cell[1:] != cell[:-1])) + 1
            stop = int(new[-1]) if len(new) else 0
            if stop >= 1 << 14:
                yield verified([x[:stop] for x in now], np.concatenate([[0], new[:-1]]))
                kept = [x[stop:] for x in now]
            else:
                kept = now
        if kept is not None and len(kept[0]):
            part, value, cell = kept[0], kept[1], kept[4]
            new = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (cell[1:] != cell[:-1])) + 1
            yield verified(kept, np.concatenate([[0], new]))

    def verified(cols, starts):
        """cols: sorted by bucket, its members before its probes."""
        fp, probe = cols[2].astype(np.int64), cols[3].astype(bool)
        stops = np.concatenate([starts[1:], [len(fp)]])
        asks = np.add.reduceat(probe.astype(np.int64), starts)
        data = stops - starts - asks
        out = []
        for k in np.flatnonzero(data * asks > 4096):
            s, e, d = starts[k], stops[k], data[k]
            out.append(compare_bucket(fp[s:s + d], fp[s + d:e], max_distance))
        small = np.flatnonzero((data * asks <= 4096) & (asks > 0) & (data > 0))
        work = np.cumsum(data[small] * asks[small])
        for lo in range(0, int(work[-1]) + 1 if len(work) else 0, CHUNK_PAIRS):
            pick = small[np.searchsorted(work, lo, side="right" if lo else "left"):
                         np.searchsorted(work, lo + CHUNK_PAIRS, side="right")]
            pairs = data[pick] * asks[pick]
            which = np.repeat(np.arange(len(pick)), pairs)
            at = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x = fp[starts[pick][which] + at % data[pick][which]]
            y = fp[starts[pick][which] + data[pick][which] + at // data[pick][which]]
            ok = (distance(x, y) <= max_distance) & (x != y)
            out.append((x[ok], y[ok]))
        a = np.concatenate([x for x, _ in out] or [np.zeros(0, np.int64)])
        b = np.concatenate([y for _, y in out] or [np.zeros(0, np.int64)])
        a, b = star_forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = dealt.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell", "probe")
    return ordered.select("part", "value", "fp", "probe", "cell").mapInArrow(run, "a long, b long")


def components(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """``(fp, root)`` for distinct fingerprints that have a link."""
    plan = make_plan(fps, max_distance)
    return connected_components(links(stored(probes(fps, plan), "probes"), max_distance))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    max_distance: int = 3) -> DataFrame:
    """``(id, key, fp, component_id)`` for every row: a key of (id, text), the
    fingerprint, and the smallest id that links lead to."""
    own = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    # Nulls last, so that a component's id is null only if all its ids are.
    distinct = stored(own.groupBy("fp").agg(F.min("id").alias("first")), "simhash_distinct")
    roots = components(distinct, max_distance).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    per_fp = placed.select("fp", "root").join(first, "root").select("fp", "component_id")
    return own.join(per_fp, "fp").select(F.col("id").alias(id_col), "key", "fp", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
