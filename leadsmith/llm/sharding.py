"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring. A row's key is hashed to
the ring and belongs to the first point clockwise. Each shard has a load bound;
keys that meet a full shard continue clockwise to the next point whose shard
has room. With ``capacity_factor`` 1 the bounds are the even quotas, so row
counts differ by one at most; a larger factor trades balance for less movement
when shards come or go.

The placement needs only the number of keys per ring cell (a fixed number of
cells), so the walk is done on that small table; the rows themselves are ranked
inside their cell and joined with the resulting segments. A cell with many rows (all
rows of one id share a cell) is ranked in parts, by a hash of size and text; each
part's ranks begin where the parts before it end.

Defined results: a null text has no bytes, a null id is a key of its own (all
null ids share a ring position), repeated rows are placed like separate rows,
an empty table gives an empty result, other columns of the input are ignored.
Equal texts form no unit here: a group of copies may hold a third of the rows,
so a bounded load has to split it. ``text_crc32`` identifies such a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one record of a repeated row expands to at a time.
COPIES_PER_CHUNK = 10_000
#: Rows of a cell that make another part of it.
ROWS_PER_PART = 10_000


def ring_points(shards: Sequence[int], vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ring positions and the shard that owns each."""
    points = [(xxhash.xxh64_intdigest(f"shard {s} point {v}".encode(), seed=42), s)
              for s in shards for v in range(vnodes)]
    points.sort()
    return (np.array([p for p, _ in points], dtype=np.uint64),
            np.array([s for _, s in points], dtype=np.int64))


def shard_bounds(n_rows: int, shards: Sequence[int], capacity_factor: float) -> dict[int, int]:
    if capacity_factor < 1:
        raise ValueError("capacity_factor must be 1 or more")
    if capacity_factor == 1:
        each, more = divmod(n_rows, len(shards))
        return {s: each + (i < more) for i, s in enumerate(sorted(shards))}
    bound = int(np.ceil(capacity_factor * n_rows / len(shards)))
    return dict.fromkeys(shards, bound)


def walk(cell_counts: dict[int, int], owners: np.ndarray, cells_per_arc: int,
         bounds: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(cell, lo, hi, shard, slot_base)``: the keys ranked lo..hi-1 in
    a cell go to ``shard``. In each round every waiting run of keys is offered to
    the point it has reached; what the shard has no room for moves one point on."""
    room, used = dict(bounds), dict.fromkeys(bounds, 0)
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    for cell in sorted(cell_counts):
        waiting.setdefault(cell // cells_per_arc, []).append((cell, 0, cell_counts[cell]))
    segments = []
    while waiting:
        moved: dict[int, list[tuple[int, int, int]]] = {}
        for arc in sorted(waiting):
            shard = int(owners[arc])
            for cell, lo, hi in waiting[arc]:
                take = min(room[shard], hi - lo)
                if take:
                    segments.append((cell, lo, lo + take, shard, used[shard]))
                    room[shard] -= take
                    used[shard] += take
                if lo + take < hi:
                    moved.setdefault((arc + 1) % len(owners), []).append((cell, lo + take, hi))
        waiting = moved
    return segments


def shard_rows(df: DataFrame, shards: int | Sequence[int] = 16, id_col: str = "doc_id",
               text_col: str = "text", vnodes: int = 128, cells_per_arc: int = 8,
               capacity_factor: float = 1.0) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row of ``df``."""
    spark = df.sparkSession
    names = list(range(shards)) if isinstance(shards, int) else list(shards)
    points, owners = ring_points(names, vnodes)

    @F.pandas_udf(T.IntegerType())
    def ring_cell(h: pd.Series) -> pd.Series:
        keys = h.to_numpy().view(np.uint64)
        arc = np.searchsorted(points, keys, side="left") % len(points)
        sub = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        return pd.Series((arc * cells_per_arc + (sub % np.uint64(cells_per_arc)).astype(np.int64)).astype(np.int32))

    text = F.col(text_col)
    cell = ring_cell(F.xxhash64(F.col(id_col)))
    # Reads the id column only; at most shards * vnodes * cells_per_arc groups.
    counts = {r["cell"]: r["n"] for r in
              df.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = walk(counts, owners, cells_per_arc,
                    shard_bounds(sum(counts.values()), names, capacity_factor))
    parts = np.ones(len(points) * cells_per_arc, np.int64)
    for c, n in counts.items():
        parts[c] = -(-n // ROWS_PER_PART)

    @F.pandas_udf(T.IntegerType())
    def part_of_cell(cells: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series((h.to_numpy().view(np.uint64) % parts[cells.to_numpy()].astype(np.uint64)).astype(np.int32))

    plan = spark.createDataFrame(segments, "p_cell int, p_lo long, p_hi long, shard int, base long")

    rows = (df.select(F.col(id_col).alias("id"),
                      (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
                      F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"))
            .groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("cell", ring_cell(F.xxhash64("id"))))
    whole = not (parts > 1).any()
    rows = rows.withColumn("part", F.lit(0) if whole else part_of_cell("cell", F.xxhash64("size", "crc")))
    in_part = (Window.partitionBy("cell", "part").orderBy("id", "size", "crc")
               .rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("lo", F.sum("n").over(in_part) - F.col("n"))
    if not whole:
        # One row per part: at most the rows of the table / ROWS_PER_PART, and one per cell.
        before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        begins = (rows.groupBy("cell", "part").agg(F.sum("n").alias("m"))
                  .select("cell", "part", (F.sum("m").over(before) - F.col("m")).alias("begin")))
        ranked = ranked.join(begins, ["cell", "part"]).withColumn("lo", F.col("lo") + F.col("begin"))
    chunks = (ranked.select("id", "size", "crc", "cell", "lo", "n",
                            F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1,
                                                 F.lit(COPIES_PER_CHUNK).cast("long"))).alias("at"))
              .repartition("id", "size", "crc", "at"))
    each = chunks.select(
        "id", "size", "crc", "cell",
        F.explode(F.sequence(F.col("lo") + F.col("at"),
                             F.col("lo") + F.least(F.col("at") + COPIES_PER_CHUNK, F.col("n")) - 1)).alias("rank"))
    # The plan has a fixed bound: one segment per cell plus one per full shard met.
    placed = each.join(F.broadcast(plan), (F.col("cell") == F.col("p_cell"))
                       & (F.col("rank") >= F.col("p_lo")) & (F.col("rank") < F.col("p_hi")))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                         (F.col("base") + F.col("rank") - F.col("p_lo")).alias("slot"))
