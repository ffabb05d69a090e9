"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of their text's 64-bit hash.  The smallest shard capacity
for which a greedy left-to-right filling needs at most ``n_shards`` shards is found by binary search; the shards
are then cut within that capacity.

The ordered sizes are never gathered whole.  The driver holds a histogram over prefixes of the hash ("cells") and
refines only the cells that a possible cut falls into, so it holds some thousand cells at any input size and the
result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize

#: Each refinement looks at so many more bits of the hash.
BITS = 10


class Cells:
    """Ordered cells: ``level`` (bits of the prefix), ``prefix``, bytes, units (different texts)."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        # the prefix's first hash gives the order, whatever the levels
        self.rows = sorted(rows, key=lambda r: r[1] << (64 - r[0]))
        self.ends = np.cumsum([r[2] for r in self.rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([r[2] for r in self.rows], dtype=np.int64)
        self.many = np.array([r[3] > 1 for r in self.rows], dtype=bool)
        self.total = int(self.ends[-1]) if rows else 0
        self.touched: set[int] = set()

    def at_most(self, x: int) -> int:
        """The last cell boundary at or before byte x."""
        i = int(np.searchsorted(self.ends, x, "right"))
        return int(self.ends[i - 1]) if i else 0

    def at_least(self, x: int) -> int:
        i = int(np.searchsorted(self.starts, x, "left"))
        return int(self.starts[i]) if i < len(self.starts) else self.total

    def loose(self, x: int) -> int:
        """As at_most, but cells of many units may be cut anywhere."""
        i = int(np.searchsorted(self.ends, x, "right"))
        return x if i < len(self.ends) and self.many[i] else self.at_most(x)

    def touch(self, low: int, high: int) -> None:
        """Remember the cells of many units that bytes low to high meet."""
        first, last = np.searchsorted(self.ends, low, "right"), np.searchsorted(self.starts, high, "left")
        self.touched.update(int(i) for i in range(first, min(last + 1, len(self.rows))) if self.many[i]
                            and self.starts[i] <= high and self.ends[i] > low)

    def greedy(self, capacity: int, n: int, step) -> list[int]:
        """Where each of n shards ends when filled in turn up to the capacity."""
        cuts, at = [], 0
        for _ in range(n):
            at = max(at, min(step(at + capacity), self.total))
            cuts.append(at)
        return cuts

    def smallest(self, n: int, step, least: int) -> int:
        """The smallest capacity, at least ``least``, that holds all in n shards."""
        low, high = least, max(least, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, n, step)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def cut_points(cells: Cells, n: int, largest: int) -> list[int]:
    """Ends of the n shards in bytes.  No shard exceeds the smallest feasible capacity; within it each cut is the
    boundary nearest to an even share of what is left.  Cells whose inside could matter are marked as touched."""
    least = max(-(-cells.total // n), largest)
    capacity, floor = cells.smallest(n, cells.at_most, least), cells.smallest(n, cells.loose, least)
    for low, high in zip(cells.greedy(floor, n, cells.at_most), cells.greedy(capacity, n, cells.loose), strict=True):
        cells.touch(low, high)
    backward, at = [cells.total], cells.total
    for _ in range(n):
        cells.touch(max(0, at - capacity), max(0, at - capacity))
        at = cells.at_least(max(0, at - capacity))
        backward.append(at)
    cuts, at = [], 0
    for k in range(n - 1, -1, -1):
        aim = at + (cells.total - at) // (k + 1)
        low, high = cells.at_most(aim), cells.at_least(aim)
        for x in (aim, at + capacity):
            cells.touch(x, x)
        near = low if low > at and aim - low <= high - aim else high  # a shard takes a group at least
        at = max(at, min(max(near, backward[k]), cells.at_most(at + capacity)))
        cuts.append(at)
    return cuts


def shard_bounds(units: DataFrame, n: int) -> list[int | None]:
    """For each shard but the last, the largest hash in it and those before it (None: none).  ``units``: one row
    per text with ``unit`` (hash) and ``bytes``."""
    def level(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        cell = F.shiftright("unit", 64 - bits) if bits < 64 else F.col("unit")
        return [(bits, r[0], r[1], r[2]) for r in
                df.groupBy(cell.alias("cell")).agg(F.sum("bytes"), F.count(F.lit(1))).collect()]

    largest = units.agg(F.max("bytes")).first()[0] or 0
    cells = Cells(level(units, BITS))
    while True:
        cuts = cut_points(cells, n, largest)
        split = [cells.rows[i] for i in sorted(cells.touched)]
        if not split:
            break
        rows = [r for i, r in enumerate(cells.rows) if i not in cells.touched]
        for bits in sorted({r[0] for r in split}):
            inside = [r[1] for r in split if r[0] == bits]
            rows += level(units.where(F.shiftright("unit", 64 - bits).isin(inside)), min(64, bits + BITS))
        cells = Cells(rows)
    out = []
    for cut in cuts[:-1]:
        i = int(np.searchsorted(cells.ends, cut, "right"))
        bits, prefix = cells.rows[i - 1][:2] if i else (0, 0)
        out.append((((prefix + 1) << (64 - bits)) - 1) if i else None)
    return out


def contiguous_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``size`` (UTF-8 bytes plus one), ``text_crc32``, ``law`` ('bytes': sizes
    near equal, equal texts together), ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` (null).

    A null text has the size of an empty one and stands with it.  Repeated rows each get a slot; ties in the order
    are broken by the id and do not matter, as the group of equal texts is atomic.  Texts whose 64-bit hashes
    collide share a group.  Other columns are not read.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text).alias("crc"), F.xxhash64(text).alias("unit"),
                                   F.spark_partition_id().alias("part")), spark, "shard-rows")
    units = materialize(rows.groupBy("unit").agg(F.sum("size").alias("bytes")), spark, "shard-units")
    bounds = shard_bounds(units, n_shards)
    shard = sum((F.when(F.col("unit") > b, 1).otherwise(0) if b is not None else F.lit(1) for b in bounds), F.lit(0))
    placed = rows.withColumn("shard", shard.cast("int"))
    # numbered within each part of the scan, which no hot text can enlarge, then moved by what earlier parts hold
    before = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    numbered = placed.withColumn("at", F.row_number().over(
        Window.partitionBy("shard", "part").orderBy("unit", "id")))
    return numbered.join(before, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
