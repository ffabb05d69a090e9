"""Approximate nearest neighbours by inner product with a forest of random-projection trees.

Vectors are lifted by one coordinate to equal length, which turns the largest inner product into the smallest angle.
Each tree splits by random hyperplanes at the median; the planes are fitted on a bounded sample, all rows are
indexed.  A query descends all trees through one shared priority queue, nearest branch first, until the leaves it has
met expect a given number of candidates.  Leaves are joined to their rows, and leaf candidates are reranked by exact
inner products of the original vectors in double precision.

Equal vectors are one entry of the index, with the ``k`` + 1 smallest ids, which are all that can be among the k
nearest of any query; so a vector that holds a third of the rows is one entry.  Large leaves are split into blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize


@dataclass(frozen=True)
class Settings:
    """``sample``: most vectors that the planes are fitted on.  ``leaves``: that a tree aims at.  ``search``: rows,
    with repetition in several trees, that a query's leaves expect, as a share of all rows.  Vectors without any
    clusters need the large share given here, which meets four fifths of all rows, for a recall above 0.9; a tenth
    of it, with more leaves, does for clustered ones.  ``least``: candidates expected at least, times k, so that k are
    found wherever there are as many (it counts below ``trees * least * k / search`` rows, 171 for k = 20).  ``block``: most rows of a leaf that one task compares at a time."""

    trees: int = 6
    leaves: int = 32
    search: float = 1.4
    least: int = 2
    sample: int = 20_000
    block: int = 8192
    seed: int = 11


class Forest:
    """Trees as arrays: node i splits by ``planes[i]`` at ``offsets[i]``; children below zero are leaves."""

    def __init__(self, sample: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.planes, self.offsets, self.children, self.roots, self.shares = [], [], [], [], []
        least = max(1, -(-len(sample) // s.leaves))
        for _ in range(s.trees):
            self.roots.append(self.grow(sample, np.arange(len(sample)), least, rng))
        dim = sample.shape[1]
        self.planes = np.array(self.planes, dtype=np.float64).reshape(-1, dim)
        self.offsets, self.children = np.array(self.offsets), np.array(self.children, dtype=np.int64).reshape(-1, 2)
        self.shares = np.array(self.shares) / max(1, len(sample))  # of the rows in each leaf

    def grow(self, x: np.ndarray, at: np.ndarray, least: int, rng) -> int:
        """The new node's number, or a leaf as -1 - its number."""
        if len(at) > least:
            plane = rng.standard_normal(x.shape[1])
            plane /= np.linalg.norm(plane)
            side = x[at] @ plane
            middle = float(np.median(side))
            left = side <= middle
            if left.any() and not left.all():
                me = len(self.planes)
                self.planes.append(plane)
                self.offsets.append(middle)
                self.children.append([0, 0])
                self.children[me] = [self.grow(x, at[left], least, rng), self.grow(x, at[~left], least, rng)]
                return me
        self.shares.append(max(1, len(at)))
        return -len(self.shares)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): each row's leaf in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                right = np.einsum("ij,ij->i", x[inner], self.planes[at]) > self.offsets[at]
                node[inner] = self.children[at, right.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def search(self, x: np.ndarray, wanted: float) -> list[int]:
        """Leaves in the order of the shared queue until they expect the share ``wanted`` of the rows.  A branch is as
        far as the squared margins of the planes that part it from x."""
        margins = self.planes @ x - self.offsets if len(self.planes) else self.offsets
        queue, found, expected = [(0.0, root) for root in self.roots], [], 0.0
        heapq.heapify(queue)
        while queue and (expected < wanted or not found):
            far, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                expected += self.shares[-1 - node]
                continue
            (left, right), m = self.children[node].tolist(), margins[node]
            heapq.heappush(queue, (far + max(m, 0.0) ** 2, left))
            heapq.heappush(queue, (far + max(-m, 0.0) ** 2, right))
        return found


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a column of equally long lists."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lift(x: np.ndarray, radius: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(radius ** 2 - np.einsum("ij,ij->i", x, x), 0.0))
    return np.column_stack([x, rest]) / radius


def index_entries(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(entry, v, ids, least, q): one row for each different usable vector, with its k + 1 smallest ids; and
    (query_id, query): the entries of the queries."""
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda c: c.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are one value
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    rows = materialize(rows.where(F.size("v") == (sizes["dim"] if sizes else 0)), spark, "forest-rows")
    # a limit on the rank reaches the rows before they are exchanged
    smallest = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = smallest.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(
        F.monotonically_increasing_id().alias("entry"), "v", "ids", F.get("ids", F.lit(0)).alias("least"))
    entries = materialize(entries, spark, "forest-entries")
    asked = rows.where("q").select(F.col("id").alias("query_id"), "v").distinct()
    return entries, materialize(asked.join(entries.select("entry", "v"), "v").select(
        "query_id", F.col("entry").alias("query")), spark, "forest-queries")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            s: Settings = Settings()) -> DataFrame:
    """(``query_id``, ``rank`` from 1, id, ``score``): for each row for which the column ``is_query`` holds, the k
    rows of other ids found nearest by inner product, ties to the smaller id.

    Vectors that are null, empty, zero, of another length than most rows (the smallest such length, if several), or
    that hold null or non-finite components take no part, and neither do rows with a null id.  Rows that repeat an
    id and its vector count once; an id with several vectors asks and is found with each, the best score counting.
    An empty table, or one without queries, gives an empty one.  Other columns are not read.
    """
    spark = vectors.sparkSession
    entries, queries = index_entries(vectors, is_query, k, id_col, vector_col)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
                        F.max(square).alias("square")).first()
    wanted = max(s.search, s.trees * min(1.0, s.least * k / max(1, shape["n"])))
    dim, radius = shape["dim"] or 1, float(shape["square"] or 1.0) ** 0.5
    sample = entries.orderBy(F.xxhash64("entry", F.lit(s.seed)), "entry").limit(s.sample).select("v").toArrow()
    forest = Forest(_lift(_matrix(sample["v"], dim), radius), s)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.leaves(_lift(_matrix(batch["v"], dim), radius))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("entry", "v", "least")),
                                              pa.array(list(found), pa.list_(pa.int64()))],
                                             ["entry", "v", "least", "leaves"])

    placed = materialize(entries.mapInArrow(
        place, "entry long, v array<double>, least long, leaves array<long>"), spark, "forest-leaves")
    # at most one count for each leaf of the fitted trees
    blocks = {r["leaf"]: -(-r["n"] // s.block) for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.block).collect()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lift(_matrix(batch["v"], dim), radius)
            cells = [[(leaf, b) for leaf in forest.search(row, wanted) for b in range(blocks.get(leaf, 1))]
                     for row in x]
            at = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays(
                [batch["entry"].take(pa.array(at)), batch["v"].take(pa.array(at)),
                 pa.array([c[0] for cs in cells for c in cs], pa.int64()),
                 pa.array([c[1] for cs in cells for c in cs], pa.int64())], ["query", "v", "leaf", "block"])

    def rerank(asked: pa.Table, there: pa.Table) -> pa.Table:
        """The block's k + 1 best for each query; one row a query."""
        if not asked.num_rows or not there.num_rows:
            return pa.schema(lists).empty_table()
        there = there.sort_by("least")  # a stable sort by score then leaves ties in the order of ids
        x, y = _matrix(asked["v"], dim), _matrix(there["v"], dim)
        best, score = [], []
        for i in range(0, len(x), 256):
            all_ = x[i:i + 256] @ y.T
            best.append(np.argsort(-all_, axis=1, kind="stable")[:, :k + 1])
            score.append(np.take_along_axis(all_, best[-1], 1).ravel())
        best = np.concatenate(best)
        at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * best.shape[1])
        return pa.table([asked["query"]] + [pa.ListArray.from_arrays(at, pa.array(c)) for c in (
            there["entry"].to_numpy()[best.ravel()], np.concatenate(score), there["least"].to_numpy()[best.ravel()])],
            schema=pa.schema(lists))

    def merge(found: pa.Table) -> pa.Table:
        entry, score, least = (found[c].combine_chunks().flatten().to_numpy() for c in ("entry", "score", "least"))
        order = np.lexsort((least, -score))
        order = order[np.sort(np.unique(entry[order], return_index=True)[1])][:k + 1]
        return pa.table({"query": pa.array(np.full(len(order), found["query"][0].as_py())), "entry": entry[order],
                         "score": score[order]})

    lists = [("query", pa.int64()), ("entry", pa.list_(pa.int64())), ("score", pa.list_(pa.float64())),
             ("least", pa.list_(pa.int64()))]
    of_leaf = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair)) if blocks else None
    count = F.coalesce(F.try_element_at(of_leaf, F.col("leaf")), F.lit(1)) if blocks else F.lit(1)
    there = placed.select("entry", "v", "least", F.explode("leaves").alias("leaf")).withColumn(
        "block", F.pmod(F.xxhash64("entry"), count).cast("long"))
    asked = entries.join(queries.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi").select(
        "entry", "v").mapInArrow(ask, "query long, v array<double>, leaf long, block long")
    found = asked.groupBy("leaf", "block").cogroup(there.groupBy("leaf", "block")).applyInArrow(
        rerank, "query long, entry array<long>, score array<double>, least array<long>")
    best = found.groupBy("query").applyInArrow(merge, "query long, entry long, score double")
    each = best.join(entries.select("entry", "ids"), "entry").groupBy("query").agg(
        F.collect_list(F.struct("score", "ids")).alias("found"))  # k + 1 at most
    each = queries.join(each, "query").select("query_id", F.explode("found").alias("f")).select(
        "query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("id"))
    each = each.where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))) \
        .where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
