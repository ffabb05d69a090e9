"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ in at most ``max_bits`` = 4 bits share
at least 8 - 4 = 4 positional bytes.  The index lists fingerprints under triples of positional bytes, chosen so that
any four positions contain an indexed triple (20 of the 56 triples are enough); so every pair that can reach the
minimum meets in a list.  For the pairs of a list the shared positional bytes are tallied, pairs below the guaranteed
minimum are discarded and the others verified by their differing bits.  A list's links leave it as a spanning forest,
never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import hex64
from tallyspark.llm.components import components
from tallyspark.session import materialize

#: A list is compared in tiles of about so many by so many fingerprints.
TILE = 4096
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of the word shingles, as an unsigned integer; 0 for a text without words."""
    import xxhash

    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    joined, n = b" ".join(ws), max(1, len(ws) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(ws)) - 1:] - 1).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts[at:at + BLOCK], stops[at:at + BLOCK],
                                                                  strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return docs.withColumn(out, simhash(F.col(text_col)))


def indexed_triples() -> list[tuple[int, int, int]]:
    """Triples of the positions 0 to 7 such that any four positions contain one (Turan's construction: positions in
    three classes; triples within a class, or two of one class and one of the next)."""
    kind = [p % 3 for p in range(8)]
    inside = [t for t in combinations(range(8), 3) if len({kind[p] for p in t}) == 1]
    mixed = [t for t in combinations(range(8), 3) if len({kind[p] for p in t}) == 2]
    follows = [t for t in mixed for a in range(3)
               if sorted(kind[p] for p in t) == sorted((a, a, (a + 1) % 3))]
    return inside + follows


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Batches of (list, tile, fp), sorted by list and tile, to the links (u, v) of a forest in each."""
    need = 8 - max_bits
    kept = np.zeros((0, 3), np.int64)

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        label, fps = np.arange(len(rows)), rows[:, 2].copy().view(np.uint64)
        near, d = np.arange(len(rows)), 0
        while True:
            d += 1
            near = near[near + d < len(rows)]
            near = near[(rows[near, 0] == rows[near + d, 0]) & (rows[near, 1] == rows[near + d, 1])]
            if not len(near):
                break
            at = near[label[near] != label[near + d]]
            diff = fps[at] ^ fps[at + d]
            tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            at, diff = at[tally >= need], diff[tally >= need]
            linked = at[np.bitwise_count(diff) <= max_bits].tolist()
            for i in linked:
                a, b = i, i + d
                while label[a] != a:
                    a = label[a]
                while label[b] != b:
                    b = label[b]
                label[max(a, b)] = min(a, b)
            while linked and (label[label] != label).any():
                label = label[label]
        linked = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[linked, 2]), pa.array(rows[label[linked], 2])], ["u", "v"])

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]).astype(np.int64)
        rows = np.concatenate([kept, rows])
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        kept = rows[cut:]
        if cut:
            yield compare(np.ascontiguousarray(rows[:cut]))
    if len(kept):
        yield compare(np.ascontiguousarray(kept))


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct links (u, v) that connect all fingerprints (column ``fp``, distinct) at ``max_bits`` or fewer.

    Lists longer than TILE are split into chunks by a hash of the fingerprint, and each two chunks form a tile, so
    that no task holds a long list whole.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees the common bytes of pairs that differ in 0 to 4 bits")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(8)]
    lists = [F.lit(i << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c]
             for i, (a, b, c) in enumerate(indexed_triples())]
    index = fps.select("fp", F.explode(F.array(*lists)).alias("list"))
    long = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE).select(
        "list", F.ceil(F.col("n") / TILE).alias("chunks"))
    own, last = F.pmod(F.xxhash64("fp"), F.col("chunks")), F.col("chunks") - 1
    tiles = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j)))
    tiled = index.join(long, "list", "left").select("list", F.explode(tiles).alias("tile"), "fp")
    dealt = tiled.repartition("list", "tile").sortWithinPartitions("list", "tile")
    return dealt.mapInArrow(lambda it: _links(it, max_bits), "u long, v long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, ``fingerprint`` as 16 hexadecimal digits, ``component_id``) for every row of ``docs``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked, and so are rows that repeat an id;
    ``component_id`` is the smallest id reachable.  A null text counts as empty; texts without words have fingerprint
    zero and are linked like any others.  Rows with a null id keep their fingerprint and lend no id to a component;
    where no other id is reachable, ``component_id`` is null.  An empty table gives an empty one.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    rows = materialize(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle,
                                        out="fp").select("id", "fp"), spark, "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), spark, "simhash-nodes")
    # an id with several fingerprints links them
    again = rows.where("id is not null").groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("w")).where("u <> w")
    repeated = rows.join(again, "id").where("fp <> u").select("u", F.col("fp").alias("v"))
    roots = components(links(nodes.select("fp"), max_bits).union(repeated))
    member = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "least", F.coalesce("root", "fp").alias("root")), spark, "simhash-members")
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return rows.join(named.select("fp", "component_id"), "fp").select(
        F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id; of rows that repeat the id, the one with
    the smallest (UTF-8 length, hash) of the text.  Rows with a null id stay, as nothing names them."""
    found = simhash_components(docs, shingle, max_bits, id_col, text_col)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col)).distinct()
    order = Window.partitionBy(id_col).orderBy(F.octet_length(text_col), F.xxhash64(text_col), F.col(text_col))
    rank = "simhash_rank"
    while rank in docs.columns:
        rank += "_"
    first = docs.join(keep, id_col, "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return first.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
