"""The prefix trie of rebuilt conversations, by composable fingerprints.

A sequence of turns has the fingerprint (value, length), a polynomial in the turns' digests modulo a prime; sequences
join as (a, m) + (b, n) = (a * base^n + b, m + n).  A rebuilt conversation is a head of another one and the rest of its
own turns, so its prefixes' fingerprints follow from those of the two stored conversations: swapping the head adds
(head - own head) * base^n.  No rebuilt text is ever made.

Turns are numbered and multiplied up in ranges of the sorted table, and each range is then joined to what the ranges
before it hold of its first conversation, so a conversation of any length is spread over tasks.  Rows with equal depth
and fingerprint are members of one node; that they are equal is verified through the stored turns that they refer to,
and where they are not, everything is done anew with another base.

Sums over subtrees follow no edges: a node lies on the path of its smallest member, so its weight is put there; running
sums from each path's end, added up over a node's members, give the sum over its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize

#: The modulus of each attempt.
PRIMES = (2 ** 127 - 1, 2 ** 127 - 1, 2 ** 107 - 1)
#: Turns taken from another conversation at most.
HEAD = 5
#: Rows of a path that share a running sum, and ids whose text is one block for the digest of ends.
SPAN, BLOCK = 1024, 512
#: Rows met by more than 1 / MANY of all rows are broadcast, so fewer than MANY of them.
MANY = 4096

NODE = ["depth", "high", "low"]


class Monoid:
    """Fingerprints of sequences of turns under one attempt's base."""

    def __init__(self, attempt: int, prime: int | None = None):
        self.attempt, self.p = attempt, prime or PRIMES[attempt]
        self.key = b"prefix trie %d" % attempt
        self.base = int.from_bytes(hashlib.blake2b(b"base", key=self.key).digest()) % (self.p - 2) + 2
        self.power = lru_cache(100_000)(lambda n: pow(self.base, n, self.p))

    def __reduce__(self):
        return Monoid, (self.attempt, self.p)

    def turn(self, role: str, text: str) -> int:
        r = role.encode()
        code = hashlib.blake2b(b"%d:" % len(r) + r + text.encode(), digest_size=16, key=self.key).digest()
        return int.from_bytes(code) % self.p

    def joined(self, a: int, b: int, length: int) -> int:
        """``a`` followed by the sequence ``b`` of that length."""
        return (a * self.power(length) + b) % self.p


def split(value: int) -> tuple[int, int]:
    """A fingerprint as two signed 64-bit integers."""
    low = value & (1 << 64) - 1
    return value >> 64, low - (1 << 64) if low >> 63 else low


def whole(high: int, low: int) -> int:
    return high << 64 | low & (1 << 64) - 1


def _table(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                       zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)],
                                      schema=schema)


def _longs(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def numbered_turns(turns: DataFrame, attempt: int) -> tuple[DataFrame, DataFrame, int]:
    """Turns of each conversation with their place ``at`` (from 1), the fingerprint up to the turn and that before it; the
    stored turns (conv_id, at, role, text); and how many there are."""
    spark, monoid = turns.sparkSession, Monoid(attempt)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    schema = pa.schema([*_longs("conv_id"), ("role", pa.string()), ("text", pa.string()),
                        *_longs("part", "at", "high", "low", "high0", "low0", "n_chars")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, value = None, 0, 0
        for batch in batches:
            rows = []
            for c, role, text, part in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text", "part")),
                                           strict=True):
                if c != conv:
                    conv, at, value = c, 0, 0
                before, value, at = value, monoid.joined(value, monoid.turn(role, text), 1), at + 1
                rows.append((c, role, text, part, at, *split(value), *split(before), len(text)))
            yield _table(schema, rows)

    local = materialize(
        turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        .select("conv_id", "role", "text", "part")
        .mapInArrow(scan, "conv_id long, role string, text string, part long, at long, high long, low long, high0 long, "
                          "low0 long, n_chars long"), spark, "trie-turns")
    # one row a range: what a range leaves to the next one
    last = F.max_by(F.struct("at", "high", "low"), F.struct("conv_id", "at")).alias("last")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first_id"), F.max("conv_id").alias("last_id"),
                                     F.count(F.lit(1)).alias("n"), last).orderBy("part").collect()
    carried, conv, at, value = [], None, 0, 0
    for r in ends:
        if r.first_id == conv:
            carried.append((r.part, conv, at, *split(value)))
        if r.last_id != conv:
            conv, at, value = r.last_id, 0, 0
        value = monoid.joined(value, whole(r.last.high, r.last.low), r.last.at)
        at += r.last.at
    before = spark.createDataFrame(carried, "part long, conv_id long, at0 long, high_c long, low_c long")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _longs("conv_id", "at", "high", "low", "high0", "low0", "n_chars")
        for batch in batches:
            rows = []
            for c, at, h, lo, h0, lo0, n, at0, hc, lc in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at0 is not None:
                    carry = whole(hc, lc)
                    h, lo = split(monoid.joined(carry, whole(h, lo), at))
                    h0, lo0 = split(monoid.joined(carry, whole(h0, lo0), at - 1))
                    at += at0
                rows.append((c, at, h, lo, h0, lo0, n))
            yield _table(out, rows)

    light = local.join(F.broadcast(before), ["part", "conv_id"], "left")
    stored = light.withColumn("at", F.col("at") + F.coalesce("at0", F.lit(0))).select("conv_id", "at", "role", "text")
    scanned = light.select("conv_id", "at", "high", "low", "high0", "low0", "n_chars", "at0", "high_c", "low_c") \
        .mapInArrow(moved, "conv_id long, at long, high long, low long, high0 long, low0 long, n_chars long")
    return materialize(scanned, spark, "trie-numbered"), stored, sum(r.n for r in ends)


def attach(rows: DataFrame, one: DataFrame, keys: list[str], met_by: Column, n_rows: int) -> DataFrame:
    """Join to each row the one row of ``one`` with its keys.  ``met_by`` tells how many rows meet it: those that more
    than 1 / MANY of all rows meet are fewer than MANY and are broadcast, the others are met in an ordinary join."""
    heavy = one.where(met_by > n_rows / MANY)
    names = heavy.select(keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(
        rows.join(F.broadcast(names), keys, "left_anti").join(one.where(met_by <= n_rows / MANY), keys))


def paths(turns: DataFrame, n_rows: int, attempt: int, base_of: Column, head_turns: Column) -> DataFrame:
    """One row per rebuilt conversation and depth (0: the root): fingerprints of the prefix and of the one before it, the
    code points of its last text, the stored turn (source, at) it ends with, and whether the conversation ends there."""
    monoid = Monoid(attempt)
    first = F.sort_array(F.collect_list(F.when(F.col("at") <= HEAD, F.struct("at", "high", "low", "n_chars"))))
    known = turns.groupBy("conv_id").agg(F.max("at").alias("n"), first.alias("first"))
    convs = known.select("conv_id", "n", "first", base_of.alias("source"), head_turns.cast("long").alias("h"))
    heads = known.select(F.col("conv_id").alias("source"), F.col("first").alias("head"))
    convs = convs.join(heads, "source", "left") \
        .withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.slice("first", 1, 0))) \
        .withColumn("depth0", F.size("head").cast("long")) \
        .withColumn("own", F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs, turns.sparkSession, "trie-conversations")
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("high"),
                       F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("n_chars"))
    steps = F.concat(F.array(nothing), "head")
    in_head = convs.select("conv_id", "source", "depth0", "own", steps.alias("steps"),
                           F.posexplode(steps).alias("depth", "step")) \
        .withColumn("up", F.when(F.col("depth") > 0, F.col("steps")[F.col("depth") - 1])) \
        .select("conv_id", F.col("depth").cast("long"), "step.high", "step.low",
                F.col("up.high").alias("up_high"), F.col("up.low").alias("up_low"), "step.n_chars",
                F.when(F.col("depth") > 0, F.col("source")).alias("source"), "step.at",
                ((F.col("own") == 0) & (F.col("depth") == F.col("depth0"))).alias("is_end"))

    replaced = F.element_at(steps, -1)
    own_head = F.when(F.col("h") > 0, F.col("first")[(F.col("h") - 1).cast("int")]).otherwise(nothing)
    swaps = convs.where("own > 0").select(
        "conv_id", "h", "depth0", "n", "own", replaced["high"].alias("new_high"), replaced["low"].alias("new_low"),
        own_head["high"].alias("old_high"), own_head["low"].alias("old_low"))
    own = attach(turns.where(F.col("at") > head_turns), swaps, ["conv_id"], F.col("own"), n_rows)
    columns = _longs("conv_id", "depth", "high", "low", "up_high", "up_low", "n_chars", "source", "at")
    columns = columns.append(pa.field("is_end", pa.bool_()))

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = monoid.p
        for batch in batches:
            rows = []
            for c, at, hi, lo, hi0, lo0, chars, h, d0, n, nh, nl, oh, ol in zip(
                    *(x.to_pylist() for x in batch.columns), strict=True):
                swap = whole(nh, nl) - whole(oh, ol)
                rows.append((c, d0 + at - h, *split((whole(hi, lo) + swap * monoid.power(at - h)) % p),
                             *split((whole(hi0, lo0) + swap * monoid.power(at - h - 1)) % p), chars, c, at, at == n))
            yield _table(columns, rows)

    own = own.select("conv_id", "at", "high", "low", "high0", "low0", "n_chars", "h", "depth0", "n", "new_high", "new_low",
                     "old_high", "old_low").mapInArrow(swapped, in_head.schema)
    return materialize(in_head.unionByName(own), turns.sparkSession, "trie-paths")


def unequal_nodes(members: DataFrame, stored: DataFrame) -> int:
    """Nodes whose members do not all follow one node with one (role, text), looked up in the stored turns."""
    refs = members.where("depth > 0").groupBy(*NODE, "source", "at").agg(
        *(f(c).alias(f"{n}_{c}") for c in ("up_high", "up_low") for n, f in (("least", F.min), ("most", F.max))))
    turns = stored.select(F.col("conv_id").alias("source"), "at", F.struct("role", "text").alias("turn"))
    said = refs.join(turns, ["source", "at"], "left").groupBy(*NODE).agg(
        F.min("turn").alias("a"), F.max("turn").alias("b"), *(
            f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("up_high", "up_low") for n, f in (("least", F.min), ("most", F.max))))
    return said.where("not (a <=> b) or least_up_high <> most_up_high or least_up_low <> most_up_low").count()


def ends_digest(members: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids that end there, ascending and joined by commas.  Ranges of the sorted ids become
    blocks of text, which one task then passes through the digest one by one."""
    keys = [*NODE, "conv_id"]
    texts = pa.schema([*_longs(*keys), ("text", pa.string())])
    digests = pa.schema([*_longs(*NODE), ("ends_sha256", pa.string())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, node, ids = [], None, []
            for *at, c in zip(*(batch.column(k).to_pylist() for k in keys), strict=True):
                if at != node or len(ids) == BLOCK:
                    if ids:
                        rows.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = at, []
                ids.append(c)
            if ids:
                rows.append((*node, ids[0], ",".join(map(str, ids))))
            yield _table(texts, rows)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            rows = []
            for *at, text in zip(*(batch.column(k).to_pylist() for k in (*NODE, "text")), strict=True):
                if at == node:
                    sha.update(b",")
                else:
                    if node:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256()
                sha.update(text.encode())
            yield _table(digests, rows)
        if node:
            yield _table(digests, [(*node, sha.hexdigest())])

    ends = members.where("is_end").select(keys)
    listed = ends.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        blocks, "depth long, high long, low long, conv_id long, text string")
    return listed.repartition(*NODE).sortWithinPartitions(*keys).mapInArrow(
        digest, "depth long, high long, low long, ends_sha256 string")


def subtree_sums(members: DataFrame, weights: DataFrame, names: list[str]) -> DataFrame:
    """Per node the sums of weights (one row a node, at ``conv_id`` and ``depth`` of its smallest member) over its
    subtree."""
    placed = members.join(weights, ["conv_id", "depth"], "left").select(
        "conv_id", *NODE, (F.col("depth") / SPAN).cast("long").alias("span"),
        *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    spans = placed.groupBy("conv_id", "span").agg(*(F.sum(n).alias(n) for n in names))
    later = Window.partitionBy("conv_id").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = spans.select("conv_id", "span", *(F.sum(n).over(later).alias(f"{n}_later") for n in names))
    onward = Window.partitionBy("conv_id", "span").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({n: F.sum(n).over(onward) for n in names}) \
        .join(beyond.where(F.col(f"{names[0]}_later").isNotNull()), ["conv_id", "span"], "left") \
        .groupBy(*NODE).agg(*(F.sum(F.col(n) + F.coalesce(f"{n}_later", F.lit(0))).alias(n) for n in names))


def prefix_trie(conversations: DataFrame, base_of: Column, head_turns: Column, attempt: int = 0) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` holds conv_id, turn, role, text; ``base_of`` and ``head_turns`` (0 to 5) are expressions over
    conv_id: the conversation that gives the head, and how many turns of it replace as many own ones.  Rows without a
    conv_id belong to no conversation and are left out; a null role or text is empty; null turns stand first, equal
    turns by role, then text; repeated rows are turns of their own.  Other columns are not read.  An empty table has no
    conversation and hence no node, not even the root.
    """
    spark = conversations.sparkSession
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    turns, stored, n_rows = numbered_turns(rows, attempt)
    members = paths(turns, n_rows, attempt, base_of, head_turns)
    if unequal_nodes(members, stored):
        if attempt + 1 == len(PRIMES):
            raise RuntimeError("fingerprints collide under every base")
        return prefix_trie(conversations, base_of, head_turns, attempt + 1)
    nodes = materialize(members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("up_high").alias("up_high"),
        F.min("up_low").alias("up_low"), F.min("n_chars").alias("n_chars")), spark, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), spark, "trie-children")
    weights = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    sums = subtree_sums(members, weights, ["n_leaves", "saved_tokens"])
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    up = ["depth", "up_high", "up_low"]
    below = attach(nodes.where("depth > 0").drop("n_children"), parents, up, F.col("n_children"), n_rows) \
        .select(*NODE, "parent_conv_id")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(below, NODE, "left").join(sums, NODE).join(ends_digest(members), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
