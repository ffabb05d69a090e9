import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import prefix_trie as trie
from tallyspark.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, high string, at long, part int"


def brute(rows: list[tuple]) -> list[tuple]:
    """Whole rebuilt conversations in a dictionary of prefixes."""
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            stored[c].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [t[2:] for t in sorted(ts)] for c, ts in stored.items()}
    members = defaultdict(list)
    for c in sorted(stored):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(stored.get(c - c % 100, [])[:h] + stored[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq) == d))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children[node]]
        leaves = sum(b[0] for b in below) if below else 1
        saved = sum(b[1] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c, end in members[node] if end)
        out.append((members[node][0][0], len(node), members[node[:-1]][0][0] if node else None, len(members[node]),
                    len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows, tmp_path):
    full = [(*r, 7, "x", 1, 2) for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert {t for _, t in got.dtypes if t != "string"} == {"bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def some_rows(seed: int) -> list[tuple]:
    r, rows = random.Random(seed), []
    texts = [None, "", "hi", "hello there", "é\U0001f600", "x" * 300]
    for c in [*range(100, 160), *range(200, 230), 5, 7, 305, 306, 499]:
        for turn in range(r.choice([1, 2, 3, 5, 6, 9])):
            rows.append((c, r.choice([turn, turn, turn, None, 1]), r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += rows[:20] + [(None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_odd_rows_as_brute_force(spark, seed, tmp_path):
    check(spark, some_rows(seed), tmp_path)


def test_driver_table_as_brute_force(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    check(spark, [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()], tmp_path)


def test_long_conversation_over_many_ranges(spark, monkeypatch, tmp_path):
    """A conversation of most rows, with null and repeated turns, lies in many ranges and spans of its path."""
    monkeypatch.setattr(trie, "SPAN", 7)
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "MANY", 4)
    rows = [(101, i // 3 if i % 5 else None, "user", f"t{i % 11}") for i in range(300)] + some_rows(3)
    rows += [(100, i, "user", f"t{i}") for i in range(3)] + [(k, 0, "user", "same") for k in range(600, 700)]
    rows += [(108, i, "user", "again") for i in range(90)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows, tmp_path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_colliding_fingerprints_are_found(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(trie, "PRIMES", (13, 2 ** 127 - 1))
    check(spark, some_rows(4), tmp_path)
    monkeypatch.setattr(trie, "PRIMES", (13,))
    with pytest.raises(RuntimeError):
        op12_prefix_trie(spark, str(tmp_path))


def test_empty(spark, tmp_path):
    check(spark, [], tmp_path)


def test_fingerprints_compose():
    m = trie.Monoid(0)
    turns = [m.turn("user", str(i)) for i in range(9)]
    whole = lambda ts: 0 if not ts else m.joined(whole(ts[:-1]), ts[-1], 1)
    for k in range(10):
        assert m.joined(whole(turns[:k]), whole(turns[k:]), 9 - k) == whole(turns)
    assert m.turn("ab", "c") != m.turn("a", "bc")
    for v in (0, 1, 2 ** 63, 2 ** 64 - 1, 2 ** 127 - 2):
        assert trie.whole(*trie.split(v)) == v


def test_attach_broadcasts_few(spark, monkeypatch):
    monkeypatch.setattr(trie, "MANY", 3)
    rows = spark.createDataFrame([(i % 4 if i % 2 else 1, i) for i in range(40)], "k long, v long")
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = trie.attach(rows, one, ["k"], F.col("n"), 40)
    assert sorted((r.k, r.v) for r in got.collect()) == sorted((r.k, r.v) for r in rows.collect())
