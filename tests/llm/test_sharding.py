import random
import zlib
from collections import defaultdict

import pytest

from tallyspark.llm import sharding
from tallyspark.llm.sharding import contiguous_shards, shard_bounds


def best_capacity(sizes, n):
    """By dynamic programming over all contiguous partitions."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    best = prefix[:]
    for _ in range(n - 1):
        best = [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(len(prefix))]
    return best[-1]


def check(rows, docs):
    assert len(rows) == docs.count()
    by_text, slots, size = defaultdict(set), defaultdict(list), defaultdict(int)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id]}
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        by_text[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_contiguous_shards(request, which):
    docs = request.getfixturevalue(which)
    check(contiguous_shards(docs).collect(), docs)


def test_empty(empty):
    assert contiguous_shards(empty).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "BITS", 3)  # several refinements on a small table
    r = random.Random(seed)
    units = [(r.randrange(-1 << 63, 1 << 63), r.choice([1, 5, 9, 400 if seed % 2 else 30])) for _ in range(220)]
    n = 8
    bounds = shard_bounds(spark.createDataFrame(units, "unit long, bytes long"), n)
    total = [0] * n
    for h, b in units:
        total[sum(1 for x in bounds if x is None or h > x)] += b
    assert max(total) == best_capacity([b for _, b in sorted(units)], n)
    if seed % 2 == 0:
        assert min(total) > 0.8 * max(total)


def test_hot_group(spark):
    rows = [(i, "same text here" if i % 3 == 0 else f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = check(contiguous_shards(docs).collect(), docs)
    assert len(size) >= 7  # the hot group fills one shard, the others share the rest
