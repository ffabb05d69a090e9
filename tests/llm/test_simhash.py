import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.components import components
from tallyspark.llm.simhash import keep_one_of_each, links, simhash_components


def reference(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(points, near):
    label = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_components_against_all_pairs(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, reference(r.text)) for r in docs.select("doc_id", "text").collect()]
    label = classes(rows, lambda a, b: (a[1] ^ b[1]).bit_count() <= 4 or a[0] is not None and a[0] == b[0])
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(i, least[c])
    key = lambda x: tuple((v is None, v) for v in x)
    expected = sorted(((i, f"{fp:016x}", least[c]) for (i, fp), c in zip(rows, label, strict=True)), key=key)
    assert sorted(map(tuple, simhash_components(docs).collect()), key=key) == expected


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_lose_no_component(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(tile)
    centres = [r.getrandbits(64) for _ in range(30)]
    fps = {c for c in centres}
    for c in centres[:12]:
        for _ in range(25):
            x = c
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {r.node: r.root for r in components(found).collect()}
    mine = [root.get(x, x) for x in signed]
    label = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(set(zip(mine, label, strict=True))) == len(set(mine)) == len(set(label))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(300)}}


def test_keep_one_of_each(docs, empty):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    found = simhash_components(docs)
    assert kept.where("doc_id is not null").count() == found.where("component_id is not null").select(
        "component_id").distinct().count()
    assert kept.where(F.col("doc_id").isNull()).count() == 2
    assert keep_one_of_each(empty).collect() == [] and simhash_components(empty).collect() == []
