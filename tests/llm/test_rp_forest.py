import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.rp_forest import Settings, nearest


def brute(rows, k):
    """By all pairs; rows: (id, vector)."""
    ok = {(i, tuple(float(c) for c in v)) for i, v in rows if i is not None and v and len(v) == 4
          and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for q in {i for i, _ in ok if i % 20 == 0}:
        best = {}
        for i, v in ok:
            if i != q:
                best[i] = max(max(sum(a * b for a, b in zip(v, w, strict=True)) for j, w in ok if j == q),
                              best.get(i, -1e300))
        for rank, (score, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k]):
            out.append((q, rank + 1, i, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def odd(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4)], "x") for i in range(1, 180)]
    rows += [(i, [1.0, 2.0, 0.5, -1.0], "hot") for i in range(200, 330)]
    rows += [(20, [1.0, 2.0, 0.5, -1.0], "again"), (205, [1.0, 2.0, 0.5, -1.0], "twice"), (None, [1.0] * 4, ""),
             (400, None, ""), (420, [], ""), (440, [0.0] * 4, ""), (460, [1.0, None, 1.0, 1.0], ""),
             (480, [float("nan"), 1.0, 1.0, 1.0], ""), (500, [float("inf"), 1.0, 1.0, 1.0], ""), (520, [1.0, 2.0], ""),
             (540, [-0.0, 0.0, 3.0, 0.0], "")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string").repartition(4)


@pytest.mark.parametrize("block", [8192, 7])
def test_whole_search_is_exact(odd, block):
    rows, df = odd
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20, s=Settings(trees=2, leaves=8, search=9.0, block=block)).collect()
    expected = brute([(i, v) for i, v, _ in rows], 20)
    assert [(a, b, c) for a, b, c, _ in sorted(map(tuple, got))] == [(a, b, c) for a, b, c, _ in expected]
    assert [x[3] for x in sorted(map(tuple, got))] == pytest.approx([x[3] for x in expected])


def test_recall(spark):
    """Both on vectors without clusters and on the table at hand."""
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for frame in (df, t):
        rows = frame.select("vec_id", "embedding").collect()
        ids, x = np.array([q[0] for q in rows]), np.array([q[1] for q in rows], dtype=float)
        got = {}
        for q in nearest(frame, F.col("vec_id") % 20 == 0).collect():
            got.setdefault(q.query_id, {})[q.vec_id] = q.score
        hit = total = 0
        for i in np.flatnonzero(ids % 20 == 0):
            score = x @ x[i]
            score[i] = -np.inf
            true = ids[np.argsort(-score, kind="stable")[:20]].tolist()
            assert len(got[ids[i]]) == 20
            hit, total = hit + len(set(true) & set(got[ids[i]])), total + 20
        assert hit / total >= 0.9


def test_empty_and_few(spark, odd):
    _, df = odd
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(df, F.lit(False)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
