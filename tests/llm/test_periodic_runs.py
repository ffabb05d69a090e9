import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.periodic_runs import collapsed, document_runs, periodic_runs
from tallyspark.llm.queries import op11_periodic_runs


def brute(t: list, least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """For each period the maximal stretches of equal words at that distance, kept if no smaller period fits."""
    found = []
    for q in range(1, len(t) // 2 + 1):
        same, k = [t[i] == t[i + q] for i in range(len(t) - q)], 0
        while k < len(same):
            j = k
            while j < len(same) and same[j]:
                j += 1
            w = t[k:j + q]
            if j - k >= q and len(w) >= max(least_length, least_exponent * q) and not any(
                    all(w[x] == w[x + d] for x in range(len(w) - d)) for d in range(1, q)):
                found.append((k, len(w), q))
            k = max(j, k + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(t: list, runs: list) -> list:
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(t) if i not in drop]


@pytest.mark.parametrize("rules", [(6, 4), (2, 2), (6, 3), (1, 2), (4, 5)])
def test_random_sequences_as_brute_force(rules):
    r = random.Random(sum(rules))
    for _ in range(1500):
        n, kinds = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
        t = [b"%d" % r.randrange(kinds) for _ in range(n)]
        if n > 4 and r.random() < .5:
            i, p = r.randrange(n), r.randint(1, 6)
            for k in range(i, n):
                t[k] = t[i + (k - i) % p]
            t += [b"x", *t] * (r.random() < .5)
        got = document_runs(t, *rules)
        assert [tuple(x) for x in got.tolist()] == brute(t, *rules)
        assert collapsed(t, got) == b" ".join(brute_collapsed(t, brute(t, *rules)))


def test_long_texts():
    n = 60_000
    assert document_runs([b"a"] * n).tolist() == [[0, n, 1]]
    assert document_runs([b"%d" % (i % 7919) for i in range(n)]).tolist() == [[0, n, 7919]]
    nested = ([b"a"] * 6 + [b"b"]) * 5
    assert [tuple(x) for x in document_runs(nested).tolist()] == brute(nested, 6, 4)


def expected(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = [tuple(x) for x in document_runs(words).tolist()]
    if n < 900:
        assert runs == brute(words, 6, 4)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()), sha(b" ".join(brute_collapsed(words, runs))), n)


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_query_as_brute_force(request, spark, which, tmp_path):
    docs = request.getfixturevalue(which)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(r.n_runs for r in got)


def test_other_columns_and_empty(docs, empty):
    got = periodic_runs(docs, out="quality")
    assert sorted(got.columns) == sorted(docs.columns)
    assert got.where("text is null").select(F.col("quality.n_words"), F.size("quality.runs"),
                                            "quality.collapsed").distinct().collect() == [(0, 0, "")]
    assert periodic_runs(empty).collect() == []
