import zlib

import numpy as np
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm.compression import Limits, measure
from tallyspark.llm.queries import WORD_BPE, tokenizer
from tests.llm.test_secret_scan import base, bin_of
from tests.llm.test_simhash import classes, reference


def blanked(rows):
    """Texts without secrets, by plain Python."""
    import re
    cand, per = {}, {}
    for i, t in rows.items():
        b = base(t)
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if not any(a < m.end() and m.start() < c for a, _, c in b):
                n = len(m[0].rstrip("="))
                cls, x = sum(n >= k for k in (24, 32, 48, 64, 128)), bin_of(m[0])
                cand.setdefault(i, []).append((m.start(), m.end(), cls, x))
                per.setdefault(cls, []).append(x)
    least = {}
    for cls, xs in per.items():
        ok = [x for x in range(1, 401) if (n := sum(y >= x for y in xs)) and 10 ** (-x / 20) * len(xs) / n <= 0.01]
        least[cls] = min(ok, default=401)
    out = {}
    for i, t in rows.items():
        spans = sorted([(a, c) for a, _, c in base(t)] + [(a, c) for a, c, cls, x in cand.get(i, []) if x >= least[cls]])
        text, at = "", 0
        for a, c in spans:
            if a >= at:
                text += t[at:a] + "[SECRET]"
            at = max(at, c)
        out[i] = text + t[at:]
    return out


def brute(docs):
    """doc_id: ids of its tokens."""
    compress = zstandard.ZstdCompressor(level=3).compress
    kept = [(r.doc_id, r.text) for r in docs if measure(r.text, Limits(), compress)[-1]]
    points = [(i, reference(t)) for i, t in kept]
    label = classes(points, lambda a, b: (a[1] ^ b[1]).bit_count() <= 4 or a[0] == b[0] is not None)
    least = {}
    for (i, _), c in zip(points, label, strict=True):
        least[c] = min(least.get(c, i), i)
    rows = {i: t for (i, t), c in zip(kept, label, strict=True) if least[c] == i}
    t = Tokenizer.from_file(tokenizer(WORD_BPE))
    return {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in blanked(rows).items()}


def check(spark, sf_dir, docs):
    expected = brute(docs)
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == expected.keys()
    for i, ids in expected.items():
        at = 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)


def test_run_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    check(spark, sf, spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_odd_rows(spark, docs, tmp_path):
    some = docs.where("doc_id is not null")
    some.write.parquet(f"{tmp_path}/documents.parquet")
    rows = some.collect()
    once = {}
    for r in rows:  # of rows that repeat an id, the shortest text stays
        if r.doc_id not in once or r.text is not None and len(r.text) < len(once[r.doc_id].text):
            once[r.doc_id] = r
    check(spark, str(tmp_path), [r for r in once.values()])


def test_stages_keep_the_columns(spark, docs, empty):
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == docs.columns, name
    last = empty
    for _, stage in corpus_pipeline.STAGES:
        last = stage(spark, last, "")
    assert last.collect() == []


def test_registered():
    import __spark_entry__
    assert "pipeline" in __spark_entry__.queries()
