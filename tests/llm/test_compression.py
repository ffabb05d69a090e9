import re

import pytest

from tallyspark.llm.compression import compression_bands
from tests.llm.conftest import prose

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    ws = W.findall(text)
    grams = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)} if len(ws) < 2000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, covered and len(covered)


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_base_columns(request, which):
    docs = request.getfixturevalue(which)
    rows = compression_bands(docs).select("doc_id", "text", "quality.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, chars, symbols, dup, repeats = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        if n < 2000:
            assert r.n_repeat_words == (repeats or 0)
        assert r.base_failed == (n < 20 or 100 * r.n_repeat_words > 30 * n)
        assert not (r.kept and r.base_failed)


def test_verdicts(spark):
    import base64
    import random
    noise = base64.b64encode(random.Random(1).randbytes(9000)).decode()
    texts = {"prose": prose(3, 900), "noise": " ".join(noise[i:i + 40] for i in range(0, len(noise), 40)),
             "loop": "\n".join(f"item {i % 3} is sold out today" for i in range(900)),
             "half": prose(4, 400) + " Ndtion" * 1200, "null": None}
    rows = compression_bands(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    got = {r.doc_id: r.quality for r in rows.collect()}
    assert got["prose"].kept and not got["null"].kept
    assert got["noise"].band_verdict == "incompressible" and not got["noise"].base_failed
    assert got["loop"].band_verdict == "repetitive" and got["half"].band_verdict != "ok"


def test_clean_labelled_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    rows = compression_bands(docs, out="q").join(labels, "doc_id").select("q.base_failed", "q.band_verdict")
    assert rows.where("not base_failed and band_verdict <> 'ok'").count() == 0


def test_empty(empty):
    assert compression_bands(empty).collect() == []
