import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.secret_scan import (ENCODINGS, KINDS, Battery, base_spans, fit_thresholds, redacted, scanned,
                                        secret_spans, spans_text)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6
           and m[1].isascii()]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def bin_of(token, b=Battery()):
    """The battery, spelt out for one token."""
    body = token.rstrip("=")
    alphabet = next((a for _, p, a in ENCODINGS if re.search(p, body)), "")
    if len(alphabet) < 2:
        return 0
    v, n, k = [alphabet.index(c) for c in body], len(body), len(alphabet)
    phi = lambda z: 0.5 * math.erfc(z / 2 ** 0.5)
    squares = sum(v.count(x) ** 2 for x in set(v))
    d = k - 1
    z_chi = ((max(0, squares * k / n - n) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    up = [2 * x >= k for x in v]
    both = 2 * sum(up) * (n - sum(up))
    spread = both * (both - n) / (n * n * (n - 1))
    turns = sum(x != y for x, y in zip(up, up[1:], strict=False))
    z_runs = (turns - both / n) / math.sqrt(spread) if spread > 0 else -math.sqrt(n)
    m = (k - 1) / 2
    z_serial = sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / ((n - 1) * (k * k - 1) / 12) * math.sqrt(n - 1)
    if min(phi(z_chi), 2 * phi(abs(z_runs)), 2 * phi(abs(z_serial))) < b.alpha / 3:
        return 0
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." for c in body]
    x, tau = sum(p != q for p, q in zip(kind, kind[1:], strict=False)) / (n - 1), b.ordinary_changes
    p = 1.0
    if x > tau:
        p = math.exp(-(n - 1) * (x * math.log(x / tau) + ((1 - x) * math.log((1 - x) / (1 - tau)) if x < 1 else 0)))
    if k > 16:
        c = b.coincidence
        sd = math.sqrt((4 * (n - 2) * (b.cubes - c * c) + 2 * (c - c * c)) / (n * (n - 1)))
        p = max(p, phi((c - (squares - n) / (n * (n - 1))) / sd))
    return min(b.bins, int(-math.log10(max(p, 1e-300)) * b.bins_per_decade))


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_base_spans(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("text", spans_text(base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.s == written(base(r.text)), r.text


def test_battery_against_plain_python(spark):
    r = random.Random(4)
    alphabets = [a for _, _, a in ENCODINGS]
    tokens = ["".join(r.choices(r.choice(alphabets), k=r.randint(20, 90))) for _ in range(150)]
    tokens += ["getUserNameFromDatabaseTable", "a" * 30, "----------------------", "internationalisierungsbehoerde",
               "usr/local/share/applications/java", "550e8400-e29b-41d4-a716-446655440000"]
    df = scanned(spark.createDataFrame([(t,) for t in tokens], "text string"), "text", Battery())
    for row in df.collect():
        if row.scan.base:
            continue
        assert len(row.scan.candidates) == 1
        assert abs(row.scan.candidates[0].bin - bin_of(row.text)) <= 1, row.text


def test_random_tokens_found_and_words_left(spark):
    r = random.Random(9)
    alphabet = ENCODINGS[5][2]
    good = ["".join(r.choices(alphabet, k=40)) for _ in range(60)]
    words = ["Einungtzheitgeungverlich" + "en" * (i % 5) for i in range(300)] + ["anbletitionthtionbletion"] * 50
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(good + words)], "doc_id long, text string")
    rows = {x.doc_id: x.spans for x in secret_spans(df).collect()}
    assert sum(bool(rows[i]) for i in range(60)) >= 55
    assert not any(rows[i] for i in range(60, len(rows)))


def test_query_columns(spark, docs, empty, tmp_path):
    from tallyspark.llm.queries import op10_secrets
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id != 7}
    for r in op10_secrets(spark, str(tmp_path)).collect():
        if r.doc_id in texts:
            b = base(texts[r.doc_id])
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in b) for i in range(3)]
            assert r.base_sha256 == hashlib.sha256(written(b).encode()).hexdigest()
            assert set(filter(None, written(b).split(","))) <= set(r.spans.split(","))
    assert secret_spans(empty).collect() == [] and redacted(empty).collect() == []


def test_redacted(docs):
    out = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert out[0] is None and out[5] == {r.doc_id: r.text for r in docs.collect()}[5]
    assert out[20].startswith("[SECRET] and AKIASHORT [SECRET] é secret:é [SECRET]")
    assert fit_thresholds(scanned(docs.limit(0), "text", Battery()), Battery()) == [401] * 6


def test_one_case_tokens_of_all_lengths(spark):
    """Random tokens of one case, from alphabets spelt out here, pass as uniform at every length and are accepted where
    the length gives the other test its power; ordinary words are left."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    r, rows = random.Random(12), []
    for alphabet in (letters + "234567", letters + digits):
        for a in (alphabet, alphabet.upper()):
            for n in (32, 48, 64, 96, 128, 256):
                rows += [((a, n), "".join(r.choices(a, k=n))) for _ in range(40)]
    words = ["internationalisierungsbehoerde", "theadministrationofthecountry", "anbletitionthtionbletion"] * 100
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate([t for _, t in rows] + words)],
                               "doc_id long, text string")
    uniform = {x.doc_id: any(c.bin for c in x.scan.candidates) for x in scanned(df, "text", Battery()).collect()}
    spans = {x.doc_id: bool(x.spans) for x in secret_spans(df).collect()}
    passed, found = {}, {}
    for i, (k, _) in enumerate(rows):
        passed[k], found[k] = passed.get(k, 0) + uniform[i], found.get(k, 0) + spans[i]
    assert len(found) == 24 and min(passed.values()) >= 37, passed
    assert all(n >= (30 if k[1] == 64 else 36) for k, n in found.items() if k[1] >= 64), found
    assert not any(spans[i] for i in range(len(rows), len(spans)))


def test_very_long_texts(spark):
    """A run of a megabyte and a list of 100 000 hashes in one text take seconds, with the spans of plain Python."""
    r = random.Random(3)
    run = "".join(r.choices(ENCODINGS[5][2], k=1_000_000))
    hashes = "\n".join(f"{r.getrandbits(128):032x} file{i}" for i in range(100_000))
    names = " ".join("".join(r.choices(ENCODINGS[4][2], k=30)) + " é" for _ in range(20_000))
    texts = [f"image {run} end", hashes, names + " password=abcdefg " + names]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    rows = {x.doc_id: x for x in secret_spans(df).collect()}
    out = {x.doc_id: x.text for x in redacted(df).collect()}
    assert time.time() - start < 90
    for i, text in enumerate(texts):
        assert [(s.start, s.rank, s.end) for s in rows[i].base] == base(text)
        plain, at = [], 0
        for a, _, e in rows[i].spans:
            if a >= at:
                plain.append(text[at:a])
            at = max(at, e)
        assert out[i] == "[SECRET]".join(plain + [text[at:]])
    assert [(s.start, s.rank, s.end) for s in rows[0].spans] == [(6, 3, 1_000_006)]
    assert len(rows[1].spans) == 100_000 and len(rows[2].spans) > 20_000


def test_candidates_that_touch_base_spans(spark):
    """Only true overlap removes a candidate; neighbours of a span stay."""
    r = random.Random(8)
    token = lambda: "".join(r.choices(ENCODINGS[4][2], k=24))
    texts = []
    for _ in range(200):
        parts = [r.choice([token(), "password=" + token(), f"{r.getrandbits(128):032x}", "AKIA" + "Q" * 16, "so"])
                 for _ in range(r.randint(0, 12))]
        texts.append(r.choice([" ", ",", "é", "", "="]).join(parts))
    df = scanned(spark.createDataFrame([(t,) for t in texts], "text string"), "text", Battery())
    for row in df.collect():
        b = base(row.text)
        found = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", row.text)]
        assert [(c.start, c.end) for c in row.scan.candidates] == [
            (x, y) for x, y in found if not any(p < y and x < q for p, _, q in b)], row.text
