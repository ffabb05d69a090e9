"""Quality rules by compression bands.

A text that repeats itself compresses far better than prose of its length, and random or encoded bytes compress
worse.  Each text is compressed with zstandard as a whole and in fixed chunks; its ratios (raw over compressed
bytes) have to lie in a band that depends on the length, because short inputs carry the frame's overhead and long
ones give the compressor more to refer back to.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import words

#: (raw bytes from, lowest ratio, highest ratio) of whole texts; the last row that a length reaches counts.
#: Prose lies well inside: about 1.4 at 300 bytes, 2.0 at 2 kB, 2.4 at 20 kB, 3 and a little above beyond.
WHOLE_BANDS = ((0, 0.0, 2.2), (64, 0.6, 2.2), (256, 1.1, 2.4), (512, 1.2, 2.6), (1024, 1.35, 2.8), (4096, 1.4, 3.0),
               (16384, 1.45, 3.4), (65536, 1.5, 4.0))
#: The same for chunks, which have at most ``chunk_bytes``.
CHUNK_BANDS = ((0, 0.0, 2.2), (64, 0.6, 2.2), (256, 1.1, 2.4), (512, 1.2, 2.6), (1024, 1.3, 2.8))


@dataclass(frozen=True)
class Limits:
    """``bad_share``: a text fails when chunks outside their band hold more than this share of its bytes."""

    whole: tuple = WHOLE_BANDS
    chunks: tuple = CHUNK_BANDS
    chunk_bytes: int = 2048
    bad_share: float = 0.3
    level: int = 3


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "ratio double, bad_chunk_share double, band_verdict string, kept boolean")
SYMBOLS = "#*$%&|<>"


def repeated_words(ws: list[bytes], window: int = 8) -> int:
    """Words covered by windows of ``window`` words that occur twice or more, the first occurrence included."""
    if len(ws) <= window:
        return 0
    wins = list(zip(*(ws[i:] for i in range(window)), strict=False))
    if len(set(wins)) == len(wins):
        return 0
    count, covered = Counter(wins), bytearray(len(ws))
    for i, w in enumerate(wins):
        if count[w] > 1:
            covered[i:i + window] = b"\1" * window
    return sum(covered)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


def band(size: int, bands: tuple) -> tuple[float, float]:
    return next((lo, hi) for least, lo, hi in reversed(bands) if size >= least)


def measure(text: str | None, limits: Limits, compress) -> tuple:
    """One row of FIELDS for one text; a null text is one without words."""
    text = text or ""
    raw, ws = text.encode(), words(text)
    n, repeats = len(ws), repeated_words(ws)
    failed = n < 20 or 100 * repeats > 30 * n
    ratio, bad_share, verdict = 1.0, 0.0, "ok"
    if raw:
        ratio = len(raw) / len(compress(raw))
        lo, hi = band(len(raw), limits.whole)
        bad = 0
        for i in range(0, len(raw), limits.chunk_bytes):
            chunk = raw[i:i + limits.chunk_bytes]
            c_lo, c_hi = band(len(chunk), limits.chunks)
            bad += len(chunk) * (not c_lo <= len(chunk) / len(compress(chunk)) <= c_hi)
        bad_share = bad / len(raw)
        verdict = ("incompressible" if ratio < lo else "repetitive" if ratio > hi
                   else "chunks" if bad_share > limits.bad_share else "ok")
    word_chars = sum(map(len, ws)) + len(text) - len(raw)  # bytes in words, less those beyond one a code point
    return (n, word_chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeats, failed, ratio, bad_share,
            verdict, not failed and verdict == "ok")


def compression_bands(docs: DataFrame, text_col: str = "text", out: str = "quality", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with a struct column ``out`` of FIELDS; a column of that name is replaced, all others stay.

    Whole texts are measured.  A null text counts as empty: no words, so the base rule fails it.  Each row is
    judged alone, so ties and repeated rows get equal results and an empty table gives an empty one.
    """
    @F.pandas_udf(FIELDS)
    def judge(texts: pd.Series) -> pd.DataFrame:
        import zstandard

        compress = zstandard.ZstdCompressor(level=limits.level, write_content_size=True).compress
        rows = [measure(t, limits, compress) for t in texts]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return docs.withColumn(out, judge(F.col(text_col)))
