"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import first_per_key


def listing_union(client_pass: DataFrame, plain_pass: DataFrame) -> DataFrame:
    """U1 parity: the reference concatenates the client-pass and the
    plain-pass lists, so every invoice appears twice.  The listing (V5)
    keeps each invoice once; this operator is the literal concatenation."""
    return client_pass.unionByName(plain_pass)


def priority_union(sources: Sequence[DataFrame], key: str, cols: Sequence[str],
                   order_by: Sequence[str]) -> DataFrame:
    """U2 row-level priority: the first row per key of the first source
    holding the key (contrast J1's per-column fallback)."""
    tagged = None
    for prio, s in enumerate(sources):
        t = s.select(key, *cols, *[o for o in order_by if o not in cols and o != key]).withColumn("_prio", F.lit(prio))
        tagged = t if tagged is None else tagged.unionByName(t)
    return first_per_key(tagged, key, list(cols) + ["_prio"], ["_prio", *order_by]).withColumnRenamed("_prio", "source")


def report_union(detail: DataFrame, totals: DataFrame, clash: Sequence[str] = ("ieps",)) -> DataFrame:
    """U3 detail rows followed by the totals row; columns missing on one
    side are NULL.  A name present on both sides with different types
    (``ieps``: number in the detail, text in the totals) is carried as text."""
    for c in clash:
        if c in detail.columns:
            detail = detail.withColumn(c, F.col(c).cast("string"))
        if c in totals.columns:
            totals = totals.withColumn(c, F.col(c).cast("string"))
    return detail.unionByName(totals, allowMissingColumns=True)
