from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(preds) -> Column:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def blank(v) -> bool:
    """Filter parameters: None and '' both mean "not given"."""
    return v is None or (isinstance(v, str) and v.strip() == "")
