"""Date helpers (X3-X7).  Driver-side helpers only parse *parameters*;
column work stays in built-in expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import as_col, blank


def date_text_dmy(c) -> Column:
    """X3 ``DD/MM/YYYY``."""
    return F.date_format(as_col(c), "dd/MM/yyyy")


def date_text_iso(c) -> Column:
    """X3/X4 ``YYYY-MM-DD`` of ``CAST(ts AS DATE)``."""
    return F.date_format(F.to_date(as_col(c)), "yyyy-MM-dd")


def ts_text(c, micros: bool = False) -> Column:
    """Timezone-free text of a TIMESTAMP_NTZ (used at result edges)."""
    return F.date_format(as_col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS" if micros else "yyyy-MM-dd HH:mm:ss")


def parse_date_param(text: str | None, end_of_day: bool = False) -> dt.datetime | None:
    """X7 ``format_date``: ``YYYY-MM-DD`` -> datetime; the end bound gets
    23:59:00 like the reference; blank -> None; bad text raises ValueError."""
    if blank(text):
        return None
    if isinstance(text, dt.datetime):
        return text
    if isinstance(text, dt.date):
        d = dt.datetime(text.year, text.month, text.day)
    else:
        d = dt.datetime.strptime(text.strip(), "%Y-%m-%d")
    return d.replace(hour=23, minute=59, second=0) if end_of_day else d


def month_key(text: str) -> tuple[int, int]:
    """X6 split of ``'YYYY-MM'`` into (year, month)."""
    y, m = text.strip().split("-")[:2]
    return int(y), int(m)


def month_bounds(text: str) -> tuple[dt.datetime, dt.datetime]:
    """[first instant of month, first instant of next month)."""
    y, m = month_key(text)
    start = dt.datetime(y, m, 1)
    nxt = dt.datetime(y + (m == 12), m % 12 + 1, 1)
    return start, nxt


def parse_ts(c, *formats: str) -> Column:
    """Q9/X7 column form: first format that parses wins; bad text -> NULL."""
    fmts = formats or ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")
    col = as_col(c)
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in fmts]).cast("timestamp_ntz")


def ts_lit(d: dt.datetime) -> Column:
    return F.lit(d).cast("timestamp_ntz")
