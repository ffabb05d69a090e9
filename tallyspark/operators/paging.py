"""Sorts, limits and pages (L1-L4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import as_col


def order_by_clearing(df: DataFrame, key: str = "clearing_payment_policy",
                      tie: Sequence[str] = ("receipt_number",)) -> DataFrame:
    """L1 ``ORDER BY clearing_payment_policy`` (NULLS LAST like Postgres),
    with a tie-break so the order is total and pages are stable."""
    return df.orderBy(F.asc_nulls_last(key), *[F.asc(t) for t in tie])


def top_clients(income: DataFrame, n: int = 5) -> DataFrame:
    """L2: the ``n`` clients with the highest income (the reference takes
    ``LIMIT 5`` of an unsorted aggregate; we sort).  Planned as
    TakeOrderedAndProject: each task keeps its top ``n`` only."""
    return income.orderBy(F.desc("sum_total_amount"), F.asc("client_name")).limit(n)


def page(df: DataFrame, number: int, size: int, order_by: Sequence[str | Column]) -> DataFrame:
    """L4: rows ``[(number-1)*size, number*size)`` of a total order."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*[as_col(o) for o in order_by]).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order_by: Sequence[str], last: Sequence | None, size: int) -> DataFrame:
    """L4 by keys: the ``size`` rows that follow the row with the values ``last`` in ``order_by`` (ascending, NULLs
    last; a total order); None: the first page.  Any depth costs a filter and each task's top ``size``, where an offset
    would carry all earlier rows."""
    keys = [F.col(c) for c in order_by]
    if last is not None:
        tests = []
        for i, (key, value) in enumerate(zip(keys, last, strict=True)):
            same = [k.eqNullSafe(F.lit(v)) for k, v in zip(keys[:i], last[:i], strict=True)]
            beyond = F.lit(False) if value is None else key.isNull() | (key > F.lit(value))
            tests.append(reduce(lambda a, b: a & b, [*same, beyond]))
        df = df.where(reduce(lambda a, b: a | b, tests))
    return df.orderBy(*[k.asc_nulls_last() for k in keys]).limit(size)
