"""Filters and projections (F1-F12).  Every predicate is a plain Column
comparison on the stored column, so Catalyst pushes it into the parquet scan
(month filters are written as ranges rather than ``EXTRACT(...) =``)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import all_of, as_col, blank
from ..functions.dates import date_text_iso, month_bounds, parse_date_param, ts_lit

# Payment methods that make an invoice part of the view.
VALID_PAYMENT_METHODS = ("PUE", "PPD")


def valid_invoices(df: DataFrame, col: str = "payment_method") -> DataFrame:
    """F1 ``payment_method = 'PUE' OR payment_method = 'PPD'``."""
    return df.where(F.col(col).isin(*VALID_PAYMENT_METHODS))


def between_dates(c, start=None, end=None) -> Column | None:
    """F2-F4 closed range; the end bound is the end of that day as in the
    reference (23:59:00).  A missing bound is an open bound."""
    s = parse_date_param(start)
    e = parse_date_param(end, end_of_day=True) if not isinstance(end, dt.datetime) else end
    col = as_col(c)
    if s is not None and e is not None:
        return col.between(ts_lit(s), ts_lit(e))
    if s is not None:
        return col >= ts_lit(s)
    if e is not None:
        return col <= ts_lit(e)
    return None


def eq_filters(df: DataFrame, values: dict) -> DataFrame:
    """F5 equality filters applied only for the values that are given."""
    return df.where(all_of([F.col(k) == F.lit(v) for k, v in values.items() if not blank(v)]))


def in_month(c, ym: str) -> Column:
    """F6 ``EXTRACT(MONTH)=m AND EXTRACT(YEAR)=y`` as a pushable range."""
    lo, hi = month_bounds(ym)
    col = as_col(c)
    return (col >= ts_lit(lo)) & (col < ts_lit(hi))


def from_month_same_year(c, ym: str) -> Column:
    """F7 ``year = y AND month >= m``: from the month's start to the end of
    that year (range form of the same predicate)."""
    lo, _ = month_bounds(ym)
    hi = dt.datetime(lo.year + 1, 1, 1)
    col = as_col(c)
    return (col >= ts_lit(lo)) & (col < ts_lit(hi))


def since(c, start) -> Column:
    """F8/F9 lower bound only."""
    return as_col(c) >= ts_lit(parse_date_param(start))


@dataclass(frozen=True)
class InvoiceFilter:
    """the listing's optional filters with the reference's precedence:
    a full date range wins and blanks the month filter; a lone start or end
    date bounds one side beside it.  None and '' both
    mean "not given" (deliberate: the reference turns None bounds into
    ``BETWEEN NULL AND NULL``, an empty result)."""

    start: str | None = None
    end: str | None = None
    rfc: str | None = None
    client: str | None = None
    month: str | None = None

    @property
    def has_range(self) -> bool:
        return not blank(self.start) or not blank(self.end)

    @property
    def effective_month(self) -> str | None:
        full = not blank(self.start) and not blank(self.end)
        return None if full or blank(self.month) else self.month

    def predicate(self, date_col: str = "cfdi_date", rfc_col: str = "rfc",
                  client_col: str = "client_name") -> Column:
        preds = [between_dates(date_col, self.start, self.end) if self.has_range else None]
        if not blank(self.rfc):
            preds.append(F.col(rfc_col) == F.lit(self.rfc))
        if not blank(self.client):
            preds.append(F.col(client_col) == F.lit(self.client))
        if self.effective_month:
            preds.append(in_month(date_col, self.effective_month))
        return all_of(preds)

    def apply(self, df: DataFrame, **cols) -> DataFrame:
        return df.where(self.predicate(**cols))

    def posting_predicate(self, value_col: str = "value_date") -> Column:
        """Postings considered by the matcher: ``value_date >= start`` when a
        start date is given (F8), else the open month filter (F7)."""
        if not blank(self.start):
            return since(value_col, self.start)
        if self.effective_month:
            return from_month_same_year(value_col, self.effective_month)
        return F.lit(True)


# Columns of the bank listing, in the reference's order.
BANK_LISTING_COLS = ("created_at", "bank_name", "account_number", "number", "book_date", "value_date",
                     "posting_amount", "payment_method", "ref", "addref", "posting_text", "payer",
                     "classification", "comment", "file_name")


def bank_listing(bank: DataFrame, start=None, end=None, account=None) -> DataFrame:
    """F11 (+F3, F5): bank rows with dates as ``YYYY-MM-DD``, filtered on
    ``book_date`` and ``bank_name`` when given."""
    pred = all_of([between_dates("book_date", start, end),
                   None if blank(account) else F.col("bank_name") == F.lit(account)])
    dates = {"created_at", "book_date", "value_date"}
    return bank.where(pred).select(*[date_text_iso(c).alias(c) if c in dates else F.col(c)
                                     for c in BANK_LISTING_COLS])


def tax_detail(view: DataFrame) -> DataFrame:
    """F12 tax projection.  The reference projects ``vat_0 AS vat_16``; we
    project the true ``vat_16`` and keep ``vat_0`` beside it."""
    return view.select("receipt_number", "vat_16", "vat_0", "ieps",
                       "amount_in_doc_curr_iva_traladado", "amount_in_doc_curr_ieps")
