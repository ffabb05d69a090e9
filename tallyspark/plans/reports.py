"""User-visible reports V5-V10: one lazily built Catalyst plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_text_dmy
from ..functions.money import format_price, money_text
from ..operators.aggregates import (bank_summary, dashboard_totals, distinct_values, income_by_client, invoice_totals,
                                    page_info, postings, sum_by_clearing, total_income)
from ..operators.filters import InvoiceFilter, bank_listing, between_dates, tax_detail
from ..operators.match import attach_bank, match_in_one_join, with_status
from ..operators.paging import order_by_clearing, page, page_after, top_clients
from ..operators.setops import report_union
from ..session import materialize
from .bridge import Model
from .views import conciliations_view, enriched, view_columns

LISTING_BANK_COLS = ("bank_name", "bank_ref", "value_date", "posting_amount_number", "posting_amount",
                     "comment", "status_conciliation")


def matched_per_clearing(view: DataFrame, bank: DataFrame, filt: InvoiceFilter,
                         two_pass: bool = True) -> DataFrame:
    """A2 + A3 (+A4) + J7 (+J9): one matched bank posting per clearing
    document.  Pass order = priority: the client pass (A4) first."""
    b = bank.where(filt.posting_predicate("value_date"))
    passes = [postings(b, by_client=True), postings(b)] if two_pass else [postings(b)]
    return match_in_one_join(sum_by_clearing(view), passes)


def attach_and_classify(view: DataFrame, per_clearing: DataFrame, filt: InvoiceFilter, as_of,
                        null_safe: bool = True, status: bool = True) -> DataFrame:
    """J8 + X2/X3 + X18 on the view rows."""
    out = attach_bank(view, per_clearing, null_safe=null_safe, spread_by=["receipt_number"])
    amt = F.col("total_posting_amount")
    out = out.select(*[c for c in out.columns if c not in ("ref", "value_date", "total_posting_amount")],
                     F.col("ref").alias("bank_ref"),
                     amt.alias("posting_amount_number"),
                     F.when(amt.isNotNull(), money_text(amt)).alias("posting_amount"),
                     date_text_dmy("value_date").alias("value_date"))
    if status:
        out = with_status(out, F.col("bank_name").isNotNull(), filt.start, as_of)
    return out


#: Columns of the view by which postings are matched and attached.
MATCH_COLS = ("receipt_number", "client_name", "clearing_payment_policy", "total_amount")


def shared_view(m, filt: InvoiceFilter | None, materialize_view: bool = True, columns=None) -> DataFrame:
    """The enrichment view feeds several branches (the per-clearing sums, the
    attach join, the totals).  Spark would evaluate its joins once per branch,
    so the joined rows are written once to the shared checkpoint folder and
    read back -- which also cuts lineage, so a lost executor does not recompute
    them; formatting stays a projection of each branch.  With ``columns`` the view has these and those it is matched by;
    joins that serve no other column are left to the optimizer to drop."""
    rows = enriched(m, filt)
    if columns is not None:
        view = view_columns(rows).select(*dict.fromkeys([*MATCH_COLS, *columns]))
        return materialize(view, label="conciliations-view", free_shuffles=True) if materialize_view else view
    return view_columns(materialize(rows, label="conciliations-view", free_shuffles=True) if materialize_view else rows)


def reconciliation_listing(m, filt: InvoiceFilter, as_of, two_pass: bool = True,
                           null_safe: bool = True, materialize_view: bool = True, columns=None) -> DataFrame:
    """V5 detail: every PUE/PPD invoice once (deliberate: the reference
    lists each twice), with the bank posting it reconciles to and its
    status.  ``columns`` are those of the listing to return (all)."""
    own = None if columns is None else [c for c in columns if c not in LISTING_BANK_COLS]
    view = shared_view(m, filt, materialize_view, own)
    per = matched_per_clearing(view, m.bank, filt, two_pass)
    out = attach_and_classify(view, per, filt, as_of, null_safe)
    return out if columns is None else out.select(*columns)


@dataclass
class ListingPage:
    rows: DataFrame
    totals: DataFrame
    info: DataFrame


def reconciliation_page(m: Model, filt: InvoiceFilter, as_of, number: int = 1, size: int = 10) -> ListingPage:
    """V5 with the listing's totals (A1), ordered page (L1+L4) and counts."""
    view = shared_view(m, filt)
    detail = attach_and_classify(view, matched_per_clearing(view, m.bank, filt), filt, as_of)
    return ListingPage(rows=page(detail, number, size, [F.asc_nulls_last("clearing_payment_policy"),
                                                         F.asc("receipt_number")]),
                       totals=invoice_totals(view), info=page_info(view, size))


def reconciliation_report(m, filt: InvoiceFilter, materialize_view: bool = True) -> DataFrame:
    """V6 download: single (plain) pass, no fallback status, totals row
    appended (U3)."""
    view = shared_view(m, filt, materialize_view)
    per = matched_per_clearing(view, m.bank, filt, two_pass=False)
    detail = attach_and_classify(view, per, filt, as_of=None, status=False)
    detail = detail.withColumn("status_conciliation",
                               F.when(F.col("bank_name").isNotNull(), F.lit("Conciliado")))
    return report_union(detail, invoice_totals(view))


def bank_page(m: Model, number: int = 1, size: int = 200, start=None, end=None, account=None) -> DataFrame:
    """V7 bank listing page (F3/F5/F11 + L4)."""
    lst = bank_listing(m.bank_events, start, end, account)
    return page(lst, number, size, ["book_date", "bank_name", "ref"])


def bank_page_after(m, last=None, size: int = 200, start=None, end=None, account=None) -> DataFrame:
    """V7 by keys: the page behind the (book_date, bank_name, ref) of the last row shown."""
    return page_after(bank_listing(m.bank_events, start, end, account), ["book_date", "bank_name", "ref"], last, size)


def bank_page_info(m, size: int = 200, start=None, end=None, account=None) -> DataFrame:
    """V7 ``total`` and ``total_pages``."""
    return page_info(bank_listing(m.bank_events, start, end, account), size)


def dashboard_bank(m: Model, start=None, end=None) -> DataFrame:
    """V8 bank summary (A5 with the optional value-date range, F4)."""
    b = m.bank_events
    pred = between_dates("value_date", start, end) if start and end else None
    return bank_summary(b.where(pred) if pred is not None else b)


def _in_range(df: DataFrame, col: str, start, end) -> DataFrame:
    return df.where(between_dates(col, start, end)) if start and end else df


def dashboard_top_clients(m: Model, n: int = 5, start=None, end=None) -> DataFrame:
    """V8 income records (A6 + L2) of the invoices in the range."""
    return top_clients(income_in_range(m.sat, start, end), n)


def income_in_range(sat: DataFrame, start=None, end=None) -> DataFrame:
    """Income by client of the invoices in the range, by their own date."""
    return income_by_client(_in_range(sat, "cfdi_date", start, end))


def invoices_with_payments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Every invoice with each of its payment complements, or once with none."""
    return invoices.join(payments, invoices["uuid_fiscal"] == payments["id_documento"], "left")


def tax_validator(view: DataFrame) -> DataFrame:
    """The ledgers' tax sums against the invoices', with the differences and their signs."""
    sums = view.agg(F.sum("amount_in_doc_curr_iva_traladado").alias("ledger_vat"), F.sum("vat_16").alias("sat_vat"),
                    F.sum("amount_in_doc_curr_ieps").alias("ledger_ieps"), F.sum("ieps").alias("sat_ieps"))
    vat, ieps = F.col("ledger_vat") - F.col("sat_vat"), F.col("ledger_ieps") - F.col("sat_ieps")
    return sums.select("*", vat.alias("vat_variance"), ieps.alias("ieps_variance"), F.signum(vat).alias("vat_sign"),
                       F.signum(ieps).alias("ieps_sign"))


def income_vs_collected(sat: DataFrame, bank: DataFrame, start=None, end=None) -> DataFrame:
    """Invoiced income beside what the bank collected, each by its own date."""
    parts = [df.agg(F.sum(c).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value") for df, c, name in (
        (_in_range(sat, "cfdi_date", start, end), "total_amount", "total_income"),
        (_in_range(bank, "value_date", start, end), "posting_amount", "total_expenses"))]
    return parts[0].unionByName(parts[1])


@dataclass
class Dashboard:
    banks: DataFrame
    totals: DataFrame
    taxes: DataFrame
    income: DataFrame
    clients: DataFrame


def dashboard_page(m, start=None, end=None, n: int = 5) -> Dashboard:
    """V8 whole: bank rows, totals (A7), tax detail (F12), income against collected (X20) and the top clients, all of
    the same date range."""
    sat, bank = _in_range(m.sat, "cfdi_date", start, end), _in_range(m.bank_events, "value_date", start, end)
    filt = InvoiceFilter(start=start, end=end) if start and end else None
    return Dashboard(bank_summary(bank), dashboard_totals(bank, sat), tax_detail(conciliations_view(m, filt)),
                     income_vs_collected(m.sat, m.bank_events, start, end), top_clients(income_by_client(sat), n))


def _with_total(rows: DataFrame, key: str, sums: dict) -> DataFrame:
    """Sums by ``key`` and over all rows (``is_total``) from one read of ``rows``.  The total is there, with NULL sums,
    also for no rows: one row without values takes part in the sums and keeps no group of its own."""
    values = rows.select(F.col(key), *[c.alias(n) for n, c in sums.items()], F.lit(1).alias("_rows"))
    seed = rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema.fields[:-1]],
                                             F.lit(0).alias("_rows"))
    out = values.unionByName(seed).rollup(key).agg(*[F.sum(n).alias(n) for n in sums], F.sum("_rows").alias("_rows"),
                                                   F.grouping_id().alias("is_total"))
    return out.where("is_total = 1 or _rows > 0")


def dashboard_metrics(m, start=None, end=None, n: int = 5) -> DataFrame:
    """V8 in long form (part, key, value), with one read of the invoices and one of the postings: the totals of a side
    are a row of the same grouping as its clients or banks.  The tax sums are those of the listing's invoices (PUE and
    PPD); the listing's left joins neither drop nor repeat an invoice, so they need no view."""
    sat, bank = _in_range(m.sat, "cfdi_date", start, end), _in_range(m.bank_events, "value_date", start, end)
    listed = F.col("payment_method").isin("PUE", "PPD")
    clients = _with_total(sat, "client_name", {
        "income": F.col("total_amount"), "vat": F.col("vat_16"), "ieps": F.col("ieps"),
        "listed_vat": F.when(listed, F.col("vat_16")), "listed_ieps": F.when(listed, F.col("ieps"))})
    # the total first, then the n largest clients
    clients = clients.orderBy(F.desc("is_total"), F.desc_nulls_last("income"), F.asc_nulls_last("client_name")).limit(n + 1)
    banks = _with_total(bank, "bank_name", {"amount": F.col("posting_amount"),
                                            "postings": F.col("id").isNotNull().cast("long")})

    def line(part, key, value):
        return F.struct(F.lit(part).alias("part"), (F.lit(key) if isinstance(key, str) else key).alias("key"),
                        F.col(value).cast("double").alias("value"))

    def long_form(df, total, each):
        return df.select(F.inline(F.when(F.col("is_total") == 1, F.array(*total)).otherwise(F.array(each))))

    return long_form(clients, [
        line("total", "total_income", "income"), line("total", "vat_16", "vat"), line("total", "ieps", "ieps"),
        line("income", "total_income", "income"), line("tax", "vat_16", "listed_vat"), line("tax", "ieps", "listed_ieps")],
        line("client", F.col("client_name"), "income")).unionByName(long_form(
            banks.withColumn("postings", F.coalesce("postings", F.lit(0))), [
                line("total", "total_amount_transactions", "amount"), line("total", "total_transactions_sum", "postings"),
                line("income", "total_expenses", "amount")], line("bank", F.col("bank_name"), "amount")))


def filter_choices(m: Model) -> DataFrame:
    """V9 filter lists in one frame: (kind, value)."""
    view = conciliations_view(m)
    return (distinct_values(view, "rfc").select(F.lit("rfc").alias("kind"), F.col("rfc").alias("value"))
            .unionByName(distinct_values(view, "client_name")
                         .select(F.lit("client").alias("kind"), F.col("client_name").alias("value")))
            .unionByName(distinct_values(m.bank_events, "bank_name")
                         .select(F.lit("bank").alias("kind"), F.col("bank_name").alias("value"))))


def tax_report(m: Model, filt: InvoiceFilter | None = None) -> tuple[DataFrame, DataFrame]:
    """V10 tax detail (F12) and total income."""
    view = conciliations_view(m, filt)
    return tax_detail(view), total_income(view)


__all__ = ["reconciliation_listing", "reconciliation_page", "reconciliation_report", "bank_page",
           "dashboard_bank", "dashboard_top_clients", "filter_choices", "tax_report", "order_by_clearing",
           "format_price", "matched_per_clearing", "attach_and_classify"]
