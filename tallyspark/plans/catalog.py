"""Registry of the inventory's queries over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazily planned DataFrame
over the *whole* input tables.  ``finalize`` normalises result types at the
edge (DECIMAL -> DOUBLE, timestamps -> text, INT -> BIGINT) so results can be
compared with an independent SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_text_dmy, date_text_iso, parse_ts, ts_text
from ..functions.keys import dec_comma, money, norm_key, text_key, trunc_int
from ..functions.money import format_price, money_text
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators.clean import credits_only
from ..operators.lookup import bank_via_ledger, exists_switch, priority_lookup, strict_lookup
from ..operators.match import attach_bank, first_match_per_clearing, match_on_amount, with_status
from ..operators.paging import order_by_clearing, page, top_clients
from ..operators.prorate import sap_sums, with_prorating
from ..operators.setops import listing_union, priority_union
from . import reports as R
from . import views as V
from .bridge import LEDGER_ORDER, Model

# Fixed parameters of the registered queries.
AS_OF = "1998-08-02"
RANGE = FL.InvoiceFilter(start="1996-01-01", end="1997-12-31")
MONTH = "1996-03"
CLIENT = "Customer#000000001"
EVENT_RANGE = ("2024-01-03", "2024-01-09")


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType | T.FloatType):
            c = c.cast("double")
        elif isinstance(t, T.TimestampNTZType | T.TimestampType):
            c = ts_text(c, micros=True)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, Query] = {}


def q(name: str):
    def deco(fn):
        _REG[name] = lambda spark, sf_dir, _fn=fn: finalize(_fn(Model(spark, sf_dir)))
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REG)


def _view(m: Model, filt=None) -> DataFrame:
    return V.conciliations_view(m, filt)


# ----------------------------------------------------------------- filters
@q("f1_valid_invoices")
def _f1(m):
    return FL.valid_invoices(m.sat).select("receipt_number", "payment_method", "total_amount", "cfdi_date",
                                           "client_name")


@q("f2_between_dates")
def _f2(m):
    return m.sat.where(FL.between_dates("cfdi_date", "1996-01-01", "1996-12-31")).select(
        "receipt_number", "cfdi_date", "total_amount")


@q("f3_book_date_range")
def _f3(m):
    return m.bank_events.where(FL.between_dates("book_date", *EVENT_RANGE)).select(
        "id", "bank_name", "book_date", "posting_amount")


@q("f4_value_date_range")
def _f4(m):
    return m.bank.where(FL.between_dates("value_date", "1996-01-01", "1996-06-30")).select(
        "bank_name", "value_date", "posting_amount", "ref")


@q("f5_eq_filters")
def _f5(m):
    return FL.eq_filters(m.sat, {"client_name": CLIENT, "rfc": "RFC1", "payment_method": None}).select(
        "receipt_number", "client_name", "rfc", "total_amount")


@q("f6_in_month")
def _f6(m):
    return FL.valid_invoices(m.sat).where(FL.in_month("cfdi_date", MONTH)).select("receipt_number", "cfdi_date")


@q("f7_from_month_same_year")
def _f7(m):
    return m.bank.where(FL.from_month_same_year("value_date", MONTH)).select(
        "bank_name", "value_date", "posting_amount", "ref")


@q("f8_since")
def _f8(m):
    return m.bank.where(FL.since("value_date", "1998-01-01")).select("bank_name", "value_date", "posting_amount",
                                                                       "ref")


@q("f10_invoice_filter_range")
def _f10a(m):
    f = FL.InvoiceFilter(start="1996-01-01", end="1996-06-30", month="1997-05", client="", rfc=None)
    return f.apply(FL.valid_invoices(m.sat)).select("receipt_number", "cfdi_date", "client_name")


@q("f10_invoice_filter_month")
def _f10b(m):
    f = FL.InvoiceFilter(start="", end="", month="1997-05")
    return f.apply(FL.valid_invoices(m.sat)).select("receipt_number", "cfdi_date", "client_name")


@q("f11_bank_listing")
def _f11(m):
    return FL.bank_listing(m.bank_events, *EVENT_RANGE, account="purchase")


@q("f12_tax_detail")
def _f12(m):
    return FL.tax_detail(_view(m))


# ------------------------------------------------------------------- joins
@q("j1_first_match_lookup")
def _j1(m):
    inv = FL.valid_invoices(m.sat).select("receipt_number")
    return priority_lookup(inv, [m.ledger_a, m.ledger_b], "receipt_number", "reference",
                           list(V.LEDGER_LOOKUP), list(LEDGER_ORDER), rename=V.LEDGER_LOOKUP,
                           hit_label=V.ENTITY_LABELS).withColumnRenamed("_ledger_amount", "ledger_amount")


@q("j2_chained_lookup")
def _j2(m):
    return _view(m).select("receipt_number", "clearing_payment_policy", "amount_in_doc_curr_ieps",
                           "amount_in_doc_curr_iva_traladado")


@q("j3_left_payments")
def _j3(m):
    return R.invoices_with_payments(m.cfdi, m.payments).select(
        "folio_interno", "uuid_fiscal", "uuid_complemento", "importe_pagado")


@q("j4_exists_switch")
def _j4(m):
    out = exists_switch(m.cfdi.select("folio_interno"), "folio_interno", m.iva_bcs, m.iva_bhc, "reference",
                        ["doc_number", "clearing_doc", "iva", "ieps"],
                        exprs=sap_sums("base_16", "cero_nacional", "cero_extranjero", "iva", "ieps"))
    return out.withColumnRenamed("_in_a", "in_a")


@q("j5_strict_lookup")
def _j5(m):
    return strict_lookup(m.cfdi.select("folio_interno"), "folio_interno", m.iva_bcs, "reference",
                         ["doc_number", "base_16"])


def _lines_per_invoice(m):
    """Invoices with the number of their rows in each entity's ledger (not grouped: keys repeat)."""
    flag = F.col("l_returnflag")
    return m.table("orders").select(F.col("o_orderkey").alias("folio_interno")).join(
        m.table("lineitem").groupBy(F.col("l_orderkey").alias("_k")).agg(
            F.count(F.when(flag == "A", 1)).alias("_a"), F.count(F.when(flag == "R", 1)).alias("_b")),
        F.col("folio_interno") == F.col("_k"), "left")


@q("j4_exists_switch_ungrouped")
def _j4u(m):
    """Ledgers with repeated keys: of the chosen side, only keys that are unique are asked for."""
    base = _lines_per_invoice(m).where("_a = 1 or (_a = 0 and _b <= 1)").select("folio_interno")
    return exists_switch(base, "folio_interno", m.ledger_a, m.ledger_b, "reference",
                         ["clearing_document", "account", "amount_in_local_currency"]).withColumnRenamed("_in_a", "in_a")


@q("j5_strict_lookup_ungrouped")
def _j5u(m):
    """Keys that repeat in the ledger but that no row asks for do not fail the lookup."""
    base = _lines_per_invoice(m).where("_b <= 1").select("folio_interno")
    return strict_lookup(base, "folio_interno", m.ledger_b, "reference", ["clearing_document", "amount_in_local_currency"])


@q("j6_bank_via_ledger")
def _j6(m):
    return bank_via_ledger(m.cfdi.select("folio_interno"), "folio_interno", m.iva_bcs, "reference", "doc_number",
                           m.bancos, "document_number", ["depositos", "nombre", "value_date"])


def _groups_and_postings(m):
    view = R.shared_view(m, None)
    return view, A.sum_by_clearing(view)


@q("j7_match_on_amount")
def _j7(m):
    return match_on_amount(A.sum_by_clearing(_view(m)), A.postings(m.bank))  # one branch: nothing to share


@q("j8_attach_bank")
def _j8(m):
    view, groups = _groups_and_postings(m)
    per = first_match_per_clearing([match_on_amount(groups, A.postings(m.bank))])
    return R.attach_and_classify(view, per, FL.InvoiceFilter(), None, status=False).select(
        "receipt_number", "clearing_payment_policy", "bank_name", "bank_ref", "value_date",
        "posting_amount_number", "posting_amount")


@q("j8_attach_bank_strict")
def _j8s(m):
    view, groups = _groups_and_postings(m)
    per = first_match_per_clearing([match_on_amount(groups, A.postings(m.bank))])
    return attach_bank(view, per, null_safe=False, spread_by=["receipt_number"]).select(
        "receipt_number", "clearing_payment_policy", "bank_name", "total_posting_amount")


@q("j9_two_pass_match")
def _j9(m):
    view = _view(m)
    return R.matched_per_clearing(view, m.bank, FL.InvoiceFilter(), two_pass=True)


@q("j10_income_by_client")
def _j10(m):
    """Corrected form: invoices filtered on their own date."""
    return R.income_in_range(m.sat, RANGE.start, RANGE.end)


@q("j10_income_by_client_crossed")
def _j10x(m):
    """Parity: the reference filters *bank* dates without a join predicate,
    so every invoice sum is multiplied by the number of bank rows in range.
    Computed as sum x count (a one-row aggregate, broadcast), never as a
    product of tables."""
    n = m.bank_events.where(FL.between_dates("value_date", *EVENT_RANGE)).agg(F.count(F.lit(1)).alias("_n"))
    inc = A.income_by_client(m.sat)
    j = inc.join(F.broadcast(n), F.lit(True), "inner")
    return j.select("client_name", *[(F.col(c) * F.col("_n")).alias(c)
                                     for c in ("sum_total_amount", "sum_total_vat_16", "sum_total_ieps")])


# ------------------------------------------------------------ aggregations
@q("a1_invoice_totals")
def _a1(m):
    return A.invoice_totals(_view(m))


@q("a1_invoice_totals_range")
def _a1r(m):
    return A.invoice_totals(_view(m, FL.InvoiceFilter(start="1996-01-01", end="1996-03-31")))


@q("a2_sum_by_clearing")
def _a2(m):
    return A.sum_by_clearing(_view(m))


@q("a3_postings")
def _a3(m):
    return A.postings(m.bank)


@q("a4_postings_by_client")
def _a4(m):
    return A.postings(m.bank, by_client=True)


@q("a5_bank_summary")
def _a5(m):
    return A.bank_summary(m.bank_events)


@q("a6_income_by_client")
def _a6(m):
    return A.income_by_client(m.sat)


@q("a7_dashboard_totals")
def _a7(m):
    return A.dashboard_totals(m.bank_events, m.sat)


@q("a7_bank_rollup")
def _a7r(m):
    return A.bank_summary_rollup(m.bank_events)


@q("a8_distinct_rfc")
def _a8a(m):
    return A.distinct_values(_view(m), "rfc")


@q("a8_distinct_client")
def _a8b(m):
    return A.distinct_values(_view(m), "client_name")


@q("a8_distinct_bank")
def _a8c(m):
    return A.distinct_values(m.bank_events, "bank_name")


@q("a9_total_income")
def _a9(m):
    return A.total_income(_view(m))


@q("a10_group_matches")
def _a10(m):
    return A.group_matches(R.reconciliation_listing(m, FL.InvoiceFilter(), AS_OF, columns=("bank_name", "posting_amount_number")))


@q("a11_page_info")
def _a11(m):
    return A.page_info(_view(m), 10)


# --------------------------------------------------------- sorts and pages
@q("l1_order_by_clearing")
def _l1(m):
    return order_by_clearing(_view(m).select("receipt_number", "clearing_payment_policy", "total_amount"))


@q("l2_top_clients")
def _l2(m):
    return top_clients(A.income_by_client(m.sat), 5)


@q("l4_page")
def _l4(m):
    v = _view(m).select("receipt_number", "clearing_payment_policy", "total_amount")
    return page(v, 3, 50, [F.asc_nulls_last("clearing_payment_policy"), "receipt_number"])


# ---------------------------------------------------------------- set ops
@q("u1_listing_union")
def _u1(m):
    view = R.shared_view(m, None)
    filt = FL.InvoiceFilter()
    per_client = R.matched_per_clearing(view, m.bank, filt, two_pass=True)
    per_plain = R.matched_per_clearing(view, m.bank, filt, two_pass=False)
    a = R.attach_and_classify(view, per_client, filt, AS_OF)
    b = R.attach_and_classify(view, per_plain, filt, AS_OF)
    cols = ["receipt_number", "clearing_payment_policy", "bank_name", "status_conciliation"]
    return listing_union(a.select(*cols), b.select(*cols))


@q("u2_priority_union")
def _u2(m):
    return priority_union([m.ledger_a, m.ledger_b], "reference",
                          ["clearing_document", "account", "amount_in_local_currency"], list(LEDGER_ORDER))


@q("u3_report_union")
def _u3(m):
    return R.reconciliation_report(m, RANGE).select(
        "receipt_number", "clearing_payment_policy", "total_amount", "ieps", "bank_name", "posting_amount",
        "status_conciliation", "subtotal_iva_16", "iva_16", "iva_0", "total_sat")


# ---------------------------------------------------------------- scalars
@q("x1_format_price")
def _x1(m):
    return _view(m).select("receipt_number", "formatted_total_amount", "formatted_vat_16", "formatted_ieps",
                           "formatted_subtotal_16", "formatted_vat_0", "formatted_subtotal_me", "diff_sat_sap")


@q("x1_format_price_numeric")
def _x1n(m):
    return m.tax_lines.select("invoice_key", "l_linenumber", "l_partkey",
                              format_price(F.col("amount") * F.lit(-1.5).cast("decimal(3,1)"), numeric=True)
                              .alias("price_text"))


@q("x2_money_text")
def _x2(m):
    return A.postings(m.bank).select("bank_name", "value_date", "ref", "comment",
                                     money_text("total_posting_amount").alias("posting_text"))


@q("x3_date_text")
def _x3(m):
    return m.sat.select("receipt_number", date_text_dmy("cfdi_date").alias("dmy"),
                        date_text_iso("cfdi_date").alias("iso"))


@q("x4_cast_date")
def _x4(m):
    return m.bank_events.select("id", F.to_date("value_date").alias("value_day"))


@q("x5_extract")
def _x5(m):
    return m.sat.select("receipt_number", F.year("cfdi_date").alias("y"), F.month("cfdi_date").alias("m"))


@q("x6_month_key")
def _x6(m):
    k = F.date_format("cfdi_date", "yyyy-MM")
    return m.sat.select("receipt_number", k.alias("month_key"),
                        F.split(k, "-").getItem(0).cast("int").alias("y"),
                        F.split(k, "-").getItem(1).cast("int").alias("m"),
                        F.to_date(F.concat(k, F.lit("-01"))).alias("month_start"))


@q("x7_date_parse")
def _x7(m):
    txt = F.date_format("cfdi_date", "dd/MM/yyyy")
    iso = F.date_format("cfdi_date", "yyyy-MM-dd")
    start = parse_ts(iso, "yyyy-MM-dd")
    return m.sat.select("receipt_number", parse_ts(txt, "yyyy-MM-dd", "dd/MM/yyyy").alias("parsed"),
                        (start + F.expr("INTERVAL 23 HOURS 59 MINUTES")).alias("end_of_day"))


@q("x9_truncate")
def _x9(m):
    return m.bank.select("bank_name", "value_date", "ref", trunc_int("posting_amount").alias("whole"),
                         trunc_int(F.col("posting_amount") - F.lit(50000)).alias("whole_shifted"))


@q("x10_round")
def _x10(m):
    prod = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    li = m.table("lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.round(prod, 2).alias("r_pos"), F.round(-prod, 2).alias("r_neg"))


def _prorated(m):
    inv, pay = m.cfdi, m.payments
    j = inv.join(pay, inv.uuid_fiscal == pay.id_documento, "left")
    return with_prorating(j, total="total_cfdi", paid="importe_pagado", subtotal="subtotal", iva="iva",
                          ieps="ieps", complement="uuid_complemento")


@q("x11_sap_sums")
def _x11(m):
    s = sap_sums("base_16", "cero_nacional", "cero_extranjero", "iva", "ieps")
    return m.iva_bcs.select("reference", s["subtotal_sap"].alias("subtotal_sap"),
                            s["total_aplicacion_sap"].alias("total_aplicacion_sap"))


@q("x12_payment_prorating")
def _x12(m):
    return _prorated(m).select("folio_interno", "uuid_complemento", "subtotal_sat", "iva_cobrado_sat",
                               "ieps_cobrado_sat", "total_aplicacion_sat")


@q("x13_validators")
def _x13(m):
    return _prorated(m).select("folio_interno", "uuid_complemento", "validador_subtotal_validador_iva",
                               "validar_ivas_validador_iva", "validador_ieps_validador_iva")


@q("x14_total_variance")
def _x14(m):
    return _prorated(m).select("folio_interno", "uuid_complemento", "total_variacion_validador_iva")


@q("x15_default_label")
def _x15(m):
    return _prorated(m).select("folio_interno", "uuid_complemento", "uuid_relacionado",
                               "validador_aplicacion_pagos")


@q("x17_diff_sat_sap")
def _x17(m):
    return _view(m).select("receipt_number", "diff_sat_sap")


@q("x18_status")
def _x18(m):
    return R.reconciliation_listing(m, RANGE, AS_OF).select("receipt_number", "status_conciliation")


@q("x18_status_per_invoice")
def _x18p(m):
    view = R.shared_view(m, None)
    per = R.matched_per_clearing(view, m.bank, FL.InvoiceFilter(), two_pass=True)
    out = attach_bank(view, per, spread_by=["receipt_number"])
    return with_status(out, F.col("bank_name").isNotNull(), as_of=AS_OF, per_invoice_date="cfdi_date").select(
        "receipt_number", "status_conciliation")


@q("x19_tax_validator")
def _x19(m):
    return R.tax_validator(_view(m))


@q("x20_income_vs_collected")
def _x20(m):
    return R.income_vs_collected(m.sat, m.bank_events)


@q("x21_entity_label")
def _x21(m):
    return _view(m).select("receipt_number", "entity")


# ------------------------------------------------------ cleaning with SQL
@q("q6_norm_key")
def _q6(m):
    key, s = F.col("l_orderkey").cast("string"), "string"
    return m.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", norm_key(F.concat(key, F.lit(".0"))).alias("k_float"),
        norm_key(money("l_extendedprice")).alias("k_price"),
        norm_key(F.concat(F.lit(" INV-"), F.col("l_linenumber").cast(s), F.lit(" "))).alias("k_alpha"),
        norm_key(F.concat(key, F.lit("E3"))).alias("k_exp"), norm_key(F.concat(F.lit("00"), key)).alias("k_zeros"),
        norm_key(F.concat(F.lit("12345678901234567890"), key)).alias("k_long"),
        text_key(F.concat(F.lit(" 00"), key, F.lit(" "))).alias("t_zeros"),
        text_key(F.concat(F.lit("00"), key, F.lit(".0"))).alias("t_float"))


@q("j1_padded_reference")
def _j1p(m):
    """Folio ``0012`` meets reference ``0012`` that a sheet wrote as ``0012.0``: both ends by one function."""
    folio = text_key(F.concat(F.lit("00"), F.col("o_orderkey").cast("string"))).alias("folio")
    ledger = m.ledger_a.withColumn("reference", text_key(F.concat(F.lit("00"), F.col("reference").cast("string"), F.lit(".0"))))
    return priority_lookup(m.table("orders").select(folio), [ledger], "folio", "reference", ["clearing_document"],
                           ["clearing_document"]).where(F.col("clearing_document").isNotNull())


@q("q7_dec_comma")
def _q7(m):
    li = m.table("lineitem")
    txt = F.regexp_replace(money("l_extendedprice").cast("string"), r"\.", ",")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dec_comma(txt).alias("amount"),
                     dec_comma(F.concat(txt, F.lit("x"))).alias("bad"))


@q("q14_credits_only")
def _q14(m):
    b = m.bank_events.withColumn("posting_amount", F.col("posting_amount") - F.lit(5))
    return credits_only(b).select("id", "bank_name", "posting_amount")


@q("q15_classify_taxes")
def _q15(m):
    return m.invoice_lines_agg


@q("s3_tax_lines")
def _s3(m):
    return m.tax_lines.select("invoice_key", "l_linenumber", "l_partkey", "l_suppkey", "tax_code", "rate", "amount")


# ------------------------------------------------------------------ views
@q("v1_conciliations_view")
def _v1(m):
    return _view(m)


@q("v2_raw_data")
def _v2(m):
    return V.raw_data(m)


@q("v3_conciliaciones")
def _v3(m):
    return V.conciliaciones(m)


@q("v4_dashboard")
def _v4(m):
    return V.dashboard(m)


@q("v5_reconciliation_listing")
def _v5(m):
    return R.reconciliation_listing(m, FL.InvoiceFilter(), AS_OF)


@q("v5_listing_filtered")
def _v5f(m):
    return R.reconciliation_listing(m, RANGE, AS_OF)


@q("v5_page")
def _v5p(m):
    return R.reconciliation_page(m, RANGE, AS_OF, number=2, size=20).rows


@q("v6_report")
def _v6(m):
    return R.reconciliation_report(m, RANGE)


@q("v7_bank_page")
def _v7(m):
    return R.bank_page(m, number=2, size=200, start=EVENT_RANGE[0], end=EVENT_RANGE[1])


@q("v8_bank_summary")
def _v8(m):
    return R.dashboard_bank(m, *EVENT_RANGE)


@q("v8_top_clients")
def _v8t(m):
    return R.dashboard_top_clients(m, 5)


@q("v7_bank_page_after")
def _v7k(m):
    """The first page's last row, then the page behind it."""
    first = R.bank_page_after(m, None, 200, *EVENT_RANGE).orderBy("book_date", "bank_name", "ref").tail(1)[0]
    return R.bank_page_after(m, (first.book_date, first.bank_name, first.ref), 200, *EVENT_RANGE)


@q("v7_bank_page_info")
def _v7i(m):
    return R.bank_page_info(m, 200, *EVENT_RANGE)


@q("v8_dashboard")
def _v8d(m):
    """Every part of the dashboard in long form; both ranges hold some rows only."""
    return R.dashboard_metrics(m, RANGE.start, EVENT_RANGE[1])


@q("v9_filter_choices")
def _v9(m):
    return R.filter_choices(m)


@q("v10_tax_detail")
def _v10(m):
    return R.tax_report(m, RANGE)[0]


@q("v10_total_income")
def _v10i(m):
    return R.tax_report(m, RANGE)[1]
