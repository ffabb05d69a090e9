import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyspark.operators import aggregates as A
from tallyspark.operators.filters import InvoiceFilter, from_month_same_year, in_month
from tallyspark.operators.paging import page, top_clients
from tallyspark.operators.prorate import with_prorating
from tallyspark.operators.setops import report_union


def test_postings_sum_identical_lines(spark):
    d = dt.datetime(2024, 1, 1)
    bank = spark.createDataFrame([("B", d, "c", D("50.00"), "r1", "x")] * 3 + [("B", d, "c", D("50.00"), "r2", "x")],
                                 "bank_name string, value_date timestamp_ntz, comment string, "
                                 "posting_amount decimal(20,2), ref string, client_name string")
    got = {r.ref: r.total_posting_amount for r in A.postings(bank).collect()}
    assert got == {"r1": D("150.00"), "r2": D("50.00")}


def test_month_filters(spark):
    rows = [(dt.datetime(2024, m, 15),) for m in (2, 3, 4, 12)] + [(dt.datetime(2025, 1, 1),)]
    df = spark.createDataFrame(rows, "d timestamp_ntz")
    assert df.where(in_month("d", "2024-03")).count() == 1
    assert df.where(from_month_same_year("d", "2024-03")).count() == 3


def test_invoice_filter_precedence(spark):
    f = InvoiceFilter(start="2024-01-01", end="2024-01-31", month="2024-05")
    assert f.effective_month is None
    assert InvoiceFilter(month="2024-05").effective_month == "2024-05"
    assert InvoiceFilter(start=None, end=None, rfc="").predicate() is not None


def test_page_slices_and_info(spark):
    df = spark.range(15).withColumnRenamed("id", "k")
    assert [r.k for r in page(df, 2, 10, ["k"]).collect()] == [10, 11, 12, 13, 14]
    info = A.page_info(df, 10).first()
    assert (info.total, info.total_pages) == (15, 2)


def test_top_clients_sorted(spark):
    inc = spark.createDataFrame([(f"c{i}", D(i)) for i in range(8)], "client_name string, sum_total_amount decimal(10,0)")
    assert [r.client_name for r in top_clients(inc, 3).collect()] == ["c7", "c6", "c5"]


def test_prorating_cases(spark):
    df = spark.createDataFrame(
        [(D("116.00"), D("100.00"), D("16.00"), D("0.00"), D("58.00"), "p1"),
         (D("116.00"), D("100.00"), D("16.00"), D("0.00"), None, None),
         (D("116.00"), D("100.00"), D("16.00"), D("0.00"), D("120.00"), "p3"),
         (D("116.00"), D("0.00"), D("16.00"), D("0.00"), D("10.00"), "p4")],
        "total decimal(20,2), subtotal decimal(20,2), iva decimal(20,2), ieps decimal(20,2), "
        "importe_pagado decimal(20,2), uuid_complemento string")
    r = with_prorating(df).collect()
    assert (r[0].subtotal_sat, r[0].iva_cobrado_sat, r[0].ieps_cobrado_sat) == (50.0, 8.0, 0.0)
    assert (r[1].subtotal_sat, r[1].uuid_relacionado, r[1].total_variacion_validador_iva) == (0.0, "Sin Complemento", 0)
    assert r[2].total_variacion_validador_iva == D("-4.00")
    assert r[3].subtotal_sat is None


def test_report_union_text_clash(spark):
    detail = spark.createDataFrame([(1, D("2.50"))], "receipt_number bigint, ieps decimal(20,2)")
    totals = spark.createDataFrame([("$2.50", "$9")], "ieps string, total_sat string")
    out = report_union(detail, totals).orderBy(F.col("receipt_number").asc_nulls_last()).collect()
    assert [(r.receipt_number, r.ieps, r.total_sat) for r in out] == [(1, "2.50", None), (None, "$2.50", "$9")]


def test_dashboard_totals_equal_sum_of_summary(spark):
    bank = spark.createDataFrame([(1, "a", D("1.00")), (2, "a", D("2.00")), (3, "b", D("4.00"))],
                                 "id bigint, bank_name string, posting_amount decimal(20,2)")
    sat = spark.createDataFrame([("x", D("10.00"), D("1.60"), D("0.00"))],
                                "client_name string, total_amount decimal(20,2), vat_16 decimal(20,2), ieps decimal(20,2)")
    tot = {r.metric: r.value for r in A.dashboard_totals(bank, sat).collect()}
    per = A.bank_summary(bank).agg(F.sum("total_posting_amount"), F.sum("total_transactions")).first()
    assert tot["total_amount_transactions"] == float(per[0]) and tot["total_transactions_sum"] == per[1]
