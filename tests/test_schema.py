"""Tables of the catalogue: creation, defaults, required columns, partitions; the dashboard's reads."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.lookup import exists_switch
from tallyspark.plans import reports as R
from tallyspark.plans.bridge import Model
from tallyspark.session import scratch_path
from tallyspark.sources.schema import (TableSpec, by_month, create_tables, drop_tables, insert_rows, invoice_table,
                                       split_required, tax_ledger_table)

SF = "/root/testdata/sf0.001"
SPEC = "receipt_number bigint, payment_method string, fiscal_uuid string, cfdi_date date, state string, total_me double"


@pytest.fixture
def db(spark, request):
    path = scratch_path(spark, "schema-test")
    name = "t_" + path.rsplit("-", 1)[-1]
    yield name, path
    drop_tables(spark, name)


def rows(spark, data, columns="receipt_number bigint, payment_method string, fiscal_uuid string, cfdi_date date"):
    return spark.createDataFrame(data, columns).withColumn("cfdi_date", F.col("cfdi_date").cast("date"))


def spec_of(spark):
    return invoice_table(spark.createDataFrame([], SPEC).schema)


def test_defaults_required_and_second_creation(spark, db):
    name, path = db
    spec = spec_of(spark)
    views = {"months": f"SELECT month, count(*) AS n FROM `{name}`.invoices GROUP BY month"}
    assert create_tables(spark, name, [spec], path, views) == ["invoices", "months"]
    import datetime as dt
    day = dt.date(2024, 2, 29)
    data = spark.createDataFrame([(1, "PUE", "u1", day, "x"), (1, "PUE", "u1", day, "x"), (2, None, "u2", day, "x"),
                                  (None, None, "u3", day, "x"), (4, "PPD", "u4", None, "x")],
                                 "receipt_number bigint, payment_method string, fiscal_uuid string, cfdi_date date, other string")
    bad = {(r.receipt_number, r.reject_reason) for r in insert_rows(data, name, spec).collect()}
    assert bad == {(2, "payment_method"), (None, "receipt_number, payment_method")}
    assert create_tables(spark, name, [spec], path, views) == ["invoices", "months"]  # nothing is lost or added
    table = spark.table(f"{name}.invoices")
    assert "other" not in table.columns
    got = sorted((r.receipt_number, r.state, r.total_me, r.month, r.created_at is not None) for r in table.collect())
    assert got == [(1, "uploaded", 0.0, "2024-02", True)] * 2 + [(4, "uploaded", 0.0, None, True)]
    assert {(r.month, r.n) for r in spark.table(f"{name}.months").collect()} == {("2024-02", 2), (None, 1)}
    # NULL in a column with a default, and a given value
    insert_rows(spark.createDataFrame([(5, "PUE", "u5", day, None, 7.5)], SPEC), name, spec)
    assert spark.table(f"{name}.invoices").where("receipt_number = 5").select("state", "total_me").first() == ("uploaded", 7.5)
    drop_tables(spark, name)
    assert not spark.catalog.databaseExists(name)
    drop_tables(spark, name)  # a second time nothing happens


def test_empty_rows_and_absent_required_column(spark, db):
    name, path = db
    spec = spec_of(spark)
    create_tables(spark, name, [spec], path)
    assert insert_rows(spark.createDataFrame([], SPEC), name, spec).collect() == []
    assert spark.table(f"{name}.invoices").count() == 0
    good, bad = split_required(spark.createDataFrame([(1, "PUE")], "receipt_number bigint, payment_method string"), spec)
    assert good.count() == 0 and bad.first().reject_reason == "fiscal_uuid"
    assert split_required(spark.range(2), TableSpec("t", spark.range(1).schema))[0].count() == 2


def partition_filters(df):
    return re.findall(r"PartitionFilters: \[(.*?)\]\n", df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def test_dates_read_their_months_only(spark, db):
    name, path = db
    m = Model(spark, SF)
    spec = invoice_table(m.sat.schema)
    create_tables(spark, name, [spec], path)
    insert_rows(m.sat.where("payment_method is not null"), name, spec)
    table = spark.table(f"{name}.invoices")
    some = by_month(table, "cfdi_date", "1996-03-10", "1996-05-20")
    assert any("month" in f for f in partition_filters(some))
    assert {f.split("month=")[1][:7] for f in some.inputFiles()} >= {"1996-03", "1996-04", "1996-05"}
    months = [r.month for r in some.select("month").distinct().collect()]
    assert sorted(months) == ["1996-03", "1996-04", "1996-05"]
    span = "cast(cfdi_date as date) between '1996-03-10' and '1996-05-20' and payment_method is not null"
    assert some.count() == m.sat.where(span).count()
    assert by_month(table, "cfdi_date", "1998-01-01", None).count() == m.sat.where(
        "payment_method is not null and cast(cfdi_date as date) >= '1998-01-01'").count()
    assert by_month(table, "cfdi_date").count() == table.count()


def test_ledger_partitions_are_pruned_by_a_join(spark, db):
    """Accounts that a small table asks for prune the ledger's partitions at run time."""
    from tallyspark.plans.rows_only import tax_ledger_rows
    name, path = db
    ledger = tax_ledger_rows(Model(spark, SF))
    spec = tax_ledger_table(ledger.drop("entity", "tax_account").schema)
    create_tables(spark, name, [spec], path)
    insert_rows(ledger, name, spec)
    asked = spark.createDataFrame([("VAT", 1), ("IEPS", 2)], "tax_account string, wanted int").where("wanted = 1")
    joined = spark.table(f"{name}.tax_ledger").join(F.broadcast(asked), "tax_account")
    assert any("dynamicpruning" in f for f in partition_filters(joined))
    assert joined.count() == ledger.where("tax_account = 'VAT'").count()


def test_dashboard_reads_each_side_once(spark):
    metrics = R.dashboard_metrics(Model(spark, SF), "1996-01-01", "2024-01-20")
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan)
    assert sorted(scans) == ["customer", "events", "lineitem", "orders"], scans


def test_dashboard_of_no_rows(spark):
    metrics = {(r.part, r.key): r.value for r in R.dashboard_metrics(Model(spark, SF), "1901-01-01", "1901-01-02").collect()}
    assert metrics == {("total", "total_income"): None, ("total", "vat_16"): None, ("total", "ieps"): None,
                       ("income", "total_income"): None, ("tax", "vat_16"): None, ("tax", "ieps"): None,
                       ("total", "total_amount_transactions"): None, ("total", "total_transactions_sum"): 0.0,
                       ("income", "total_expenses"): None}


def test_loose_switch_takes_one_defined_row(spark):
    base = spark.createDataFrame([(1,), (2,), (None,)], "folio bigint")
    a = spark.createDataFrame([(1, "z", 1), (1, "x", 9), (1, "y", 0), (None, "n", 5)], "reference bigint, doc string, iva int")
    b = spark.createDataFrame([(2, None, 3), (2, "q", 1)], "reference bigint, doc string, iva int")
    for parts in (1, 3):
        got = {r.folio: (r.doc, r.iva) for r in exists_switch(
            base, "folio", a.repartition(parts), b.repartition(parts), "reference", ["doc", "iva"], strict=False).collect()}
        assert got == {1: ("x", 9), 2: (None, 3), None: (None, None)}
