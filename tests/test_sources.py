import os
import tempfile
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import FIXTURES
from tallyspark.operators.clean import MissingColumns, Rule, require_columns, split_rejects
from tallyspark.sources.bank import bank_rows, read_bank_extract
from tallyspark.sources.invoices import invoices, read_invoice_xml
from tallyspark.sources.ledgers import clean_ledger, read_ledger, route_bank_sheet
from tallyspark.sources.sinks import seed_banks


def test_invoice_xml_golden(spark):
    raw = read_invoice_xml(spark, os.path.join(FIXTURES, "invoices"))
    sat, rejects = invoices(raw, load_date="2024-02-01")
    got = {r.receipt_number: r for r in sat.collect()}
    assert set(got) == {"1001", "1002", "1003"}
    a, b, c = got["1001"], got["1002"], got["1003"]
    assert (a.tax_rate, a.vat_16, a.subtotal_16, a.vat_0) == ("16%", D("16.00"), D("100.00"), D("0.00"))
    assert a.product_or_service == "Seeds * Freight" and a.client_name == "O'Hara SA"
    # namespace version 4 and no receiver: still read, receiver fields default to ''
    assert (b.tax_rate, b.vat_16, b.vat_0, b.rfc) == ("0%", D("0.00"), D("250.00"), "")
    assert (c.tax_rate, c.vat_16, c.ieps, c.product_or_service) == ("16%0%", D("32.00"), D("22.00"), "A *  * C")
    assert a.file_name.startswith("01-02-2024/")
    reasons = [r.reject_reason for r in rejects.collect()]
    assert any("missing:Folio" in x for x in reasons)
    assert any("corrupt_xml" in x for x in reasons)


def test_bank_extract_golden(spark):
    raw = read_bank_extract(spark, os.path.join(FIXTURES, "bank"))
    rows = bank_rows(raw, load_date="2024-02-01").orderBy("ref").collect()
    assert [r.ref for r in rows] == ["R1", "R5"]          # 0.99, 0 and -3 dropped
    assert rows[0].bank_name == "acme-mxn" and rows[0].posting_amount == D("10.50")
    assert rows[1].value_date is None


def _write_csv(lines):
    d = tempfile.mkdtemp(prefix="ledger-")
    with open(os.path.join(d, "sheet1.csv"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_bhc_fbl5n_duplicate_headers_and_rejects(spark):
    from tallyspark.sources.ledgers import BHC_FBL5N_HEADERS
    hdr = ",".join([*BHC_FBL5N_HEADERS, "line_no"])
    n = len(BHC_FBL5N_HEADERS)

    def row(line, **kv):
        vals = [""] * n + [str(line)]
        for h, v in kv.items():
            vals[BHC_FBL5N_HEADERS.index(h)] = v
        return ",".join(vals)

    ok = {"Clave contabiliz.": "1", "Nº documento": "123.0", "Cuenta": "55", "Doc.compensación": "900",
          "Posición": "1", "Cuenta de mayor": "77", "Referencia": "1001", "Importe en moneda local": "116"}
    bad = dict(ok, **{"Cuenta": ""})
    blank = dict(ok, **{"Nº documento": ""})
    path = _write_csv([hdr, row(2, **ok), row(9, **bad), row(10, **blank), row(11, **ok), row(20), row(100), row(103)])
    good, rejects = clean_ledger(read_ledger(spark, path, "bhc_fbl5n"), "bhc_fbl5n")
    g = good.collect()
    assert len(g) == 2 and g[0].document_number == "123" and g[0].position == "1"
    assert g[0].amount_in_local_currency == D("116.00")
    assert sorted(r.reject_reason for r in rejects.collect()) == [
        "invalid:account", "invalid:document_number", "trailing_row", "trailing_row", "trailing_row"]


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    require_columns(df, ["b"])
    try:
        require_columns(df, ["c"])
        raise AssertionError("expected failure")
    except MissingColumns:
        pass


def test_split_rejects_partition(spark):
    df = spark.createDataFrame([("1",), (None,), ("",)], "x string")
    good, bad = split_rejects(df, [Rule("missing:x", F.col("x") != "")])
    assert good.count() + bad.count() == df.count() and good.count() == 1


def test_route_bank_sheet(spark):
    df = spark.createDataFrame([("mx-ban PBC",), ("mx-ban N8P",), ("mx-ban XYZ",), ("bad name PBC",)], "s string")
    assert [r.t for r in df.select(route_bank_sheet("s").alias("t")).collect()] == ["bank_pbc", "bank_n8p", None, None]


def test_seed_banks_day_first(spark):
    df = seed_banks(spark, [(10.5, "Bank", 7, "19/12/2023"), (0, "Bank", 8, None)])
    assert [str(r.value_date) for r in df.orderBy("document_number").collect()] == ["2023-12-19", "None"]


def _documents(*taxes, uuid="U"):
    from tallyspark.sources.invoices import INVOICE_SCHEMA
    return [{"_Folio": "0012", "_SubTotal": "100", "_Total": "116", "_MetodoPago": "PUE", "_Moneda": "MXN",
             "Impuestos": {"_TotalImpuestosTrasladados": "1", "Traslados": {"Traslado": [
                 {"_Impuesto": c, "_TasaOCuota": r, "_Importe": a} for c, r, a in t]}},
             "Complemento": {"TimbreFiscalDigital": {"_UUID": uuid}}} for t in taxes], INVOICE_SCHEMA


def test_taxes_per_document_exact_and_without_exchange(spark):
    vat, zero = ("002", "0.160000", "16.000000"), ("002", "0.000000", "0")
    docs, schema = _documents([vat, zero] + [("003", "x", "0.004")] * 10, [vat, zero, ("003", "x", "22")],
                              [vat, ("001", "x", "not a number")], [vat, ("003", "x", "bad")])
    raw = spark.createDataFrame(docs, schema).withColumn("source_file", F.lit("f.xml")).withColumn("s3_url", F.lit("p"))
    sat, bad = invoices(raw, load_date="2024-02-01")
    got = sorted((r.ieps, r.tax_rate, r.vat_16, r.subtotal_16, r.vat_0, r.receipt_number) for r in sat.collect())
    assert got == [(D("0.00"), "16%", D("16.00"), D("100.00"), D("0.00"), "0012"),
                   (D("0.04"), "16%0%", D("16.00"), D("100.00"), D("100.00"), "0012"),
                   (D("22.00"), "16%0%", D("16.00"), D("100.00"), D("100.00"), "0012")]  # one stamp, each its own
    assert [r.reject_reason for r in bad.collect()] == ["bad:Importe"]
    assert "Exchange" not in sat._jdf.queryExecution().executedPlan().toString()


def test_lone_start_date_keeps_the_month(spark):
    from tallyspark.operators.filters import InvoiceFilter
    both = InvoiceFilter(start="2024-01-01", end="2024-02-01", month="2024-03")
    assert both.effective_month is None and InvoiceFilter(start="2024-01-01", month="2024-03").effective_month == "2024-03"


def test_page_after(spark):
    from tallyspark.operators.paging import page_after
    rows = [(1, "a"), (1, "b"), (2, None), (2, "a"), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "x int, y string")
    seen, last = [], None
    while part := [tuple(r) for r in page_after(df, ["x", "y"], last, 2).collect()]:
        seen, last = seen + part, part[-1]
    assert seen == [(1, "a"), (1, "b"), (2, "a"), (2, None), (None, "a"), (None, None)]


def test_require_header_exact_case_insensitive(spark):
    from tallyspark.operators.clean import require_header
    df = spark.createDataFrame([(1, 2)], "A int, b int")
    assert require_header(df, ["a", "B"]) and not require_header(df, ["b", "a"])

