"""What queries read, exchange and open."""

import os
import tempfile

from pyspark.sql import functions as F

from tallyspark.functions.parsing import read_cell
from tallyspark.operators.clean import type_and_split
from tallyspark.sources.invoices import INVOICE_SCHEMA, read_invoice_xml, write_invoice_xml
from tallyspark.sources.ledgers import LEDGER_SPECS, read_ledger
from tallyspark.streaming.incremental import committed, ingest_files


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_cells_that_are_taken_or_ruled_are_read(spark):
    spec = LEDGER_SPECS["bhc_fbl3n"]
    raw = spark.createDataFrame([tuple("1" for _ in spec.headers)], ", ".join(f"`{h}` string" for h in spec.headers))
    good, _ = type_and_split(raw, spec)
    plan = plan_of(good.select("reference"))
    assert "_cell_reference" in plan and "_cell_" not in plan.replace("_cell_reference", "")


def test_dates_of_every_format_and_none(spark):
    formats = LEDGER_SPECS["bhc_fbl3n"].date_formats
    cell = read_cell("d", "timestamp", formats)
    texts = ["2024-02-01 10:20:30", "2024-02-01", "01/02/2024", "01.02.2024", "31/31/2024", "2024-02-01 10", "x", " ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "d string").selectExpr("d", f"{cell.value} v", f"{cell.unreadable} u").collect()
    assert [r.v is not None for r in rows] == [True] * 4 + [False] * 5
    assert [r.u for r in rows] == [False] * 4 + [True] * 3 + [False] * 2
    assert cell.value.count("CASE WHEN contains(") == len(formats)


def test_a_sheets_rows_are_not_exchanged_for_their_numbers(spark):
    path = tempfile.mkdtemp(prefix="sheet-")
    with open(f"{path}/a.csv", "w", encoding="utf-8") as f:
        f.write("Reference\nr1\nr2\n")
    sheet = read_ledger(spark, path, "bcs_fbl5n")
    assert "strategy=broadcast" in plan_of(sheet)
    assert [(r.Reference, r.line_no) for r in sheet.orderBy("line_no").collect()] == [("r1", 1), ("r2", 2)]


def test_documents_land_compressed(spark):
    path = tempfile.mkdtemp(prefix="xml-") + "/out"
    docs = spark.range(3).select(F.col("id").cast("string").alias("_Folio"), F.lit("PUE").alias("_MetodoPago"))
    write_invoice_xml(docs, path)
    assert all(n.endswith(".xml.gz") for n in os.listdir(path) if n.startswith("part-"))
    back = read_invoice_xml(spark, path)
    assert sorted(r._Folio for r in back.collect()) == ["0", "1", "2"] and set(INVOICE_SCHEMA.names) <= set(back.columns)


def test_a_replay_opens_no_known_file_and_names_may_be_odd(spark):
    root = tempfile.mkdtemp(prefix="t1-")
    landing, target = f"{root}/landing", f"{root}/target"
    os.makedirs(landing)
    for i, name in enumerate(("a b.csv", "100%25.csv", "x[1]{y}.csv")):
        with open(f"{landing}/{name}", "w", encoding="utf-8") as f:
            f.write(f"k{i},{i}\n")
    strict = {"mode": "FAILFAST"}
    ingest_files(spark, landing, "csv", "k string, v int", target, f"{root}/one", options=strict)
    assert sorted(r.k for r in committed(spark, target).collect()) == ["k0", "k1", "k2"]
    with open(f"{landing}/a b.csv", "w", encoding="utf-8") as f:
        f.write("k0,none\n")  # a reader would fail on it
    ingest_files(spark, landing, "csv", "k string, v int", target, f"{root}/two", options=strict)
    assert committed(spark, target).count() == 3


def test_landed_sheets_are_compressed_and_go_once_they_are_counted(spark):
    """Of six sheets that a query lands and reads, only the counts are left."""
    import __spark_entry__
    from tallyspark.session import ensure_checkpoint_dir
    folder, sizes = ensure_checkpoint_dir(spark).removeprefix("file:"), []
    before = set(os.listdir(folder))
    from tallyspark.plans import rows_only
    land = rows_only.land_sheet

    def landed(sheet, path):
        land(sheet, path)
        files = [f for _, _, names in os.walk(path.removeprefix("file:")) for f in names if not f.startswith((".", "_"))]
        assert files and all(f.endswith(".csv.gz") for f in files)
        sizes.append({x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before})
        return path

    rows_only.land_sheet = landed
    try:
        __spark_entry__.queries()["q12_unreadable_numbers"](spark, "/root/testdata/sf0.001")
    finally:
        rows_only.land_sheet = land
    assert len(sizes) == 6 and all(x <= {"landing-ledger", "unreadable-cells"} for x in sizes)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"unreadable-cells"}


def test_a_listing_of_landed_files_keeps_what_it_reads(spark):
    """Of the landed files and work tables only the view and the bank extracts, and no exchange before the listing's."""
    import __spark_entry__
    from tallyspark.session import FREE_SHUFFLES, ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, setting = set(os.listdir(folder)), spark.conf.get(FREE_SHUFFLES)
    listing = __spark_entry__.queries()["e2e_reconciliation"](spark, "/root/testdata/sf0.001")
    made = set(os.listdir(folder)) - before
    assert {x.rsplit("-", 1)[0] for x in made} == {"conciliations-view", "landing-bank"}
    banks = next(os.path.join(folder, x) for x in made if x.startswith("landing-bank"))
    assert all(f.endswith(".txt.gz") for f in os.listdir(banks) if not f.startswith((".", "_")))
    assert spark.conf.get(FREE_SHUFFLES) == setting and listing.count() > 0
