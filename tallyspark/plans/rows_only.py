"""Registry entries for sources, sinks, cleaning and streaming.

Each entry first lands input files derived from the driver tables (invoice
XML, bank extract JSON, ledger sheets as CSV) in a new folder below the
shared checkpoint folder, then reads them back through the source operators.
Where the round trip is lossless the oracle is plain SQL over the original
tables (``ROWS_ONLY_ORACLE``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import register_functions
from ..operators.clean import new_files_only
from ..operators.filters import InvoiceFilter
from ..operators.lookup import chained_lookup
from ..session import discard, discard_folder, freed_shuffles, materialize, scratch_path
from ..sources.bank import bank_documents, bank_rows, file_stem, parse_extracts, read_bank_extract
from ..sources.invoices import invoice_documents, invoices, read_invoice_xml, tax_lines, write_invoice_xml
from ..sources.ledgers import LEDGER_SPECS, clean_ledger, dispatch_sheets, read_ledger, route_bank_sheet
from ..sources.schema import (by_month, create_tables, insert_rows, invoice_table, posting_table,
                              tax_ledger_table)
from ..sources.sinks import append, create_catalog, write_json_rows, write_report
from ..streaming.incremental import REJECTS, committed, ingest_files, ingest_invoices
from .bridge import LINE_ORDER, Model
from .catalog import AS_OF, finalize
from .ingested import counted, ingest
from .reports import reconciliation_listing

_REG = {}
LOAD_DATE = "2024-02-01"


def q(name):
    def deco(fn):
        _REG[name] = lambda spark, sf_dir, _fn=fn: finalize(_fn(Model(spark, sf_dir)))
        return fn
    return deco


def rows_only_registry():
    return dict(_REG)


# ------------------------------------------------------------------ landing
def land_invoices(m: Model) -> str:
    path = scratch_path(m.spark, "landing-invoices")
    write_invoice_xml(documents_where(m), path)
    return path


def documents_where(m: Model, which: str = "true", six_decimals: bool = False) -> DataFrame:
    """Documents of the orders that a condition on their key, ``{key}``, chooses; other orders' lines are not exchanged."""
    return invoice_documents(m.table("orders").where(which.format(key="o_orderkey")), m.table("customer"),
                             m.table("lineitem").where(which.format(key="l_orderkey")), six_decimals)


def land_bank_extracts(m: Model) -> str:
    path = scratch_path(m.spark, "landing-bank")
    bank_documents(m.bank_events).write.mode("overwrite").text(path)
    return path


def _dec_comma(c):
    return F.regexp_replace(c.cast("decimal(20,5)").cast("string"), r"\.", ",")


ORDERS_A_FILE = 2_500  #: order keys whose rows a landed sheet file holds
POSTINGS_A_FILE = 500_000  #: a compressed file is read by one task


def _text(cols: dict, headers) -> list:
    """The headers' columns, NULL where no value is given; a repeated header gets the suffix that the reader gives it."""
    out = []
    for i, h in enumerate(headers):
        first = headers.index(h) == i
        out.append((cols.get(h, F.lit(None).cast("string")) if first else F.lit(None).cast("string"))
                   .alias(h if first else f"{h}{i}"))
    return out


def _ledger_values(kind: str) -> dict:
    """Text cells of a ledger row made from a lineitem row.  Document numbers are blank in the middle of the sheet for
    part 11, and the account for supplier 7."""
    spec, s = LEDGER_SPECS[kind], "string"
    cells = {
        "document_number": F.when(F.col("l_partkey") != 11, F.concat(F.col("l_orderkey").cast(s), F.lit(".0"))),
        "account": F.when(F.col("l_suppkey") != 7, F.col("l_suppkey").cast(s)),
        "gl_account": F.when(F.col("l_suppkey") != 7, F.col("l_suppkey").cast(s)),
        "fiscal_year": F.year("l_shipdate").cast(s), "reference": F.col("l_orderkey").cast(s),
        "invoice_reference": F.col("l_linenumber").cast(s), "clearing_document": F.col("l_partkey").cast(s),
        "line_item": F.col("l_linenumber").cast(s), "position": F.col("l_linenumber").cast(s),
        "posting_key": F.lit("40"), "text": F.concat(F.lit("Part'"), F.col("l_partkey").cast(s)),
        "amount_in_doc_curr": _dec_comma(F.col("l_extendedprice")),
        "eff_exchange_rate": _dec_comma(F.col("l_discount")),
        "amount_in_local_currency": _dec_comma(F.col("l_extendedprice")),
        "posting_date": F.date_format("l_shipdate", "dd/MM/yyyy"), "document_currency": F.lit("MXN"),
    }
    return {spec.columns[c]: v for c, v in cells.items() if c in spec.columns}


def ledger_sheet(m: Model, kind: str = "bhc_fbl3n", flag: str = "R", cells: dict | None = None) -> tuple[DataFrame, list]:
    """Sheet rows from lineitem, dealt over files by order key (``chunk``), each with the kind's trailing total rows
    (``total``; no document number), and the sheet's columns, the rows' cells as text."""
    spec = LEDGER_SPECS[kind]
    values = {**_ledger_values(kind), **(cells or {})}
    li = m.table("lineitem").where(F.col("l_returnflag") == flag)
    rows = li.select(F.lpad(F.floor(F.col("l_orderkey") / ORDERS_A_FILE).cast("string"), 8, "0").alias("chunk"),
                     F.lit(False).alias("total"), F.lit(None).cast("string").alias("_total"), "*")
    if not spec.trailing_rows:
        return rows, _text(values, spec.headers)
    amount = spec.columns["amount_in_local_currency"]
    total = F.regexp_replace(F.sum(F.regexp_replace(values[amount], ",", ".").try_cast("decimal(20,2)")).cast("string"), r"\.", ",")
    totals = rows.groupBy("chunk").agg(F.max(F.struct("l_orderkey", *LINE_ORDER)).alias("_last"), total.alias("_total"))
    totals = totals.select("chunk", F.lit(True).alias("total"), "_total", "_last.*",
                           F.explode(F.sequence(F.lit(1), F.lit(spec.trailing_rows))).alias("_")).drop("_")
    values = {h: F.when(~F.col("total"), v) for h, v in values.items()}
    values[amount] = F.coalesce("_total", values[amount])
    return rows.unionByName(totals, allowMissingColumns=True), _text(values, spec.headers)


def land_sheet(sheet: tuple[DataFrame, list], path: str) -> str:
    """Rows are exchanged as numbers, and become text in their files, which are compressed."""
    rows, text = sheet
    with freed_shuffles(rows.sparkSession):
        (rows.repartition("chunk").sortWithinPartitions("chunk", "total", "l_orderkey", *LINE_ORDER).select("chunk", *text)
         .write.partitionBy("chunk").option("header", True).option("compression", "gzip").mode("overwrite").csv(path))
    return path


def land_ledger(m: Model, kind: str = "bhc_fbl3n", flag: str = "R") -> str:
    return land_sheet(ledger_sheet(m, kind, flag), scratch_path(m.spark, "landing-ledger"))


def land_workbooks(m: Model, kinds: tuple[str, ...]) -> str:
    """A landing folder with sheets of the given kinds, of both entities: ``entity=<e>/sheet=<name>``, and one that
    feeds no table."""
    root = scratch_path(m.spark, "landing-workbooks")
    for entity, sheet, kind, flag in (("BCS", "IVA cobrado 2440015", "bcs_fbl3n", "A"), ("BCS", "Sheet1", "bcs_fbl5n", "A"),
                                      ("BHC", "Sheet1", "bhc_fbl5n", "R"), ("BHC", "IEPS 2440020", "bhc_fbl3n", "R")):
        if kind in kinds:
            land_sheet(ledger_sheet(m, kind, flag), f"{root}/entity={entity}/sheet={sheet}")
    for entity, sheet, kind in (("BCS", "mx-ban N8P", "bank_n8p"), ("BHC", "mx-oth N8P", "bank_n8p"), ("BCS", "Notes", "bank_pbc")):
        if kind not in kinds and sheet != "Notes":
            continue
        bank_sheet(m, kind).write.option("header", True).mode("overwrite").csv(f"{root}/entity={entity}/sheet={sheet}")
    return root


# ---------------------------------------------------------------- sources
@q("s1_read_invoices")
def _s1(m):
    sat, _ = invoices(read_invoice_xml(m.spark, land_invoices(m)), load_date=LOAD_DATE)
    return sat.select("receipt_number", "rfc", "client_name", "cfdi_use", "payment_method", "cfdi_date", "currency",
                      "total_amount", "subtotal_16", "vat_16", "vat_0", "ieps", "tax_rate", "fiscal_uuid")


@q("s1_reuploaded_invoices")
def _s1r(m):
    """Every tenth order's document also under a second file name; tax amounts with six decimals."""
    path, again = scratch_path(m.spark, "landing-invoices"), scratch_path(m.spark, "landing-invoices")
    for folder, which in ((path, "true"), (again, "{key} % 10 = 0")):
        write_invoice_xml(documents_where(m, which, six_decimals=True), folder)
    sat, _ = invoices(read_invoice_xml(m.spark, path).unionByName(read_invoice_xml(m.spark, again)), load_date=LOAD_DATE)
    return sat.select("receipt_number", "vat_16", "ieps", "tax_rate", "fiscal_uuid")


@q("s2_concept_text")
def _s2(m):
    sat, _ = invoices(read_invoice_xml(m.spark, land_invoices(m)), load_date=LOAD_DATE)
    return sat.select("receipt_number", "product_or_service")


@q("s3_tax_lines_xml")
def _s3x(m):
    raw = read_invoice_xml(m.spark, land_invoices(m)).withColumn(
        "fiscal_uuid", F.col("Complemento.TimbreFiscalDigital._UUID"))
    return tax_lines(raw).drop("amount_text")


@q("s4_read_bank_extract")
def _s4(m):
    raw = read_bank_extract(m.spark, land_bank_extracts(m), one_document_per_file=False)
    return bank_rows(raw, load_date=LOAD_DATE).select("bank_name", "book_date", "value_date", "posting_amount",
                                                      "payment_method", "ref", "comment", "client_name")


@q("s5_file_stem")
def _s5(m):
    path = F.concat(F.lit("s3a://landing/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".v1.json"))
    return m.table("events").select("event_id", file_stem(path).alias("stem"), file_stem(F.col("event_type")).alias("plain"))


LEDGER_OUT = ("document_number", "gl_account", "reference", "invoice_reference", "clearing_document", "text",
              "amount_in_doc_curr", "eff_exchange_rate", "amount_in_local_currency", "posting_date")


@q("s6_read_ledger")
def _s6(m):
    good, _ = clean_ledger(read_ledger(m.spark, land_ledger(m), "bhc_fbl3n"), "bhc_fbl3n")
    return good.select(*LEDGER_OUT, "line_item", "fiscal_year")


@q("s6_bcs_fbl3n")
def _s6a(m):
    return dispatch_sheets(m.spark, land_workbooks(m, ("bcs_fbl3n", "bcs_fbl5n")))["bcs_iva_cobrado_2440015"][0].select(
        *LEDGER_OUT, "line_item", "fiscal_year")


@q("s6_bcs_fbl5n")
def _s6b(m):
    return dispatch_sheets(m.spark, land_workbooks(m, ("bcs_fbl5n", "bhc_fbl5n")))["bcs_fbl5n"][0].select(*LEDGER_OUT, "account")


@q("s6_bhc_fbl5n")
def _s6c(m):
    return dispatch_sheets(m.spark, land_workbooks(m, ("bcs_fbl5n", "bhc_fbl5n")))["bhc_fbl5n"][0].select(*LEDGER_OUT, "account", "position", "posting_key")


BANK_SHEET_OUT = ("business_area", "document_number", "account", "fiscal_year", "amount_in_local_currency",
                  "posting_date", "text")


@q("s6_bank_n8p")
def _s6d(m):
    """Two entities' sheets in one table."""
    return dispatch_sheets(m.spark, land_workbooks(m, ("bank_n8p",)))["bank_n8p"][0].select(*BANK_SHEET_OUT)


@q("s7_route_bank_sheet")
def _s7(m):
    s, n, r = m.table("supplier"), m.table("nation"), m.table("region")
    sheets = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
              .select("s_suppkey", F.concat(F.lower(F.substring("n_name", 1, 2)), F.lit("-"),
                                            F.lower(F.substring("r_name", 1, 3)), F.lit(" "),
                                            F.element_at(F.array(F.lit("PBC"), F.lit("N8P"), F.lit("XYZ")),
                                                         (F.pmod("s_suppkey", F.lit(3)) + 1).cast("int")))
                      .alias("sheet")))
    return sheets.select("s_suppkey", "sheet", route_bank_sheet("sheet").alias("target"))


# --------------------------------------------------------------- cleaning
def _cleaned(m, kind):
    return clean_ledger(read_ledger(m.spark, land_ledger(m, kind), kind, file_order="name"), kind)


def _trimmed(m, kind):
    """What the trim leaves: the good rows and the rejects of other reasons."""
    good, bad = _cleaned(m, kind)
    key = F.regexp_replace(F.col(f"`{LEDGER_SPECS[kind].columns['reference']}`"), "'", "")
    return good.select("reference", "line_no").unionByName(
        bad.where("reject_reason <> 'trailing_row'").select(key.alias("reference"), "line_no")).select(
        "reference", F.col("line_no").cast("bigint").alias("line_no"))


@q("q4_drop_trailing_rows")
def _q4(m):
    return _trimmed(m, "bhc_fbl3n")


@q("q4_drop_three_rows")
def _q4b(m):
    return _trimmed(m, "bhc_fbl5n")


@q("q11_split_rejects")
def _q11(m):
    _, bad = _cleaned(m, "bhc_fbl3n")
    return bad.where("reject_reason <> 'trailing_row'").select(
        F.col("Nº documento").alias("document_text"), F.col("Posición").alias("position"), "reject_reason")


@q("q11_partition")
def _q11p(m):
    """Each landed row is good, rejected or trimmed, once; by counts and sums of their numbers in their files."""
    parts = None
    for kind in ("bhc_fbl3n", "bhc_fbl5n"):
        good, bad = _cleaned(m, kind)
        reason = F.when(F.col("reject_reason") == "trailing_row", "trimmed").otherwise("rejected")
        part = good.select("line_no", F.lit("good").alias("part")).unionByName(bad.select("line_no", reason.alias("part")))
        part = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))
        part = part.select(F.lit(kind).alias("kind"), "part", "n", "lines")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def unreadable_cells(kind: str) -> dict:
    """Texts that are no numbers or dates, each in its own share of the rows: the rate where the part is a multiple of
    5, the local amount of 7, the withholding of 9, the posting date of 11; blank amounts where it is one of 13."""
    spec, p = LEDGER_SPECS[kind], F.col("l_partkey")
    cells = {"eff_exchange_rate": F.when(p % 5 == 0, "abc").otherwise(_dec_comma(F.col("l_discount"))),
             "amount_in_local_currency": F.when(p % 7 == 0, "12,3,4").when(p % 13 != 0, _dec_comma(F.col("l_extendedprice"))),
             "posting_date": F.when(p % 11 == 0, "31/31/2024").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")),
             "fiscal_year": F.lit("2024"), "document_number": F.col("l_orderkey").cast("string"),
             "account": F.col("l_suppkey").cast("string"), "gl_account": F.col("l_suppkey").cast("string"),
             "item": F.col("l_linenumber").cast("string")}
    for c in ("withholding_tax_amnt", "withholding_amount"):
        cells[c] = F.when(p % 9 == 0, "n/a").otherwise("1,5")
    return {spec.columns[c]: v for c, v in cells.items() if c in spec.columns}


@q("q12_unreadable_numbers")
def _q12(m):
    """Good rows and rejects of all six kinds, by reason; one kind's sheet at a time is kept."""
    parts = None
    for kind in LEDGER_SPECS:
        path = land_sheet(ledger_sheet(m, kind, "R", unreadable_cells(kind)), scratch_path(m.spark, "landing-ledger"))
        raw = read_ledger(m.spark, path, kind, file_order="name")
        discard_folder(m.spark, path)
        good, bad = clean_ledger(raw, kind)
        good = good.groupBy().agg(F.lit("").alias("reason"), F.count(F.lit(1)).alias("n"),
                                  F.sum(F.col("amount_in_local_currency").cast("decimal(20,2)")).alias("amount"),
                                  F.count("eff_exchange_rate").alias("rates"), F.sum("line_no").alias("lines"))
        bad = bad.where("reject_reason <> 'trailing_row'").groupBy(F.col("reject_reason").alias("reason")).agg(
            F.count(F.lit(1)).alias("n"), F.lit(None).cast("decimal(30,2)").alias("amount"),
            F.lit(None).cast("bigint").alias("rates"), F.sum("line_no").alias("lines"))
        part = materialize(good.unionByName(bad).select(F.lit(kind).alias("kind"), "*"), m.spark, "unreadable-cells",
                           free_shuffles=True)
        discard(raw)
        parts = part if parts is None else parts.unionByName(part)
    return parts


@q("q13_new_files_only")
def _q13(m):
    """The files of even orders are registered already; all files are offered again."""
    paths = [scratch_path(m.spark, "landing-invoices") for _ in range(2)]
    for rest, path in enumerate(paths):
        write_invoice_xml(documents_where(m, f"{{key}} % 2 = {rest}"), path)
    even, odd = (read_invoice_xml(m.spark, p) for p in paths)
    # a stored table, whose size is known when the join is planned
    registry = materialize(even.select(F.col("s3_url").alias("file")).distinct(), m.spark, "registry")
    fresh = new_files_only(even.unionByName(odd).withColumn("file", F.col("s3_url")), registry, "file")
    sat, _ = invoices(fresh.drop("file"), load_date=LOAD_DATE)
    return sat.select("receipt_number", "fiscal_uuid", "total_amount")


def bank_sheet(m: Model, kind: str = "bank_pbc") -> DataFrame:
    """A bank auxiliary sheet from events; rows of type 'error' carry the 'Cleared/open items' marker in Business
    Area."""
    spec = LEDGER_SPECS[kind]
    ev = m.table("events")
    vals = {
        "Business Area": F.when(F.col("event_type") == "error", F.lit("Cleared/open items"))
                          .otherwise(F.concat(F.lit("BA-"), F.col("event_type"))),
        "Document Number": F.col("event_id").cast("string"),
        "Account": F.col("user_id").cast("string"),
        "Fiscal Year": F.year("ts").cast("string"),
        "Amount in local currency": F.col("value").cast("decimal(20,2)").cast("string"),
        "Posting Date": F.date_format("ts", "yyyy-MM-dd"),
        "Text": F.col("props"),
    }
    return ev.select(F.lit("mx-ban PBC").alias("sheet"),
                     *[(vals.get(h, F.lit(None).cast("string"))).alias(h) for h in spec.headers])


@q("q5_drop_markers")
def _q5(m):
    path = scratch_path(m.spark, "landing-bank-sheet")
    bank_sheet(m).write.option("header", True).mode("overwrite").csv(path)
    raw = read_ledger(m.spark, path, "bank_pbc")
    raw = raw.where(route_bank_sheet("sheet") == F.lit("bank_pbc"))
    good, _ = clean_ledger(raw, "bank_pbc")
    return good.select("business_area", "document_number", "account", "fiscal_year", "amount_in_local_currency",
                       "posting_date", "text")


# --------------------------------------------------------- ingest to view
@q("e2e_reconciliation")
def _e2e(m):
    """Invoice XML, two open-item sheets, two tax-ledger sheets and bank extracts, landed and read; then V5.  A sheet goes
    once its rows are numbered, these once the rows that count are written, and what the listing's view reads with that."""
    bills = land_invoices(m)
    root = scratch_path(m.spark, "landing-e2e")
    for entity, sheet, kind, flag in (("BCS", "Sheet1", "bcs_fbl5n", "A"), ("BHC", "Sheet1", "bhc_fbl5n", "R"),
                                      ("BCS", "IEPS 2440020", "bcs_fbl3n", "A"), ("BHC", "IVA Trasladado 2440015", "bhc_fbl3n", "N")):
        land_sheet(ledger_sheet(m, kind, flag), f"{root}/entity={entity}/sheet={sheet}")
    missing = [F.lit(None).cast("string").alias(c) for c in ("payment_method", "addref", "payer", "posting_text")]
    banks = scratch_path(m.spark, "landing-bank")
    (bank_documents(m.bank.select("*", *missing)).write.option("compression", "gzip")
     .option("maxRecordsPerFile", POSTINGS_A_FILE).mode("overwrite").text(banks))
    tables = counted(ingest(m.spark, bills, root, banks, LOAD_DATE, one_document_per_file=False, file_order="name",
                            keep=False))
    discard_folder(m.spark, root)  # sheets that feed no table, and empty folders
    listing = reconciliation_listing(tables, InvoiceFilter(), AS_OF, columns=(
        "receipt_number", "client_name", "total_amount", "account", "clearing_payment_policy", "provision_policy_document",
        "t_c_dof", "invoice_reference", "amount_in_doc_curr_ieps", "amount_in_doc_curr_iva_traladado", "entity",
        "bank_name", "bank_ref", "value_date", "posting_amount", "status_conciliation"))
    for table in (tables.sat, tables.ledger_a, tables.ledger_b, tables.aux_ieps, tables.aux_iva):
        discard(table)
    return listing


# ------------------------------------------------------------------ sinks
@q("k1_append")
def _k1(m):
    path = scratch_path(m.spark, "table-sat")
    sat = m.sat.select("receipt_number", "payment_method", "total_amount")
    for method in ("PUE", "PPD", "OTHER"):
        append(sat.where(F.col("payment_method") == method), path)
    return m.spark.read.parquet(path)


@q("k2_report_export")
def _k2(m):
    from ..operators.aggregates import invoice_totals
    from .views import conciliations_view
    path = scratch_path(m.spark, "report")
    view = conciliations_view(m)
    write_report(view.select("receipt_number", "client_name", "total_amount", "ieps"), invoice_totals(view), path)
    return m.spark.read.option("header", True).csv(path)


@q("k3_json_rows")
def _k3(m):
    from ..operators.aggregates import bank_summary
    path = scratch_path(m.spark, "json-rows")
    write_json_rows(bank_summary(m.bank_events), path)
    return m.spark.read.schema("bank_name string, total_posting_amount decimal(30,2), total_transactions bigint") \
        .json(path)


@q("k4_create_catalog")
def _k4(m):
    create_catalog(m.spark, {"sat": m.sat})
    register_functions(m.spark)
    return m.spark.sql("SELECT client_name, format_price(CAST(SUM(total_amount) AS DOUBLE)) AS total_text, "
                       "format_price_numeric(SUM(ieps)) AS ieps_text FROM sat GROUP BY client_name")


# ------------------------------------------------------ tables of the catalogue
def _database(m: Model, tables: list, views: dict | None = None) -> str:
    """A new database below the shared folder.  Queries are lazy, so it stays; its name is never used again."""
    path = scratch_path(m.spark, "tables")
    name = "tallyspark_" + path.rsplit("-", 1)[-1]
    create_tables(m.spark, name, tables, path, {k: v.format(db=name) for k, v in (views or {}).items()})
    return name


ZERO_ME = ("subtotal_me", "discount_me", "vat_16_me", "ieps_me")


@q("k4_tables_with_defaults")
def _k4t(m):
    """Invoices stored without state, date of creation and two amounts; those without a payment method are rejected.
    Read back through a view of the catalogue after a second, void creation."""
    spec = invoice_table(m.sat.schema)
    views = {"invoice_rows": "SELECT receipt_number, state, subtotal_me, discount_me, total_amount, "
                             "created_at IS NOT NULL AS dated, month FROM `{db}`.invoices"}
    db = _database(m, [spec], views)
    rows = m.sat.drop("state", "subtotal_me").withColumns({
        "discount_me": F.lit(None).cast("decimal(20,2)"),
        "payment_method": F.when(F.col("receipt_number") % 5 != 0, F.col("payment_method"))})
    rejects = insert_rows(rows, db, spec)
    create_tables(m.spark, db, [spec])
    kept = m.spark.table(f"{db}.invoice_rows").withColumn("reject_reason", F.lit(None).cast("string"))
    return kept.unionByName(rejects.select("receipt_number", "reject_reason"), allowMissingColumns=True)


@q("f2_invoices_by_month")
def _f2m(m):
    """F2 over the table partitioned by month."""
    spec = invoice_table(m.sat.schema)
    db = _database(m, [spec])
    insert_rows(m.sat.where(F.col("payment_method").isNotNull()), db, spec)
    return by_month(m.spark.table(f"{db}.invoices"), "cfdi_date", "1996-03-10", "1996-05-20").select(
        "receipt_number", "client_name", "total_amount", "cfdi_date")


@q("f3_postings_by_month")
def _f3m(m):
    """F3 and A5 over postings partitioned by month."""
    postings = m.bank_events.select("id", "bank_name", "book_date", "posting_amount")
    spec = posting_table(postings.schema)
    db = _database(m, [spec])
    insert_rows(postings, db, spec)
    days = by_month(m.spark.table(f"{db}.postings"), "book_date", "2024-01-10", "2024-01-25")
    return days.groupBy("bank_name").agg(F.sum("posting_amount").cast("double").alias("total_posting_amount"),
                                         F.count("id").alias("total_transactions"))


def tax_ledger_rows(m: Model) -> DataFrame:
    """The tax ledgers of the model as rows of one table."""
    cols = ["clearing_document", "amount_in_doc_curr", *m.aux_order]
    return (m.aux_ieps.select(*cols, F.lit("BCS").alias("entity"), F.lit("IEPS").alias("tax_account"))
            .unionByName(m.aux_iva.select(*cols, F.lit("BCS").alias("entity"), F.lit("VAT").alias("tax_account"))))


@q("j2_lookup_in_tax_ledger")
def _j2t(m):
    """J2 over the one tax ledger: each lookup reads the partition of its account."""
    rows = tax_ledger_rows(m)
    spec = tax_ledger_table(rows.drop("entity", "tax_account").schema)
    db = _database(m, [spec])
    insert_rows(rows, db, spec)
    ledger = m.spark.table(f"{db}.tax_ledger")
    part = lambda account: ledger.where((F.col("entity") == "BCS") & (F.col("tax_account") == account))
    base = m.ledger_a.select("reference", "clearing_document")
    out = chained_lookup(base, "clearing_document", [(part("IEPS"), "amount_in_doc_curr", "ieps"),
                                                     (part("VAT"), "amount_in_doc_curr", "vat")],
                         "clearing_document", m.aux_order, spread_by=["reference"])
    return out.groupBy("clearing_document").agg(F.count(F.lit(1)).alias("items"), F.max("ieps").cast("double").alias("ieps"),
                                                F.max("vat").cast("double").alias("vat"))


# -------------------------------------------------------------- streaming
@q("t1_incremental_ingest")
def _t1(m):
    spark = m.spark
    landing = land_bank_extracts(m)
    target, ckpt = scratch_path(spark, "bank-table"), scratch_path(spark, "bank-stream-ckpt")

    for day, checkpoint in ((LOAD_DATE, ckpt), (LOAD_DATE, ckpt), ("2024-02-02", scratch_path(spark, "bank-stream-ckpt"))):
        # the last run replays all files with a new checkpoint on another day
        ingest_files(spark, landing, "text", "value string", target, checkpoint,
                     lambda batch, day=day: bank_rows(parse_extracts(batch), load_date=day))
    return committed(spark, target).select("bank_name", "book_date", "value_date", "posting_amount",
                                             "payment_method", "ref", "comment", "client_name")


@q("t1_streaming_invoices")
def _t1i(m):
    """Invoice XML in two landings and three runs, the last with a new checkpoint; every seventh document has no folio,
    every eleventh no stamp."""
    spark, landing = m.spark, scratch_path(m.spark, "landing-invoices")
    target, ckpt = scratch_path(spark, "invoice-table"), scratch_path(spark, "invoice-stream-ckpt")
    for half, checkpoint in ((0, ckpt), (1, ckpt), (None, scratch_path(spark, "invoice-stream-ckpt"))):
        if half is not None:
            docs = documents_where(m, f"{{key}} % 2 = {half}")
            key = F.col("_Folio").cast("bigint")
            docs = docs.withColumns({"Complemento": F.when(key % 11 != 0, F.col("Complemento")),
                                     "_Folio": F.when(key % 7 != 0, F.col("_Folio"))})
            write_invoice_xml(docs, f"{landing}/half={half}")
        ingest_invoices(spark, landing, target, checkpoint, LOAD_DATE)
    rows, bad = committed(spark, target), committed(spark, target, REJECTS)
    return rows.select("fiscal_uuid", "receipt_number", "total_amount", F.lit("").alias("reject_reason")).unionByName(
        bad.select("fiscal_uuid", F.col("folio").alias("receipt_number"), F.lit(None).cast("decimal(20,2)").alias("total_amount"),
                   "reject_reason"))


# ------------------------------------------------------------------ oracles
def _oracle():
    from .oracle import CTES, LEDGER_ORD, TOTALS, fin, fp
    from .oracle import build as _build

    def b(uses, final):
        return _build(CTES, final, uses)

    O = {}
    O["s1_read_invoices"] = b(["sat"], fin(
        "receipt_number:s rfc:s client_name:s cfdi_use:s payment_method:s cfdi_date:t currency:s total_amount:d "
        "subtotal_16:d vat_16:d vat_0:d ieps:d tax_rate:s fiscal_uuid:s", "sat"))
    tax = "CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))"
    O["s1_reuploaded_invoices"] = fin("receipt_number:s vat_16:d ieps:d tax_rate:s fiscal_uuid:s",
        f"(SELECT x.o_orderkey AS receipt_number, 'UUID-' || CAST(x.o_orderkey AS VARCHAR) AS fiscal_uuid, COALESCE(t.tax_rate, '') AS tax_rate, "
        f"COALESCE(round(t.vat, 2), 0) AS vat_16, COALESCE(round(t.ieps, 2), 0) AS ieps FROM (SELECT o_orderkey FROM orders "
        f"UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0) x JOIN orders USING (o_orderkey) "
        f"JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, "
        f"last({tax} ORDER BY {LEDGER_ORD}) FILTER (l_linestatus = 'F' AND {tax} > 0) AS vat, "
        f"SUM({tax}) FILTER (l_linestatus = 'O') AS ieps, COALESCE(string_agg(CASE WHEN l_tax > 0 THEN '16%' ELSE '0%' END, '' "
        f"ORDER BY {LEDGER_ORD}) FILTER (l_linestatus = 'F'), '') AS tax_rate FROM lineitem GROUP BY 1) t ON t.l_orderkey = x.o_orderkey)")
    O["s2_concept_text"] = fin("receipt_number:s product_or_service:s",
        f"(SELECT o.o_orderkey AS receipt_number, COALESCE(string_agg('Part ' || CAST(l.l_partkey AS VARCHAR), ' * ' "
        f"ORDER BY l.{LEDGER_ORD.replace(', ', ', l.')}), '') AS product_or_service "
        f"FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)")
    O["s3_tax_lines_xml"] = b(["tl"], fin("fiscal_uuid:s pos:i tax_code:s rate:s amount:d",
        f"(SELECT 'UUID-' || CAST(invoice_key AS VARCHAR) AS fiscal_uuid, "
        f"row_number() OVER (PARTITION BY invoice_key ORDER BY {LEDGER_ORD}) - 1 AS pos, tax_code, rate, amount FROM tl)"))
    bank_sql = ("(SELECT bank_name, date_trunc('second', book_date) AS book_date, date_trunc('second', value_date) "
                "AS value_date, posting_amount, payment_method, ref, comment, client_name FROM bank_ev "
                "WHERE CAST(trunc(posting_amount) AS BIGINT) > 0)")
    bank_spec = ("bank_name:s book_date:t value_date:t posting_amount:d payment_method:s ref:s comment:s "
                 "client_name:s")
    O["s4_read_bank_extract"] = b(["bank_ev"], fin(bank_spec, bank_sql))
    O["t1_incremental_ingest"] = O["s4_read_bank_extract"]
    bad = "o_orderkey % 7 = 0 OR o_orderkey % 11 = 0"
    O["t1_streaming_invoices"] = fin("fiscal_uuid:s receipt_number:s total_amount:d reject_reason:s",
        f"(SELECT CASE WHEN o_orderkey % 11 <> 0 THEN 'UUID-' || CAST(o_orderkey AS VARCHAR) END AS fiscal_uuid, "
        f"CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS receipt_number, "
        f"CASE WHEN NOT ({bad}) THEN CAST(o_totalprice AS DECIMAL(20,2)) END AS total_amount, concat_ws(';', "
        f"CASE WHEN o_orderkey % 7 = 0 THEN 'missing:Folio' END, CASE WHEN o_orderkey % 11 = 0 THEN 'missing:UUID' END) "
        f"AS reject_reason FROM orders JOIN customer ON o_custkey = c_custkey)")
    dc = "CAST(CAST(l_extendedprice AS DECIMAL(20,5)) AS DECIMAL(20,2))"

    def ledger(flag, where, more, gl="CAST(l_suppkey AS VARCHAR)", document="CAST(l_orderkey AS VARCHAR)"):
        return fin("document_number:s gl_account:s reference:s invoice_reference:s clearing_document:s text:s "
                   "amount_in_doc_curr:d eff_exchange_rate:d amount_in_local_currency:d posting_date:t " + " ".join(
                       f"{n}:{k}" for n, k, _ in more),
                   f"(SELECT {document} AS document_number, {gl} AS gl_account, CAST(l_orderkey AS VARCHAR) AS reference, "
                   f"CAST(l_linenumber AS VARCHAR) AS invoice_reference, CAST(l_partkey AS VARCHAR) AS clearing_document, "
                   f"'Part' || CAST(l_partkey AS VARCHAR) AS text, {dc} AS amount_in_doc_curr, "
                   f"CAST(l_discount AS DECIMAL(20,5)) AS eff_exchange_rate, {dc} AS amount_in_local_currency, "
                   f"CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS posting_date, "
                   + ", ".join(f"{e} AS {n}" for n, _, e in more)
                   + f" FROM lineitem WHERE l_returnflag = '{flag}' AND {where})")

    year = ("fiscal_year", "s", "CAST(year(l_shipdate) AS VARCHAR)")
    item = ("line_item", "i", "l_linenumber")
    maybe = "CASE WHEN l_suppkey <> 7 THEN CAST(l_suppkey AS VARCHAR) END"
    blank = "CASE WHEN l_partkey <> 11 THEN CAST(l_orderkey AS VARCHAR) END"
    O["s6_read_ledger"] = ledger("R", "l_suppkey <> 7 AND l_partkey <> 11", [item, year])
    O["s6_bcs_fbl3n"] = ledger("A", "l_partkey <> 11", [item, year], gl=maybe)
    O["s6_bcs_fbl5n"] = ledger("A", "TRUE", [("account", "s", maybe)], gl=maybe, document=blank)
    O["s6_bhc_fbl5n"] = ledger("R", "l_suppkey <> 7 AND l_partkey <> 11", [
        ("account", "s", "CAST(l_suppkey AS VARCHAR)"), ("position", "s", "CAST(l_linenumber AS VARCHAR)"),
        ("posting_key", "s", "'40'")])
    O["s7_route_bank_sheet"] = fin("s_suppkey:i sheet:s target:s",
        "(SELECT s_suppkey, sheet, CASE WHEN regexp_full_match(sheet, '[a-z]{2,3}-[a-z]{3} [A-Z0-9]{3}') "
        "AND right(sheet, 3) = 'PBC' THEN 'bank_pbc' WHEN regexp_full_match(sheet, '[a-z]{2,3}-[a-z]{3} [A-Z0-9]{3}') "
        "AND right(sheet, 3) = 'N8P' THEN 'bank_n8p' END AS target FROM ("
        "SELECT s_suppkey, lower(substr(n_name, 1, 2)) || '-' || lower(substr(r_name, 1, 3)) || ' ' || "
        "(['PBC', 'N8P', 'XYZ'])[(s_suppkey % 3) + 1] AS sheet FROM supplier JOIN nation ON s_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey))")
    numbered = (f"SELECT *, row_number() OVER (PARTITION BY l_orderkey // 2500 ORDER BY l_orderkey, {LEDGER_ORD}) AS line_no "
                "FROM lineitem WHERE l_returnflag = 'R'")
    O["q4_drop_trailing_rows"] = fin("reference:s line_no:i",
        f"(SELECT CAST(l_orderkey AS VARCHAR) AS reference, line_no FROM ({numbered}))")
    O["q4_drop_three_rows"] = O["q4_drop_trailing_rows"]
    O["q11_split_rejects"] = fin("document_text:s position:s reject_reason:s",
        "(SELECT CASE WHEN l_partkey <> 11 THEN CAST(l_orderkey AS VARCHAR) || '.0' END AS document_text, "
        "CAST(l_linenumber AS VARCHAR) AS position, concat_ws(';', CASE WHEN l_partkey = 11 THEN 'invalid:document_number' END, "
        "CASE WHEN l_suppkey = 7 THEN 'invalid:gl_account' END) AS reject_reason FROM lineitem "
        "WHERE l_returnflag = 'R' AND (l_suppkey = 7 OR l_partkey = 11))")
    parts = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, part, count(*) AS n, SUM(line_no) AS lines FROM (SELECT CASE WHEN l_suppkey = 7 OR "
        f"l_partkey = 11 THEN 'rejected' ELSE 'good' END AS part, line_no FROM ({numbered}) UNION ALL "
        f"SELECT 'trimmed', f.n + i FROM (SELECT count(*) AS n FROM ({numbered}) GROUP BY l_orderkey // 2500) f, "
        f"(SELECT unnest(range(1, {trim + 1})) AS i)) GROUP BY ALL" for kind, trim in (("bhc_fbl3n", 1), ("bhc_fbl5n", 3)))
    O["q11_partition"] = fin("kind:s part:s n:i lines:i", f"({parts})")
    parts = []
    for kind, mandatory_rate, lenient_rate, withholding in (
            ("bcs_fbl3n", True, False, "withholding_tax_amnt"), ("bhc_fbl3n", False, True, "withholding_tax_amnt"),
            ("bcs_fbl5n", False, False, None), ("bhc_fbl5n", False, False, "withholding_amount"),
            ("bank_pbc", False, True, "withholding_tax_amnt"), ("bank_n8p", False, True, "withholding_tax_amnt")):
        bad = {"posting_date": 11, "amount_in_local_currency": 7}
        if not lenient_rate:
            bad["eff_exchange_rate"] = 5
        if withholding:
            bad[withholding] = 9
        places = {c: i for i, c in enumerate(LEDGER_SPECS[kind].columns)}
        why = ", ".join(f"CASE WHEN l_partkey % {bad[c]} = 0 THEN '{'invalid' if mandatory_rate and c == 'eff_exchange_rate' else 'unreadable'}:{c}' END"
                        for c in sorted(bad, key=places.get))
        rate = "CASE WHEN l_partkey % 5 <> 0 THEN 1 END"
        parts.append(
            f"SELECT '{kind}' AS kind, reason, count(*) AS n, CASE WHEN reason = '' THEN SUM(CASE WHEN l_partkey % 13 <> 0 "
            f"THEN CAST(l_extendedprice AS DECIMAL(20,2)) END) END AS amount, CASE WHEN reason = '' THEN count({rate}) END AS rates, "
            f"SUM(line_no) AS lines FROM (SELECT *, concat_ws(';', {why}) AS reason FROM ({numbered})) GROUP BY reason")
    O["q12_unreadable_numbers"] = fin("kind:s reason:s n:i amount:d rates:i lines:i", "(" + " UNION ALL ".join(parts) + ")")
    O["q5_drop_markers"] = fin(
        "business_area:s document_number:s account:s fiscal_year:s amount_in_local_currency:d posting_date:D text:s",
        "(SELECT 'BA-' || event_type AS business_area, CAST(event_id AS VARCHAR) AS document_number, "
        "CAST(user_id AS VARCHAR) AS account, CAST(year(ts) AS VARCHAR) AS fiscal_year, "
        "CAST(CAST(value AS DECIMAL(20,2)) AS DOUBLE) AS amount_in_local_currency, CAST(ts AS DATE) AS posting_date, "
        "props AS text FROM events WHERE event_type <> 'error')")
    O["s6_bank_n8p"] = O["q5_drop_markers"].replace("FROM events", "FROM (SELECT * FROM events UNION ALL SELECT * FROM events)")
    O["q13_new_files_only"] = b(["sat"], fin("receipt_number:s fiscal_uuid:s total_amount:d",
                                             "(SELECT * FROM sat WHERE receipt_number % 2 = 1)"))
    O["k1_append"] = b(["sat"], fin("receipt_number:i payment_method:s total_amount:d", "sat"))
    O["s5_file_stem"] = fin("event_id:i stem:s plain:s",
        "(SELECT event_id, CAST(event_id AS VARCHAR) || '.v1' AS stem, event_type AS plain FROM events)")
    none = ", ".join(f"NULL AS {c}" for c in ("subtotal_iva_16", "iva_16", "iva_0", "total_sat"))
    O["k2_report_export"] = b(["v1"], fin(
        "receipt_number:s client_name:s total_amount:s ieps:s subtotal_iva_16:s iva_16:s iva_0:s total_sat:s",
        f"(SELECT CAST(receipt_number AS VARCHAR) AS receipt_number, client_name, CAST(total_amount AS VARCHAR) AS total_amount, "
        f"CAST(ieps AS VARCHAR) AS ieps, {none} FROM v1 UNION ALL SELECT NULL, NULL, NULL, ieps, subtotal_iva_16, iva_16, "
        f"iva_0, total_sat FROM (SELECT {TOTALS} FROM v1))"))
    O["e2e_reconciliation"] = _e2e_sql()
    O["k3_json_rows"] = b(["bank_ev"], fin("bank_name:s total_posting_amount:d total_transactions:i",
        "(SELECT bank_name, SUM(posting_amount) AS total_posting_amount, COUNT(id) AS total_transactions "
        "FROM bank_ev GROUP BY bank_name)"))
    O["k4_create_catalog"] = b(["sat"], fin("client_name:s total_text:s ieps_text:s",
        f"(SELECT client_name, {fp('CAST(SUM(total_amount) AS DOUBLE)')} AS total_text, "
        f"{fp('SUM(ieps)', numeric=True)} AS ieps_text FROM sat GROUP BY client_name)"))
    fails = "(receipt_number % 5 = 0 OR payment_method IS NULL)"
    O["k4_tables_with_defaults"] = b(["sat"], fin(
        "receipt_number:i state:s subtotal_me:d discount_me:d total_amount:d dated:b month:s reject_reason:s",
        f"(SELECT receipt_number, 'uploaded' AS state, 0 AS subtotal_me, 0 AS discount_me, total_amount, TRUE AS dated, "
        f"strftime(cfdi_date, '%Y-%m') AS month, NULL AS reject_reason FROM sat WHERE NOT {fails} UNION ALL "
        f"SELECT receipt_number, NULL, NULL, NULL, NULL, NULL, NULL, 'payment_method' FROM sat WHERE {fails})"))
    O["f2_invoices_by_month"] = b(["sat"], fin(
        "receipt_number:i client_name:s total_amount:d cfdi_date:t", "(SELECT * FROM sat WHERE payment_method IS NOT NULL "
        "AND CAST(cfdi_date AS DATE) BETWEEN DATE '1996-03-10' AND DATE '1996-05-20')"))
    O["f3_postings_by_month"] = b(["bank_ev"], fin(
        "bank_name:s total_posting_amount:d total_transactions:i", "(SELECT bank_name, SUM(posting_amount) AS "
        "total_posting_amount, COUNT(id) AS total_transactions FROM bank_ev WHERE CAST(book_date AS DATE) BETWEEN "
        "DATE '2024-01-10' AND DATE '2024-01-25' GROUP BY bank_name)"))
    amount = "round(l_extendedprice::DECIMAL(12,2) * l_tax::DECIMAL(4,2), 2)"
    order = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
    first = lambda flag: (f"(SELECT l_partkey AS k, first({amount} ORDER BY {order}) AS v FROM lineitem "  # noqa: E731
                          f"WHERE l_linestatus = '{flag}' GROUP BY 1)")
    O["j2_lookup_in_tax_ledger"] = fin(
        "clearing_document:i items:i ieps:d vat:d", "(SELECT a.l_partkey AS clearing_document, count(*) AS items, "
        "coalesce(any_value(o.v), 0) AS ieps, coalesce(any_value(f.v), 0) AS vat FROM lineitem a "
        f"LEFT JOIN {first('O')} o ON o.k = a.l_partkey LEFT JOIN {first('F')} f ON f.k = a.l_partkey "
        "WHERE a.l_returnflag = 'A' GROUP BY 1)")
    return O


def _e2e_sql() -> str:
    """V5 over tables in the shape that the ingest gives them; the rules of the sheets' kinds as conditions."""
    from .oracle import BASE, LEDGER_ORD, fin, first_rows, listing_cte, match_ctes, view_ctes
    from .oracle import build as _build

    def rows(flag, kept):
        return (f"""SELECT CAST(l_orderkey AS VARCHAR) AS reference, CAST(l_partkey AS VARCHAR) AS clearing_document,
            CASE WHEN l_suppkey <> 7 THEN CAST(l_suppkey AS VARCHAR) END AS account,
            CASE WHEN l_partkey <> 11 THEN CAST(l_orderkey AS VARCHAR) END AS document_number,
            CAST(l_discount AS DECIMAL(20,5)) AS eff_exchange_rate, CAST(l_linenumber AS VARCHAR) AS invoice_reference,
            CAST(l_extendedprice AS DECIMAL(20,2)) AS amount_in_local_currency,
            CAST(l_extendedprice AS DECIMAL(20,2)) AS amount_in_doc_curr, ingest_seq
          FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, {LEDGER_ORD}) AS ingest_seq FROM lineitem
                WHERE l_returnflag = '{flag}') WHERE {kept}""")

    ledger = "ingest_seq, clearing_document, amount_in_local_currency, eff_exchange_rate, account NULLS FIRST"
    aux = "ingest_seq, reference, amount_in_doc_curr"
    own = {"la": rows("A", "TRUE"), "lb": rows("R", "l_partkey <> 11 AND l_suppkey <> 7"),
           "aux_ieps": rows("A", "l_partkey <> 11"), "aux_iva": rows("N", "l_partkey <> 11 AND l_suppkey <> 7")}
    ctes = {**BASE, **{n: ([], sql) for n, sql in own.items()}}
    ctes |= {"la_first": (["la"], first_rows("la", "reference", ledger)), "lb_first": (["lb"], first_rows("lb", "reference", ledger)),
             "ieps_first": (["aux_ieps"], first_rows("aux_ieps", "clearing_document", aux)),
             "iva_first": (["aux_iva"], first_rows("aux_iva", "clearing_document", aux))}
    deps, sat = BASE["sat"]
    ctes["sat"] = (deps, f"SELECT * REPLACE (CAST(receipt_number AS VARCHAR) AS receipt_number) FROM ({sat})")
    ctes |= view_ctes("v1") | match_ctes("ma", "v1") | listing_cte("lst", "v1", "ma_pc", "FALSE")
    return _build(ctes, fin(
        "receipt_number:s client_name:s total_amount:d account:s clearing_payment_policy:s provision_policy_document:s t_c_dof:d "
        "invoice_reference:s amount_in_doc_curr_ieps:d amount_in_doc_curr_iva_traladado:d entity:s bank_name:s bank_ref:s "
        "value_date:s posting_amount:s status_conciliation:s", "lst"), ["lst"])


ROWS_ONLY_ORACLE = _oracle()
