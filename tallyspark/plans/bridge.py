"""Test-table adapter: derives the reconciliation model (invoices, ledgers,
tax auxiliaries, bank postings, payment complements, prototype tables) from
the TPC-H-like driver tables.  Every model table is a lazy DataFrame over the
whole input tables; nothing is sampled or capped.

Mapping (fixed, also used by the DuckDB oracle):
  invoice (sat)        orders JOIN customer; receipt_number = o_orderkey,
                       payment_method F->PUE, O->PPD, P->OTHER
  tax lines            lineitem; code F->002 (VAT), O->003 (IEPS); rate text
                       0.160000 when l_tax > 0 else 0.000000;
                       amount = round(l_extendedprice * l_tax, 2)
  ledger A / B         lineitem returnflag A / R; reference = l_orderkey,
                       clearing_document = l_partkey, account =
                       nullif(l_suppkey, 7), document_number = l_linenumber
  aux IEPS / aux VAT   lineitem linestatus O / F keyed by l_partkey
  bank (matching)      lineitem returnflag N
  bank (summary)       events (bank = event_type, amount = value)
  payments             lineitem (one complement per line)
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import money
from ..sources.tables import read_table

# Fixed values of the adapter.
PAYMENT_METHOD_BY_STATUS = {"F": "PUE", "O": "PPD", "P": "OTHER"}
TAX_CODE_BY_LINESTATUS = {"F": "002", "O": "003"}
RATE_16, RATE_0 = "0.160000", "0.000000"
NULL_ACCOUNT_SUPPLIER = 7

# Total orders of lineitem rows (the full row tuple is unique).
LEDGER_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
AUX_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
LINE_ORDER = LEDGER_ORDER

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _map(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def tax_amount():
    return F.round(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_tax").cast("decimal(4,2)"), 2
                   ).cast("decimal(20,2)")


class Model:
    """Lazily derived model tables over one scale-factor folder."""

    ledger_order, aux_order = LEDGER_ORDER, AUX_ORDER

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One scan definition per table and model (file listing and footer
        reads happen once; the plan is still re-evaluated per query)."""
        if name not in self._tables:
            path = f"{self.sf_dir}/{name}.parquet"
            self._tables[name] = read_table(self.spark, path)
        return self._tables[name]

    # ---------------------------------------------------------------- invoices
    @cached_property
    def tax_lines(self) -> DataFrame:
        """S3 shape: one row per transferred tax of an invoice."""
        li = self.table("lineitem")
        return li.select(
            F.col("l_orderkey").alias("invoice_key"),
            *[F.col(c) for c in LINE_ORDER],
            _map(F.col("l_linestatus"), TAX_CODE_BY_LINESTATUS).alias("tax_code"),
            F.when(F.col("l_tax") > 0, F.lit(RATE_16)).otherwise(F.lit(RATE_0)).alias("rate"),
            tax_amount().alias("amount"),
            money("l_extendedprice").alias("line_amount"))

    @cached_property
    def invoice_lines_agg(self) -> DataFrame:
        """Per invoice: SubTotal (sum of line amounts) and the Q15 tax
        classification -- one partial aggregation over lineitem."""
        from ..operators.clean import classify_taxes
        return classify_taxes(self.tax_lines, "invoice_key", list(LINE_ORDER), subtotal_col="line_amount")

    @cached_property
    def sat(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        inv = o.join(c, o.o_custkey == c.c_custkey, "inner")
        inv = inv.join(self.invoice_lines_agg, inv.o_orderkey == F.col("invoice_key"), "left")
        zero = F.lit(0).cast("decimal(20,2)")
        return inv.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").alias("cfdi_date"),
            F.lit("G03").alias("cfdi_use"),
            F.concat(F.lit("RFC"), F.col("c_custkey").cast("string")).alias("rfc"),
            F.col("c_name").alias("client_name"),
            F.col("o_orderkey").alias("receipt_number"),
            F.concat(F.lit("UUID-"), F.col("o_orderkey").cast("string")).alias("fiscal_uuid"),
            F.col("o_orderpriority").alias("product_or_service"),
            F.lit("MXN").alias("currency"),
            _map(F.col("o_orderstatus"), PAYMENT_METHOD_BY_STATUS).alias("payment_method"),
            F.lit("uploaded").alias("state"),
            F.coalesce(F.col("tax_rate"), F.lit("")).alias("tax_rate"),
            F.coalesce(F.col("subtotal_16"), zero).alias("subtotal_16"),
            F.coalesce(F.col("vat_16"), zero).alias("vat_16"),
            F.coalesce(F.col("vat_0"), zero).alias("vat_0"),
            F.coalesce(F.col("ieps"), zero).alias("ieps"),
            money("o_totalprice").alias("total_amount"),
            *[zero.alias(n) for n in ("subtotal_me", "discount_me", "vat_16_me", "ieps_me",
                                      "vat_withholding_4_me", "vat_withholding_2_3_me", "total_me",
                                      "income_tax_withholding_me")],
            F.col("subtotal").alias("subtotal"),
            F.col("vat_total").alias("iva_total"),
        )

    # ----------------------------------------------------------------- ledgers
    def _ledger(self, flag: str) -> DataFrame:
        li = self.table("lineitem").where(F.col("l_returnflag") == F.lit(flag))
        return li.select(
            F.col("l_orderkey").alias("reference"),
            F.col("l_partkey").alias("clearing_document"),
            F.when(F.col("l_suppkey") == F.lit(NULL_ACCOUNT_SUPPLIER), F.lit(None).cast("bigint"))
             .otherwise(F.col("l_suppkey")).alias("account"),
            F.col("l_linenumber").alias("document_number"),
            F.col("l_discount").cast("decimal(20,5)").alias("eff_exchange_rate"),
            F.concat(F.lit("INV-"), F.col("l_linenumber").cast("string")).alias("invoice_reference"),
            money("l_extendedprice").alias("amount_in_local_currency"),
            *[F.col(c) for c in LEDGER_ORDER])

    @cached_property
    def ledger_a(self) -> DataFrame:
        return self._ledger("A")

    @cached_property
    def ledger_b(self) -> DataFrame:
        return self._ledger("R")

    def _aux(self, linestatus: str) -> DataFrame:
        li = self.table("lineitem").where(F.col("l_linestatus") == F.lit(linestatus))
        return li.select(F.col("l_partkey").alias("clearing_document"),
                         tax_amount().alias("amount_in_doc_curr"),
                         *[F.col(c) for c in AUX_ORDER])

    @cached_property
    def aux_ieps(self) -> DataFrame:
        return self._aux("O")

    @cached_property
    def aux_iva(self) -> DataFrame:
        return self._aux("F")

    # -------------------------------------------------------------------- bank
    @cached_property
    def bank(self) -> DataFrame:
        """Bank postings used by the matcher (lineitem, returnflag N)."""
        li = self.table("lineitem").where(F.col("l_returnflag") == F.lit("N"))
        return li.select(
            F.concat(F.lit("BANK-"), F.col("l_suppkey").cast("string")).alias("bank_name"),
            F.col("l_shipdate").alias("book_date"),
            F.col("l_shipdate").alias("value_date"),
            F.col("l_linestatus").alias("comment"),
            money("l_extendedprice").alias("posting_amount"),
            F.col("l_partkey").cast("string").alias("ref"),
            F.concat(F.lit("Client-"), F.col("l_linenumber").cast("string")).alias("client_name"))

    @cached_property
    def bank_events(self) -> DataFrame:
        """Bank table of the dashboard / listing (events)."""
        ev = self.table("events")
        return ev.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            F.col("event_type").alias("bank_name"),
            F.lit(None).cast("string").alias("account_number"),
            F.lit(None).cast("int").alias("number"),
            F.col("ts").alias("book_date"),
            F.col("ts").alias("value_date"),
            money("value").alias("posting_amount"),
            F.lit("SPEI").alias("payment_method"),
            F.col("event_id").cast("string").alias("ref"),
            F.lit(None).cast("string").alias("addref"),
            F.lit(None).cast("string").alias("posting_text"),
            F.lit(None).cast("string").alias("payer"),
            F.lit(None).cast("string").alias("classification"),
            F.col("props").alias("comment"),
            F.lit(None).cast("string").alias("s3_url"),
            F.lit("events.parquet").alias("file_name"),
            F.col("user_id").cast("string").alias("client_name"))

    # --------------------------------------------------------------- prototype
    @cached_property
    def payments(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            F.concat(F.lit("PAY-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                     F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
                     F.lit("-"), F.col("l_suppkey").cast("string")).alias("uuid_complemento"),
            F.concat(F.lit("UUID-"), F.col("l_orderkey").cast("string")).alias("id_documento"),
            money("l_extendedprice").alias("importe_pagado"),
            F.col("l_shipdate").alias("fecha_de_pago"))

    @cached_property
    def cfdi(self) -> DataFrame:
        """``cfdi_ingreso`` of the prototype schema (all invoices)."""
        s = self.sat
        return s.select(
            F.col("receipt_number").alias("folio_interno"),
            F.col("client_name").alias("nombre"),
            F.lit("I").alias("tipo_comprobante"),
            F.col("rfc"),
            F.col("cfdi_date").alias("fecha_emision"),
            F.col("payment_method").alias("estado"),
            F.col("fiscal_uuid").alias("uuid_fiscal"),
            F.col("subtotal"),
            F.col("iva_total").alias("iva"),
            F.col("ieps"),
            F.col("total_amount").alias("total_cfdi"))

    def _iva_aux(self, flag: str) -> DataFrame:
        li = self.table("lineitem").where(F.col("l_returnflag") == F.lit(flag))
        amt, taxed = money("l_extendedprice"), F.col("l_tax") > 0
        zero = F.lit(0).cast("decimal(20,2)")
        return li.groupBy(F.col("l_orderkey").alias("reference")).agg(
            F.min("l_partkey").alias("doc_number"),
            F.max("l_partkey").alias("clearing_doc"),
            F.sum(F.when(taxed, amt).otherwise(zero)).alias("base_16"),
            F.sum(F.when(~taxed, amt).otherwise(zero)).alias("cero_nacional"),
            zero.alias("cero_extranjero"),
            F.sum(F.when(F.col("l_linestatus") == "F", tax_amount()).otherwise(zero)).alias("iva"),
            F.sum(F.when(F.col("l_linestatus") == "O", tax_amount()).otherwise(zero)).alias("ieps"))

    @cached_property
    def iva_bcs(self) -> DataFrame:
        return self._iva_aux("A")

    @cached_property
    def iva_bhc(self) -> DataFrame:
        return self._iva_aux("R")

    @cached_property
    def bancos(self) -> DataFrame:
        """``BANCOS``: one deposit row per bank document (lineitem N by part)."""
        li = self.table("lineitem").where(F.col("l_returnflag") == F.lit("N"))
        return li.groupBy(F.col("l_partkey").alias("document_number")).agg(
            F.concat(F.lit("BANK-"), F.min("l_suppkey").cast("string")).alias("nombre"),
            F.sum(money("l_extendedprice")).alias("depositos"),
            F.min("l_shipdate").alias("value_date"))
