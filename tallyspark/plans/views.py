"""Composite views V1-V4 as DataFrame -> DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_text_dmy
from ..functions.money import format_price, format_price_sql
from ..operators.filters import InvoiceFilter, valid_invoices
from ..operators.lookup import chained_lookup, exists_switch, priority_lookup, strict_lookup
from ..operators.prorate import sap_sums, with_prorating
from .bridge import AUX_ORDER, LEDGER_ORDER, Model

# Ledger columns looked up per invoice and their view names.
LEDGER_LOOKUP = {"account": "account", "clearing_document": "clearing_payment_policy",
                 "document_number": "provision_policy_document", "eff_exchange_rate": "t_c_dof",
                 "invoice_reference": "invoice_reference", "amount_in_local_currency": "_ledger_amount"}
ENTITY_LABELS = ("BCS", "BHC")
FORMATTED_ME = ("subtotal_me", "discount_me", "vat_16_me", "ieps_me", "vat_withholding_4_me",
                "vat_withholding_2_3_me", "total_me")
FORMATTED_MAIN = ("subtotal_16", "vat_16", "vat_0", "ieps", "total_amount", "income_tax_withholding_me")


def enrich_invoices(sat: DataFrame, ledger_a: DataFrame, ledger_b: DataFrame, aux_ieps: DataFrame,
                    aux_iva: DataFrame, ledger_order=LEDGER_ORDER, aux_order=AUX_ORDER) -> DataFrame:
    """J1 + J2 over (already filtered) invoices: the ledger item of each
    invoice (entity A first, per column) and the two chained tax-ledger
    amounts looked up by the found clearing document (default 0)."""
    j1 = priority_lookup(sat, [ledger_a, ledger_b], "receipt_number", "reference", list(LEDGER_LOOKUP),
                         list(ledger_order), rename=LEDGER_LOOKUP, hit_label=ENTITY_LABELS)
    return chained_lookup(j1, "clearing_payment_policy",
                          [(aux_ieps, "amount_in_doc_curr", "amount_in_doc_curr_ieps"),
                           (aux_iva, "amount_in_doc_curr", "amount_in_doc_curr_iva_traladado")],
                          "clearing_document", list(aux_order), default=0,
                          spread_by=["receipt_number"])


def enriched(m, filt: InvoiceFilter | None = None) -> DataFrame:
    """The joins of V1: valid invoices under the listing filters (F10, applied to the invoice scan itself) with their
    ledger items.  ``m`` is anything with the tables ``sat``, ``ledger_a``, ``ledger_b``, ``aux_ieps``, ``aux_iva`` and
    the orders of their rows, ``ledger_order`` and ``aux_order``."""
    sat = valid_invoices(m.sat)
    if filt is not None:
        sat = filt.apply(sat)
    return enrich_invoices(sat, m.ledger_a, m.ledger_b, m.aux_ieps, m.aux_iva, m.ledger_order, m.aux_order)


def conciliations_view(m, filt: InvoiceFilter | None = None) -> DataFrame:
    """V1 ``conciliations_view``: one row per PUE/PPD invoice with its ledger
    item, formatted amounts, ``diff_sat_sap`` (X17) and tax-ledger amounts."""
    return view_columns(enriched(m, filt))


def view_columns(e: DataFrame) -> DataFrame:
    """The projection of V1 over its joined rows."""
    return e.select(
        "account", "client_name", "rfc",
        date_text_dmy("cfdi_date").alias("formatted_date_cfdi_date"),
        "cfdi_date", "receipt_number", "fiscal_uuid", "product_or_service", "currency",
        *[format_price(c).alias(f"formatted_{c}") for c in FORMATTED_ME],
        "clearing_payment_policy", "provision_policy_document", "t_c_dof",
        *[format_price(c).alias(f"formatted_{c}") for c in FORMATTED_MAIN],
        "subtotal_16", "vat_16", "vat_0", "ieps", "total_amount", "income_tax_withholding_me",
        "tax_rate", "payment_method", "invoice_reference",
        format_price_sql("total_amount - _ledger_amount").alias("diff_sat_sap"),
        "amount_in_doc_curr_ieps", "amount_in_doc_curr_iva_traladado",
        F.col("entity"))


def raw_data(m: Model) -> DataFrame:
    """V2 ``conciliaciones_raw_data``: invoice x payment complement (J3
    fan-out kept) with ledger side chosen per row (J4, strict J5), bank
    deposit via the ledger's document (J6) and pro-rating/validators
    (X11-X16), unformatted."""
    inv = m.cfdi
    sap = exists_switch(inv, "folio_interno", m.iva_bcs, m.iva_bhc, "reference",
                        ["doc_number", "clearing_doc", "iva", "ieps"],
                        exprs=sap_sums("base_16", "cero_nacional", "cero_extranjero", "iva", "ieps"),
                        strict=True, prefix="sap_")
    sap = sap.select(*inv.columns, "_in_a",
                     F.col("sap_doc_number").alias("document_number_sap"),
                     F.col("sap_clearing_doc").alias("clearing_document_sap"),
                     F.col("sap_subtotal_sap").alias("subtotal_sap"), F.col("sap_iva").alias("iva_sap"),
                     F.col("sap_ieps").alias("ieps_sap"), F.col("sap_total_aplicacion_sap").alias("total_aplicacion_sap"))
    # The chosen ledger row's document is unique per invoice, so the bank is one hop from it
    bancos = m.bancos.select(F.col("document_number").alias("_doc"), F.col("depositos"),
                             F.col("nombre").alias("nombre_del_banco"), F.col("value_date").alias("fecha_deposito"))
    sap = strict_lookup(sap, "document_number_sap", bancos, "_doc",
                        ["depositos", "nombre_del_banco", "fecha_deposito"], spread_by=["folio_interno"])
    pays = m.payments.select("id_documento", "uuid_complemento", "importe_pagado")
    joined = sap.join(pays, sap.uuid_fiscal == pays.id_documento, "left").drop("id_documento")
    out = with_prorating(joined, total="total_cfdi", paid="importe_pagado", subtotal="subtotal",
                         iva="iva", ieps="ieps", complement="uuid_complemento")
    return out.select(
        F.col("folio_interno").alias("factura"), F.col("nombre").alias("cliente"),
        F.col("tipo_comprobante").alias("transaccion"), "rfc", F.col("fecha_emision").alias("fecha"),
        "estado", F.col("uuid_fiscal").alias("uuid"), "subtotal", "iva", "ieps",
        F.col("total_cfdi").alias("total"), "depositos", "nombre_del_banco", "fecha_deposito",
        "document_number_sap", "clearing_document_sap", "subtotal_sap", "iva_sap", "ieps_sap",
        "total_aplicacion_sap", "uuid_relacionado", "subtotal_sat", "iva_cobrado_sat", "ieps_cobrado_sat",
        "total_aplicacion_sat", "validador_aplicacion_pagos", "validador_subtotal_validador_iva",
        "validar_ivas_validador_iva", "validador_ieps_validador_iva", "total_variacion_validador_iva")


MONEY_V3 = ("subtotal", "iva", "ieps", "total", "depositos", "subtotal_sap", "iva_sap", "ieps_sap",
            "total_aplicacion_sap", "subtotal_sat", "iva_cobrado_sat", "ieps_cobrado_sat",
            "total_aplicacion_sat", "validador_aplicacion_pagos", "validador_subtotal_validador_iva",
            "validar_ivas_validador_iva", "validador_ieps_validador_iva", "total_variacion_validador_iva")


def conciliaciones(m: Model) -> DataFrame:
    """V3: V2 with money formatted (derived from V2, not a second copy of
    its logic).  ``format_price`` of NUMERIC rounds to 2 first."""
    raw = raw_data(m)
    return raw.select(*[format_price(c, numeric=True).alias(c) if c in MONEY_V3 else F.col(c)
                        for c in raw.columns])


def dashboard(m: Model) -> DataFrame:
    """V4 ``dashboard``: collected VAT / IEPS per invoice x payment and
    their validators."""
    inv = m.cfdi
    pays = m.payments.select("id_documento", "uuid_complemento", "importe_pagado")
    j = inv.join(pays, inv.uuid_fiscal == pays.id_documento, "left")
    out = with_prorating(j, total="total_cfdi", paid="importe_pagado", subtotal="subtotal",
                         iva="iva", ieps="ieps", complement="uuid_complemento")
    return out.select(F.col("nombre").alias("cliente"), "rfc", F.col("fecha_emision").alias("fecha"),
                      "iva_cobrado_sat", "iva", "validar_ivas_validador_iva",
                      "ieps_cobrado_sat", "ieps", "validador_ieps_validador_iva")
