"""Independent DuckDB SQL for every registered query.

Written from the operators' definitions with windows and plain joins over the pre-registered driver tables: first row
per key by ``row_number``, the entity by a join and the smallest side, counts of matches by a window.  The model
tables follow the same fixed adapter mapping as ``bridge.py``.
"""

from __future__ import annotations

LEDGER_ORD = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
AUX_ORD = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
AS_OF = "TIMESTAMP '1998-08-02 00:00:00'"


def fp(x: str, numeric: bool = False) -> str:
    """format_price: '$0' for zero, Postgres mask, '#' overflow."""
    p = f"round(({x}), 2)" if numeric else f"({x})"
    return (f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} = 0 THEN '$0' "
            f"WHEN round(abs({p}), 2) >= 1000000000 THEN '$' || (CASE WHEN {p} < 0 THEN '-' ELSE '' END) || '###,###,###.##' "
            f"ELSE '$' || (CASE WHEN {p} < 0 THEN '-' ELSE '' END) || "
            f"regexp_replace(format('{{:,.2f}}', CAST(abs({p}) AS DOUBLE)), '^0\\.', '.') END)")


def mt(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', CAST(({x}) AS DOUBLE)))"


_KIND = {"i": "CAST({c} AS BIGINT)", "d": "CAST({c} AS DOUBLE)", "s": "CAST({c} AS VARCHAR)",
         "t": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')", "D": "strftime(CAST({c} AS DATE), '%Y-%m-%d')",
         "b": "CAST({c} AS BOOLEAN)"}


def fin(spec: str, src: str) -> str:
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        cols.append(_KIND[kind].format(c=f'"{name}"') + f' AS "{name}"')
    return f"SELECT {', '.join(cols)} FROM {src}"


# ------------------------------------------------------------ model tables
BASE = {
    "tl": ([], f"""SELECT l_orderkey AS invoice_key, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        l_quantity, l_shipdate,
        CASE l_linestatus WHEN 'F' THEN '002' WHEN 'O' THEN '003' END AS tax_code,
        CASE WHEN l_tax > 0 THEN '0.160000' ELSE '0.000000' END AS rate,
        CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(20,2)) AS amount,
        CAST(l_extendedprice AS DECIMAL(20,2)) AS line_amount
      FROM lineitem"""),
    "inv_agg": (["tl"], f"""SELECT invoice_key,
        COALESCE(last(amount ORDER BY {LEDGER_ORD}) FILTER (WHERE tax_code = '002' AND amount > 0), 0) AS vat_16,
        bool_or(tax_code = '002' AND rate = '0.160000') AS has_16,
        bool_or(tax_code = '002' AND rate = '0.000000') AS has_0,
        COALESCE(SUM(amount) FILTER (WHERE tax_code = '003' AND amount > 0), 0) AS ieps,
        COALESCE(SUM(amount) FILTER (WHERE tax_code = '002'), 0) AS vat_total,
        SUM(line_amount) AS subtotal,
        COALESCE(string_agg(CASE WHEN tax_code = '002' AND rate = '0.160000' THEN '16%'
                                 WHEN tax_code = '002' AND rate = '0.000000' THEN '0%' END, '' ORDER BY {LEDGER_ORD}), '') AS tax_rate
      FROM tl GROUP BY invoice_key"""),
    "inv_cls": (["inv_agg"], """SELECT *, CASE WHEN has_16 THEN subtotal ELSE 0 END AS subtotal_16,
        CASE WHEN has_0 THEN subtotal ELSE 0 END AS vat_0 FROM inv_agg"""),
    "sat": (["inv_cls"], """SELECT o.o_orderkey AS id, o.o_orderdate AS cfdi_date, 'G03' AS cfdi_use,
        'RFC' || CAST(c.c_custkey AS VARCHAR) AS rfc, c.c_name AS client_name, o.o_orderkey AS receipt_number,
        'UUID-' || CAST(o.o_orderkey AS VARCHAR) AS fiscal_uuid, o.o_orderpriority AS product_or_service,
        'MXN' AS currency,
        CASE o.o_orderstatus WHEN 'F' THEN 'PUE' WHEN 'O' THEN 'PPD' WHEN 'P' THEN 'OTHER' END AS payment_method,
        COALESCE(a.tax_rate, '') AS tax_rate,
        CAST(COALESCE(a.subtotal_16, 0) AS DECIMAL(20,2)) AS subtotal_16,
        CAST(COALESCE(a.vat_16, 0) AS DECIMAL(20,2)) AS vat_16,
        CAST(COALESCE(a.vat_0, 0) AS DECIMAL(20,2)) AS vat_0,
        CAST(COALESCE(a.ieps, 0) AS DECIMAL(20,2)) AS ieps,
        CAST(o.o_totalprice AS DECIMAL(20,2)) AS total_amount,
        CAST(0 AS DECIMAL(20,2)) AS subtotal_me, CAST(0 AS DECIMAL(20,2)) AS discount_me,
        CAST(0 AS DECIMAL(20,2)) AS vat_16_me, CAST(0 AS DECIMAL(20,2)) AS ieps_me,
        CAST(0 AS DECIMAL(20,2)) AS vat_withholding_4_me, CAST(0 AS DECIMAL(20,2)) AS vat_withholding_2_3_me,
        CAST(0 AS DECIMAL(20,2)) AS total_me, CAST(0 AS DECIMAL(20,2)) AS income_tax_withholding_me,
        a.subtotal AS subtotal, a.vat_total AS iva_total
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      LEFT JOIN inv_cls a ON a.invoice_key = o.o_orderkey"""),
}


def _ledger(flag: str) -> str:
    return f"""SELECT l_orderkey AS reference, l_partkey AS clearing_document,
        CASE WHEN l_suppkey = 7 THEN NULL ELSE l_suppkey END AS account, l_linenumber AS document_number,
        CAST(l_discount AS DECIMAL(20,5)) AS eff_exchange_rate,
        'INV-' || CAST(l_linenumber AS VARCHAR) AS invoice_reference,
        CAST(l_extendedprice AS DECIMAL(20,2)) AS amount_in_local_currency,
        l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate
      FROM lineitem WHERE l_returnflag = '{flag}'"""


def _aux(status: str) -> str:
    return f"""SELECT l_partkey AS clearing_document,
        CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(20,2)) AS amount_in_doc_curr,
        l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate
      FROM lineitem WHERE l_linestatus = '{status}'"""


def _iva_aux(flag: str) -> str:
    tax = "CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(20,2))"
    amt = "CAST(l_extendedprice AS DECIMAL(20,2))"
    return f"""SELECT l_orderkey AS reference, min(l_partkey) AS doc_number, max(l_partkey) AS clearing_doc,
        SUM(CASE WHEN l_tax > 0 THEN {amt} ELSE 0 END) AS base_16,
        SUM(CASE WHEN l_tax > 0 THEN 0 ELSE {amt} END) AS cero_nacional,
        CAST(0 AS DECIMAL(20,2)) AS cero_extranjero,
        SUM(CASE WHEN l_linestatus = 'F' THEN {tax} ELSE 0 END) AS iva,
        SUM(CASE WHEN l_linestatus = 'O' THEN {tax} ELSE 0 END) AS ieps
      FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY l_orderkey"""


BASE.update({
    "la": ([], _ledger("A")),
    "lb": ([], _ledger("R")),
    "aux_ieps": ([], _aux("O")),
    "aux_iva": ([], _aux("F")),
    "bank": ([], """SELECT 'BANK-' || CAST(l_suppkey AS VARCHAR) AS bank_name, l_shipdate AS book_date,
        l_shipdate AS value_date, l_linestatus AS comment, CAST(l_extendedprice AS DECIMAL(20,2)) AS posting_amount,
        CAST(l_partkey AS VARCHAR) AS ref, 'Client-' || CAST(l_linenumber AS VARCHAR) AS client_name
      FROM lineitem WHERE l_returnflag = 'N'"""),
    "bank_ev": ([], """SELECT event_id AS id, ts AS created_at, event_type AS bank_name,
        CAST(NULL AS VARCHAR) AS account_number, CAST(NULL AS INTEGER) AS number, ts AS book_date, ts AS value_date,
        CAST(value AS DECIMAL(20,2)) AS posting_amount, 'SPEI' AS payment_method, CAST(event_id AS VARCHAR) AS ref,
        CAST(NULL AS VARCHAR) AS addref, CAST(NULL AS VARCHAR) AS posting_text, CAST(NULL AS VARCHAR) AS payer,
        CAST(NULL AS VARCHAR) AS classification, props AS comment, 'events.parquet' AS file_name,
        CAST(user_id AS VARCHAR) AS client_name
      FROM events"""),
    "payments": ([], """SELECT 'PAY-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
          CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS uuid_complemento,
        'UUID-' || CAST(l_orderkey AS VARCHAR) AS id_documento,
        CAST(l_extendedprice AS DECIMAL(20,2)) AS importe_pagado, l_shipdate AS fecha_de_pago
      FROM lineitem"""),
    "cfdi": (["sat"], """SELECT receipt_number AS folio_interno, client_name AS nombre, 'I' AS tipo_comprobante, rfc,
        cfdi_date AS fecha_emision, payment_method AS estado, fiscal_uuid AS uuid_fiscal, subtotal,
        iva_total AS iva, ieps, total_amount AS total_cfdi FROM sat"""),
    "iva_bcs": ([], _iva_aux("A")),
    "iva_bhc": ([], _iva_aux("R")),
    "bancos": ([], """SELECT l_partkey AS document_number, 'BANK-' || CAST(min(l_suppkey) AS VARCHAR) AS nombre,
        SUM(CAST(l_extendedprice AS DECIMAL(20,2))) AS depositos, min(l_shipdate) AS value_date
      FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey"""),
})


def first_rows(table: str, key: str, order: str) -> str:
    """The first row of each key."""
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


BASE.update({
    "la_first": (["la"], first_rows("la", "reference", LEDGER_ORD)),
    "lb_first": (["lb"], first_rows("lb", "reference", LEDGER_ORD)),
    "ieps_first": (["aux_ieps"], first_rows("aux_ieps", "clearing_document", AUX_ORD)),
    "iva_first": (["aux_iva"], first_rows("aux_iva", "clearing_document", AUX_ORD)),
})

#: Ledger column, its name in the view.
LEDGER_COLS = [("account", "account"), ("clearing_document", "clearing_payment_policy"),
               ("document_number", "provision_policy_document"), ("eff_exchange_rate", "t_c_dof"),
               ("invoice_reference", "invoice_reference"), ("amount_in_local_currency", "ledger_amount")]


def view_ctes(tag: str, where: str = "TRUE") -> dict:
    """V1: the valid invoices joined to each ledger's first row of their number (J1), then to the first tax-ledger
    rows of the clearing document found (J2)."""
    picked = ", ".join(f"COALESCE(p.{c}, q.{c}) AS {alias}" for c, alias in LEDGER_COLS)
    a = f"""SELECT s.*, {picked},
        CASE WHEN p.reference IS NOT NULL THEN 'BCS' WHEN q.reference IS NOT NULL THEN 'BHC' END AS entity
      FROM sat s LEFT JOIN la_first p ON p.reference = s.receipt_number
      LEFT JOIN lb_first q ON q.reference = s.receipt_number
      WHERE s.payment_method IN ('PUE', 'PPD') AND ({where})"""
    b = f"""SELECT j.*, COALESCE(i.amount_in_doc_curr, 0) AS amount_in_doc_curr_ieps,
        COALESCE(v.amount_in_doc_curr, 0) AS amount_in_doc_curr_iva_traladado
      FROM {tag}_a j LEFT JOIN ieps_first i ON i.clearing_document = j.clearing_payment_policy
      LEFT JOIN iva_first v ON v.clearing_document = j.clearing_payment_policy"""
    me = ["subtotal_me", "discount_me", "vat_16_me", "ieps_me", "vat_withholding_4_me", "vat_withholding_2_3_me",
          "total_me"]
    main = ["subtotal_16", "vat_16", "vat_0", "ieps", "total_amount", "income_tax_withholding_me"]
    v = f"""SELECT account, client_name, rfc, strftime(cfdi_date, '%d/%m/%Y') AS formatted_date_cfdi_date, cfdi_date,
        receipt_number, fiscal_uuid, product_or_service, currency,
        {', '.join(fp(c) + ' AS formatted_' + c for c in me)},
        clearing_payment_policy, provision_policy_document, t_c_dof,
        {', '.join(fp(c) + ' AS formatted_' + c for c in main)},
        subtotal_16, vat_16, vat_0, ieps, total_amount, income_tax_withholding_me, tax_rate, payment_method,
        invoice_reference, {fp('total_amount - ledger_amount')} AS diff_sat_sap,
        amount_in_doc_curr_ieps, amount_in_doc_curr_iva_traladado, entity
      FROM {tag}_b"""
    return {f"{tag}_a": (["sat", "la_first", "lb_first"], a),
            f"{tag}_b": ([f"{tag}_a", "ieps_first", "iva_first"], b),
            tag: ([f"{tag}_b"], v)}


def match_ctes(tag: str, view: str, bank_where: str = "TRUE", two_pass: bool = True) -> dict:
    """A2, A3/A4, the matching loop (J7) for each pass and the
    first-per-clearing reduction (J8/J9)."""
    ctes = {
        f"{tag}_g": ([view], f"""SELECT clearing_payment_policy, client_name, SUM(total_amount) AS sum
            FROM {view} GROUP BY clearing_payment_policy, client_name"""),
        f"{tag}_bf": (["bank"], f"SELECT * FROM bank WHERE {bank_where}"),
        f"{tag}_p1": ([f"{tag}_bf"], f"""SELECT bank_name, comment, value_date, SUM(posting_amount) AS total_posting_amount, ref
            FROM {tag}_bf GROUP BY bank_name, value_date, comment, posting_amount, ref"""),
        f"{tag}_p2": ([f"{tag}_bf"], f"""SELECT bank_name, comment, value_date, SUM(posting_amount) AS total_posting_amount, ref
            FROM {tag}_bf GROUP BY bank_name, value_date, comment, posting_amount, ref, client_name"""),
    }
    for p in ("p1", "p2"):
        ctes[f"{tag}_m{p[1]}"] = ([f"{tag}_g", f"{tag}_{p}"], f"""SELECT clearing_payment_policy, client_name, sum,
                bank_name, comment, value_date, total_posting_amount, ref FROM (
              SELECT g.clearing_payment_policy, g.client_name, g.sum, p.bank_name, p.comment, p.value_date,
                     p.total_posting_amount, p.ref,
                     row_number() OVER (PARTITION BY g.clearing_payment_policy, g.client_name
                                        ORDER BY p.value_date, p.bank_name, p.ref, p.comment, p.total_posting_amount) AS rn
              FROM {tag}_g g JOIN {tag}_{p} p
                ON CAST(trunc(p.total_posting_amount) AS BIGINT) = CAST(trunc(g.sum) AS BIGINT)) WHERE rn = 1""")
    union = (f"SELECT 0 AS pass, * FROM {tag}_m2 UNION ALL SELECT 1 AS pass, * FROM {tag}_m1" if two_pass
             else f"SELECT 0 AS pass, * FROM {tag}_m1")
    ctes[f"{tag}_pc"] = ([f"{tag}_m1", f"{tag}_m2"], f"""SELECT clearing_payment_policy, bank_name, comment,
            value_date, total_posting_amount, ref FROM (
          SELECT *, row_number() OVER (PARTITION BY clearing_payment_policy ORDER BY pass, client_name) AS rn
          FROM ({union})) WHERE rn = 1""")
    return ctes


def listing_cte(tag: str, view: str, pc: str, status_aged: str | None = "FALSE", null_safe: bool = True) -> dict:
    on = "IS NOT DISTINCT FROM" if null_safe else "="
    status = ("CASE WHEN pc.bank_name IS NOT NULL THEN 'Conciliado' "
              f"WHEN {status_aged} THEN 'Revision Manual' ELSE 'En Proceso de Conciliación' END"
              if status_aged is not None else "CASE WHEN pc.bank_name IS NOT NULL THEN 'Conciliado' END")
    return {tag: ([view, pc], f"""SELECT v.*, pc.bank_name, pc.comment, strftime(pc.value_date, '%d/%m/%Y') AS value_date,
            pc.ref AS bank_ref, pc.total_posting_amount AS posting_amount_number,
            CASE WHEN pc.total_posting_amount IS NOT NULL THEN {mt('pc.total_posting_amount')} END AS posting_amount,
            {status} AS status_conciliation
          FROM {view} v LEFT JOIN {pc} pc ON v.clearing_payment_policy {on} pc.clearing_payment_policy""")}


def build(ctes: dict, final: str, uses: list[str]) -> str:
    """Emit the CTEs ``final`` needs, dependencies first."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in ctes[n][0]:
            visit(d)
        order.append(n)

    for u in uses:
        visit(u)
    body = ",\n".join(f"{n} AS (\n{ctes[n][1]}\n)" for n in order)
    return f"WITH {body}\n{final}"


# --------------------------------------------------------------- specs
V1_SPEC = ("account:i client_name:s rfc:s formatted_date_cfdi_date:s cfdi_date:t receipt_number:i fiscal_uuid:s "
           "product_or_service:s currency:s formatted_subtotal_me:s formatted_discount_me:s formatted_vat_16_me:s "
           "formatted_ieps_me:s formatted_vat_withholding_4_me:s formatted_vat_withholding_2_3_me:s "
           "formatted_total_me:s clearing_payment_policy:i provision_policy_document:i t_c_dof:d "
           "formatted_subtotal_16:s formatted_vat_16:s formatted_vat_0:s formatted_ieps:s formatted_total_amount:s "
           "formatted_income_tax_withholding_me:s subtotal_16:d vat_16:d vat_0:d ieps:d total_amount:d "
           "income_tax_withholding_me:d tax_rate:s payment_method:s invoice_reference:s diff_sat_sap:s "
           "amount_in_doc_curr_ieps:d amount_in_doc_curr_iva_traladado:d entity:s")
LISTING_SPEC = V1_SPEC + (" bank_name:s comment:s value_date:s bank_ref:s posting_amount_number:d posting_amount:s "
                          "status_conciliation:s")
RANGE_WHERE = "s.cfdi_date BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:00'"
RANGE_BANK = "value_date >= TIMESTAMP '1996-01-01 00:00:00'"
RANGE_AGED = f"TIMESTAMP '1996-01-01 00:00:00' + INTERVAL 3 MONTH <= {AS_OF}"
EV_RANGE = "BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-09 23:59:00'"
TOTALS = (f"{fp('SUM(subtotal_16)')} AS subtotal_iva_16, {fp('SUM(vat_16)')} AS iva_16, {fp('SUM(vat_0)')} AS iva_0, "
          f"{fp('SUM(ieps)')} AS ieps, {fp('SUM(total_amount)')} AS total_sat")
TOTALS_SPEC = "subtotal_iva_16:s iva_16:s iva_0:s ieps:s total_sat:s"


def _all_ctes() -> dict:
    c = dict(BASE)
    c.update(view_ctes("v1"))
    c.update(view_ctes("vr", RANGE_WHERE))
    c.update(view_ctes("vq", "s.cfdi_date BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-03-31 23:59:00'"))
    c.update(match_ctes("ma", "v1"))
    c.update(match_ctes("mr", "vr", RANGE_BANK))
    c.update(listing_cte("lst", "v1", "ma_pc", "FALSE"))
    c.update(listing_cte("lstr", "vr", "mr_pc", RANGE_AGED))
    # single (plain) pass variants
    c.update({k.replace("ma_", "m1_"): ([d.replace("ma_", "m1_") for d in deps], s.replace("ma_", "m1_"))
              for k, (deps, s) in match_ctes("ma", "v1", two_pass=False).items()})
    c.update({k.replace("mr_", "r1_"): ([d.replace("mr_", "r1_") for d in deps], s.replace("mr_", "r1_"))
              for k, (deps, s) in match_ctes("mr", "vr", RANGE_BANK, two_pass=False).items()})
    c.update(listing_cte("lst1", "v1", "m1_pc", "FALSE"))
    c.update(listing_cte("rep", "vr", "r1_pc", None))
    # Shares of the taxes in the subtotal, then what of a payment is subtotal, then the differences
    c["paid"] = (["cfdi", "payments"], """SELECT inv.*, pay.uuid_complemento, pay.importe_pagado,
        CAST(subtotal AS DOUBLE) AS sub, CAST(iva AS DOUBLE) / nullif(CAST(subtotal AS DOUBLE), 0) AS iva_share,
        CAST(ieps AS DOUBLE) / nullif(CAST(subtotal AS DOUBLE), 0) AS ieps_share,
        round(total_cfdi - importe_pagado, 2) AS left_over
      FROM cfdi inv LEFT JOIN payments pay ON inv.uuid_fiscal = pay.id_documento""")
    c["parts"] = (["paid"], """SELECT *, CAST(importe_pagado AS DOUBLE) / (1 + (iva_share + ieps_share)) AS part,
        importe_pagado IS NULL AS unpaid, left_over + importe_pagado - total_cfdi AS excess FROM paid""")
    differs = lambda x: f"CASE WHEN unpaid OR excess = 0 THEN 0 ELSE round({x}, 2) END"
    known = lambda x: f"CASE WHEN unpaid THEN 0 ELSE {x} END"
    c["pror"] = (["parts"], f"""SELECT *, COALESCE(uuid_complemento, 'Sin Complemento') AS uuid_relacionado,
        {known('round(part, 2)')} AS subtotal_sat, {known('round(part * iva_share, 2)')} AS iva_cobrado_sat,
        {known('round(part * ieps_share, 2)')} AS ieps_cobrado_sat,
        COALESCE(importe_pagado, 0) AS total_aplicacion_sat, 0 AS validador_aplicacion_pagos,
        {differs('sub - part')} AS validador_subtotal_validador_iva,
        {differs('CAST(iva AS DOUBLE) - part * iva_share')} AS validar_ivas_validador_iva,
        {differs('CAST(ieps AS DOUBLE) - part * ieps_share')} AS validador_ieps_validador_iva,
        {known('CASE WHEN left_over > 0 THEN excess ELSE left_over END')} AS total_variacion_validador_iva
      FROM parts""")
    # Of the rows of both entities, those of the smaller side
    c["sides"] = (["iva_bcs", "iva_bhc"], """SELECT *, base_16 + cero_nacional + cero_extranjero AS subtotal_sap,
        base_16 + cero_nacional + cero_extranjero + iva + ieps AS total_aplicacion_sap FROM (
          SELECT 1 AS side, * FROM iva_bcs UNION ALL SELECT 2 AS side, * FROM iva_bhc)""")
    c["chosen"] = (["sides"], """SELECT * FROM sides
        QUALIFY side = min(side) OVER (PARTITION BY reference)""")
    c["v2"] = (["pror", "chosen", "bancos"], """SELECT r.folio_interno AS factura, r.nombre AS cliente,
        r.tipo_comprobante AS transaccion, r.rfc, r.fecha_emision AS fecha, r.estado, r.uuid_fiscal AS uuid, r.subtotal,
        r.iva, r.ieps, r.total_cfdi AS total, d.depositos, d.nombre AS nombre_del_banco, d.value_date AS fecha_deposito,
        e.doc_number AS document_number_sap, e.clearing_doc AS clearing_document_sap, e.subtotal_sap,
        e.iva AS iva_sap, e.ieps AS ieps_sap, e.total_aplicacion_sap, r.uuid_relacionado, r.subtotal_sat,
        r.iva_cobrado_sat, r.ieps_cobrado_sat, r.total_aplicacion_sat, r.validador_aplicacion_pagos,
        r.validador_subtotal_validador_iva, r.validar_ivas_validador_iva, r.validador_ieps_validador_iva,
        r.total_variacion_validador_iva
      FROM pror r LEFT JOIN chosen e ON e.reference = r.folio_interno
      LEFT JOIN bancos d ON d.document_number = e.doc_number""")
    return c


CTES = _all_ctes()

V2_SPEC = ("factura:i cliente:s transaccion:s rfc:s fecha:t estado:s uuid:s subtotal:d iva:d ieps:d total:d "
           "depositos:d nombre_del_banco:s fecha_deposito:t document_number_sap:i clearing_document_sap:i "
           "subtotal_sap:d iva_sap:d ieps_sap:d total_aplicacion_sap:d uuid_relacionado:s subtotal_sat:d "
           "iva_cobrado_sat:d ieps_cobrado_sat:d total_aplicacion_sat:d validador_aplicacion_pagos:i "
           "validador_subtotal_validador_iva:d validar_ivas_validador_iva:d validador_ieps_validador_iva:d "
           "total_variacion_validador_iva:d")
V3_MONEY = ("subtotal iva ieps total depositos subtotal_sap iva_sap ieps_sap total_aplicacion_sap subtotal_sat "
            "iva_cobrado_sat ieps_cobrado_sat total_aplicacion_sat validador_aplicacion_pagos "
            "validador_subtotal_validador_iva validar_ivas_validador_iva validador_ieps_validador_iva "
            "total_variacion_validador_iva").split()
BANK_LISTING = ("created_at bank_name account_number number book_date value_date posting_amount payment_method ref "
                "addref posting_text payer classification comment file_name")


def _q(uses, final):
    return build(CTES, final, uses)


def _v3() -> str:
    items = []
    for item in V2_SPEC.split():
        name, kind = item.split(":")
        items.append(f"{name}:s" if name in V3_MONEY else item)
    money_cols = ", ".join(f"{fp(n, numeric=True)} AS {n}" for n in V3_MONEY)
    other = ", ".join(n.split(":")[0] for n in V2_SPEC.split() if n.split(":")[0] not in V3_MONEY)
    return _q(["v2"], fin(" ".join(items), f"(SELECT {other}, {money_cols} FROM v2)"))


def oracle_sql() -> dict[str, str]:
    O: dict[str, str] = {}
    O["f1_valid_invoices"] = _q(["sat"], fin("receipt_number:i payment_method:s total_amount:d cfdi_date:t client_name:s",
                                             "(SELECT * FROM sat WHERE payment_method = 'PUE' OR payment_method = 'PPD')"))
    O["f2_between_dates"] = _q(["sat"], fin("receipt_number:i cfdi_date:t total_amount:d",
                                            "(SELECT * FROM sat WHERE cfdi_date BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 23:59:00')"))
    O["f3_book_date_range"] = _q(["bank_ev"], fin("id:i bank_name:s book_date:t posting_amount:d",
                                                  f"(SELECT * FROM bank_ev WHERE book_date {EV_RANGE})"))
    O["f4_value_date_range"] = _q(["bank"], fin("bank_name:s value_date:t posting_amount:d ref:s",
                                                "(SELECT * FROM bank WHERE value_date BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-06-30 23:59:00')"))
    O["f5_eq_filters"] = _q(["sat"], fin("receipt_number:i client_name:s rfc:s total_amount:d",
                                         "(SELECT * FROM sat WHERE client_name = 'Customer#000000001' AND rfc = 'RFC1')"))
    O["f6_in_month"] = _q(["sat"], fin("receipt_number:i cfdi_date:t",
                                       "(SELECT * FROM sat WHERE payment_method IN ('PUE', 'PPD') AND EXTRACT(MONTH FROM cfdi_date) = 3 AND EXTRACT(YEAR FROM cfdi_date) = 1996)"))
    O["f7_from_month_same_year"] = _q(["bank"], fin("bank_name:s value_date:t posting_amount:d ref:s",
                                                    "(SELECT * FROM bank WHERE EXTRACT(YEAR FROM value_date) = 1996 AND EXTRACT(MONTH FROM value_date) >= 3)"))
    O["f8_since"] = _q(["bank"], fin("bank_name:s value_date:t posting_amount:d ref:s",
                                     "(SELECT * FROM bank WHERE value_date >= TIMESTAMP '1998-01-01 00:00:00')"))
    O["f10_invoice_filter_range"] = _q(["sat"], fin("receipt_number:i cfdi_date:t client_name:s",
                                                    "(SELECT * FROM sat WHERE payment_method IN ('PUE', 'PPD') AND cfdi_date BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-06-30 23:59:00')"))
    O["f10_invoice_filter_month"] = _q(["sat"], fin("receipt_number:i cfdi_date:t client_name:s",
                                                    "(SELECT * FROM sat WHERE payment_method IN ('PUE', 'PPD') AND EXTRACT(MONTH FROM cfdi_date) = 5 AND EXTRACT(YEAR FROM cfdi_date) = 1997)"))
    bl = ", ".join(f"strftime(CAST({c} AS DATE), '%Y-%m-%d') AS {c}" if c in ("created_at", "book_date", "value_date")
                   else c for c in BANK_LISTING.split())
    bl_spec = " ".join(f"{c}:{'i' if c == 'number' else 'd' if c == 'posting_amount' else 's'}" for c in BANK_LISTING.split())
    O["f11_bank_listing"] = _q(["bank_ev"], fin(bl_spec, f"(SELECT {bl} FROM bank_ev WHERE book_date {EV_RANGE} AND bank_name = 'purchase')"))
    O["f12_tax_detail"] = _q(["v1"], fin("receipt_number:i vat_16:d vat_0:d ieps:d amount_in_doc_curr_iva_traladado:d amount_in_doc_curr_ieps:d", "v1"))

    O["j1_first_match_lookup"] = _q(["v1_a"], fin("receipt_number:i account:i clearing_payment_policy:i provision_policy_document:i t_c_dof:d invoice_reference:s ledger_amount:d entity:s", "v1_a"))
    O["j2_chained_lookup"] = _q(["v1"], fin("receipt_number:i clearing_payment_policy:i amount_in_doc_curr_ieps:d amount_in_doc_curr_iva_traladado:d", "v1"))
    O["j3_left_payments"] = _q(["cfdi", "payments"], fin("folio_interno:i uuid_fiscal:s uuid_complemento:s importe_pagado:d",
                                                         "(SELECT * FROM cfdi t1 LEFT JOIN payments t2 ON t1.uuid_fiscal = t2.id_documento)"))
    O["j4_exists_switch"] = _q(["cfdi", "chosen"], fin(
        "folio_interno:i in_a:b doc_number:i clearing_doc:i iva:d ieps:d subtotal_sap:d total_aplicacion_sap:d",
        "(SELECT f.folio_interno, COALESCE(e.side = 1, FALSE) AS in_a, e.* FROM cfdi f LEFT JOIN chosen e "
        "ON e.reference = f.folio_interno)"))
    O["j5_strict_lookup"] = _q(["cfdi", "iva_bcs"], fin("folio_interno:i doc_number:i base_16:d",
        "(SELECT f.folio_interno, e.doc_number, e.base_16 FROM cfdi f LEFT JOIN iva_bcs e ON e.reference = f.folio_interno)"))
    per = ("(SELECT o.o_orderkey AS folio_interno, count(*) FILTER (l.l_returnflag = 'A') AS a, "
           "count(*) FILTER (l.l_returnflag = 'R') AS b FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1)")
    O["j4_exists_switch_ungrouped"] = _q(["la", "lb"], fin(
        "folio_interno:i in_a:b clearing_document:i account:i amount_in_local_currency:d",
        f"(SELECT n.folio_interno, n.a = 1 AS in_a, x.* FROM {per} n LEFT JOIN (SELECT 1 AS side, * FROM la UNION ALL "
        "SELECT 2, * FROM lb) x ON x.reference = n.folio_interno AND x.side = CASE WHEN n.a = 1 THEN 1 ELSE 2 END "
        "WHERE n.a = 1 OR (n.a = 0 AND n.b <= 1))"))
    O["j5_strict_lookup_ungrouped"] = _q(["lb"], fin("folio_interno:i clearing_document:i amount_in_local_currency:d",
        f"(SELECT n.folio_interno, x.clearing_document, x.amount_in_local_currency FROM {per} n LEFT JOIN lb x "
        "ON x.reference = n.folio_interno WHERE n.b <= 1)"))
    O["j6_bank_via_ledger"] = _q(["cfdi", "iva_bcs", "bancos"], fin("folio_interno:i depositos:d nombre:s value_date:t",
        "(SELECT f.folio_interno, d.depositos, d.nombre, d.value_date FROM cfdi f "
        "LEFT JOIN iva_bcs e ON e.reference = f.folio_interno LEFT JOIN bancos d ON d.document_number = e.doc_number)"))
    O["j7_match_on_amount"] = _q(["m1_m1"], fin("clearing_payment_policy:i client_name:s sum:d bank_name:s comment:s value_date:t total_posting_amount:d ref:s", "m1_m1"))
    O["j8_attach_bank"] = _q(["lst1"], fin("receipt_number:i clearing_payment_policy:i bank_name:s bank_ref:s value_date:s posting_amount_number:d posting_amount:s", "lst1"))
    O["j8_attach_bank_strict"] = _q(["v1", "m1_pc"], fin("receipt_number:i clearing_payment_policy:i bank_name:s total_posting_amount:d",
        "(SELECT v.receipt_number, v.clearing_payment_policy, pc.bank_name, pc.total_posting_amount FROM v1 v LEFT JOIN m1_pc pc ON v.clearing_payment_policy = pc.clearing_payment_policy)"))
    O["j9_two_pass_match"] = _q(["ma_pc"], fin("clearing_payment_policy:i bank_name:s comment:s value_date:t total_posting_amount:d ref:s", "ma_pc"))
    inc = "SELECT client_name, SUM(total_amount) AS sum_total_amount, SUM(vat_16) AS sum_total_vat_16, SUM(ieps) AS sum_total_ieps FROM sat"
    inc_spec = "client_name:s sum_total_amount:d sum_total_vat_16:d sum_total_ieps:d"
    O["j10_income_by_client"] = _q(["sat"], fin(inc_spec, f"({inc} WHERE cfdi_date BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:00' GROUP BY client_name)"))
    O["j10_income_by_client_crossed"] = _q(["sat", "bank_ev"], fin(inc_spec,
        f"(SELECT sat.client_name, SUM(total_amount) AS sum_total_amount, SUM(vat_16) AS sum_total_vat_16, SUM(ieps) AS sum_total_ieps "
        f"FROM sat, bank_ev WHERE bank_ev.value_date {EV_RANGE} GROUP BY sat.client_name)"))

    O["a1_invoice_totals"] = _q(["v1"], fin(TOTALS_SPEC, f"(SELECT {TOTALS} FROM v1)"))
    O["a1_invoice_totals_range"] = _q(["vq"], fin(TOTALS_SPEC, f"(SELECT {TOTALS} FROM vq)"))
    O["a2_sum_by_clearing"] = _q(["ma_g"], fin("clearing_payment_policy:i client_name:s sum:d", "ma_g"))
    O["a3_postings"] = _q(["m1_p1"], fin("bank_name:s comment:s value_date:t total_posting_amount:d ref:s", "m1_p1"))
    O["a4_postings_by_client"] = _q(["m1_p2"], fin("bank_name:s comment:s value_date:t total_posting_amount:d ref:s", "m1_p2"))
    O["a5_bank_summary"] = _q(["bank_ev"], fin("bank_name:s total_posting_amount:d total_transactions:i",
        "(SELECT bank_name, SUM(posting_amount) AS total_posting_amount, COUNT(id) AS total_transactions FROM bank_ev GROUP BY bank_name)"))
    O["a6_income_by_client"] = _q(["sat"], fin(inc_spec, f"({inc} GROUP BY client_name)"))
    O["a7_dashboard_totals"] = _q(["sat", "bank_ev"], fin("metric:s value:d",
        "(SELECT 'total_amount_transactions' AS metric, CAST(SUM(posting_amount) AS DOUBLE) AS value FROM bank_ev "
        "UNION ALL SELECT 'total_transactions_sum', CAST(COUNT(id) AS DOUBLE) FROM bank_ev "
        "UNION ALL SELECT 'total_income', CAST(SUM(total_amount) AS DOUBLE) FROM sat "
        "UNION ALL SELECT 'vat_16', CAST(SUM(vat_16) AS DOUBLE) FROM sat "
        "UNION ALL SELECT 'ieps', CAST(SUM(ieps) AS DOUBLE) FROM sat)"))
    O["a7_bank_rollup"] = _q(["bank_ev"], fin("bank_name:s total_posting_amount:d total_transactions:i is_total:i",
        "(SELECT bank_name, SUM(posting_amount) AS total_posting_amount, COUNT(id) AS total_transactions, "
        "GROUPING(bank_name) AS is_total FROM bank_ev GROUP BY ROLLUP (bank_name))"))
    O["a8_distinct_rfc"] = _q(["v1"], fin("rfc:s", "(SELECT DISTINCT rfc FROM v1)"))
    O["a8_distinct_client"] = _q(["v1"], fin("client_name:s", "(SELECT DISTINCT client_name FROM v1)"))
    O["a8_distinct_bank"] = _q(["bank_ev"], fin("bank_name:s", "(SELECT DISTINCT bank_name FROM bank_ev)"))
    O["a9_total_income"] = _q(["v1"], fin("sum_total:d", "(SELECT SUM(total_amount) AS sum_total FROM v1)"))
    O["a10_group_matches"] = _q(["lst"], fin("bank_name:s total_posting_amount:d total_transactions:i",
        "(SELECT bank_name, SUM(posting_amount_number) AS total_posting_amount, COUNT(*) AS total_transactions FROM lst WHERE bank_name IS NOT NULL GROUP BY bank_name)"))
    O["a11_page_info"] = _q(["v1"], fin("total:i page_size:i total_pages:i",
        "(SELECT COUNT(*) AS total, 10 AS page_size, (COUNT(*) + 9) // 10 AS total_pages FROM v1)"))
    O["l1_order_by_clearing"] = _q(["v1"], fin("receipt_number:i clearing_payment_policy:i total_amount:d",
        "(SELECT * FROM v1 ORDER BY clearing_payment_policy NULLS LAST, receipt_number)"))
    O["l2_top_clients"] = _q(["sat"], fin(inc_spec, f"({inc} GROUP BY client_name ORDER BY sum_total_amount DESC, client_name LIMIT 5)"))
    O["l4_page"] = _q(["v1"], fin("receipt_number:i clearing_payment_policy:i total_amount:d",
        "(SELECT * FROM v1 ORDER BY clearing_payment_policy ASC NULLS LAST, receipt_number LIMIT 50 OFFSET 100)"))
    O["u1_listing_union"] = _q(["lst", "lst1"], fin("receipt_number:i clearing_payment_policy:i bank_name:s status_conciliation:s",
        "(SELECT receipt_number, clearing_payment_policy, bank_name, status_conciliation FROM lst UNION ALL "
        "SELECT receipt_number, clearing_payment_policy, bank_name, status_conciliation FROM lst1)"))
    O["u2_priority_union"] = _q(["la", "lb"], fin("reference:i clearing_document:i account:i amount_in_local_currency:d source:i",
        f"(SELECT reference, clearing_document, account, amount_in_local_currency, source FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY reference ORDER BY source, {LEDGER_ORD}) AS rn FROM ("
        f"SELECT *, 0 AS source FROM la UNION ALL SELECT *, 1 AS source FROM lb)) WHERE rn = 1)"))
    rep = (f"(SELECT receipt_number, clearing_payment_policy, total_amount, CAST(ieps AS VARCHAR) AS ieps, bank_name, "
           f"posting_amount, status_conciliation, NULL AS subtotal_iva_16, NULL AS iva_16, NULL AS iva_0, NULL AS total_sat FROM rep "
           f"UNION ALL SELECT NULL, NULL, NULL, ieps, NULL, NULL, NULL, subtotal_iva_16, iva_16, iva_0, total_sat FROM (SELECT {TOTALS} FROM vr))")
    O["u3_report_union"] = _q(["rep", "vr"], fin("receipt_number:i clearing_payment_policy:i total_amount:d ieps:s bank_name:s "
                                                 "posting_amount:s status_conciliation:s subtotal_iva_16:s iva_16:s iva_0:s total_sat:s", rep))

    O["x1_format_price"] = _q(["v1"], fin("receipt_number:i formatted_total_amount:s formatted_vat_16:s formatted_ieps:s "
                                          "formatted_subtotal_16:s formatted_vat_0:s formatted_subtotal_me:s diff_sat_sap:s", "v1"))
    O["x1_format_price_numeric"] = _q(["tl"], fin("invoice_key:i l_linenumber:i l_partkey:i price_text:s",
        f"(SELECT invoice_key, l_linenumber, l_partkey, {fp('amount * CAST(-1.5 AS DECIMAL(3,1))', numeric=True)} AS price_text FROM tl)"))
    O["x2_money_text"] = _q(["m1_p1"], fin("bank_name:s value_date:t ref:s comment:s posting_text:s",
        f"(SELECT bank_name, value_date, ref, comment, {mt('total_posting_amount')} AS posting_text FROM m1_p1)"))
    O["x3_date_text"] = _q(["sat"], fin("receipt_number:i dmy:s iso:s",
        "(SELECT receipt_number, strftime(cfdi_date, '%d/%m/%Y') AS dmy, strftime(CAST(cfdi_date AS DATE), '%Y-%m-%d') AS iso FROM sat)"))
    O["x4_cast_date"] = _q(["bank_ev"], fin("id:i value_day:D", "(SELECT id, CAST(value_date AS DATE) AS value_day FROM bank_ev)"))
    O["x5_extract"] = _q(["sat"], fin("receipt_number:i y:i m:i",
        "(SELECT receipt_number, EXTRACT(YEAR FROM cfdi_date) AS y, EXTRACT(MONTH FROM cfdi_date) AS m FROM sat)"))
    O["x6_month_key"] = _q(["sat"], fin("receipt_number:i month_key:s y:i m:i month_start:D",
        "(SELECT receipt_number, strftime(cfdi_date, '%Y-%m') AS month_key, year(cfdi_date) AS y, month(cfdi_date) AS m, "
        "CAST(date_trunc('month', cfdi_date) AS DATE) AS month_start FROM sat)"))
    O["x7_date_parse"] = _q(["sat"], fin("receipt_number:i parsed:t end_of_day:t",
        "(SELECT receipt_number, strptime(strftime(cfdi_date, '%d/%m/%Y'), '%d/%m/%Y') AS parsed, "
        "CAST(cfdi_date AS DATE) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS end_of_day FROM sat)"))
    O["x9_truncate"] = _q(["bank"], fin("bank_name:s value_date:t ref:s whole:i whole_shifted:i",
        "(SELECT bank_name, value_date, ref, CAST(trunc(posting_amount) AS BIGINT) AS whole, "
        "CAST(trunc(posting_amount - 50000) AS BIGINT) AS whole_shifted FROM bank)"))
    O["x10_round"] = fin("l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i r_pos:d r_neg:d",
        "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS r_pos, "
        "round(-(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))), 2) AS r_neg FROM lineitem)")
    O["x11_sap_sums"] = _q(["iva_bcs"], fin("reference:i subtotal_sap:d total_aplicacion_sap:d",
        "(SELECT reference, base_16 + cero_nacional + cero_extranjero AS subtotal_sap, "
        "base_16 + cero_nacional + cero_extranjero + iva + ieps AS total_aplicacion_sap FROM iva_bcs)"))
    O["x12_payment_prorating"] = _q(["pror"], fin("folio_interno:i uuid_complemento:s subtotal_sat:d iva_cobrado_sat:d ieps_cobrado_sat:d total_aplicacion_sat:d", "pror"))
    O["x13_validators"] = _q(["pror"], fin("folio_interno:i uuid_complemento:s validador_subtotal_validador_iva:d validar_ivas_validador_iva:d validador_ieps_validador_iva:d", "pror"))
    O["x14_total_variance"] = _q(["pror"], fin("folio_interno:i uuid_complemento:s total_variacion_validador_iva:d", "pror"))
    O["x15_default_label"] = _q(["pror"], fin("folio_interno:i uuid_complemento:s uuid_relacionado:s validador_aplicacion_pagos:i", "pror"))
    O["x17_diff_sat_sap"] = _q(["v1"], fin("receipt_number:i diff_sat_sap:s", "v1"))
    O["x18_status"] = _q(["lstr"], fin("receipt_number:i status_conciliation:s", "lstr"))
    O["x18_status_per_invoice"] = _q(["v1", "ma_pc"], fin("receipt_number:i status_conciliation:s",
        f"(SELECT v.receipt_number, CASE WHEN pc.bank_name IS NOT NULL THEN 'Conciliado' "
        f"WHEN v.cfdi_date + INTERVAL 3 MONTH <= {AS_OF} THEN 'Revision Manual' ELSE 'En Proceso de Conciliación' END AS status_conciliation "
        f"FROM v1 v LEFT JOIN ma_pc pc ON v.clearing_payment_policy IS NOT DISTINCT FROM pc.clearing_payment_policy)"))
    O["x19_tax_validator"] = _q(["v1"], fin("ledger_vat:d sat_vat:d ledger_ieps:d sat_ieps:d vat_variance:d ieps_variance:d vat_sign:d ieps_sign:d",
        "(SELECT *, ledger_vat - sat_vat AS vat_variance, ledger_ieps - sat_ieps AS ieps_variance, "
        "sign(ledger_vat - sat_vat) AS vat_sign, sign(ledger_ieps - sat_ieps) AS ieps_sign FROM ("
        "SELECT SUM(amount_in_doc_curr_iva_traladado) AS ledger_vat, SUM(vat_16) AS sat_vat, "
        "SUM(amount_in_doc_curr_ieps) AS ledger_ieps, SUM(ieps) AS sat_ieps FROM v1))"))
    O["x20_income_vs_collected"] = _q(["sat", "bank_ev"], fin("metric:s value:d",
        "(SELECT 'total_income' AS metric, CAST(SUM(total_amount) AS DOUBLE) AS value FROM sat "
        "UNION ALL SELECT 'total_expenses', CAST(SUM(posting_amount) AS DOUBLE) FROM bank_ev)"))
    O["x21_entity_label"] = _q(["v1"], fin("receipt_number:i entity:s", "v1"))

    number = r"^[+-]?\\d+(\\.\\d*)?$".replace("\\\\", "\\")
    whole = lambda e: (f"CASE WHEN regexp_matches({e}, '{number}') THEN CAST(CAST(regexp_extract({e}, '^[+-]?\\d+') AS HUGEINT) "  # noqa: E731
                       f"AS VARCHAR) ELSE NULLIF({e}, '') END")
    key = "CAST(l_orderkey AS VARCHAR)"
    O["q6_norm_key"] = fin("l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i k_float:s k_price:s k_alpha:s k_exp:s k_zeros:s k_long:s t_zeros:s t_float:s",
        "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{whole(e)} AS {n}" for e, n in [
            (f"({key} || '.0')", "k_float"), ("CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR)", "k_price"),
            ("('INV-' || CAST(l_linenumber AS VARCHAR))", "k_alpha"), (f"({key} || 'E3')", "k_exp"),
            (f"('00' || {key})", "k_zeros"), (f"('12345678901234567890' || {key})", "k_long")])
        + f", '00' || {key} AS t_zeros, '00' || {key} AS t_float FROM lineitem)")
    O["j1_padded_reference"] = _q(["la"], fin("folio:s clearing_document:i",
        "(SELECT '00' || CAST(o.o_orderkey AS VARCHAR) AS folio, min(x.l_partkey) AS clearing_document FROM orders o "
        "JOIN la x ON x.reference = o.o_orderkey GROUP BY o.o_orderkey)"))
    txt = "replace(CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR), '.', ',')"
    O["q7_dec_comma"] = fin("l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i amount:d bad:d",
        f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(replace(trim({txt}), ',', '.') AS DECIMAL(20,5)) AS amount, "
        f"TRY_CAST(replace(trim({txt} || 'x'), ',', '.') AS DECIMAL(20,5)) AS bad FROM lineitem)")
    O["q14_credits_only"] = _q(["bank_ev"], fin("id:i bank_name:s posting_amount:d",
        "(SELECT id, bank_name, posting_amount - 5 AS posting_amount FROM bank_ev WHERE CAST(trunc(posting_amount - 5) AS BIGINT) > 0)"))
    O["q15_classify_taxes"] = _q(["inv_cls"], fin("invoice_key:i vat_16:d has_16:b has_0:b ieps:d vat_total:d subtotal:d tax_rate:s subtotal_16:d vat_0:d", "inv_cls"))
    O["s3_tax_lines"] = _q(["tl"], fin("invoice_key:i l_linenumber:i l_partkey:i l_suppkey:i tax_code:s rate:s amount:d", "tl"))

    O["v1_conciliations_view"] = _q(["v1"], fin(V1_SPEC, "v1"))
    O["v2_raw_data"] = _q(["v2"], fin(V2_SPEC, "v2"))
    O["v3_conciliaciones"] = _v3()
    O["v4_dashboard"] = _q(["pror"], fin("cliente:s rfc:s fecha:t iva_cobrado_sat:d iva:d validar_ivas_validador_iva:d ieps_cobrado_sat:d ieps:d validador_ieps_validador_iva:d",
        "(SELECT nombre AS cliente, rfc, fecha_emision AS fecha, iva_cobrado_sat, iva, validar_ivas_validador_iva, ieps_cobrado_sat, ieps, validador_ieps_validador_iva FROM pror)"))
    O["v5_reconciliation_listing"] = _q(["lst"], fin(LISTING_SPEC, "lst"))
    O["v5_listing_filtered"] = _q(["lstr"], fin(LISTING_SPEC, "lstr"))
    O["v5_page"] = _q(["lstr"], fin(LISTING_SPEC, "(SELECT * FROM lstr ORDER BY clearing_payment_policy ASC NULLS LAST, receipt_number LIMIT 20 OFFSET 20)"))
    rep_full_cols = [c.split(":")[0] for c in LISTING_SPEC.split()]
    rep_sel = ", ".join("CAST(ieps AS VARCHAR) AS ieps" if c == "ieps" else c for c in rep_full_cols)
    rep_tot = ", ".join("ieps" if c == "ieps" else f"NULL AS {c}" for c in rep_full_cols)
    v6_spec = " ".join("ieps:s" if s.startswith("ieps:") else s for s in LISTING_SPEC.split()) + " subtotal_iva_16:s iva_16:s iva_0:s total_sat:s"
    O["v6_report"] = _q(["rep", "vr"], fin(v6_spec,
        f"(SELECT {rep_sel}, NULL AS subtotal_iva_16, NULL AS iva_16, NULL AS iva_0, NULL AS total_sat FROM rep "
        f"UNION ALL SELECT {rep_tot}, subtotal_iva_16, iva_16, iva_0, total_sat FROM (SELECT {TOTALS} FROM vr))"))
    O["v7_bank_page"] = _q(["bank_ev"], fin(bl_spec,
        f"(SELECT * FROM (SELECT {bl} FROM bank_ev WHERE book_date {EV_RANGE}) ORDER BY book_date, bank_name, ref LIMIT 200 OFFSET 200)"))
    O["v7_bank_page_after"] = O["v7_bank_page"]
    O["v7_bank_page_info"] = _q(["bank_ev"], fin("total:i page_size:i total_pages:i",
        f"(SELECT count(*) AS total, 200 AS page_size, (count(*) + 199) // 200 AS total_pages FROM bank_ev WHERE book_date {EV_RANGE})"))
    span = "BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '2024-01-09 23:59:00'"
    inv, post = f"(SELECT * FROM sat WHERE cfdi_date {span})", f"(SELECT * FROM bank_ev WHERE value_date {span})"
    one = lambda part, key, value, src: f"SELECT '{part}' AS part, '{key}' AS key, CAST({value} AS DOUBLE) AS value FROM {src}"
    O["v8_dashboard"] = _q(["sat", "bank_ev"], fin("part:s key:s value:d", "(" + " UNION ALL ".join([
        one("total", "total_amount_transactions", "SUM(posting_amount)", post), one("total", "total_transactions_sum", "count(id)", post),
        one("total", "total_income", "SUM(total_amount)", inv), one("total", "vat_16", "SUM(vat_16)", inv),
        one("total", "ieps", "SUM(ieps)", inv), one("income", "total_income", "SUM(total_amount)", inv),
        one("income", "total_expenses", "SUM(posting_amount)", post),
        one("tax", "vat_16", "SUM(vat_16)", inv + " WHERE payment_method IN ('PUE', 'PPD')"),
        one("tax", "ieps", "SUM(ieps)", inv + " WHERE payment_method IN ('PUE', 'PPD')"),
        f"SELECT * FROM (SELECT 'client', client_name, CAST(SUM(total_amount) AS DOUBLE) AS s FROM {inv} GROUP BY 2 ORDER BY s DESC, 2 LIMIT 5)",
        f"SELECT 'bank', bank_name, CAST(SUM(posting_amount) AS DOUBLE) FROM {post} GROUP BY 2"]) + ")"))
    O["v8_bank_summary"] = _q(["bank_ev"], fin("bank_name:s total_posting_amount:d total_transactions:i",
        f"(SELECT bank_name, SUM(posting_amount) AS total_posting_amount, COUNT(id) AS total_transactions FROM bank_ev WHERE value_date {EV_RANGE} GROUP BY bank_name)"))
    O["v8_top_clients"] = O["l2_top_clients"]
    O["v9_filter_choices"] = _q(["v1", "bank_ev"], fin("kind:s value:s",
        "(SELECT DISTINCT 'rfc' AS kind, rfc AS value FROM v1 UNION ALL SELECT DISTINCT 'client', client_name FROM v1 "
        "UNION ALL SELECT DISTINCT 'bank', bank_name FROM bank_ev)"))
    O["v10_tax_detail"] = _q(["vr"], fin("receipt_number:i vat_16:d vat_0:d ieps:d amount_in_doc_curr_iva_traladado:d amount_in_doc_curr_ieps:d", "vr"))
    O["v10_total_income"] = _q(["vr"], fin("sum_total:d", "(SELECT SUM(total_amount) AS sum_total FROM vr)"))
    return O
