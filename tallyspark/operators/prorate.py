"""Payment pro-rating and validators of the prototype views.

Ratios are computed in DOUBLE and rounded at the end (DECIMAL division would
change scale with the operand types); the "is the payment exact" test stays
in DECIMAL, like the reference's NUMERIC arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import as_col

# Fixed value: label of an invoice without a payment complement.
NO_COMPLEMENT = "Sin Complemento"


def prorate(paid, subtotal, iva, ieps) -> dict[str, Column]:
    """``base = paid / (1 + iva/sub + ieps/sub)``; ``iva_paid =
    base*iva/sub``; ``ieps_paid = base*ieps/sub``; rounded to 2; no payment ->
    0.  A zero subtotal gives NULL (the reference raises a division error)."""
    p, s = as_col(paid).cast("double"), F.nullif(as_col(subtotal).cast("double"), F.lit(0.0))
    r_iva, r_ieps = as_col(iva).cast("double") / s, as_col(ieps).cast("double") / s
    base = p / (F.lit(1.0) + (r_iva + r_ieps))   # same association as the reference
    none = as_col(paid).isNull()
    return {
        "subtotal_sat": F.when(none, F.lit(0.0)).otherwise(F.round(base, 2)),
        "iva_cobrado_sat": F.when(none, F.lit(0.0)).otherwise(F.round(base * r_iva, 2)),
        "ieps_cobrado_sat": F.when(none, F.lit(0.0)).otherwise(F.round(base * r_ieps, 2)),
        "_base": base, "_r_iva": r_iva, "_r_ieps": r_ieps,
    }


def exact_payment(total, paid) -> Column:
    """``(round(total - paid, 2) + paid) - total = 0`` in exact arithmetic."""
    t, p = as_col(total), as_col(paid)
    return (F.round(t - p, 2) + p) - t == 0


def validators(total, paid, subtotal, iva, ieps) -> dict[str, Column]:
    """X13 (subtotal, VAT, IEPS validators) and X14 (total variance)."""
    pr = prorate(paid, subtotal, iva, ieps)
    none = as_col(paid).isNull()
    exact = exact_payment(total, paid)

    def v(expr):
        return F.when(none, F.lit(0.0)).when(exact, F.lit(0.0)).otherwise(F.round(expr, 2))

    d = F.round(as_col(total) - as_col(paid), 2)
    variance = (F.when(none, F.lit(0).cast("decimal(22,2)"))
                .when(d > 0, (d + as_col(paid)) - as_col(total))
                .otherwise(d))
    return {
        "validador_subtotal_validador_iva": v(as_col(subtotal).cast("double") - pr["_base"]),
        "validar_ivas_validador_iva": v(as_col(iva).cast("double") - pr["_base"] * pr["_r_iva"]),
        "validador_ieps_validador_iva": v(as_col(ieps).cast("double") - pr["_base"] * pr["_r_ieps"]),
        "total_variacion_validador_iva": variance,
    }


def sap_sums(base_16, cero_nacional, cero_extranjero, iva, ieps) -> dict[str, Column]:
    """X11 ledger-side sums; NULL propagates."""
    sub = as_col(base_16) + as_col(cero_nacional) + as_col(cero_extranjero)
    return {"subtotal_sap": sub, "total_aplicacion_sap": sub + as_col(iva) + as_col(ieps)}


def with_prorating(df: DataFrame, total="total", paid="importe_pagado", subtotal="subtotal",
                   iva="iva", ieps="ieps", complement="uuid_complemento") -> DataFrame:
    """X12-X16 on an invoice x payment row set."""
    pr = prorate(paid, subtotal, iva, ieps)
    va = validators(total, paid, subtotal, iva, ieps)
    return df.select(
        "*",
        F.coalesce(F.col(complement), F.lit(NO_COMPLEMENT)).alias("uuid_relacionado"),
        pr["subtotal_sat"].alias("subtotal_sat"),
        pr["iva_cobrado_sat"].alias("iva_cobrado_sat"),
        pr["ieps_cobrado_sat"].alias("ieps_cobrado_sat"),
        F.coalesce(F.col(paid), F.lit(0).cast("decimal(20,2)")).alias("total_aplicacion_sat"),
        F.lit(0).alias("validador_aplicacion_pagos"),
        *[e.alias(n) for n, e in va.items()])
