"""Money text (X1, X2) as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import as_col

# Fixed values that must equal the reference's output format:
#   zero is printed as "$0"; otherwise the Postgres mask FM$999,999,999.00
#   (thousands commas, two decimals, no leading zero before the point);
#   values needing more than nine integer digits print the mask as '#'.
ZERO_TEXT = "$0"
OVERFLOW_DIGITS = "###,###,###.##"
MASK_LIMIT = 1_000_000_000


# The mask as one SQL expression over ``{p}`` (shared with the SQL UDF).
FORMAT_PRICE_SQL = """CASE WHEN {p} IS NULL THEN CAST(NULL AS STRING)
     WHEN {p} = 0 THEN '$0'
     WHEN round(abs({p}), 2) >= 1000000000 THEN concat('$', IF({p} < 0, '-', ''), '###,###,###.##')
     ELSE concat('$', IF({p} < 0, '-', ''), regexp_replace(format_number(abs({p}), 2), '^0[.]', '.')) END"""


def format_price_sql(expr_sql: str, numeric: bool = False) -> Column:
    """``format_price`` of a SQL expression, built as a single expression
    (one call to the JVM instead of one per sub-expression)."""
    p = f"round(({expr_sql}), 2)" if numeric else f"({expr_sql})"
    return F.expr(FORMAT_PRICE_SQL.format(p=p))


def format_price(c, numeric: bool = False) -> Column:
    """X1 ``format_price``: NULL in, NULL out; 0 -> ``$0``; 0.5 -> ``$.50``;
    1234567.5 -> ``$1,234,567.50``; >= 10^9 -> ``$###,###,###.##``.
    ``numeric=True`` is the NUMERIC overload (rounds half away from zero
    first; DECIMAL rounding in Spark is HALF_UP).  A column *name* is
    formatted through ``format_price_sql``."""
    if isinstance(c, str):
        return format_price_sql(f"`{c}`", numeric)
    p = as_col(c)
    if numeric:
        p = F.round(p, 2)
    a = F.abs(p)
    sign = F.when(p < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.format_number(a, 2), r"^0\.", ".")
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(p == 0, F.lit(ZERO_TEXT))
            .when(F.round(a, 2) >= MASK_LIMIT, F.concat(F.lit("$"), sign, F.lit(OVERFLOW_DIGITS)))
            .otherwise(F.concat(F.lit("$"), sign, digits)))


def money_text(c) -> Column:
    """X2 Python ``f"${x:,.2f}"``: keeps ``$0.00``, ``$0.50``, ``$-5.00``."""
    return F.concat(F.lit("$"), F.format_number(as_col(c), 2))
