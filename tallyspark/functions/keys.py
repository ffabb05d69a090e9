"""Key and number normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import as_col


def norm_key(c) -> Column:
    """Q6 ``str(int(x))`` for document and account numbers, on both ends of a lookup.  Numbers written as decimals lose their fraction
    (``"123.0"`` -> ``"123"``, ``"123.9"`` -> ``"123"``), leading zeros and a plus sign; everything else that is not
    plain digits with an optional sign and fraction (``"12E3"``, ``"INV-1"``) stays as trimmed text.  Digits are cut as
    text, so ids of any length stay exact; ``"-0"`` is ``"0"``; blank is NULL."""
    s = F.trim(as_col(c).cast("string"))
    plain = r"^([+-]?)0*(\d+?)(?:\.\d*)?$"
    digits = F.regexp_extract(s, plain, 2)
    sign = F.when((F.regexp_extract(s, plain, 1) == "-") & (digits != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(s.rlike(plain), F.concat(sign, digits)).otherwise(F.nullif(s, F.lit("")))


def text_key(c) -> Column:
    """Q6 for keys that are text (reference, folio, assignment): trimmed, leading zeros kept; only the zero fraction
    that a spreadsheet adds to a whole number goes (``"0012.0"`` -> ``"0012"``); blank is NULL."""
    s = F.trim(as_col(c).cast("string"))
    return F.nullif(F.regexp_replace(s, r"^([+-]?\d+)\.0+$", "$1"), F.lit(""))


def dec_comma(c, scale: int = 5) -> Column:
    """Q7 decimal comma ``"18,5"`` -> 18.5; unparsable text -> NULL."""
    return F.replace(F.trim(as_col(c)), F.lit(","), F.lit(".")).try_cast(f"decimal(20,{scale})")


def trunc_int(c) -> Column:
    """X9 ``int(x)``: truncate toward zero."""
    return as_col(c).cast("bigint")


def money(c) -> Column:
    """Amounts are carried as DECIMAL(20,2) so sums are exact and
    order-independent (the truncation key of J7 must be stable)."""
    return as_col(c).cast("decimal(20,2)")


def nz_string(c) -> Column:
    """Q8: null-safe stringify; empty / 'nan' / 'None' text counts as NULL."""
    s = as_col(c).cast("string")
    return F.when(F.lower(F.trim(s)).isin("", "nan", "none", "nat"), F.lit(None).cast("string")).otherwise(s)
