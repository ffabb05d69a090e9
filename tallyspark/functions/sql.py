"""SQL function registration (the reference's only UDF surface, X1)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .money import FORMAT_PRICE_SQL as _TEMPLATE


def register_functions(spark: SparkSession) -> None:
    """``format_price(DOUBLE)`` and ``format_price_numeric(DECIMAL)`` (the
    NUMERIC overload, rounding half away from zero first) as SQL UDFs --
    inlined by Catalyst, no Python at run time."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION format_price(p DOUBLE) RETURNS STRING RETURN "
              + _TEMPLATE.format(p="p"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION format_price_numeric(x DECIMAL(38,6)) RETURNS STRING RETURN "
              + _TEMPLATE.format(p="round(x, 2)"))
