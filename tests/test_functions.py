from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dec_comma, format_price, money_text, norm_key, register_functions, trunc_int
from tallyspark.functions.dates import month_bounds, parse_date_param


def _one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,expected", [
    (0.0, "$0"), (0.5, "$.50"), (1234567.5, "$1,234,567.50"), (None, None), (2.5e9, "$###,###,###.##"),
    (-5.0, "$-5.00"), (999999999.99, "$999,999,999.99"),
])
def test_format_price(spark, value, expected):
    assert _one(spark, format_price, value, "double") == expected


def test_format_price_numeric_rounds_half_up(spark):
    assert _one(spark, lambda c: format_price(c, numeric=True), Decimal("2.345"), "decimal(10,3)") == "$2.35"
    assert _one(spark, lambda c: format_price(c, numeric=True), Decimal("-2.345"), "decimal(10,3)") == "$-2.35"


def test_sql_udf_matches_column_function(spark):
    register_functions(spark)
    r = spark.sql("SELECT format_price(0.5D) a, format_price(0D) b, format_price(CAST(NULL AS DOUBLE)) c, "
                  "format_price_numeric(1234567.505) d").first()
    assert (r.a, r.b, r.c, r.d) == ("$.50", "$0", None, "$1,234,567.51")


def test_money_text(spark):
    assert _one(spark, money_text, 0.5, "double") == "$0.50"
    assert _one(spark, money_text, 0.0, "double") == "$0.00"
    assert _one(spark, money_text, -5.0, "double") == "$-5.00"


@pytest.mark.parametrize("text,expected", [("123.0", "123"), ("123.9", "123"), (" 42 ", "42"), ("INV-7", "INV-7"),
                                           (None, None), ("", None), ("9007199254740993", "9007199254740993"),
                                           ("12E3", "12E3"), ("0012", "12"), ("-007.5", "-7"), ("-0", "0"), ("000", "0"),
                                           ("12345678901234567890123456789012345678901", "12345678901234567890123456789012345678901")])
def test_norm_key(spark, text, expected):
    assert _one(spark, norm_key, text, "string") == expected


def test_dec_comma(spark):
    assert _one(spark, dec_comma, "18,5321", "string") == Decimal("18.53210")
    assert _one(spark, dec_comma, "n/a", "string") is None


def test_trunc_toward_zero(spark):
    assert _one(spark, trunc_int, -1.9, "double") == -1
    assert _one(spark, trunc_int, 100.99, "double") == 100


def test_date_params():
    assert parse_date_param("2024-03-05", end_of_day=True).strftime("%H:%M") == "23:59"
    assert parse_date_param("") is None
    with pytest.raises(ValueError):
        parse_date_param("05/03/2024")
    lo, hi = month_bounds("2024-12")
    assert (lo.month, hi.year, hi.month) == (12, 2025, 1)
