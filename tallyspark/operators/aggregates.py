"""Aggregations (A1-A13).  All are hash/sort aggregates with partial
(map-side) combine, so hot groups are reduced before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import format_price

TOTAL_COLS = (("subtotal_16", "subtotal_iva_16"), ("vat_16", "iva_16"), ("vat_0", "iva_0"),
              ("ieps", "ieps"), ("total_amount", "total_sat"))


def invoice_totals(view: DataFrame, formatted: bool = True) -> DataFrame:
    """A1 grand totals (one row; NULLs over an empty input)."""
    sums = [F.sum(src).alias(dst) for src, dst in TOTAL_COLS]
    out = view.agg(*sums)
    if formatted:
        out = out.select(*[format_price(dst).alias(dst) for _, dst in TOTAL_COLS])
    return out


def sum_by_clearing(view: DataFrame, key: str = "clearing_payment_policy",
                    client: str = "client_name", amount: str = "total_amount") -> DataFrame:
    """A2 ``SUM(total_amount) GROUP BY clearing_payment_policy, client_name``
    (NULL clearing is a group)."""
    return view.groupBy(key, client).agg(F.sum(amount).alias("sum"))


POSTING_KEYS = ("bank_name", "value_date", "comment", "posting_amount", "ref")


def postings(bank: DataFrame, by_client: bool = False) -> DataFrame:
    """A3 / A4: postings grouped by (bank, value_date, comment,
    posting_amount, ref) -- plus ``client_name`` for A4, which is not
    projected -- with the summed amount (k identical lines -> k x amount)."""
    keys = [*POSTING_KEYS, *(["client_name"] if by_client else [])]
    return (bank.groupBy(*keys).agg(F.sum("posting_amount").alias("total_posting_amount"))
            .select("bank_name", "comment", "value_date", "total_posting_amount", "ref"))


def bank_summary(bank: DataFrame) -> DataFrame:
    """A5 per bank: summed amount and number of rows."""
    return bank.groupBy("bank_name").agg(F.sum("posting_amount").alias("total_posting_amount"),
                                         F.count("id").alias("total_transactions"))


def income_by_client(sat: DataFrame) -> DataFrame:
    """A6 per client: total, VAT and IEPS sums."""
    return sat.groupBy("client_name").agg(F.sum("total_amount").alias("sum_total_amount"),
                                          F.sum("vat_16").alias("sum_total_vat_16"),
                                          F.sum("ieps").alias("sum_total_ieps"))


def bank_summary_rollup(bank: DataFrame) -> DataFrame:
    """A7 (bank side) as a rollup: one row per bank plus the grand total row
    (``is_total = 1``)."""
    return (bank.rollup("bank_name")
            .agg(F.sum("posting_amount").alias("total_posting_amount"),
                 F.count("id").alias("total_transactions"),
                 F.grouping_id().alias("is_total")))


def dashboard_totals(bank: DataFrame, sat: DataFrame) -> DataFrame:
    """The dashboard's grand totals in long form (metric, value): total
    posted amount, number of postings, total income, VAT and IEPS.  Two
    global aggregates stacked with a union -- no product of tables."""
    b = bank.agg(F.sum("posting_amount").cast("double").alias("total_amount_transactions"),
                 F.count("id").cast("double").alias("total_transactions_sum"))
    s = sat.agg(F.sum("total_amount").cast("double").alias("total_income"),
                F.sum("vat_16").cast("double").alias("vat_16"),
                F.sum("ieps").cast("double").alias("ieps"))

    def stack(df):
        pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
        return df.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (metric, value)")

    return stack(b).unionByName(stack(s))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A8 ``SELECT DISTINCT col`` (NULL kept)."""
    return df.select(col).distinct()


def total_income(view: DataFrame) -> DataFrame:
    """A9."""
    return view.agg(F.sum("total_amount").alias("sum_total"))


def group_matches(matched: DataFrame) -> DataFrame:
    """A10: matched rows grouped by bank: amount sum and row count."""
    return (matched.where(F.col("bank_name").isNotNull())
            .groupBy("bank_name").agg(F.sum("posting_amount_number").alias("total_posting_amount"),
                                      F.count(F.lit(1)).alias("total_transactions")))


def page_info(df: DataFrame, size: int) -> DataFrame:
    """A11 ``total`` and ``ceil(total / size)``, computed on the cluster."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(size).alias("page_size"),
        ((F.col("total") + F.lit(size - 1)) / F.lit(size)).cast("bigint").alias("total_pages"))
