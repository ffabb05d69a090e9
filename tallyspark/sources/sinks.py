"""Sinks (K1-K6).  Every write is one distributed job; nothing is collected
to the driver."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """K1 append rows to a table folder (one job per batch, not per row)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_report(detail: DataFrame, totals: DataFrame, path: str) -> None:
    """K2 report export: detail rows followed by the totals row (U3) as CSV
    with a header (workbook writing is out of scope)."""
    from ..operators.setops import report_union
    report_union(detail, totals).write.mode("overwrite").option("header", True).csv(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """K3 JSON rows (the listing responses) as JSON Lines."""
    df.write.mode("overwrite").json(path)


def create_catalog(spark: SparkSession, frames: dict[str, DataFrame], functions: bool = True) -> list[str]:
    """K4 create-or-replace the views of the model (temp views over the
    given DataFrames) and register the SQL functions."""
    from ..functions.sql import register_functions
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    if functions:
        register_functions(spark)
    return sorted(frames)


def seed_banks(spark: SparkSession, rows) -> DataFrame:
    """K5 seed a reference table from literal rows; text dates are day-first
    (``dd/MM/yyyy``)."""
    schema = T.StructType([T.StructField("depositos", T.DoubleType()), T.StructField("nombre", T.StringType()),
                           T.StructField("document_number", T.LongType()),
                           T.StructField("value_date_text", T.StringType())])
    df = spark.createDataFrame([(float(a), b, c, d) for a, b, c, d in rows], schema)
    return df.select("depositos", "nombre", "document_number",
                     F.to_date("value_date_text", "dd/MM/yyyy").alias("value_date"))


def append_fx(spark: SparkSession, rate: float, path: str, at: dt.datetime | None = None) -> None:
    """K6 store the day's exchange rate (always; the reference only stored it
    when the bank file was already registered)."""
    at = at or dt.datetime.now()
    df = spark.createDataFrame([(at, float(rate))], "created_at timestamp_ntz, exchange_rate double")
    append(df, path)
