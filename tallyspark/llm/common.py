"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as every operator here splits texts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes (``bytes.split`` cuts at exactly the ASCII white space)."""
    return text.encode().split() if text else []


def schema_with(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The named columns of ``df`` with their own types, then the fields of the DDL string ``more``."""
    own = [T.StructField(c, df.schema[c].dataType, True) for c in columns]
    return T.StructType(own + T.StructType.fromDDL(more).fields)


def hex64(col) -> F.Column:
    """A 64-bit integer as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
