"""Tables of the model in the session's catalogue (K4, Q17): created where missing, with NOT NULL columns, defaults and
a partitioned layout; filled with rejects instead of failed jobs; dropped.

Invoices and postings are partitioned by month and the tax ledgers are one table partitioned by entity and tax account,
so a date range or an account reads its own folders only.  A write rebalances its rows by the partition columns first:
a partition is written by as many tasks as its size asks for, and small ones share a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import all_of, blank


@dataclass(frozen=True)
class TableSpec:
    """``defaults``: SQL text by column, for columns that an insert leaves out or has NULL in.  ``required``: columns
    without which a row is rejected.  ``partitions``: SQL text by partition column, over the other columns; NULL
    means a column of the rows."""

    name: str
    columns: T.StructType
    required: tuple[str, ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    partitions: dict[str, str | None] = field(default_factory=dict)

    def ddl(self, database: str) -> str:
        types = {f.name: f.dataType.simpleString() for f in self.columns.fields}
        types |= {c: types.get(c, "string") for c in self.partitions}
        lines = [f"`{c}` {t}" + (" NOT NULL" if c in self.required else "")
                 + (f" DEFAULT {self.defaults[c]}" if c in self.defaults else "") for c, t in types.items()]
        parts = ", ".join(f"`{c}`" for c in self.partitions)
        return (f"CREATE TABLE IF NOT EXISTS `{database}`.`{self.name}` ({', '.join(lines)}) USING parquet"
                + (f" PARTITIONED BY ({parts})" if parts else ""))


MONTH = "date_format({}, 'yyyy-MM')"


def invoice_table(columns: T.StructType) -> TableSpec:
    """Q17: amounts in foreign currency default to 0, the state to ``uploaded``, ``created_at`` to now."""
    zero = {f.name: "0" for f in columns.fields if f.name.endswith("_me")}
    extra = [f for f in (T.StructField("created_at", T.TimestampType()),) if f.name not in columns.names]
    return TableSpec("invoices", T.StructType([*columns.fields, *extra]), ("receipt_number", "payment_method", "fiscal_uuid"),
                     {"state": "'uploaded'", "created_at": "current_timestamp()", **zero},
                     {"month": MONTH.format("cfdi_date")})


def posting_table(columns: T.StructType) -> TableSpec:
    return TableSpec("postings", columns, ("bank_name",), {"created_at": "current_timestamp()"},
                     {"month": MONTH.format("book_date")})


def tax_ledger_table(columns: T.StructType) -> TableSpec:
    """One table for the tax ledgers of all entities and accounts."""
    return TableSpec("tax_ledger", columns, partitions={"entity": None, "tax_account": None})


def create_tables(spark: SparkSession, database: str, tables: list[TableSpec], location: str | None = None,
                  views: dict[str, str] | None = None) -> list[str]:
    """K4: creates the database, its tables and ``views`` (SQL text by name).  Tables that exist stay as they are, rows
    included; views are replaced.  ``location`` is the shared folder of a new database (else the warehouse's)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`" + (f" LOCATION '{location}'" if location else ""))
    for t in tables:
        spark.sql(t.ddl(database))
    for name, text in (views or {}).items():
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS {text}")
    return sorted(r.tableName for r in spark.sql(f"SHOW TABLES IN `{database}`").collect() if not r.isTemporary)


def drop_tables(spark: SparkSession, database: str) -> None:
    """K4: drops the database with its tables, their rows and its views; nothing where there is none."""
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")


def split_required(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(rows with all required columns, the others with ``reject_reason`` naming the missing ones).  A required column
    that the frame does not have at all is missing in every row."""
    lacks = [F.when(F.col(c).isNull() if c in df.columns else F.lit(True), F.lit(c)) for c in spec.required]
    reason = F.concat_ws(", ", *lacks) if lacks else F.lit("")
    return df.where(reason == ""), df.withColumn("reject_reason", reason).where("reject_reason <> ''")


def insert_rows(df: DataFrame, database: str, spec: TableSpec) -> DataFrame:
    """Appends the rows of ``df`` by column name and returns those rejected.  Columns that ``df`` lacks get their
    defaults, and so do NULLs in columns with a default; columns that the table does not know are not stored."""
    good, bad = split_required(df, spec)
    own = [c for c in spec.columns.names if c in df.columns and c not in spec.partitions]
    values = [F.coalesce(F.col(c), F.expr(spec.defaults[c])).alias(c) if c in spec.defaults else F.col(c) for c in own]
    parts = [(F.expr(e) if e else F.col(c)).alias(c) for c, e in spec.partitions.items()]
    rows = good.select(*values, *parts)
    if parts:
        rows = rows.hint("rebalance", *spec.partitions)
    names = ", ".join(f"`{c}`" for c in rows.columns)
    df.sparkSession.sql(f"INSERT INTO `{database}`.`{spec.name}` ({names}) SELECT {names} FROM {{rows}}", rows=rows)
    return bad


def by_month(table: DataFrame, date_col: str, start=None, end=None) -> DataFrame:
    """F2-F8 over a table partitioned by month: the rows of the dates, read from the months that the dates span."""
    day, month = F.col(date_col).cast("date"), F.col("month")
    as_month = lambda d: F.date_format(F.lit(d).cast("date"), "yyyy-MM")
    return table.where(all_of([
        None if blank(start) else (month >= as_month(start)) & (day >= F.lit(start).cast("date")),
        None if blank(end) else (month <= as_month(end)) & (day <= F.lit(end).cast("date"))]))
