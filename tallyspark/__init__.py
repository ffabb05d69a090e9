"""tallyspark: invoice / ledger / bank reconciliation on Spark DataFrames."""

__version__ = "0.1.0"
