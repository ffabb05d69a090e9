"""Every registered query against its DuckDB oracle (rows-only where none)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def results(spark):
    from compare_oracle import compare
    return compare(spark, SF, verbose=False)


def test_all_queries_run_and_match(results):
    errors = {n: r["error"] for n, r in results.items() if "error" in r}
    assert not errors
    mism = [n for n, r in results.items() if r["oracle"] and not r.get("values_ok")]
    assert not mism, {n: results[n] for n in mism}


def test_properties(results):
    assert results["v5_reconciliation_listing"]["spark_rows"] == results["v1_conciliations_view"]["spark_rows"]
    assert results["u1_listing_union"]["spark_rows"] == 2 * results["v1_conciliations_view"]["spark_rows"]
    assert results["j7_match_on_amount"]["spark_rows"] <= results["a2_sum_by_clearing"]["spark_rows"]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"status_conciliation", "invoices", "total_amount"} and len(rows) >= 1
