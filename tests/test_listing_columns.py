from tallyspark.operators.aggregates import group_matches
from tallyspark.operators.filters import InvoiceFilter
from tallyspark.plans.bridge import Model
from tallyspark.plans.catalog import AS_OF
from tallyspark.plans.reports import reconciliation_listing


def test_a_listing_of_some_columns_has_the_same_rows(spark):
    m = Model(spark, "/root/testdata/sf0.001")
    some = reconciliation_listing(m, InvoiceFilter(), AS_OF, columns=("bank_name", "posting_amount_number"))
    assert some.columns == ["bank_name", "posting_amount_number"]
    rows = lambda df: sorted(map(tuple, group_matches(df).collect()))
    assert rows(some) == rows(reconciliation_listing(m, InvoiceFilter(), AS_OF))
