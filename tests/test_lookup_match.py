import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.lookup import (bank_via_ledger, chained_lookup, exists_switch, first_per_key,
                                         priority_lookup, strict_lookup)
from tallyspark.operators.match import (STATUS_IN_PROCESS, STATUS_MANUAL, STATUS_MATCHED, attach_bank,
                                        first_match_per_clearing, match_on_amount, with_status)

LEDGER = "reference bigint, seq int, account bigint, clearing bigint"


def test_priority_lookup_cases(spark):
    base = spark.createDataFrame([(1,), (2,), (3,), (4,)], "receipt bigint")
    a = spark.createDataFrame([(1, 2, 11, 101), (1, 1, None, 100), (3, 1, 31, 300)], LEDGER)
    b = spark.createDataFrame([(1, 1, 19, 109), (2, 1, 21, 200), (3, 1, 39, 309)], LEDGER)
    out = {r.receipt: r for r in priority_lookup(base, [a, b], "receipt", "reference", ["account", "clearing"],
                                                 ["seq"], hit_label=["A", "B"]).collect()}
    # row 1: A's first row (seq 1) has NULL account -> B's account, A's clearing (per-column fallback)
    assert (out[1].account, out[1].clearing, out[1].entity) == (19, 100, "A")
    assert (out[2].account, out[2].clearing, out[2].entity) == (21, 200, "B")
    assert (out[3].account, out[3].clearing) == (31, 300)
    assert (out[4].account, out[4].clearing, out[4].entity) == (None, None, None)


def test_first_per_key_lowest_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (None, 1, "n")], "k bigint, o int, v string")
    got = {r.k: r.v for r in first_per_key(df, "k", ["v"], ["o"]).collect()}
    assert got == {1: "a", None: "n"}


def test_chained_lookup_default_zero(spark):
    base = spark.createDataFrame([(1, 100), (2, 999), (3, None)], "id bigint, clearing bigint")
    aux = spark.createDataFrame([(100, 2, D("5.00")), (100, 1, D("7.00"))], "cd bigint, o int, amt decimal(20,2)")
    got = {r.id: r.x for r in chained_lookup(base, "clearing", [(aux, "amt", "x")], "cd", ["o"]).collect()}
    assert got == {1: D("7.00"), 2: D("0.00"), 3: D("0.00")}


def test_exists_switch_has_no_per_column_fallback(spark):
    base = spark.createDataFrame([(1,), (2,)], "folio bigint")
    a = spark.createDataFrame([(1, None, D("1"))], "reference bigint, doc bigint, iva decimal(10,2)")
    b = spark.createDataFrame([(1, 55, D("2")), (2, 66, D("3"))], "reference bigint, doc bigint, iva decimal(10,2)")
    got = {r.folio: (r.doc, r.iva) for r in exists_switch(base, "folio", a, b, "reference", ["doc", "iva"]).collect()}
    assert got == {1: (None, D("1.00")), 2: (66, D("3.00"))}


def test_exists_switch_looks_at_the_chosen_side_only(spark):
    cols = "reference bigint, doc bigint"
    a = spark.createDataFrame([(1, 5), (3, 8), (3, 9)], cols)
    b = spark.createDataFrame([(1, 6), (1, 7), (2, 4), (9, 1), (9, 2)], cols)
    base = spark.createDataFrame([(1,), (2,)], "folio bigint")
    got = {r.folio: r.doc for r in exists_switch(base, "folio", a, b, "reference", ["doc"]).collect()}
    assert got == {1: 5, 2: 4}
    for key in (3, 9):  # two rows on the chosen side
        with pytest.raises(Exception, match="more than one row"):
            exists_switch(spark.createDataFrame([(key,)], "folio bigint"), "folio", a, b, "reference", ["doc"]).collect()


def test_strict_lookup_raises_for_asked_keys_only(spark):
    t = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "reference bigint, doc bigint")
    base = spark.createDataFrame([(2, "x"), (None, "y")], "folio bigint, name string")
    assert {r.name: r.doc for r in strict_lookup(base, "folio", t, "reference", ["doc"]).collect()} == {"x": 7, "y": None}
    with pytest.raises(Exception, match="more than one row"):
        strict_lookup(spark.createDataFrame([(1,)], "folio bigint"), "folio", t, "reference", ["doc"]).collect()


def test_bank_via_ledger(spark):
    base = spark.createDataFrame([(1,), (2,)], "folio bigint")
    led = spark.createDataFrame([(1, 500), (1, 500)], "reference bigint, doc bigint")
    bank = spark.createDataFrame([(500, D("10.00"))], "document_number bigint, depositos decimal(20,2)")
    got = {r.folio: r.depositos for r in bank_via_ledger(base, "folio", led, "reference", "doc", bank,
                                                         "document_number", ["depositos"]).collect()}
    assert got == {1: D("10.00"), 2: None}


POST = "bank_name string, comment string, value_date timestamp_ntz, total_posting_amount decimal(20,2), ref string"


def _posts(spark, rows):
    return spark.createDataFrame(rows, POST)


def test_match_on_amount_whole_units(spark):
    d = dt.datetime(2024, 1, 1)
    groups = spark.createDataFrame([(1, "c", D("100.99")), (2, "c", D("99.99")), (3, "c", D("-1.90"))],
                                   "clearing_payment_policy bigint, client_name string, sum decimal(20,2)")
    posts = _posts(spark, [("B2", "x", d, D("100.01"), "r2"), ("B1", "x", d, D("100.50"), "r1"),
                           ("B1", "x", d, D("100.00"), "r0"), ("B3", "x", d, D("-1.10"), "r3")])
    got = {r.clearing_payment_policy: (r.bank_name, r.ref) for r in match_on_amount(groups, posts).collect()}
    # 99.99 -> 99 matches nothing; 100.99 -> first of the three 100.xx postings by (date, bank, ref)
    assert got == {1: ("B1", "r0"), 3: ("B3", "r3")}


def test_two_pass_priority_and_null_safe_attach(spark):
    d = dt.datetime(2024, 1, 1)
    cols = "clearing_payment_policy bigint, client_name string, bank_name string, comment string, " \
           "value_date timestamp_ntz, total_posting_amount decimal(20,2), ref string"
    p_client = spark.createDataFrame([(7, "b", "CLIENTPASS", "x", d, D("1.00"), "r")], cols)
    p_plain = spark.createDataFrame([(7, "a", "PLAIN", "x", d, D("1.00"), "r"),
                                     (8, "a", "ONLYPLAIN", "x", d, D("1.00"), "r"),
                                     (None, "z", "NULLDOC", "x", d, D("1.00"), "r")], cols)
    per = first_match_per_clearing([p_client, p_plain])
    got = {r.clearing_payment_policy: r.bank_name for r in per.collect()}
    assert got == {7: "CLIENTPASS", 8: "ONLYPLAIN", None: "NULLDOC"}
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "receipt_number bigint, clearing_payment_policy bigint")
    safe = {r.receipt_number: r.bank_name for r in attach_bank(rows, per).collect()}
    strict = {r.receipt_number: r.bank_name for r in attach_bank(rows, per, null_safe=False).collect()}
    assert safe == {1: "CLIENTPASS", 2: "NULLDOC", 3: None}
    assert strict == {1: "CLIENTPASS", 2: None, 3: None}


def test_status_rules(spark):
    df = spark.createDataFrame([(True,), (False,)], "m boolean")
    s = lambda start, as_of: [r.status_conciliation for r in with_status(df, F.col("m"), start, as_of).collect()]
    assert s("2022-11-29", "2023-02-28") == [STATUS_MATCHED, STATUS_MANUAL]
    assert s("2022-11-30", "2023-02-27") == [STATUS_MATCHED, STATUS_IN_PROCESS]
    assert s(None, "2030-01-01") == [STATUS_MATCHED, STATUS_IN_PROCESS]
