"""Lookups of the enrichment view.

The reference evaluates up to 18 correlated ``(SELECT x ... LIMIT 1)``
subqueries per invoice row.  Here every lookup table is first reduced to one
row per key with ``min_by(struct(cols), struct(order))`` -- a partial
(map-side) aggregation, so a hot key never lands whole on one task -- and is
then attached with one left join per table, sharing the join key's
partitioning.  ``LIMIT 1`` has no ORDER BY in the reference; we always pass an
explicit total order (``order_by``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import as_col

# Number of buckets a NULL join key is spread over (NULL never matches in a
# plain equi-join, yet all NULL rows would hash to one reducer).
NULL_SPREAD = 64


def first_per_key(df: DataFrame, key: str | Sequence[str], cols: Sequence[str],
                  order_by: Sequence[str | Column]) -> DataFrame:
    """One row per ``key``: the values of ``cols`` from the row that is first
    in ``order_by``.  NULL keys form one group (like SQL GROUP BY)."""
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in cols if c not in keys]
    order = F.struct(*[as_col(o) for o in order_by])
    return (df.groupBy(*keys)
            .agg(F.min_by(F.struct(*payload), order).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in payload]))


def _null_salt(base: DataFrame, key: str, spread_by: Sequence[str] | None, buckets: int) -> Column:
    """Deterministic salt (a hash of row values, not rand(), so a recomputed
    task after executor loss routes every row to the same reducer)."""
    by = list(spread_by) if spread_by else [c for c in base.columns if c != key][:3]
    if not by:
        return F.lit(0)
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(buckets))
                  ).otherwise(F.lit(0)).cast("int")


def first_per_key_by_source(sources: Sequence[DataFrame], src_key: str, cols: Sequence[str],
                            order_by: Sequence[str | Column]) -> DataFrame:
    """For several tables sharing a key: one row per key holding, per source
    ``i``, the struct ``_s{i}`` of the first row (by ``order_by``) of that
    source (NULL when the source lacks the key) and ``_hit{i}``.  The sources
    are tagged and unioned, so a single partial aggregation and a single
    shuffle serve all of them (``min_by`` skips rows whose ordering is NULL,
    i.e. rows of the other sources)."""
    need = list(dict.fromkeys([src_key, *cols, *[o for o in order_by if isinstance(o, str)]]))
    tagged = None
    for i, src in enumerate(sources):
        t = src.select(*need).withColumn("_src", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    order = F.struct(*[as_col(o) for o in order_by])
    payload = F.struct(*[F.col(c) for c in cols])
    aggs = []
    for i in range(len(sources)):
        mine = F.col("_src") == F.lit(i)
        aggs += [F.min_by(payload, F.when(mine, order)).alias(f"_s{i}"),
                 F.max(mine).alias(f"_hit{i}")]
    return tagged.groupBy(src_key).agg(*aggs)


def priority_lookup(base: DataFrame, sources: Sequence[DataFrame], base_key: str, src_key: str,
                    cols: Sequence[str], order_by: Sequence[str | Column],
                    rename: dict[str, str] | None = None, hit_label: Sequence[str] | None = None,
                    label_col: str = "entity") -> DataFrame:
    """Per base row and per column, the value of the first row (by
    ``order_by``) of source 0 whose ``src_key`` equals ``base_key``; when that
    value is NULL (or no row exists) the first row of source 1, and so on.
    The fallback is per column: a source-0 row with a NULL ``account`` still
    provides its clearing document.  ``hit_label`` adds X21's entity column
    (label of the first source holding the key).  All sources are reduced by
    one aggregation and attached by one left join."""
    rename = rename or {}
    r = first_per_key_by_source(sources, src_key, cols, order_by).withColumnRenamed(src_key, "_k")
    out = base.join(r, F.col(base_key) == F.col("_k"), "left")
    n = len(sources)
    picked = [F.coalesce(*[F.col(f"_s{i}.{c}") for i in range(n)]).alias(rename.get(c, c)) for c in cols]
    extra = []
    if hit_label:
        label = F.lit(None).cast("string")
        for i in reversed(range(n)):
            label = F.when(F.coalesce(F.col(f"_hit{i}"), F.lit(False)), F.lit(hit_label[i])).otherwise(label)
        extra.append(label.alias(label_col))
    return out.select(*[F.col(c) for c in base.columns], *picked, *extra)


def chained_lookup(base: DataFrame, key: str, lookups: Sequence[tuple], aux_key: str,
                   order_by: Sequence[str | Column], default=0,
                   spread_by: Sequence[str] | None = None) -> DataFrame:
    """Attach ``aux.col`` (first row by ``order_by`` whose ``aux_key``
    equals the base row's ``key``), defaulting to ``default`` when no row
    exists or the base key is NULL.  ``lookups`` = [(aux_df, col, alias)];
    all of them are reduced together and attached with one join.  NULL base
    keys are spread over ``NULL_SPREAD`` reducers (they can never match), so
    invoices without a ledger item are not one hot partition."""
    sources = [aux.select(F.col(aux_key), F.col(col).alias("_v"), *[o for o in order_by if isinstance(o, str)])
               for aux, col, _ in lookups]
    r = first_per_key_by_source(sources, aux_key, ["_v"], order_by)
    r = r.select(F.col(aux_key).alias("_ck"), F.lit(0).alias("_cs"),
                 *[F.col(f"_s{i}._v").alias(alias) for i, (_, _, alias) in enumerate(lookups)])
    out = base.withColumn("_salt", _null_salt(base, key, spread_by, NULL_SPREAD))
    out = (out.join(r, (F.col(key) == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
           .drop("_ck", "_cs", "_salt"))
    if default is not None:
        for _, _, alias in lookups:
            out = out.withColumn(alias, F.coalesce(F.col(alias), F.lit(default).cast(r.schema[alias].dataType)))
    return out


MANY_ROWS = "more than one row returned by a scalar lookup"


def strict_lookup_table(src: DataFrame, key: str, cols: Sequence[str], ordered: bool = False) -> DataFrame:
    """One row per key with ``cols`` and the number of rows of the key, ``_n``.  A scalar subquery fails only
    where it is evaluated, so nothing is raised here: see :func:`one_row`.  The count rides along the same partial
    aggregation.  With ``ordered`` the values of a key with several rows are defined too: those of one row, the
    smallest by ``cols`` in their order, NULLs first."""
    if ordered:
        row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
        return src.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_row")).select(
            key, "_n", *[F.col("_row")[f"v{i}"].alias(c) for i, c in enumerate(cols)])
    return src.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in cols])


def one_row(col: Column, n: Column) -> Column:
    """``col``, or an error for a row whose lookup found ``n`` > 1 rows."""
    return F.when(n > 1, F.raise_error(F.lit(MANY_ROWS))).otherwise(col)


def strict_lookup(base: DataFrame, base_key: str, src: DataFrame, src_key: str, cols: Sequence[str],
                  rename: dict[str, str] | None = None, spread_by: Sequence[str] | None = None) -> DataFrame:
    """J5 ``(SELECT col FROM src WHERE src_key = base_key)`` without LIMIT: fails for a base row whose key holds two
    rows; duplicate keys that no base row asks for do no harm.  NULL base keys are spread over ``NULL_SPREAD``
    reducers."""
    rename = rename or {}
    t = strict_lookup_table(src, src_key, cols).select(
        F.col(src_key).alias("_k"), F.lit(0).alias("_ks"), "_n", *[F.col(c).alias(f"_v_{c}") for c in cols])
    out = base.withColumn("_salt", _null_salt(base, base_key, spread_by, NULL_SPREAD))
    out = out.join(t, (F.col(base_key) == F.col("_k")) & (F.col("_salt") == F.col("_ks")), "left")
    return out.select(*[F.col(c) for c in base.columns],
                      *[one_row(F.col(f"_v_{c}"), F.col("_n")).alias(rename.get(c, c)) for c in cols])


def exists_switch(base: DataFrame, base_key: str, a: DataFrame, b: DataFrame, src_key: str,
                  cols: Sequence[str], exprs: dict[str, Column] | None = None,
                  strict: bool = True, prefix: str = "") -> DataFrame:
    """J4 ``CASE WHEN EXISTS(row in A) THEN (col from A) ELSE (col from B)``:
    decided per *row*, so a NULL in A does not fall back to B (contrast J1).
    With ``strict`` (J5) a base row whose chosen side holds two rows for its
    key fails; the other side and keys nobody asks for are not looked at.
    ``exprs`` are derived columns evaluated on the chosen side (e.g.
    ``base_16 + cero_nacional``); ``prefix`` names the chosen columns when
    they clash with the base.  Each side is reduced to a row per key; a side
    that is grouped by the key already is not exchanged again.  Without ``strict``
    it is the smallest row of the chosen side by ``cols`` and ``exprs``."""
    exprs = exprs or {}
    keep = [*cols, *exprs]
    out = base
    for i, src in enumerate((a, b)):
        # derived columns are written over the source's column names and evaluated before the per-key reduction
        t = strict_lookup_table(src.select(src_key, *cols, *[e.alias(n) for n, e in exprs.items()]), src_key, keep,
                                not strict)
        t = t.select(F.col(src_key).alias(f"_k{i}"), F.col("_n").alias(f"_n{i}"), *[F.col(c).alias(f"_s{i}_{c}") for c in keep])
        out = out.join(t, F.col(base_key) == F.col(f"_k{i}"), "left")
    in_a = F.col("_n0").isNotNull()
    n = F.when(in_a, F.col("_n0")).otherwise(F.col("_n1")) if strict else F.lit(1)
    chosen = [one_row(F.when(in_a, F.col(f"_s0_{c}")).otherwise(F.col(f"_s1_{c}")), n).alias(prefix + c) for c in keep]
    return out.select(*[F.col(c) for c in base.columns], in_a.alias("_in_a"), *chosen)


def bank_via_ledger(base: DataFrame, base_key: str, ledger: DataFrame, ledger_ref: str, ledger_doc: str,
                    bank: DataFrame, bank_doc: str, bank_cols: Sequence[str], strict: bool = True) -> DataFrame:
    """J6 two-hop semi join: the bank row whose ``bank_doc`` is ``IN (SELECT
    ledger_doc FROM ledger WHERE ledger_ref = base_key)``.  Distinct
    (ref, doc) pairs are joined to the bank on the document, then attached by
    reference; with ``strict`` a base row that reaches two bank rows fails."""
    pairs = ledger.select(F.col(ledger_ref).alias("_ref"), F.col(ledger_doc).alias("_doc")).distinct()
    hop = pairs.join(bank.select(F.col(bank_doc).alias("_doc"), *bank_cols), "_doc", "inner").drop("_doc")
    if strict:
        return strict_lookup(base, base_key, hop, "_ref", list(bank_cols))
    per_ref = first_per_key(hop, "_ref", bank_cols, list(bank_cols))
    return base.join(per_ref, F.col(base_key) == F.col("_ref"), "left").drop("_ref")
