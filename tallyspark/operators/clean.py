"""Ingest cleaning (Q1-Q18): column-wise expressions replacing the
reference's per-row loops.  Rules produce a ``reject_reason`` column instead
of exceptions, so one bad row never aborts a file."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.keys import trunc_int
from ..functions.parsing import Cell, read_cell

# Fixed values of the tax classification (Q15).
VAT_CODE, IEPS_CODE = "002", "003"
RATE_16_TEXT, RATE_0_TEXT = "0.160000", "0.000000"
LABEL_16, LABEL_0 = "16%", "0%"


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q1: all required headers present (extra ones and any order allowed).
    A schema check on the driver -- no data is read."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def require_header(df: DataFrame, cols: Sequence[str]) -> bool:
    """Q2: exact header, case-insensitive, order-sensitive."""
    return [c.lower() for c in df.columns] == [c.lower() for c in cols]


def strip_chars(df: DataFrame, chars: str = "'") -> DataFrame:
    """Q3: remove ``chars`` from every string column (one projection)."""
    return df.select(*[F.translate(F.col(f"`{f.name}`"), chars, "").alias(f.name)
                       if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def trailing_rows(df: DataFrame, n: int, line_col: str, file_col: str = "file_name") -> DataFrame:
    """(``file_col``, ``_first``): of each file, the number of the first of its last ``n`` rows by ``line_col``, read
    as a number (a landed column is text) and whatever gaps the numbering has.  A limit on the rank reaches the rows
    before they are exchanged, so a huge file sends ``n`` rows a task."""
    line = F.col(line_col).try_cast("bigint")
    last = df.where(line.isNotNull()).select(file_col, line.alias("_line")).withColumn(
        "_r", F.row_number().over(Window.partitionBy(file_col).orderBy(F.desc("_line")))).where(F.col("_r") <= n)
    return last.groupBy(file_col).agg(F.min("_line").alias("_first"))


def split_last(df: DataFrame, n: int, line_col: str, file_col: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Q4: (rows but the last ``n`` of every file, those last rows).  A row whose line number is no number is none of
    the last.  Where rows carry the number of their file's rows (``file_rows``), that is a plain filter."""
    if n <= 0:
        return df, df.limit(0)
    if "file_rows" in df.columns:
        last = F.col(line_col) > F.col("file_rows") - n
        return df.where(~last), df.where(last)
    tagged = df.join(trailing_rows(df, n, line_col, file_col), file_col, "left")
    last = F.coalesce(F.col(line_col).try_cast("bigint") >= F.col("_first"), F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return tagged.where(~last).select(own), tagged.where(last).select(own)


def drop_last(df: DataFrame, n: int, line_col: str, file_col: str = "file_name") -> DataFrame:
    """Q4: all rows but the last ``n`` of every file (trailing total rows)."""
    return split_last(df, n, line_col, file_col)[0]


def drop_markers(df: DataFrame, col: str, text: str = "Cleared/open") -> DataFrame:
    """Q5: drop rows whose ``col`` contains the marker text."""
    return df.where(~F.coalesce(F.col(f"`{col}`"), F.lit("")).contains(text))


def credits_only(df: DataFrame, col: str = "posting_amount") -> DataFrame:
    """Q14: keep postings with ``int(amount) > 0`` (amounts in (0,1) drop)."""
    return df.where(trunc_int(col) > 0)


@dataclass(frozen=True)
class Rule:
    """A row rule: ``ok`` must be true, else the row is rejected with ``name``."""
    name: str
    ok: Column


def split_rejects(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Q11: (good rows, rejected rows with ``reject_reason``).  Both sides
    filter the same plan; persist or cut lineage (``materialize``) upstream
    when the input is expensive."""
    reasons = [F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules]
    tagged = df.withColumn("reject_reason", F.concat_ws(";", *reasons) if reasons else F.lit(""))
    good = tagged.where(F.col("reject_reason") == "").drop("reject_reason")
    bad = tagged.where(F.col("reject_reason") != "")
    return good, bad


def new_files_only(incoming: DataFrame, registry: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows of files whose registry name is not yet registered."""
    return incoming.join(registry.select(key).distinct(), key, "left_anti")


def classify_taxes(tax_lines: DataFrame, key: str, order_by: Sequence[str], code: str = "tax_code",
                   rate: str = "rate", amount: str = "amount", subtotal_col: str | None = None) -> DataFrame:
    """Q15 per invoice from its transferred-tax lines (document order
    ``order_by``):
      vat_16   = amount of the *last* VAT (002) line with amount > 0 (else 0)
      has_16   = some VAT line at rate 0.160000 (SubTotal goes to subtotal_16)
      has_0    = some VAT line at rate 0.000000 (SubTotal goes to vat_0)
      ieps     = sum of IEPS (003) amounts > 0
      tax_rate = '16%' / '0%' per VAT line, concatenated in document order
    One grouped aggregation; the label list of an invoice is its own output
    text, so it is bounded by the invoice itself."""
    pos = F.struct(*[F.col(c) for c in order_by])
    is_vat = F.col(code) == F.lit(VAT_CODE)
    vat_pos = is_vat & (F.col(amount) > 0)
    label = (F.when(is_vat & (F.col(rate) == F.lit(RATE_16_TEXT)), F.lit(LABEL_16))
             .when(is_vat & (F.col(rate) == F.lit(RATE_0_TEXT)), F.lit(LABEL_0)))
    zero = F.lit(0).cast("decimal(20,2)")
    aggs = [
        F.max_by(F.when(vat_pos, F.col(amount)), F.when(vat_pos, pos)).alias("vat_16"),
        F.bool_or(is_vat & (F.col(rate) == F.lit(RATE_16_TEXT))).alias("has_16"),
        F.bool_or(is_vat & (F.col(rate) == F.lit(RATE_0_TEXT))).alias("has_0"),
        F.coalesce(F.sum(F.when((F.col(code) == F.lit(IEPS_CODE)) & (F.col(amount) > 0), F.col(amount))),
                   zero).alias("ieps"),
        F.coalesce(F.sum(F.when(is_vat, F.col(amount))), zero).alias("vat_total"),
        F.collect_list(F.when(label.isNotNull(), F.struct(pos.alias("p"), label.alias("l")))).alias("_labels"),
    ]
    if subtotal_col:
        aggs.append(F.sum(subtotal_col).alias("subtotal"))
    out = tax_lines.groupBy(key).agg(*aggs)
    out = out.withColumn("tax_rate", F.array_join(F.transform(F.array_sort("_labels"), lambda x: x["l"]), "")
                         ).drop("_labels")
    out = out.withColumn("vat_16", F.coalesce(F.col("vat_16"), zero))
    if subtotal_col:
        out = (out.withColumn("subtotal_16", F.when(F.col("has_16"), F.col("subtotal")).otherwise(zero))
               .withColumn("vat_0", F.when(F.col("has_0"), F.col("subtotal")).otherwise(zero)))
    return out


@dataclass
class LedgerSpec:
    """How one ledger kind is landed and typed."""
    kind: str
    headers: Sequence[str]
    columns: dict[str, str]              # canonical column -> source header
    types: dict[str, str] = field(default_factory=dict)   # canonical column -> spark type
    mandatory: Sequence[str] = ()        # canonical columns that must parse
    whole: Sequence[str] = ()            # canonical columns that must be digits where they are not blank
    lenient: Sequence[str] = ()          # canonical columns whose unreadable text counts as blank
    defaults: dict[str, object] = field(default_factory=dict)  # canonical column -> value of a blank cell
    trailing_rows: int = 0
    marker_col: str | None = None
    date_formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")


def canonicalise(df: DataFrame, spec: LedgerSpec) -> DataFrame:
    """Q10 (+Q6-Q9): landed all-STRING sheet -> canonical typed columns in
    one projection.  Key-like columns go through ``norm_key``; numbers
    accept a decimal comma; dates try each format (:func:`spec_rules` rejects what none reads)."""
    return df.select(*typed_cells(df, spec), *lineage(df))


def typed_cells(df: DataFrame, spec: LedgerSpec) -> list[Column]:
    out, headers = [], set(df.columns)
    for canon in spec.columns:
        value = cell_of(headers, spec, canon).value
        if canon in spec.defaults:
            value = f"coalesce({value}, {spec.defaults[canon]!r})"
        out.append(F.expr(value).alias(canon))
    return out


def lineage(df: DataFrame) -> list[Column]:
    """The columns that say where a landed row stands."""
    own = [F.col(c) for c in ("file_name", "s3_url", "line_no", "sheet") if c in df.columns]
    if "ingest_seq" in df.columns:
        return [*own, F.col("ingest_seq")]
    return [*own, F.col("line_no").try_cast("bigint").alias("ingest_seq")] if "line_no" in df.columns else own


def type_and_split(df: DataFrame, spec: LedgerSpec) -> tuple[DataFrame, DataFrame]:
    """Q10-Q12: (typed good rows, rejected rows as landed with ``reject_reason``).  A row's cells and its reasons are
    read in one projection, a column a cell, so that a query reads the cells it takes and those that rules ask for, each
    once; the row number that the filters ask for too keeps the optimizer from copying the parsing into them.  The reasons
    come last: each column after them would double what the optimizer derives from them."""
    reasons = [F.when(~r.ok, F.lit(r.name)) for r in spec_rules(df, spec)]  # a rule is never NULL
    cells = [c.alias(f"_cell_{name}") for name, c in zip(spec.columns, typed_cells(df, spec), strict=True)]
    tagged = df.select("*", *cells, F.concat_ws(";", *reasons).alias("_reason"), F.monotonically_increasing_id().alias("_parsed"))
    good = tagged.where("_reason = '' AND _parsed >= 0").select(
        *[F.col(f"_cell_{c}").alias(c) for c in spec.columns], *lineage(df))
    return good, tagged.where("_reason <> '' AND _parsed >= 0").select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("_reason").alias("reject_reason"))


def cell_of(headers: set[str], spec: LedgerSpec, canon: str) -> Cell:
    header, type_name = spec.columns[canon], spec.types.get(canon, "string")
    return read_cell(f"`{header}`" if header in headers else "CAST(NULL AS STRING)", type_name, spec.date_formats,
                     canon in spec.whole or (canon in spec.mandatory and type_name == "key"))


def spec_rules(df: DataFrame, spec: LedgerSpec) -> list[Rule]:
    """Q12 rules of a spec evaluated on the landed text columns.  Mandatory cells have to be present and readable
    (``invalid:<column>``); any other number, date or whole number may be blank but has to be readable
    (``unreadable:<column>``), unless the column is lenient."""
    rules, headers = [], set(df.columns)
    for c in spec.columns:
        cell = cell_of(headers, spec, c)
        if c in spec.mandatory:
            rules.append(Rule(f"invalid:{c}", F.expr(f"NOT ({cell.absent}) AND NOT {cell.unreadable}")))
        elif c not in spec.lenient and (c in spec.whole or spec.types.get(c, "string") not in ("string", "key", "text_key")):
            rules.append(Rule(f"unreadable:{c}", F.expr(f"NOT {cell.unreadable}")))
    return rules
