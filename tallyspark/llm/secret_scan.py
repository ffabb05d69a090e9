"""Secret scans: known patterns, and a randomness test battery over other token-like strings.

DataFrame functions only.  A candidate is a run of token characters without a known pattern's span in it.  Its
encoding (decimal, hexadecimal, base32 and base36 in either case, alphanumeric, base64, its URL form) is inferred from the characters it has,
and gives the alphabet for three tests of uniform randomness: chi-squared over the alphabet, runs above and below
its middle, and serial correlation at lag one.  A candidate that passes them still may be an ordinary word by
chance, the more so the shorter it is.  So it also gets a p-value under the hypothesis that it is ordinary text
(few changes between character classes; for wide alphabets, the coincidence of letters that language has), and the
Benjamini-Hochberg procedure within classes of equal length bounds the share of false discoveries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialize

#: Fixed patterns; the matches of ``assign`` need six characters or more in their group.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LOWER = UPPER.lower()
#: Encodings in the order in which they are tried: name, pattern, alphabet.  The wide ones leave what has letters of
#: one case only to those of one case, which come last.
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("alphanumeric", "^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^(?=.*[+/])[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^(?=.*[_-])[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    ("base32 lower", "^[a-z2-7]+=*$", LOWER + "234567"),
    ("base36 lower", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base36", "^[0-9A-Z]+$", DIGITS + UPPER),
)


@dataclass(frozen=True)
class Battery:
    """``alpha``: level of the uniformity tests together.  ``false_discovery``: bound within a length class.
    ``ordinary_changes``: share of neighbouring characters of ordinary tokens that differ in class.  ``coincidence``
    and ``cubes``: sums of the squared and cubed letter frequencies of ordinary text."""

    least: int = 20
    alpha: float = 0.001
    false_discovery: float = 0.01
    lengths: tuple = (20, 24, 32, 48, 64, 128)
    ordinary_changes: float = 0.1
    coincidence: float = 0.065
    cubes: float = 0.0054
    bins: int = 400
    bins_per_decade: int = 20


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op) -> Column:
    """For each element of an array of numbers ``op`` (a sum or a maximum) over it and all before it, by doubling
    steps: n log n work, where appending to an array would take n squared."""
    def doubled(acc: Column, k: Column) -> Column:
        back = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(acc))
        before = F.concat(F.transform(F.slice(acc, F.lit(1), back), lambda _: F.lit(None)),
                          F.slice(acc, F.lit(1), F.size(acc) - back))
        return F.zip_with(acc, before, lambda x, y: F.when(y.isNull(), x).otherwise(op(x, y)))

    return _bind(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int")), v, doubled)))


def _rows(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, match, size of the group), by code points, of the leftmost non-overlapping matches."""
    def spans(matches: Column) -> Column:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        steps = F.zip_with(
            F.slice(F.split(text, pattern, -1), 1, F.size(matches)), F.arrays_zip(matches.alias("m"), groups.alias("g")),
            lambda gap, m: F.struct((F.length(gap) + F.length(m["m"])).alias("step"), m["m"].alias("match"),
                                    F.length(m["g"]).alias("group")))
        return _bind(steps, lambda rows: F.zip_with(
            rows, _running(F.transform(rows, lambda r: r["step"]), lambda x, y: x + y),
            lambda r, end: F.struct((end - F.length(r["match"])).alias("start"), end.alias("end"),
                                    r["match"].alias("match"), r["group"].alias("group"))))

    none = F.array().cast("array<struct<start:int,end:int,match:string,group:int>>")
    return F.when(text.rlike(pattern), _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def _apart(rows: Column, base: Column) -> Column:
    """The rows (sorted, not overlapping) that meet no span of ``base``: as many spans start before the row's end as
    end by its start.  Both counts come from one sorted list of all edges."""
    edge = lambda spans, field, rank: F.transform(spans, lambda s: s[field].cast("long") * 4 + rank)
    edges = F.sort_array(F.concat(edge(base, "end", 0), edge(rows, "start", 1), edge(rows, "end", 2),
                                  edge(base, "start", 3)))
    weigh = lambda e: F.when(e % 4 == 3, F.lit(1 << 32)).when(e % 4 == 0, F.lit(1).cast("long")).otherwise(
        F.lit(0).cast("long"))

    def kept(both: Column) -> Column:
        counts = lambda rank, f: F.transform(F.filter(both, lambda x: x["e"] % 4 == rank), lambda x: f(x["n"]))
        ended, begun = counts(1, lambda n: n % (1 << 32)), counts(2, lambda n: F.floor(n / F.lit(float(1 << 32))))
        meets = F.zip_with(begun, ended, lambda x, y: x > y)
        marked = F.zip_with(rows, meets, lambda r, m: F.struct(r.alias("r"), m.alias("m")))
        return F.transform(F.filter(marked, lambda x: ~x["m"]), lambda x: x["r"])

    counted = _bind(edges, lambda es: F.zip_with(
        es, _running(F.transform(es, weigh), lambda x, y: x + y), lambda e, n: F.struct(e.alias("e"), n.alias("n"))))
    return F.when((F.size(base) == 0) | (F.size(rows) == 0), rows).otherwise(_bind(counted, kept))


def _kind(rows: Column, rank: int) -> Column:
    return F.transform(rows, lambda r: F.struct(r["start"].alias("start"), F.lit(rank).alias("rank"),
                                                r["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank of the kind, end) of the known patterns."""
    assign = F.filter(_rows(text, ASSIGN, 1), lambda r: r["group"] >= 6)
    return F.sort_array(F.concat(_kind(assign, 0), _kind(_rows(text, ACCESS), 1), _kind(_rows(text, HEX), 2)))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / 2 ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def _pairs(values: Column, f) -> Column:
    """Sum of f over neighbouring values."""
    n = F.size(values)
    return F.aggregate(F.zip_with(F.slice(values, 1, n - 1), F.slice(values, 2, n - 1), f), F.lit(0.0),
                       lambda total, x: total + x)


def candidates(text: Column, base: Column, b: Battery) -> Column:
    """Array of (start, end, class of the length, bin of the p-value as ordinary text, uniform) of the candidates
    that meet no span of ``base``.  Each step below binds what the next one uses more than once."""
    found = _bind(_rows(text, "[A-Za-z0-9+/_-]{%d,}={0,2}" % b.least), lambda rows: _apart(rows, base))
    named = F.transform(found, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), F.regexp_replace(r["match"], "=+$", "").alias("body")))
    spelt = F.transform(named, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), r["body"].alias("body"),
        F.length(r["body"]).cast("double").alias("n"),
        F.coalesce(*(F.when(r["body"].rlike(p), F.lit(a)) for _, p, a in ENCODINGS), F.lit("")).alias("alphabet")))
    valued = F.transform(spelt, lambda r: F.struct(
        *(r[c].alias(c) for c in ("start", "end", "body", "n")), F.length(r["alphabet"]).cast("double").alias("k"),
        F.array_distinct(F.split(r["body"], "")).alias("letters"),
        F.transform(F.split(r["body"], ""), lambda x: F.instr(r["alphabet"], x) - 1).alias("v")))
    collapsed = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        c, "[+/_-]", "."), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), r"(.)\1+", "$1")
    counted = F.transform(valued, lambda r: F.struct(
        *(r[c].alias(c) for c in ("start", "end", "n", "k")),
        F.aggregate(r["letters"], F.lit(0.0), lambda total, x: total + F.pow(
            r["n"] - F.length(F.replace(r["body"], x, F.lit(""))), F.lit(2.0))).alias("squares"),
        F.size(F.filter(r["v"], lambda x: 2 * x >= r["k"])).cast("double").alias("high"),
        _pairs(r["v"], lambda x, y: F.when((2 * x >= r["k"]) != (2 * y >= r["k"]), 1.0).otherwise(0.0)).alias("turns"),
        _pairs(r["v"], lambda x, y: (x - (r["k"] - 1) / 2) * (y - (r["k"] - 1) / 2)).alias("serial"),
        (F.length(collapsed(r["body"])) - 1).cast("double").alias("changes")))

    def score(r: Column) -> Column:
        n, k, high, low = r["n"], r["k"], r["high"], r["n"] - r["high"]
        d = k - 1
        chi = F.greatest(r["squares"] * k / n - n, F.lit(0.0))
        z_chi = (F.pow(chi / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
        both = 2 * high * low
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (r["turns"] - both / n) / F.sqrt(spread)).otherwise(-F.sqrt(n))
        z_serial = r["serial"] / ((n - 1) * (k * k - 1) / 12) * F.sqrt(n - 1)
        p_random = F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial)))
        tau, x = b.ordinary_changes, r["changes"] / (n - 1)
        divergence = x * F.log(F.greatest(x, F.lit(1e-9)) / tau) + F.when(
            x < 1, (1 - x) * F.log(F.greatest(1 - x, F.lit(1e-9)) / (1 - tau))).otherwise(0.0)
        p_changes = F.when(x > tau, F.exp(-(n - 1) * divergence)).otherwise(1.0)
        ic, kappa = (r["squares"] - n) / (n * (n - 1)), b.coincidence
        sd = F.sqrt((4 * (n - 2) * (b.cubes - kappa ** 2) + 2 * (kappa - kappa ** 2)) / (n * (n - 1)))
        p_letters = upper_tail((kappa - ic) / sd)
        p = F.when(k > 16, F.greatest(p_changes, p_letters)).otherwise(p_changes)
        uniform = (k > 1) & (p_random >= b.alpha / 3)
        bin_ = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * b.bins_per_decade), F.lit(b.bins))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"),
                        sum((F.when(n >= x, 1).otherwise(0) for x in b.lengths[1:]), F.lit(0)).alias("cls"),
                        F.when(uniform, bin_).otherwise(0).cast("int").alias("bin"))

    return F.transform(counted, score)


def scanned(docs: DataFrame, text_col: str, b: Battery, out: str = "scan") -> DataFrame:
    """``docs`` with a struct column of the base spans and the scored candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(text)
    return docs.withColumn(out, F.struct(base.alias("base"))).withColumn(out, F.struct(
        F.col(out)["base"].alias("base"), candidates(text, F.col(out)["base"], b).alias("candidates")))


def fit_thresholds(scan: DataFrame, b: Battery, col: str = "scan") -> list[int]:
    """For each length class, the smallest bin that Benjamini-Hochberg accepts.  The driver gets counts by class and
    bin, at most 401 a class."""
    rows = scan.select(F.explode(F.col(col)["candidates"]).alias("c")).groupBy("c.cls", "c.bin").agg(
        F.count(F.lit(1)).alias("n")).collect()
    out = []
    for cls in range(len(b.lengths)):
        count = {r["bin"]: r["n"] for r in rows if r["cls"] == cls}
        tested, above, accepted = sum(count.values()), 0, b.bins + 1
        for x in range(b.bins, 0, -1):
            above += count.get(x, 0)
            if above and 10 ** (-x / b.bins_per_decade) * tested / above <= b.false_discovery:
                accepted = x
        out.append(accepted)
    return out


def all_spans(scan: Column, thresholds: list[int]) -> Column:
    """Sorted array of (start, rank of the kind, end) of base spans and accepted candidates."""
    least = F.array(*map(F.lit, thresholds))
    good = F.filter(scan["candidates"], lambda c: c["bin"] >= F.get(least, c["cls"]))
    return F.sort_array(F.concat(scan["base"], _kind(good, 3)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", b: Battery = Battery()) -> DataFrame:
    """(id, ``base``, ``spans``): arrays of (start, rank in KINDS, end) by code points, end exclusive, sorted.

    Whole texts are scanned.  A null text counts as empty; repeated rows give repeated results; other columns are
    not read.  An empty table gives an empty one.
    """
    scan = materialize(scanned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", b)
                       .select("id", "scan"), docs.sparkSession, "secrets")
    thresholds = fit_thresholds(scan, b)
    return scan.select(F.col("id").alias(id_col), F.col("scan")["base"].alias("base"),
                       all_spans(F.col("scan"), thresholds).alias("spans"))


def _between(text: Column, gaps: Column, block: int = 1024) -> Column:
    """The stretches ``gaps`` (start, end) of a text.  Blocks of it are cut once, so that a stretch costs its own
    length and a block, not the way from the text's start."""
    def piece(blocks: Column, g: Column) -> Column:
        first = F.floor(g["start"] / block).cast("int")
        joined = F.array_join(F.slice(blocks, first + 1, F.floor(g["end"] / block).cast("int") - first + 1), "")
        return F.substring(joined, g["start"] - first * block + 1, g["end"] - g["start"])

    return _bind(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0)),
                 lambda blocks: F.transform(gaps, lambda g: piece(blocks, g)))


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """The text with its spans (sorted) replaced, those that overlap by one mark."""
    def rest(rows: Column) -> Column:  # a span that starts behind all earlier ones ends the gap before it
        gaps = F.transform(F.filter(rows, lambda r: r["start"] >= r["at"]),
                           lambda r: F.struct(r["at"].alias("start"), r["start"].alias("end")))
        tail = F.array(F.struct(F.greatest(F.element_at(rows, -1)["at"], F.element_at(rows, -1)["end"]).alias("start"),
                                F.length(text).alias("end")))
        return F.array_join(_between(text, F.concat(gaps, tail)), mark)

    furthest = F.concat(F.array(F.lit(0)), _running(F.transform(spans, lambda s: s["end"]), F.greatest))
    rows = F.zip_with(spans, F.slice(furthest, 1, F.size(spans)), lambda s, at: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))
    return _bind(rows, rest)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", b: Battery = Battery()) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) of the text replaced by ``mark``.  Null texts stay null.
    All rows are scanned once; the scan is written beside them, and the thresholds come from it."""
    scan = "secret_scan"
    while scan in {c.lower() for c in docs.columns}:
        scan += "_"
    done = materialize(scanned(docs, text_col, b, scan), docs.sparkSession, "redaction")
    spans = all_spans(F.col(scan), fit_thresholds(done, b, scan))
    text = F.col(text_col)
    new = _bind(spans, lambda s: F.when(F.size(s) > 0, _marked(text, s, mark)).otherwise(text))
    return done.withColumn(text_col, F.when(text.isNotNull(), new)).select(*docs.columns)
