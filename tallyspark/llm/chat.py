"""Transcript parsing by a hidden Markov model over lines, and canonical rendering of the turns it recovers.

The states are the speakers' roles.  A line's observation is its speaker marker (none, or one that hints at a role),
whether it begins a row, the class of its length, and at a row's beginning the class of the row's length.  The role
can change where a row or a marked line begins; elsewhere it stays.  Transitions and length distributions are counted
on a bounded sample of conversations whose rows have roles; how much a marker tells is a parameter.

Viterbi runs over any conversation in three passes, none of which holds one whole: rows stand in blocks of so many
turns; a block yields the best scores between any two roles (a matrix, in the algebra of maximum and sum); the
matrices of a conversation are chained to find the role at each block's ends; then each block is decoded between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyspark.llm.common import schema_with
from tallyspark.session import materialize

ROLES = ("system", "user", "assistant", "tool")
#: Fixed words of speaker markers, by role.
MARKERS = {"system": ("system", "instructions", "sys"), "user": ("user", "human", "customer", "client", "question", "q"),
           "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a"),
           "tool": ("tool", "function", "observation")}
MARKER = re.compile(r"^\s*(?:[#>*\[<|(-]+\s*)?(%s)\s*(?:[\]>*|)]+\s*:?|:)[\s*]*" % "|".join(
    sorted((w for ws in MARKERS.values() for w in ws), key=len, reverse=True)), re.IGNORECASE | re.ASCII)
OF_WORD = {w: i + 1 for i, r in enumerate(ROLES) for w in MARKERS[r]}
LENGTHS = 12  #: classes of length, by powers of two


@dataclass(frozen=True)
class Settings:
    """``sample``: most conversations that the model is counted on.  ``marker_trust``: probability that a marker names
    the role of its line.  ``block``: turns of a block."""

    sample: int = 2000
    marker_trust: float = 0.98
    smoothing: float = 0.5
    block: int = 256
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"


def _class(size: int) -> int:
    return min(LENGTHS - 1, size.bit_length())


def observe(text: str | None) -> list[tuple[int, int, int]]:
    """Of each line: marker (0: none, else the role it hints at, plus one), class of its length, class of the row's
    length on its first line (else -1).  A null text is one empty line."""
    text = text or ""
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        out.append((OF_WORD[m[1].lower()] if m else 0, _class(len(line)), _class(len(text)) if i == 0 else -1))
    return out


@dataclass
class Model:
    """Natural logarithms.  ``change[a, b]``: role b where a row or marked line follows role a."""

    first: np.ndarray
    change: np.ndarray
    line: np.ndarray
    row: np.ndarray
    marker: np.ndarray

    @staticmethod
    def count(rows: Iterator[tuple[object, list[str], list[str | None]]], s: Settings) -> Model:
        """rows: (conversation, roles, texts) in order."""
        k = len(ROLES)
        first, change = np.full(k, s.smoothing), np.full((k, k), s.smoothing)
        line, row = np.full((k, LENGTHS), s.smoothing), np.full((k, LENGTHS), s.smoothing)
        for _, roles, texts in rows:
            known = [(ROLES.index(r), t) for r, t in zip(roles, texts, strict=True) if r in ROLES]
            for i, (r, text) in enumerate(known):
                if i:
                    change[known[i - 1][0], r] += 1
                else:
                    first[r] += 1
                for _, size, whole in observe(text):
                    line[r, size] += 1
                    if whole >= 0:
                        row[r, whole] += 1
        marker = np.full((k, k + 1), (1 - s.marker_trust) / (k - 1))
        marker[:, 0] = 1.0
        marker[np.arange(k), np.arange(k) + 1] = s.marker_trust
        share = lambda x: np.log(x / x.sum(-1, keepdims=True))
        return Model(share(first), share(change), share(line), share(row), np.log(marker))

    def emission(self, o: tuple[int, int, int]) -> np.ndarray:
        marker, size, whole = o
        e = self.marker[:, marker] + self.line[:, size]
        return e + self.row[:, whole] if whole >= 0 else e

    def step(self, o: tuple[int, int, int]) -> np.ndarray | None:
        """Scores of the moves before a line; None where the role stays."""
        return self.change if o[0] or o[2] >= 0 else None

    def matrix(self, lines: list[tuple[int, int, int]]) -> np.ndarray:
        """Best score from the role before the lines to that of the last one."""
        k = len(ROLES)
        total = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
        for o in lines:
            move = self.step(o)
            if move is not None:
                total = (total[:, :, None] + move[None]).max(1)
            total = total + self.emission(o)
        return total

    def decode(self, lines: list[tuple[int, int, int]], before: int, last: int) -> list[int]:
        """The best roles of lines after role ``before`` (-1: the conversation begins) with the last one given."""
        score, back = None, []
        for o in lines:
            move = self.step(o)
            if score is None:
                start = self.first if before < 0 else self.change[before] if move is not None else np.where(
                    np.arange(len(ROLES)) == before, 0.0, -np.inf)
                score = start + self.emission(o)
                back.append(None)
                continue
            if move is None:
                back.append(np.arange(len(ROLES)))
            else:
                all_ = score[:, None] + move
                back.append(all_.argmax(0))
                score = all_.max(0)
            score = score + self.emission(o)
        out = [last]
        for b in back[:0:-1]:
            out.append(int(b[out[-1]]))
        return out[::-1]


def fit(rows: DataFrame, s: Settings) -> Model:
    """``rows``: conv, turn, text, role.  Counts the ``sample`` conversations of the smallest hash; of a longer one,
    the rows of its first block."""
    chosen = rows.where("role is not null and block = 0").select("conv").distinct().orderBy(
        F.xxhash64("conv"), "conv").limit(s.sample)
    few = rows.where("role is not null and block = 0").join(chosen, rows["conv"].eqNullSafe(chosen["conv"]), "left_semi")
    found: dict = {}
    for r in few.select("conv", "turn", "role", "text").orderBy("conv", "turn", F.xxhash64("text"), "text").collect():
        found.setdefault(r["conv"], ([], []))
        found[r["conv"]][0].append(r["role"])
        found[r["conv"]][1].append(r["text"])
    return Model.count(((c, *v) for c, v in found.items()), s)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def recover_roles(rows: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
                  role_col: str | None = "role", s: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """(conversation, order, ``part``, ``role``, ``content``, ``rendered``): the turns recovered from each row, a row
    with several speakers giving several parts (from 0).

    ``role_col`` is read for fitting alone, on the bounded sample; give ``model`` instead where no row has a role.
    Markers are cut from the content, and the rendering's own marks in a text are broken by a space.  Lines of equal
    role that follow each other in a row are one part.  A null text is an empty turn, a null order stands first, a null
    conversation is one of its own.  Rows that repeat a turn follow each other in the order of their texts.  An empty
    table gives an empty one.  Other columns are not read.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("turn"), F.col(text_col).alias("text"),
                      (F.col(role_col) if role_col else F.lit(None).cast("string")).alias("role")).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / s.block), F.lit(-1)).cast("long"))
    m = model or fit(own, s)
    ordered = own.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", F.xxhash64("text"), "text")
    conv, k = own.schema["conv"].dataType, len(ROLES)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (c, b), run in _runs(batches, 2):
            lines = [o for r in run for o in observe(r[2])]
            inside, head = m.matrix(lines), m.first + m.emission(lines[0])
            # the same lines as the beginning of a conversation
            start = (head[:, None] + m.matrix(lines[1:])).max(0) if len(lines) > 1 else head
            out.append((c, b, inside.ravel().tolist(), start.tolist()))
            if len(out) >= 1000:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    narrow = T.StructType([T.StructField("conv", conv)] + T.StructType.fromDDL(
        "block long, inside array<double>, start array<double>").fields)
    arrow = to_arrow_schema(narrow)
    blocks = materialize(ordered.select("conv", "block", "text").mapInArrow(matrices, narrow), spark, "chat-blocks")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (c,), run in _runs(batches, 1):
            score, back = np.array(run[0][3]), []
            for r in run[1:]:
                all_ = score[:, None] + np.array(r[2]).reshape(k, k)
                back.append(all_.argmax(0))
                score = all_.max(0)
            last = [int(score.argmax())]
            for b in back[::-1]:
                last.append(int(b[last[-1]]))
            last = last[::-1]
            out += [(c, r[1], before, end) for r, before, end in zip(run, [-1, *last], last, strict=False)]
            if len(out) >= 1000:
                yield _batch(out, ends_arrow)
                out = []
        if out:
            yield _batch(out, ends_arrow)

    ends_schema = T.StructType([T.StructField("conv", conv)] + T.StructType.fromDDL(
        "block long, before int, last int").fields)
    ends_arrow = to_arrow_schema(ends_schema)
    ends = blocks.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(chain, ends_schema)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in _runs(batches, 2):
            observed = [observe(r[3]) for r in run]
            roles = iter(m.decode([o for x in observed for o in x], run[0][4], run[0][5]))
            out = []
            for r, seen in zip(run, observed, strict=True):
                parts: list[tuple[int, list[str]]] = []
                for line, o in zip((r[3] or "").split("\n"), seen, strict=True):
                    role = next(roles)
                    line = MARKER.sub("", line, count=1) if o[0] else line
                    if parts and parts[-1][0] == role:
                        parts[-1][1].append(line)
                    else:
                        parts.append((role, [line]))
                for i, (role, lines) in enumerate(parts):
                    content = "\n".join(lines)
                    safe = content.replace(s.start, s.start[0] + " " + s.start[1:]).replace(s.end, s.end[0] + " " + s.end[1:])
                    out.append((r[0], r[2], i, ROLES[role], content, f"{s.start}{ROLES[role]}\n{safe}{s.end}\n"))
            yield _batch(out, turns_arrow)

    turns = schema_with(rows, [conv_col, order_col], "part int, role string, content string, rendered string")
    turns_arrow = to_arrow_schema(turns)
    e = ends.select(F.col("conv").alias("c"), F.col("block").alias("b"), "before", "last")
    joined = ordered.join(e, ordered["conv"].eqNullSafe(e["c"]) & (ordered["block"] == e["b"]))
    return joined.select("conv", "block", "turn", "text", "before", "last").repartition("conv", "block") \
        .sortWithinPartitions("conv", "block", "turn", F.xxhash64("text"), "text").mapInArrow(render, turns)


def transcript_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Raw transcripts, one text each, as rows for :func:`recover_roles`: one row a conversation."""
    return docs.select(F.col(id_col).alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                       F.col(text_col).alias("text"), F.lit(None).cast("string").alias("role"))

