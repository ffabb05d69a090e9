"""Packing token sequences by first-fit decreasing with a tournament tree.

Every document is tokenised whole.  Full blocks of the sequence length are sequences by themselves; the rests are
packed first-fit decreasing, where a tournament tree over the bins' free capacities gives the first bin with room
in logarithmic time.  Packing runs independently in randomised groups of documents of about ``group_tokens``
tokens.  As documents may be cut, the emptiest bins of a group then fill the gaps of the others, which leaves at
most one padded sequence in a group.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import byte_characters
from tallyspark.llm.common import schema_with
from tallyspark.session import materialize

#: Different words of a task whose ids are kept at a time.
CACHE_WORDS = 600_000


class Bins:
    """Bins of equal capacity; node i of the tree holds the largest free capacity below it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.leaves = capacity, 1 << max(0, most - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)
        self.content: list[list[tuple[int, int, int]]] = []

    def first_fit(self, size: int) -> int:
        """The leftmost bin with room for ``size``, and take the room."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            at += free[at] < size
        leaf = at - self.leaves
        free[at] -= size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        while len(self.content) <= leaf:
            self.content.append([])
        return leaf


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that cover documents of the given lengths."""
    pieces, sequence, rests = [], 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((doc, n - n % capacity, n % capacity))
    rests.sort(key=lambda r: -r[2])
    bins = Bins(capacity, max(1, len(rests)))
    for rest in rests:
        bins.content[bins.first_fit(rest[2])].append(rest)
    for content in fill_gaps(bins.content, capacity):
        offset = 0
        for doc, start, n in content:
            pieces.append((doc, start, n, sequence, offset))
            offset += n
        sequence += 1
    return pieces


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Moves pieces, cut where needed, from the emptiest bins into the gaps of the fullest."""
    bins = sorted((list(b) for b in bins if b), key=lambda b: -sum(p[2] for p in b))
    first, last = 0, len(bins) - 1
    while first < last:
        gap = capacity - sum(p[2] for p in bins[first])
        while gap and first < last:
            doc, start, n = bins[last].pop()
            take = min(gap, n)
            bins[first].append((doc, start + n - take, take))
            gap -= take
            if take < n:
                bins[last].append((doc, start, n - take))
            last -= not bins[last]
        first += 1
    return [b for b in bins if b]


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and ends words at its own expression.

    A text of plain characters (ASCII, the letters of western Europe, common punctuation: those on which the
    tokenizer's normalizer only lower-cases) is cut by that expression here, and the tokenizer's model encodes each
    different part once.  Any other text goes to the tokenizer whole.
    """

    #: Fixed: the tokenizer's pre-token expression on plain characters in lower case.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\x09-\x0Da-z0-9ß-öø-ÿ]+")
    #: Anything but plain characters; a special token's string counts with it.
    OTHER = re.compile(r"[^\x20-\x7E\x09-\x0D¡¿«»À-ÿ–—‘’“”…€]|<\|")

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts: dict[str, bytes] = {}
        self.stands_for = {b: c for c, b in byte_characters().items()}

    def learn(self, parts: Iterable[str]) -> None:
        model, stands_for = self.tokenizer.model.tokenize, self.stands_for
        for part in parts:
            text = part if part.isascii() else part.encode().decode("latin-1").translate(stands_for)
            ids = [t.id for t in model(text)]
            self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """For each text, its ids and the end id as little-endian unsigned 32-bit integers."""
        cut = [None if self.OTHER.search(t) else self.PARTS.findall(t.lower()) for t in texts]
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        self.learn(set().union(*(c for c in cut if c)).difference(self.parts))
        end = struct.pack("<I", end_id)
        return [(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if c is None
                 else b"".join(map(self.parts.__getitem__, c))) + end for t, c in zip(texts, cut, strict=True)]


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(row_key, id, n_tokens, ids): ids as unsigned 16-bit integers where the vocabulary allows, else 32-bit."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    kind = "<u2" if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, key = WordIds(spec), TaskContext.get().partitionId() << 40
        gc.disable()  # nothing here makes cycles, and the collector would walk the kept ids again and again
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids = coder.encode([t or "" for t in part.column(1).to_pylist()], end_id)
                    short = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(range(key, key + len(ids)), pa.int64()),
                         pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(short, pa.binary())],
                        [id_col, "row_key", "n_tokens", "ids"])
                    key += len(ids)
        finally:
            gc.enable()

    table = docs.select(id_col, text_col).mapInArrow(
        encode, schema_with(docs, [id_col], "row_key long, n_tokens long, ids binary"))
    return materialize(table, docs.sparkSession, "packing-ids").withColumn("wide", F.lit(kind == "<u4"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096,
                   group_tokens: int = 4_000_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    (and ``ids``, little-endian unsigned 32-bit, if ``with_ids``).

    A document's ids end with ``end_id``; a null or empty text has that id alone.  Groups are dealt by a hash of a
    row's place in the input, so neither repeated ids nor copies can enlarge one; repeated rows are packed each
    for itself.  Other columns are not read.  An empty table gives an empty one.
    """
    tokens = token_table(docs, tokenizer_path, end_id, id_col, text_col)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_key", ignore_index=True)
        pieces, base = [[] for _ in range(len(pdf))], int(pdf["grp"].iloc[0]) << 32
        for doc, start, n, sequence, offset in pack(pdf["n_tokens"].tolist(), capacity):
            pieces[doc].append((start, n, base + sequence, offset))
        return pd.DataFrame({"row_key": pdf["row_key"],
                             "pieces": [np.array(sorted(p), dtype="<i8").tobytes() for p in pieces]})

    planned = tokens.select("row_key", "n_tokens", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(groups)).alias("grp")) \
        .groupBy("grp").applyInPandas(plan, "row_key long, pieces binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pydict(), {c: [] for c in ("doc", "start", "length", "crc", "n", "seq", "off", "ids")}
            for doc, (ids, wide, n, plan_) in enumerate(zip(rows["ids"], rows["wide"], rows["n_tokens"], rows["pieces"],
                                                            strict=True)):
                ids = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                for start, length, sequence, offset in np.frombuffer(plan_, "<i8").reshape(-1, 4).tolist():
                    piece = ids[start:start + length].tobytes()
                    for c, v in zip(out, (doc, start, length, zlib.crc32(piece), n, sequence, offset,
                                          piece if with_ids else None), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out["doc"], pa.int64()))]
                + [pa.array(out[c], pa.int64()) for c in ("start", "length", "crc", "n", "seq", "off")]
                + [pa.array(out["ids"], pa.binary())] * with_ids, names)

    schema = schema_with(docs, [id_col], "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                                         "offset long" + ", ids binary" * with_ids)
    names = schema.fieldNames()
    return tokens.join(planned, "row_key").select(id_col, "ids", "wide", "n_tokens", "pieces").mapInArrow(cut, schema)
