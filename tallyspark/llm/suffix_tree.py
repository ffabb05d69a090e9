"""Language-model scoring by a probabilistic suffix tree over words.

Symbols are the training words seen ``least_count`` times, the end of a text, and one symbol for all others.  A context
(suffix of what came before, up to ``depth`` words) becomes a state when its next-symbol distribution diverges from that
of its own suffix by more than describing it costs.  It stores the next symbols seen ``least_count`` times; absolute
discounting hands the rest of its mass to its suffix, down to the root, which gives unknown words the mass that words
seen once suggest.  A word is scored in the longest suffix of its history that is a state.

The tree has two parts.  Its *trunk* has the contexts whose share of the training tokens reaches ``least_context``, which
are at most 1 / ``least_context`` a depth at any input size and travel with the tasks.  Their next symbols grow with the
input: those of the share ``held_pair`` travel along, and all others, the *light pairs*, lie in a partitioned table, by the
shortest context in which the pair is light.  A part counts its own pairs; what they take from their contexts' mass and
add to their divergence is summed by context.  All other contexts, whose number grows with the input, are *branches*: the
contexts that end in the same shortest context outside the trunk lie in one part of a partitioned table, with all their
counts, and a part tests, smooths and answers its own contexts.  No branch holds more than the share ``least_context`` of
the training tokens, and no part's pair more than ``held_pair``.

All counts cover all training rows.  Neither the vocabulary, the light pairs nor the branches are gathered: texts are cut
into chunks, each chunk asks for the counts of its different words, for those of its different light pairs and for the
probabilities of its different histories with their next symbols, and the answers return to the chunk by exchanges.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.session import discard, materialize

#: Codes of symbols: 0 for words below ``least_count``, 1 for the end of a text, then the words.
RARE, END, FIRST = 0, 1, 2
NONE = -1  #: no symbol: before the start of a text, or before a word without a code
SHIFT = np.int64(32)


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    least_context: float = 1e-5
    least_pair: float = 0.0  #: share below which a trunk's context stores no next symbol; 0: ``least_count`` alone decides
    held_pair: float = 2e-6  #: share from which a trunk's next symbols travel with the tasks; changes no result
    least_count: int = 2
    discount: float = 0.75
    chunk_bytes: int = 8_000_000
    buckets: int = 0  #: of the vocabulary; 0: by the bytes of the texts, at least the session's shuffle partitions
    bucket_bytes: int = 32_000_000
    part_tokens: int = 800_000  #: of the branches and of the light pairs

    def thresholds(self, tokens: int) -> tuple[int, int, int]:
        """Occurrences from which a trunk's pair is stored, travels with the tasks, and becomes a context."""
        stored = max(self.least_count, int(np.ceil(self.least_pair * tokens)))
        context = max(stored, int(np.ceil(self.least_context * tokens)))
        return stored, max(stored, min(context, int(np.ceil(self.held_pair * tokens)))), context


def _pack(values, dtype: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.asarray(values, dtype=dtype).tobytes())


def _unpack(blob: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, the bytes of each weight together, which compress better."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack_ids(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(_planes(values))


def _unpack_ids(blob: bytes) -> np.ndarray:
    import zstandard

    return _from_planes(zstandard.ZstdDecompressor().decompress(blob))


def held_out(doc_id: object, folds: int = 7, fold: int = 2) -> bool:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


# ---- chunks: texts as numbers of the chunk's own words, and the words with their training counts by bucket

def _chunk_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()),
                         T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.BinaryType()),
                         T.StructField("body", T.BinaryType()), T.StructField("counts", T.BinaryType()),
                         T.StructField("train_tokens", T.LongType()), T.StructField("train_docs", T.LongType()),
                         T.StructField("tokens", T.LongType())])


def _chunks(docs: DataFrame, s: Settings, buckets: int) -> DataFrame:
    schema = _chunk_schema(docs.schema["id"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        arrow_type, chunk = None, TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        number = defaultdict(numbers().__next__)  # of the chunk's words, in the order met

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in texts], dtype=np.int64)
            flat = np.concatenate(texts).astype(np.int64)
            train = np.array([not held_out(i) for i in ids], dtype=bool)
            count = np.bincount(flat[np.repeat(train, lengths)], minlength=len(number))
            words = list(number)
            bucket = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            rows = {n: [] for n in schema.names}

            def add(*values):
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)

            add(chunk, -1, ids, _pack(lengths, "<i8"), _pack_ids(place[flat] if len(flat) else flat), None,
                int(lengths[train].sum()), int(train.sum()), int(lengths.sum()) + len(lengths))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b]:edges[b + 1]]
                add(chunk, b, None, None, zstandard.compress(b"\n".join([words[i] for i in own.tolist()]), 3),
                    _pack(count[own], "<i8"), None, None, None)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["chunk"], pa.int64()), pa.array(rows["bucket"], pa.int32()),
                 pa.array(rows["ids"], pa.list_(arrow_type)), pa.array(rows["lengths"], pa.binary()),
                 pa.array(rows["body"], pa.binary()), pa.array(rows["counts"], pa.binary()),
                 pa.array(rows["train_tokens"], pa.int64()), pa.array(rows["train_docs"], pa.int64()),
                 pa.array(rows["tokens"], pa.int64())], schema.names)

        for batch in batches:
            arrow_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                ids.append(doc_id)
                words = raw.lower().split()
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(raw)
                if size >= s.chunk_bytes or len(ids) >= 100_000:
                    yield flush()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
                    number = defaultdict(numbers().__next__)
        if ids:
            yield flush()

    return docs.mapInArrow(cut, schema)


# ---- vocabulary: a bucket holds all requests for its words

def _answers(chunks: DataFrame, least: int, frequent: int) -> DataFrame:
    """Of each (chunk, bucket), the words' training counts and codes (the word's number among the bucket's words seen
    ``least`` times, plus one; 0: fewer).  Those seen ``frequent`` times have the first numbers.  One more row a bucket,
    with chunk -1, counts its different words and those seen once, and has the counts of the frequent ones in the order
    of their numbers."""
    def merge(table: pa.Table) -> pa.Table:
        import zstandard

        place = defaultdict(numbers().__next__)  # of the bucket's words, in the order met
        inflate = zstandard.ZstdDecompressor().decompress
        rows = sorted(zip(table["chunk"].to_pylist(), table["body"].to_pylist(), table["counts"].to_pylist(), strict=True))
        asked = []
        for _, body, _ in rows:
            words = inflate(body).split(b"\n")
            asked.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        total = np.zeros(len(place), np.int64)
        for at, (_, _, counts) in zip(asked, rows, strict=True):
            total[at] += _unpack(counts, "<i8")  # a chunk asks for a word once
        # by frequency: small codes for most tokens compress well
        order = np.argsort(-total, kind="stable")
        numbered = order[total[order] >= min(least, frequent)]
        number = np.zeros(len(total), np.int64)
        number[numbered] = np.arange(1, len(numbered) + 1)
        trunk = numbered[total[numbered] >= frequent]
        b = table["bucket"][0].as_py()
        out = [(c, b, _pack(total[at], "<i8"), _pack(number[at], "<i8"), None, None)
               for at, (c, _, _) in zip(asked, rows, strict=True)]
        out.append((-1, b, _pack(total[trunk], "<i8"), None, int((total > 0).sum()), int((total == 1).sum())))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (
            pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
            ["chunk", "bucket", "counts", "codes", "different", "once"])

    return chunks.where("bucket >= 0").select("chunk", "bucket", "body", "counts").groupBy("bucket").applyInArrow(
        merge, "chunk long, bucket int, counts binary, codes binary, different long, once long")


@dataclass
class Vocabulary:
    """Totals of the training rows, and the counts of the trunk's symbols by code (0 at other codes)."""

    tokens: int
    texts: int
    different: int
    once: int
    count: np.ndarray

    @property
    def unknown(self) -> float:
        """The root's probability of the unknown symbol."""
        return (self.once + 0.5) / (self.tokens + self.once + 1)

    def known(self, codes: np.ndarray) -> np.ndarray:
        """The counts of symbols that the trunk has, 0 of others."""
        inside = codes < len(self.count)
        return np.where(inside, self.count[np.where(inside, codes, RARE)], 0)

    def root(self, count: np.ndarray) -> np.ndarray:
        known = (1 - self.unknown) * count / max(1, self.tokens)
        return np.where(count > 0, known, self.unknown)


def _coded(chunks: DataFrame, answers: DataFrame, v: Vocabulary, buckets: int) -> DataFrame:
    """Each chunk's texts as symbol codes, with what the root and the base formula give for each text."""
    id_type = chunks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type))] + [
        T.StructField(n, T.BinaryType()) for n in ("lengths", "codes", "known", "base", "rare", "symbols", "counts")])

    def code(asked: pa.Table, answered: pa.Table) -> pa.Table:
        arrow = pa.schema([("chunk", pa.int64()), ("ids", asked.schema.field("ids").type)] + [
            (n, pa.binary()) for n in schema.names[2:]])
        if not asked.num_rows:
            return arrow.empty_table()
        row = asked.to_pylist()[0]
        found = sorted(zip(answered["bucket"].to_pylist(), answered["counts"].to_pylist(), answered["codes"].to_pylist(),
                           strict=True))
        count = np.concatenate([np.zeros(0, np.int64)] + [_unpack(c, "<i8") for _, c, _ in found])
        codes = np.concatenate([np.zeros(0, np.int64)] + [
            np.where((x := _unpack(k, "<i8")) > 0, (x - 1) * buckets + b + FIRST, RARE) for b, _, k in found])
        lengths, words = _unpack(row["lengths"], "<i8"), _unpack_ids(row["body"])
        stops = np.cumsum(lengths) + np.arange(len(lengths))  # where each text's end stands
        n = int(lengths.sum()) + len(lengths)
        is_word = np.ones(n, bool)
        is_word[stops] = False
        place = np.full(n, len(codes))  # of each token among the chunk's words and, last, the end
        place[is_word] = words
        each, symbol = np.append(count, v.texts), np.append(codes, END)
        first = stops - lengths
        base = np.log10((each + 1) / (v.tokens + v.different + 1))
        rare = np.where(symbol == RARE, np.log10(v.root(each)), 0.0)
        total = lambda x: np.add.reduceat(x[place], first)  # noqa: E731  every text has one token at least
        # the chunk's symbols by frequency, so that the texts as their numbers compress well
        symbols, at, number = np.unique(symbol, return_index=True, return_inverse=True)
        number = number[place]
        order = np.argsort(-np.bincount(number, minlength=len(symbols)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        symbols, at = symbols[order], at[order]
        return pa.Table.from_arrays([asked["chunk"].combine_chunks(), asked["ids"].combine_chunks()] + [
            pa.array([x], pa.binary()) for x in (
                _pack(lengths + 1, "<i8"), _pack_ids(rank[number]), _pack(total((each > 0).astype(np.int64)), "<i8"),
                _pack(total(base), "<f8"), _pack(total(rare), "<f8"), _pack(symbols, "<u4"),
                _pack(each[at], "<i8"))], schema=arrow)

    return chunks.where("bucket = -1").select("chunk", "ids", "lengths", "body").groupBy("chunk").cogroup(
        answers.where("chunk >= 0").select("chunk", "bucket", "counts", "codes").groupBy("chunk")).applyInArrow(code, schema)


# ---- the trunk

@dataclass
class Depth:
    """Contexts of one length.  ``keys``: held pairs as context << 32 | symbol, sorted; ``child``: the pair as a
    context of the next depth, or -1.  ``rest`` and ``state`` come of all stored pairs, held or light."""

    size: np.ndarray
    suffix: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def find(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Place of each pair among the keys, or -1."""
        out = np.full(len(context), -1, np.int64)
        ask = np.flatnonzero((context >= 0) & (symbol != RARE))
        if len(self.keys) and len(ask):
            key = (context[ask] << SHIFT) | symbol[ask]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[ask] = np.where(self.keys[at] == key, at, -1)
        return out

    def gains(self, context: np.ndarray, symbol: np.ndarray, light: np.ndarray, s: Settings) -> np.ndarray:
        """What each pair itself has in its context; ``light``: its occurrences if it is light and stored, or 0."""
        place = self.find(context, symbol)
        gain = np.where(light > 0, (light - s.discount) / np.maximum(1, self.size[context]), 0.0)
        return np.where(place >= 0, self.gain[place], gain) if len(self.gain) else gain


@dataclass
class Tree:
    root: np.ndarray  #: by code
    first: np.ndarray  #: by code, the context of that one symbol, or -1
    depths: list[Depth]
    first_of: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  #: number of a depth's first context
    chain: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))  #: each context's suffixes by depth, or -1

    def own(self, codes: np.ndarray) -> np.ndarray:
        """The codes that the trunk knows; others count as rare here."""
        return np.where(codes < len(self.first), codes, RARE)

    def walk(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[Depth, np.ndarray, np.ndarray]]:
        """For each depth, the context before each symbol and the place of the pair."""
        before = np.empty_like(codes)
        before[1:], before[starts] = codes[:-1], END
        context = self.first[before]
        for depth in self.depths:
            place = depth.find(context, codes)
            yield depth, context, place
            context = np.full(len(codes), -1, np.int64)
            if len(depth.child):
                context[1:] = np.where(place[:-1] >= 0, depth.child[place[:-1]], -1)
            context[starts] = -1

    def context(self, history: list[np.ndarray]) -> np.ndarray:
        """The contexts of these symbols, the nearest first, or -1."""
        context = self.first[self.own(history[-1])]
        for depth, symbol in zip(self.depths, history[-2::-1], strict=False):
            place = depth.find(context, self.own(symbol))
            context = np.where(place >= 0, depth.child[place], -1) if len(depth.child) else np.full(len(place), -1)
        return context

    def below(self, level: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Probability of symbols in contexts of depth ``level`` (0: the root), states or not."""
        if level == 0:
            return self.root[symbol]
        depth = self.depths[level - 1]
        place = depth.find(context, symbol)
        gain = np.where(place >= 0, depth.gain[place], 0.0) if len(depth.gain) else 0.0
        return gain + depth.rest[context] * self.below(level - 1, depth.suffix[context], symbol)

    def gains(self, context: np.ndarray, symbol: np.ndarray, light: np.ndarray, s: Settings) -> Iterator[
            tuple[Depth, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth, which rows have a context of it, these contexts, and the symbols' gains there.  ``context``:
        the longest, numbered over all depths; ``light``: by depth the occurrences of the pair if it is light."""
        for depth, own, n in zip(self.depths, self.chain[:, context], light, strict=True):
            at = np.flatnonzero(own >= 0)
            own = own[at].astype(np.int64)
            yield depth, at, own, depth.gains(own, symbol[at], n[at], s)

    def store(self, level: int, keys: np.ndarray, count: np.ndarray, s: Settings) -> None:
        """Takes the held pairs of the deepest contexts so far."""
        depth = self.depths[level - 1]
        order = np.argsort(keys)
        depth.keys, depth.count = keys[order], count[order]
        depth.gain = (depth.count - s.discount) / depth.size[depth.keys >> SHIFT]
        depth.child = np.full(len(keys), -1, np.int64)

    def number_all(self) -> None:
        """Numbers the contexts over all depths."""
        self.first_of = np.cumsum([0] + [len(d.size) for d in self.depths])
        self.chain = np.full((len(self.depths), self.first_of[-1]), -1, np.int32)
        for level, start in enumerate(self.first_of[:-1]):
            own = np.arange(len(self.depths[level].size))
            for k in range(level, -1, -1):
                self.chain[k, start:start + len(own)] = own
                own = self.depths[k].suffix[own]

    def smooth(self, stored: np.ndarray, count: np.ndarray, s: Settings) -> None:
        """The mass that each context hands down, by the number and the occurrences of its light pairs."""
        for depth, m, n in zip(self.depths, self.by_depth(stored), self.by_depth(count), strict=True):
            light = (n - s.discount * m) / np.maximum(1, depth.size)
            depth.rest = np.maximum(1 - (np.bincount(depth.keys >> SHIFT, depth.gain, len(depth.size)) + light), 1e-12)

    def test(self, stored: np.ndarray, light: np.ndarray, light_lower: np.ndarray, tokens: int) -> None:
        """The test of divergence, by the number of each context's light pairs and their sums of divergence and of the
        suffix's probability."""
        for level, (depth, m, d, low) in enumerate(zip(self.depths, *map(self.by_depth, (stored, light, light_lower)),
                                                       strict=True)):
            context, symbol = depth.keys >> SHIFT, depth.keys & 0xFFFFFFFF
            n = len(depth.size)
            lower = self.below(level, depth.suffix[context], symbol) if len(context) else np.zeros(0)
            own = depth.gain + depth.rest[context] * lower
            left = np.maximum(1 - (np.bincount(context, lower, n) + low), 0.0)
            divergence = np.bincount(context, own * np.log(own / lower), n) + d + depth.rest * left * np.log(depth.rest)
            m = m + np.bincount(context, minlength=n)
            depth.state = (m > 0) & (depth.size * divergence > 0.5 * m * np.log(max(2, tokens)))
        # a state's suffixes are states
        for longer, shorter in zip(self.depths[:0:-1], self.depths[-2::-1], strict=True):
            shorter.state[longer.suffix[longer.state]] = True

    def by_depth(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, self.first_of[1:-1])

    def deepen(self, level: int, least: int) -> bool:
        """Makes pairs of ``least`` occurrences contexts of the next depth."""
        depth = self.depths[level - 1]
        context, symbol = depth.keys >> SHIFT, depth.keys & 0xFFFFFFFF
        grown = np.flatnonzero((depth.count >= least) & (symbol != END))
        if not len(grown):
            return False
        depth.child[grown] = np.arange(len(grown))
        if level == 1:
            suffix = self.first[symbol[grown]]
        else:
            shorter = self.depths[level - 2]
            suffix = shorter.child[shorter.find(depth.suffix[context[grown]], symbol[grown])]
        self.depths.append(Depth(depth.count[grown], suffix))
        return True


def _text_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, tokens as numbers of the chunk's symbols, which texts train, symbols, their counts) of a coded chunk."""
    return (_unpack(row["lengths"], "<i8"), _unpack_ids(row["codes"]).astype(np.int32),
            np.array([not held_out(i) for i in row["ids"]], dtype=bool), _unpack(row["symbols"], "<u4").astype(np.int64),
            _unpack(row["counts"], "<i8"))


def _pair_counts(coded: DataFrame, tree: Tree) -> DataFrame:
    """(pair, n) at the tree's deepest contexts over the training texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _text_rows(batch):
                lengths, number, train, symbols, _ = _read(row)
                codes = tree.own(symbols)[number]
                codes, lengths = codes[np.repeat(train, lengths)], lengths[train]
                if not len(lengths):
                    continue
                for _, context, _ in tree.walk(codes, np.cumsum(lengths) - lengths):
                    pass
                use = (context >= 0) & (codes != RARE)
                pair, n = np.unique((context[use] << SHIFT) | codes[use], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    return coded.select("ids", "lengths", "codes", "symbols", "counts").mapInArrow(count, "pair long, n long")


def fit_trunk(coded: DataFrame, v: Vocabulary, s: Settings) -> Tree:
    """A pass over the coded texts for each depth.  The driver gets the pairs that reach ``held_pair``; what lighter ones
    add to their contexts is yet to come."""
    _, least_pair, least_context = s.thresholds(v.tokens)
    frequent = np.flatnonzero(v.count >= least_context)
    first = np.full(len(v.count), -1, np.int64)
    first[frequent] = np.arange(len(frequent))
    tree = Tree(v.root(v.count), first, [Depth(v.count[frequent], np.zeros(len(frequent), np.int64))])
    for level in range(1, s.depth + 1):
        rows = materialize(_pair_counts(coded, tree).groupBy("pair").agg(F.sum("n").alias("n")).where(
            F.col("n") >= least_pair), label="suffix-trunk", free_shuffles=True)
        held = rows.toArrow()
        discard(rows)
        tree.store(level, held["pair"].to_numpy(), held["n"].to_numpy(), s)
        if level < s.depth and not tree.deepen(level, least_context):
            break
    tree.number_all()
    return tree


# ---- the trunk's light pairs

def _mail(chunk: int, part: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(chunk, part, size, body): a chunk's rows, in the order of their parts, as what it asks of each part."""
    import zstandard

    edges = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[p], edges[p + 1])
        out.append((chunk, p, int(edges[p + 1] - edges[p]),
                    zstandard.compress(b"".join([_planes(c[own]) for c in columns]), 1)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (
            pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "part", "size", "body"])


def _unmail(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, where each row of ``table`` begins and the last one ends in them)."""
    import zstandard

    sizes = table["size"].to_pylist()
    edges = np.cumsum([0, *sizes])
    columns = np.empty((width, edges[-1]), np.int64)
    for body, at, w in zip(table["body"], edges.tolist(), sizes, strict=False):
        raw = zstandard.decompress(body.as_py())
        for i, column in enumerate(columns):
            column[at:at + w] = _from_planes(raw[4 * i * w:4 * (i + 1) * w])
    return columns, edges


@dataclass
class Walk:
    """Of each token how many contexts of the trunk precede it, the longest of them, numbered over all depths, or -1, and
    in how many the pair is held, which are the shortest ones."""

    inside: np.ndarray
    longest: np.ndarray
    held: np.ndarray

    @staticmethod
    def of(n: int) -> Walk:
        return Walk(np.zeros(n, np.int8), np.full(n, -1, np.int32), np.zeros(n, np.int8))

    def add(self, first: int, context: np.ndarray, place: np.ndarray) -> None:
        has = context >= 0
        self.inside += has
        self.longest[has] = context[has] + first
        self.held += place >= 0


@dataclass
class Light:
    """A chunk's different light pairs, each in its longest context, in the order of their parts; symbols as the chunk's
    numbers.  ``row``: of each token the row that stands for it, or -1."""

    part: np.ndarray
    context: np.ndarray
    symbol: np.ndarray
    held: np.ndarray
    n: np.ndarray
    row: np.ndarray


def _light(tree: Tree, walk: Walk, number: np.ndarray, lengths: np.ndarray, train: np.ndarray, symbols: np.ndarray,
           parts: int) -> Light:
    at = np.flatnonzero((walk.inside > walk.held) & (symbols != RARE)[number])
    context, symbol, held = walk.longest[at], number[at], walk.held[at]
    # the shortest context in which the pair is light decides
    shortest = (tree.first_of[held] + tree.chain[held, context]).astype(np.uint64)
    key = (shortest + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    key = ((key ^ (key >> np.uint64(29))) + symbols[symbol].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order, first = _sorted([part, context, symbol])
    kept = np.flatnonzero(first)
    row = np.full(len(number), -1, np.int32)
    row[at[order]] = np.cumsum(first) - 1
    trains = np.repeat(train, lengths)[at][order].astype(np.int64)
    n = np.add.reduceat(trains, kept) if len(kept) else trains
    kept = order[kept]
    return Light(part[kept], context[kept], symbol[kept], held[kept], n, row)


def _light_requests(coded: DataFrame, tree: Tree, v: Vocabulary, s: Settings, parts: int) -> DataFrame:
    """What each chunk asks of each part: of each row the context and the symbol's code, its training occurrences with
    the number of contexts that hold the pair, and the symbol's count if the trunk has none."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _text_rows(batch):
                lengths, number, train, symbols, counts = _read(row)
                walk = Walk.of(len(number))
                for i, (_, context, place) in enumerate(tree.walk(tree.own(symbols)[number], np.cumsum(lengths) - lengths)):
                    walk.add(tree.first_of[i], context, place)
                x = _light(tree, walk, number, lengths, train, symbols, parts)
                more = np.where(v.known(symbols) > 0, 0, counts)
                yield from _mail(row["chunk"], x.part, parts, [
                    x.context, symbols[x.symbol], x.n * (s.depth + 1) + x.held, more[x.symbol]])

    return coded.select("chunk", "ids", "lengths", "codes", "symbols", "counts").mapInArrow(
        ask, "chunk long, part long, size long, body binary")


def _light_pairs(requests: DataFrame, tree: Tree, s: Settings, least: int) -> DataFrame:
    """Of each (chunk, part) the answers (``body``): by depth the occurrences of each row's pair in the training texts, 0
    where it is held or not stored.  One more row a part, with chunk -1: ``pairs``, the ``size`` different rows with a
    stored pair, each pair marked in one of them, and the number and occurrences of the light pairs by context."""
    def merge(table: pa.Table) -> pa.Table:
        import zstandard

        table = table.sort_by("chunk")
        (context, symbol, n, more), edges = _unmail(table, 4)
        order, first = _sorted([context, symbol])
        row = np.empty(len(order), np.int64)
        row[order] = np.cumsum(first) - 1
        held, n = (n % (s.depth + 1))[order[first]], np.bincount(row, n // (s.depth + 1))
        context, symbol, more = (x[order[first]] for x in (context, symbol, more))
        seen, marks, sums = np.zeros((len(tree.depths), len(n)), np.int64), np.zeros(len(n), np.int64), []
        for level, own in enumerate(tree.chain[:, context]):
            at = np.flatnonzero((held <= level) & (own >= 0))
            by, new = _sorted([own[at], symbol[at]])
            pair = np.empty(len(at), np.int64)
            pair[by] = np.cumsum(new) - 1
            total = np.bincount(pair, n[at]).astype(np.int64)
            stored = total >= least
            seen[level, at] = np.where(stored, total, 0)[pair]
            first = at[by][new][stored]
            marks[first] |= 1 << level
            of, group = np.unique(tree.first_of[level] + own[first], return_inverse=True)
            sums.append((of, np.bincount(group), np.bincount(group, total[stored]).astype(np.int64)))
        sums = [np.concatenate(x) for x in zip(*sums, strict=True)]
        answers = [zstandard.compress(b"".join([_planes(x[row[a:b]]) for x in seen]), 1)
                   for a, b in zip(edges[:-1], edges[1:], strict=True)]
        kept = marks > 0
        pairs = zstandard.compress(b"".join([_planes(x[kept]) for x in (context, symbol, more, marks, *seen)]), 1)
        none, part = [None] * table.num_rows, table["part"][0].as_py()
        return pa.table({
            "chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int64()),
            "part": pa.array([part] * (table.num_rows + 1), pa.int64()), "body": pa.array([*answers, None], pa.binary()),
            "size": pa.array([*none, int(kept.sum())], pa.int64()), "pairs": pa.array([*none, pairs], pa.binary()),
            **{name: pa.array([*none, x], pa.list_(pa.int64())) for name, x in zip(("context", "stored", "n"), sums, strict=True)}})

    return requests.groupBy("part").applyInArrow(
        merge, "chunk long, part long, body binary, size long, pairs binary, context array<long>, stored array<long>, "
               "n array<long>")


UNIT = float(1 << 44)  #: sums of whole units come out alike in any order


def _light_divergence(pairs: DataFrame, tree: Tree, v: Vocabulary, s: Settings) -> DataFrame:
    """(context, divergence, lower): what the light pairs add to the test of their contexts, in units."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (context, symbol, more, marks, *seen), _ = _unmail(
                    pa.Table.from_batches([batch.slice(i, 1)]), 4 + len(tree.depths))
                known = v.known(symbol)
                lower = v.root(np.where(known > 0, known, more))
                for level, (depth, at, own, gain) in enumerate(tree.gains(context, symbol, seen, s)):
                    here = gain + depth.rest[own] * lower[at]
                    marked = (marks[at] >> level & 1).astype(bool)
                    below = lower[at][marked]
                    of, group = np.unique(tree.first_of[level] + own[marked], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64))] + [
                        pa.array(np.rint(np.bincount(group, x, len(of)) * UNIT).astype(np.int64))
                        for x in (here[marked] * np.log(here[marked] / below), below)], ["context", "divergence", "lower"])
                    lower[at] = here

    return pairs.where("chunk = -1").select("size", F.col("pairs").alias("body")).mapInArrow(
        add, "context long, divergence long, lower long")


def _sums(rows: DataFrame, tree: Tree, names: list[str]) -> list[np.ndarray]:
    """Sums by context of the trunk, a row a context at most."""
    found = rows.groupBy("context").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = [np.zeros(tree.first_of[-1], np.int64) for _ in names]
    for sums, n in zip(out, names, strict=True):
        sums[found["context"].to_numpy()] = found[n].to_numpy()
    return out


def settle_trunk(coded: DataFrame, tree: Tree, v: Vocabulary, s: Settings, parts: int) -> DataFrame:
    """Counts the trunk's light pairs and closes its contexts.  The texts come back with the answers to their chunks
    (``seen``, by part; no light pair is stored where the threshold of the held ones is no higher)."""
    spark = coded.sparkSession
    least, held, _ = s.thresholds(v.tokens)
    none = np.zeros(tree.first_of[-1], np.int64)
    if least == held:
        tree.smooth(none, none, s)
        tree.test(none, none, none, v.tokens)
        return coded.withColumn("seen", F.lit(None).cast("array<binary>"))
    pairs = materialize(_light_pairs(_light_requests(coded, tree, v, s, parts), tree, s, least), spark, "suffix-pairs",
                        free_shuffles=True)
    stored, n = _sums(pairs.where("chunk = -1").select(F.inline(F.arrays_zip("context", "stored", "n"))), tree, ["stored", "n"])
    tree.smooth(stored, n, s)
    divergence, lower = _sums(_light_divergence(pairs, tree, v, s), tree, ["divergence", "lower"])
    tree.test(stored, divergence / UNIT, lower / UNIT, v.tokens)
    answers = pairs.where("chunk >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("of"))
    answered = materialize(coded.join(answers.select("chunk", F.col("of.body").alias("seen")), "chunk", "left"), spark,
                           "suffix-coded", free_shuffles=True)
    discard(coded)
    discard(pairs)
    return answered


def _seen(row: dict, tree: Tree, n: int) -> np.ndarray:
    """By depth, the occurrences of the chunk's ``n`` light pairs."""
    import zstandard

    found = [np.array([_from_planes(x) for x in np.split(np.frombuffer(zstandard.decompress(b), np.uint8), len(tree.depths))])
             for b in row["seen"] or []]
    return np.concatenate(found, axis=1) if found else np.zeros((len(tree.depths), n), np.int64)


# ---- the branches

def _history(number: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """The numbers of the symbols before each symbol, the nearest first; the start of a text stands as its end."""
    starts = np.cumsum(lengths) - lengths
    since = (np.arange(len(number)) - np.repeat(starts, lengths)).astype(np.int32)
    end, rare = (int(x[0]) if len(x := np.flatnonzero(symbols == c)) else NONE - 1 for c in (END, RARE))
    out = []
    for k in range(1, depth + 1):
        before = np.full(len(number), NONE, np.int32)
        before[k:] = number[:-k]
        before[since == k - 1] = end
        before[(since < k - 1) | (before == rare)] = NONE
        if out:
            before[out[-1] == NONE] = NONE
        out.append(before)
    return out


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by columns of numbers from -1 on, equal rows in any order, and where, in it, a row differs from
    the one before."""
    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        return order, _runs([key[order]])

    key, room = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        size = int(c.max(initial=0)) + 2
        if room * size >= 1 << 62:  # the rows' ranks so far stand for their columns
            order, first = ranked(key)
            key[order] = np.cumsum(first) - 1
            room = len(key)
        key = key * size + (c + 1)
        room *= size
    return ranked(key)


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


@dataclass
class Open:
    """A chunk's different histories that leave the trunk, with their next symbols, in the order of their parts and as
    numbers of the chunk's symbols.  ``row``: of each token the row that stands for it, or -1; ``inside``: the depth at
    which the trunk ends; ``token``: one that the row stands for."""

    part: np.ndarray
    inside: np.ndarray
    history: list[np.ndarray]
    symbol: np.ndarray
    n: np.ndarray
    row: np.ndarray
    token: np.ndarray


def _open(inside: np.ndarray, number: np.ndarray, lengths: np.ndarray, train: np.ndarray, symbols: np.ndarray,
          s: Settings, parts: int) -> Open:
    """``inside``: of each token the depth at which the trunk ends."""
    history = _history(number, lengths, symbols, s.depth)
    out = np.zeros(len(number), bool)
    for k, h in enumerate(history):
        out |= (inside == k) & (h != NONE)
    at = np.flatnonzero(out)
    history, inside, symbol = [h[at] for h in history], inside[at], number[at]
    key = np.zeros(len(at), np.uint64)
    for k, h in enumerate(history):  # the shortest context outside the trunk decides
        own = np.flatnonzero(k <= inside)
        mixed = (key[own] + symbols[h[own]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key[own] = mixed ^ (mixed >> np.uint64(29))
    part = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order, first = _sorted([part, *history, symbol])
    kept = np.flatnonzero(first)
    row = np.full(len(number), -1, np.int32)
    row[at[order]] = np.cumsum(first) - 1
    trains = np.repeat(train, lengths)[at][order].astype(np.int64)
    n = np.add.reduceat(trains, kept) if len(kept) else trains
    kept = order[kept]
    return Open(part[kept], inside[kept], [h[kept] for h in history], symbol[kept], n, row, at[kept])


def _requests(coded: DataFrame, tree: Tree, v: Vocabulary, s: Settings, parts: int) -> DataFrame:
    """What each chunk asks of each part: of each row the history and the symbol as codes, its training occurrences with
    the depth at which the trunk ends, the symbol's count if the trunk has none, and by depth the occurrences of the
    trunk's pair if it is light."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _text_rows(batch):
                lengths, number, train, symbols, counts = _read(row)
                walk = Walk.of(len(number))
                for i, (_, context, place) in enumerate(tree.walk(tree.own(symbols)[number], np.cumsum(lengths) - lengths)):
                    walk.add(tree.first_of[i], context, place)
                o = _open(walk.inside, number, lengths, train, symbols, s, parts)
                named = np.append(symbols, NONE)  # a history's -1 is the last
                more = np.where(v.known(symbols) > 0, 0, counts)
                light = np.zeros((s.depth - 1, len(o.token)), np.int64)
                if row["seen"]:
                    x = _light(tree, walk, number, lengths, train, symbols, parts)
                    at = np.flatnonzero(x.row[o.token] >= 0)
                    for n, seen in zip(light, _seen(row, tree, len(x.part)), strict=False):
                        n[at] = seen[x.row[o.token[at]]]
                yield from _mail(row["chunk"], o.part, parts, [
                    *(named[h] + 1 for h in o.history), symbols[o.symbol], o.n * (s.depth + 1) + o.inside, more[o.symbol],
                    *light])

    return coded.select("chunk", "ids", "lengths", "codes", "symbols", "counts", "seen").mapInArrow(
        ask, "chunk long, part long, size long, body binary")


def branch(tree: Tree, v: Vocabulary, s: Settings, inside: np.ndarray, history: list[np.ndarray], symbol: np.ndarray,
           count: np.ndarray, n: np.ndarray, light: np.ndarray) -> np.ndarray:
    """log10 of each row's probability, NaN where no branch is a state, so that the trunk's word holds; rows with whole
    contexts of a part, equal rows of several chunks included.  ``count``: of the symbol in the training rows; for rare
    symbols the root's part is left out.  ``light``: by depth the occurrences of the trunk's pair if it is light."""
    order, _ = _sorted([*history, symbol])
    inside, symbol, n = inside[order], symbol[order], n[order]
    history = [h[order] for h in history]
    score = np.where(symbol == RARE, 1.0, v.root(count[order]))
    lower = score.copy()  # through all contexts, for the test; ``score``: through the states
    for level, (depth, seen) in enumerate(zip(tree.depths, light, strict=False), 1):
        at = np.flatnonzero(inside >= level)
        context = tree.context([h[at] for h in history[:level]])
        gain = depth.gains(context, symbol[at], seen[order[at]], s)
        lower[at] = gain + depth.rest[context] * lower[at]
        state = depth.state[context]
        score[at] = np.where(state, (gain + depth.rest[context] * score[at]), score[at])
    kept = []
    for level in range(1, s.depth + 1):
        at = np.flatnonzero((inside < level) & (history[level - 1] != NONE))
        if not len(at):
            continue
        group = np.cumsum(_runs([h[at] for h in history[:level]])) - 1
        size = np.bincount(group, n[at])
        often = size >= s.least_count  # the others store nothing and change nothing
        at, group = at[often[group]], (np.cumsum(often) - 1)[group[often[group]]]
        if not len(at):
            continue
        size, own = size[often], symbol[at]
        # the rows lie in the order of the longest contexts and their symbols
        by, new = (slice(None), _runs([group, own])) if level == s.depth else _sorted([group, own])
        pair = np.empty(len(at), np.int64)
        pair[by] = np.cumsum(new) - 1
        first = np.arange(len(at))[by][new]
        seen, of = np.bincount(pair, n[at]), group[first]
        stored = (seen >= s.least_count) & (own[first] != RARE)
        gain = np.where(stored, (seen - s.discount) / np.maximum(1, size[of]), 0.0)
        rest = np.maximum(1 - np.bincount(of, gain), 1e-12)
        below = lower[at][first]
        here = gain + rest[of] * below
        left = np.maximum(1 - np.bincount(of, np.where(stored, below, 0.0)), 0.0)
        divergence = np.bincount(of, np.where(stored, here * np.log(here / below), 0.0)) + rest * left * np.log(rest)
        m = np.bincount(of, stored)
        state = (m > 0) & (size * divergence > 0.5 * m * np.log(max(2, v.tokens)))
        lower[at] = here[pair]
        kept.append((at, group, state, gain[pair], rest[group]))
    for (_, group, shorter, *_), (longer_at, longer, state, *_), at in zip(
            kept[-2::-1], kept[:0:-1], [k[0] for k in kept[-2::-1]], strict=True):  # a state's suffixes are states
        own = np.isin(at, longer_at[state[longer]], assume_unique=True)
        shorter[group[own]] = True
    changed = np.zeros(len(order), bool)
    for at, group, state, gain, rest in kept:
        score[at] = np.where(state[group], gain + rest * score[at], score[at])
        changed[at] |= state[group]
    out = np.empty(len(order))
    out[order] = np.where(changed, np.log10(score), np.nan)
    return out


def _branches(requests: DataFrame, tree: Tree, v: Vocabulary, s: Settings) -> DataFrame:
    """(chunk, part, body): the answers, in the order of the chunk's rows."""
    def answer(table: pa.Table) -> pa.Table:
        columns, edges = _unmail(table, 2 * s.depth + 2)
        history, (symbol, n, count, *light) = columns[:s.depth], columns[s.depth:]
        history -= 1
        known = v.known(symbol)
        p = branch(tree, v, s, n % (s.depth + 1), list(history), symbol, np.where(known > 0, known, count),
                   n // (s.depth + 1), light)
        each = np.split(p, edges[1:-1])
        return pa.table({"chunk": table["chunk"], "part": table["part"],
                         "body": pa.array([_pack_ids(x.astype("<f4").view("<u4")) for x in each], pa.binary())})

    return requests.groupBy("part").applyInArrow(answer, "chunk long, part long, body binary")


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       s: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (add-one unigram) and ``score`` (log10 probability of the whole text by the tree).

    Texts are lower-cased (A-Z) words and one end.  A null text counts as empty: its end alone.  A null id counts as
    an empty one and trains.  Repeated rows train and are scored each for itself.  Without training rows all symbols
    are unknown.  Other columns are not read.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = s.buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // s.bucket_bytes))
    chunks = materialize(_chunks(own, s, buckets), spark, "suffix-chunks", free_shuffles=True)
    words, texts, every = chunks.where("bucket = -1").agg(
        F.sum("train_tokens"), F.sum("train_docs"), F.sum("tokens")).first()
    texts = texts or 0
    tokens = (words or 0) + texts
    _, held, _ = s.thresholds(tokens)
    answers = materialize(_answers(chunks, s.least_count, held), spark, "suffix-vocabulary", free_shuffles=True)
    # at most 1 / held_pair counts
    frequent = {r["bucket"]: _unpack(r["counts"], "<i8") for r in answers.where("chunk = -1").select(
        "bucket", "counts").collect()}
    totals = answers.where("chunk = -1").agg(F.sum("different"), F.sum("once")).first()
    count = np.zeros(FIRST + buckets * max([0, *map(len, frequent.values())]), np.int64)
    for b, of in frequent.items():
        count[FIRST + b + buckets * np.arange(len(of))] = of
    count[END] = texts
    v = Vocabulary(tokens, texts, (totals[0] or 0) + (texts > 0), (totals[1] or 0) + (texts == 1), count)
    coded = materialize(_coded(chunks, answers, v, buckets), spark, "suffix-coded", free_shuffles=True)
    discard(chunks)
    discard(answers)
    tree, parts = fit_trunk(coded, v, s), max(1, -(-(every or 0) // s.part_tokens))
    coded = settle_trunk(coded, tree, v, s, parts)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + T.StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields)

    def score(texts: pa.Table, answered: pa.Table) -> pa.Table:
        arrow = pa.schema(list(zip(schema.names, (
            texts.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(),
            pa.float64()), strict=True)))
        if not texts.num_rows:
            return arrow.empty_table()
        row = texts.to_pylist()[0]
        lengths, number, train, symbols, counts = _read(row)
        starts = np.cumsum(lengths) - lengths
        root = np.where(symbols == RARE, 1.0, v.root(counts))
        p, walk = root[number], Walk.of(len(number))
        for i, (depth, context, place) in enumerate(tree.walk(tree.own(symbols)[number], starts)):
            walk.add(tree.first_of[i], context, place)
            at = np.flatnonzero(context >= 0)
            at = at[depth.state[context[at]]]
            gain = np.where(place[at] >= 0, depth.gain[place[at]], 0.0) if len(depth.gain) else 0.0
            p[at] = gain + depth.rest[context[at]] * p[at]
        if row["seen"]:
            x = _light(tree, walk, number, lengths, train, symbols, parts)
            own = root[x.symbol]
            for depth, at, context, gain in tree.gains(x.context, symbols[x.symbol], _seen(row, tree, len(x.part)), s):
                own[at] = np.where(depth.state[context], gain + depth.rest[context] * own[at], own[at])
            at = np.flatnonzero(x.row >= 0)
            p[at] = own[x.row[at]]
        p = np.log10(p)
        found = [_unpack_ids(b) for _, b in sorted(zip(
            answered["part"].to_pylist(), answered["body"].to_pylist(), strict=True))]
        asked = _open(walk.inside, number, lengths, train, symbols, s, parts).row
        at = np.flatnonzero(asked >= 0)
        if len(at):
            branches = np.concatenate(found).astype("<u4").view("<f4").astype(np.float64)[asked[at]]
            p[at] = np.where(np.isnan(branches), p[at], branches)
        model = np.add.reduceat(p, starts) + _unpack(row["rare"], "<f8")
        return pa.Table.from_arrays([
            texts["ids"].combine_chunks().flatten(), pa.array(~train), pa.array(lengths),
            pa.array(_unpack(row["known"], "<i8")), pa.array(np.full(len(lengths), v.tokens, np.int64)),
            pa.array(_unpack(row["base"], "<f8")), pa.array(model)], schema=arrow)

    # written before the texts are exchanged, so that the requests' files are gone by then
    asked = materialize(_branches(_requests(coded, tree, v, s, parts), tree, v, s), spark, "suffix-branches",
                        free_shuffles=True)
    return coded.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(score, schema)
