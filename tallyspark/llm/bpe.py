"""Byte-level BPE by a pair occurrence index.

The different pre-tokens of a task's block of texts stand in one array of symbols, linked to their neighbours.  An
index maps each mergeable pair's rank to all its positions.  Active ranks are applied in ascending order; a merge
updates the lists of the pairs it makes, and entries that an earlier merge has used up are skipped when their rank
comes.  A rank with many positions is applied to all of them at once, one with few position by position.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the pre-tokenizer's expression sees it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed: the pre-tokenizer's expression.
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|"
           rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Positions from which on a rank is applied to an array.
MANY = 48
#: Bytes of new pre-tokens that share an index, of texts split at a time, and pre-tokens whose ids are kept.
BLOCK_BYTES, TEXT_BYTES, KEPT = 1_000_000, 2_000_000, 300_000


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary: printable Latin-1 bytes for themselves, the
    others as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Merges:
    """``pairs``: left << 32 | right, sorted, with their ranks; ``made``: the id that a rank's merge makes."""

    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: list[int]
    sides: list[tuple[int, int]]
    specials: dict[str, int]
    token_bytes: list[bytes]
    rank: dict[int, int]  #: of a pair, as in ``pairs``

    @staticmethod
    def load(tokenizer_json: str) -> Merges:
        spec = json.loads(tokenizer_json)
        vocab, byte_of = spec["model"]["vocab"], byte_characters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        sides = [(vocab[a], vocab[b]) for a, b in merges]
        keys = np.array([a << 32 | b for a, b in sides], dtype=np.int64)
        order = np.argsort(keys)
        byte_ids = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            byte_ids[b] = vocab[c]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for token, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in token)
        for token, i in specials.items():
            table[i] = token.encode()
        return Merges(byte_ids, keys[order], order.astype(np.int64), [vocab[a + b] for a, b in merges], sides, specials,
                      table, {k: r for r, k in enumerate(keys.tolist())})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)


class Occurrences:
    """Positions of each active rank's pair, and the ranks in ascending order."""

    def __init__(self):
        self.at: dict[int, list[int]] = {}
        self.active: list[int] = []

    def add(self, rank: int, positions: Iterable[int]) -> None:
        known = self.at.get(rank)
        if known is None:
            self.at[rank] = list(positions)
            heapq.heappush(self.active, rank)
        else:
            known.extend(positions)

    def add_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        ok = ranks >= 0
        ranks, positions = ranks[ok], positions[ok]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].tolist()
        edges = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
        for i, j in zip(edges, edges[1:], strict=False):
            self.add(int(ranks[i]), positions[i:j])

    def pop(self) -> tuple[int, list[int]]:
        rank = heapq.heappop(self.active)
        return rank, self.at.pop(rank)


def encode_words(words: list[bytes], m: Merges) -> list[list[int]]:
    """Ids of each (non-empty) pre-token."""
    # a stop (-1) before, between and after the words keeps pairs within them
    joined = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
    stops = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    symbol = m.byte_ids[joined].astype(np.int32)
    symbol[stops] = -1
    n = len(symbol)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    index = Occurrences()
    index.add_all(m.rank_of(symbol[:-1], symbol[1:]), np.arange(n - 1))
    get = m.rank.get
    sym, nxt, prv = memoryview(symbol), memoryview(after), memoryview(before)
    while index.active:
        rank, positions = index.pop()
        (a, b), new = m.sides[rank], m.made[rank]
        if len(positions) >= MANY and a != b:
            p = np.unique(np.array(positions, dtype=np.int32))
            p = p[symbol[p] == a]
            q = after[p]
            p, q = p[symbol[q] == b], q[symbol[q] == b]
            symbol[p], symbol[q] = new, -2
            far = after[q]
            after[p], before[far] = far, p
            left = before[p]
            index.add_all(m.rank_of(symbol[left], symbol[p]), left)
            index.add_all(m.rank_of(symbol[p], symbol[far]), p)
            continue
        positions.sort()
        for p in positions:
            if sym[p] != a:
                continue
            q = nxt[p]
            if sym[q] != b:
                continue
            sym[p], sym[q] = new, -2
            far, left = nxt[q], prv[p]
            nxt[p], prv[far] = far, p
            s = sym[left]
            if s >= 0 and (r := get(s << 32 | new)) is not None:
                index.add(r, (left,))
            s = sym[far]
            if s >= 0 and (r := get(new << 32 | s)) is not None:
                index.add(r, (p,))
    alive = np.flatnonzero(symbol >= 0)
    ids, edges = symbol[alive].tolist(), np.searchsorted(alive, stops).tolist()
    return [ids[i:j] for i, j in zip(edges, edges[1:], strict=False)]


class Encoder:
    """Encodes blocks of texts; ids of the pre-tokens seen so far are kept."""

    def __init__(self, merges: Merges):
        import regex

        self.m, self.split = merges, regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, merges.specials)) + ")") if merges.specials else None
        self.known: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; strings of special tokens stand for themselves."""
        if self.specials is None or not self.specials.search(text):
            return self.split(text)
        out = []
        for i, part in enumerate(self.specials.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.pieces(t) for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        known = self.known
        known.update((t, [i]) for t, i in self.m.specials.items())
        new, size = [], 0
        for piece in set().union(*pieces).difference(known):
            new.append(piece)
            size += len(piece)
            if size > BLOCK_BYTES:
                self.learn(new)
                new, size = [], 0
        self.learn(new)
        return [[i for p in ps for i in known[p]] for ps in pieces]

    def learn(self, words: list[str]) -> None:
        if words:
            self.known.update(zip(words, encode_words([w.encode() for w in words], self.m), strict=True))


def _blocks(texts: list[str]) -> Iterable[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > TEXT_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(text: Column, tokenizer_json: str) -> Column:
    """Ids of whole texts (null: of an empty one) by a byte-level BPE tokenizer, without special tokens around."""
    holder: list[Encoder] = []

    @F.arrow_udf("array<int>")
    def bpe(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not holder:
            holder.append(Encoder(Merges.load(tokenizer_json)))
        for batch in texts:
            lengths, flat = [], []
            for block in _blocks([t or "" for t in batch.to_pylist()]):
                ids = holder[0].encode(block)
                lengths += map(len, ids)
                flat.append(np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids))))
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))

    return bpe(text)


def decode(ids: Column, tokenizer_json: str) -> Column:
    """Texts of ids, special tokens included; bytes that are not UTF-8 become replacement characters."""
    holder: list[list[bytes]] = []

    @F.arrow_udf("string")
    def bpe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not holder:
            holder.append(Merges.load(tokenizer_json).token_bytes)
        table = holder[0]
        for batch in batches:
            flat, offsets = batch.flatten().to_numpy(), batch.offsets.to_numpy()
            offsets = (offsets - offsets[0]).tolist()
            yield pa.array([b"".join([table[i] for i in flat[a:b].tolist()]).decode("utf-8", "replace")
                            for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())

    return bpe(ids)


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids: str = "ids",
                     decoded: str = "decoded") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) and ``decoded``, the text that these ids give again; columns
    of these names are replaced.  A null text counts as empty.  Rows are encoded each for itself, so repeated ones
    get equal ids, and an empty table gives an empty one."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    return docs.withColumn(ids, encode(F.col(text_col), spec)).withColumn(decoded, decode(F.col(ids), spec))
