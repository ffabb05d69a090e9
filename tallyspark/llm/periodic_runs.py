"""Periodic runs of words, found by longest common extensions on suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends.  Every run holds a Lyndon word of
length q that is the longest one at its start, in one of two opposite orders of the words, so the longest Lyndon words
at all positions give 2n candidates.  Ukkonen's algorithm builds the suffix tree of the words and that of their
reversal; the depths along an Euler tour, with constant-time range minima, answer how far a candidate extends to the
right and to the left.

Words that can lie in no run of the wanted exponent are set apart first: in such a run every three words in a row occur
several times.  That changes no result; the trees then cover the stretches that remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import words

#: Entries of the Euler tour whose minima are kept by prefix and suffix.
BLOCK = 16
#: How often the counts that set words apart are taken anew within what remains.
PASSES = 3


class SuffixTree:
    """Ukkonen's suffix tree of integers >= 0; a stop smaller than all of them follows the last."""

    def __init__(self, codes: list[int]):
        s = self.s = [*codes, -1]
        n = len(s)
        # node 0 is the root; an edge leads to node v over s[start[v]:end[v]]; leaves have no children
        start, end, link, children = [0], [0], [0], [{}]
        node, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                child = children[node].get(s[edge])
                if child is None:
                    children[node][s[edge]] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    children.append(None)
                    if last:
                        link[last] = node
                    last = node
                else:
                    size = min(end[child], i + 1) - start[child]
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[start[child] + length] == c:
                        if last:
                            link[last] = node
                        length += 1
                        break
                    middle = len(start)
                    start += [start[child], i]
                    end += [start[child] + length, n]
                    link += [0, 0]
                    start[child] += length
                    children += [{s[start[child]]: child, c: middle + 1}, None]
                    children[node][s[edge]] = middle
                    if last:
                        link[last] = middle
                    last = middle
                waiting -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - waiting + 1
                else:
                    node = link[node]
        self.start, self.end, self.children = start, end, children

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String depths along the Euler tour that visits children in ascending order; where each suffix's leaf
        stands in it; the rank of each suffix."""
        n, start, end, children = len(self.s), self.start, self.end, self.children
        depths, place, rank = [0], [0] * n, [0] * n
        stack = [(0, iter([v for _, v in sorted(children[0].items())]))]
        leaves = 0
        while stack:
            depth, rest = stack[-1]
            v = next(rest, None)
            if v is None:
                stack.pop()
                if stack:
                    depths.append(stack[-1][0])
                continue
            below = children[v]
            if below is None:
                suffix = start[v] - depth
                place[suffix], rank[suffix] = len(depths), leaves
                leaves += 1
                depths += [n - suffix, depth]
            else:
                depth += end[v] - start[v]
                depths.append(depth)
                stack.append((depth, iter([below[c] for c in sorted(below)])))
        return np.array(depths, np.int32), np.array(place, np.int64), np.array(rank, np.int64)

    def opposite_rank(self) -> np.ndarray:
        """Rank of each suffix when greater words come first; the stop stays first."""
        rank, leaves = [0] * len(self.s), 0
        stack = [(0, 0)]
        while stack:
            v, depth = stack.pop()
            below = self.children[v]
            if below is None:
                rank[self.start[v] - depth] = leaves
                leaves += 1
                continue
            depth += self.end[v] - self.start[v]
            # taken from the end of the stack: the stop (-1), then descending words
            stack += [(below[c], depth if below[c] else 0) for c in sorted(below) if c >= 0]
            if -1 in below:
                stack.append((below[-1], depth))
        return np.array(rank, np.int64)


class RangeMinimum:
    """Minima of ranges of an array in constant time: within blocks by prefix and suffix, over blocks by doubling."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.values = np.full(blocks * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        self.values[:len(values)] = values
        square = self.values.reshape(blocks, BLOCK)
        self.prefix = np.minimum.accumulate(square, axis=1).ravel()
        self.suffix = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [square.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum from a to b, both included, a <= b."""
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.suffix[a], self.prefix[b])
        same = np.flatnonzero(first == last)
        if len(same):
            at = a[same, None] + np.arange(BLOCK)
            inside = at <= b[same, None]
            out[same] = np.where(inside, self.values[np.where(inside, at, 0)], np.iinfo(out.dtype).max).min(axis=1)
        between = last - first - 1
        for k, level in enumerate(self.levels):
            use = np.flatnonzero((between >= 1 << k) & (between < 2 << k))
            if len(use):
                out[use] = np.minimum(out[use], np.minimum(level[first[use] + 1], level[last[use] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of a sequence's positions, from its suffix tree."""

    def __init__(self, tree: SuffixTree):
        depths, self.place, self.rank = tree.tour()
        self.minima = RangeMinimum(depths)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols are equal from positions i and j on (i != j)."""
        a, b = self.place[i], self.place[j]
        return self.minima.least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word at each position ends: at the next smaller suffix."""
    order, stack = rank.tolist(), [len(rank) - 1]
    out = np.empty(len(rank) - 1, np.int64)
    for i in range(len(rank) - 2, -1, -1):
        while order[stack[-1]] > order[i]:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


def runs_of(codes: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Runs (start, length, period) of a sequence with length >= max(least_length, least_exponent * period)."""
    n = len(codes)
    forward = codes.tolist()
    tree = SuffixTree(forward)
    right = Extensions(tree)
    ends = [lyndon_ends(right.rank), lyndon_ends(tree.opposite_rank())]
    del tree
    at = np.tile(np.arange(n), 2)
    period = np.concatenate(ends) - at
    onward = right.common(at, at + period)
    del right
    # what reaches the least length at all also does so with what stands before
    possible = at + period + onward >= np.maximum(least_length, least_exponent * period)
    at, period, onward = at[possible], period[possible], onward[possible]
    backward = Extensions(SuffixTree(forward[::-1])).common(n - at, n - at - period)
    length = backward + period + onward
    found = np.stack([at - backward, length, period], axis=1)
    found = found[length >= np.maximum(least_length, least_exponent * period)]
    return np.unique(found, axis=0) if len(found) else found


def stretches(codes: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Stretches (from, to) outside of which no run lies.  A run of exponent e and period q >= 2 holds e*q - 2 triples
    of q kinds, that of a single word at least ``least_length`` - 2 of one kind."""
    n, times = len(codes), min(least_exponent - 1, least_length - 2)
    if n < max(least_length, 3) or times < 2:
        return [(0, n)] if n >= 2 else []
    stretch = np.zeros(n, np.int64)  # 0: set apart, else the number of the stretch
    stretch[:] = 1
    _, triple = np.unique(codes[:-1] * (codes.max() + 1) + codes[1:], return_inverse=True)
    triple = triple[:-1] * (codes.max() + 1) + codes[2:]
    for _ in range(PASSES):
        whole = np.flatnonzero((stretch[:-2] == stretch[2:]) & (stretch[1:-1] == stretch[2:]) & (stretch[2:] > 0))
        key, inside = triple[whole], stretch[whole]
        order = np.lexsort((key, inside))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(inside[order]) != 0)
        group = np.cumsum(new) - 1
        often = np.bincount(group, minlength=1)[group] >= times if len(group) else np.zeros(0, bool)
        hits = whole[order[often]]
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[hits + k] = True
        edges = np.flatnonzero(np.diff(covered, prepend=False, append=False)).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= least_length]
        before = np.count_nonzero(stretch)
        stretch[:] = 0
        for number, (a, b) in enumerate(edges.tolist(), 1):
            stretch[a:b] = number
        if np.count_nonzero(stretch) == before:
            break
    return [(a, b) for a, b in edges.tolist()]


def document_runs(tokens: list[bytes], least_length: int = 6, least_exponent: int = 4) -> np.ndarray:
    """Runs (start, length, period) of a list of words by start, then period."""
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, len(tokens))
    found = [runs_of(np.unique(codes[a:b], return_inverse=True)[1], least_length, least_exponent) + [a, 0, 0]
             for a, b in stretches(codes, least_length, least_exponent)]
    out = np.concatenate([np.zeros((0, 3), np.int64), *found])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(tokens: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that lie in a run after its first period."""
    if not len(runs):
        return b" ".join(tokens)
    step = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([tokens[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def word_runs(text: Column, least_length: int = 6, least_exponent: int = 4) -> Column:
    """A struct of ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` (text)."""
    if least_exponent < 2:
        raise ValueError("a run repeats its period at least once")

    @F.arrow_udf("struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, "
                 "collapsed: string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, runs, short = [], [np.zeros((0, 3), np.int64)], []
            for t in batch:
                tokens = words(t.as_py())
                runs.append(document_runs(tokens, least_length, least_exponent))
                counts.append(len(tokens))
                short.append(collapsed(tokens, runs[-1]).decode())
            offsets = np.cumsum([len(r) for r in runs])
            flat = np.concatenate(runs)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows),
                 pa.array(short, pa.string())], ["n_words", "runs", "collapsed"])

    return found(text)


def periodic_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4, text_col: str = "text",
                  out: str = "periodic") -> DataFrame:
    """``docs`` with the struct column ``out`` (a column of that name is replaced): the number of words, the runs of
    at least ``least_length`` words and ``least_exponent`` periods, and the text without the words that repeat a run's
    first period, joined by single spaces.

    A null or empty text has no words, no run and an empty collapsed text.  Each row is treated for itself: repeated
    rows get equal results, an empty table gives an empty one.  A task holds one text's words and the trees of its
    longest repetitive stretch (about half a kilobyte a word).
    """
    return docs.withColumn(out, word_runs(F.col(text_col), least_length, least_exponent))
