import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from tallyspark.llm.suffix_tree import Settings, suffix_tree_scores
from tallyspark.session import FREE_SHUFFLES, ensure_checkpoint_dir


def split(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


class Plain:
    """The same model with dictionaries, a symbol at a time."""

    def __init__(self, texts, s):
        self.s, self.c = s, Counter(w for t in texts for w in t)
        self.n, once = sum(self.c.values()), sum(v == 1 for v in self.c.values())
        self.u = (once + 0.5) / (self.n + once + 1)
        pair = max(s.least_count, math.ceil(s.least_pair * self.n))
        context = max(pair, math.ceil(s.least_context * self.n))
        self.size, self.next, self.states = {}, {}, set()
        for d in range(1, s.depth + 1):
            got = defaultdict(Counter)
            for t in texts:
                h = ["\n", *t]
                for i in range(d, len(h)):
                    got[tuple(h[i - d:i])][h[i]] += 1
            for c, n in got.items():
                if all(self.c[w] >= s.least_count for w in c):
                    self.size[c] = sum(n.values())
                    least = pair if self.size[c] >= context else s.least_count
                    self.next[c] = {w: v for w, v in n.items() if v >= least}
        trunk = {c for c, v in self.size.items() if v >= context}
        for c in sorted(self.next, key=len):
            own, low = {w: self.p(c, w) for w in self.next[c]}, {w: self.p(c[1:], w) for w in self.next[c]}
            kl = sum(own[w] * math.log(own[w] / low[w]) for w in own)
            kl += self.rest(c) * max(0, 1 - sum(low.values())) * math.log(self.rest(c))
            if own and self.size[c] * kl > 0.5 * len(own) * math.log(max(2, self.n)):
                self.states.add(c)
        for c in list(self.states):  # suffixes in the same half of the tree
            self.states.update(c[i:] for i in range(len(c)) if (c[i:] in trunk) == (c in trunk))

    def rest(self, c):
        return max(1e-12, 1 - sum(v - self.s.discount for v in self.next[c].values()) / self.size[c])

    def p(self, c, w):
        if not c:
            return (1 - self.u) * self.c[w] / self.n if self.c[w] else self.u
        gain = (self.next[c][w] - self.s.discount) / self.size[c] if w in self.next[c] else 0
        return gain + self.rest(c) * self.p(c[1:], w)

    def kept(self, c, w):
        """Through the states alone."""
        if not c:
            return self.p(c, w)
        lower = self.kept(c[1:], w)
        if c not in self.states:
            return lower
        return (self.next[c][w] - self.s.discount if w in self.next[c] else 0) / self.size[c] + self.rest(c) * lower

    def score(self, t):
        h, total = ["\n", *t], 0
        for i in range(1, len(h)):
            total += math.log10(self.kept(tuple(h[max(0, i - self.s.depth):i]), h[i]))
        return total


@pytest.mark.parametrize("which", ["docs", "documents"])
@pytest.mark.parametrize("share", [1e-4, 3e-3, 1.0])
def test_scores_against_a_plain_model(request, which, share):
    """The tree as trunk, as both, and as branches alone."""
    docs = request.getfixturevalue(which)
    s = Settings(least_context=share, least_pair=share / 2, least_count=2, chunk_bytes=30_000, buckets=3, part_tokens=20_000)
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = [split(r.text) + ["\n"] for r in rows if not held(r.doc_id)]
    plain = Plain(train, s)
    v = len(plain.c)
    expected = []
    for r in rows:
        t = split(r.text) + ["\n"]
        expected.append((-1 if r.doc_id is None else r.doc_id, held(r.doc_id), len(t), sum(plain.c[w] > 0 for w in t),
                         plain.n, sum(math.log10((plain.c[w] + 1) / (plain.n + v + 1)) for w in t), plain.score(t)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in suffix_tree_scores(docs, s=s).collect())
    assert len(got) == len(rows)
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6), a


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = suffix_tree_scores(docs).where("held_out").selectExpr("sum(base_score) b", "sum(score) s", "max(score) m").first()
    assert r.b < r.s < 0 and r.m < 0


def test_empty_and_all_held_out(spark, empty):
    assert suffix_tree_scores(empty).collect() == []
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = suffix_tree_scores(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)


def test_copies_are_learned_alike_at_every_size(spark):
    """A passage of 60 words copied ten times, in little and in much other text."""
    found = []
    for n in (1_000, 5_000):
        r = random.Random(n)
        word = lambda: f"w{r.randrange(20_000)}"
        passage = " ".join(f"w{random.Random(k).randrange(20_000)}" for k in range(60))
        rows = [(i, " ".join(word() for _ in range(300))) for i in range(n)]
        train = [i for i in range(n) if zlib.crc32(str(i).encode()) % 7 != 2][:10]
        held = next(i for i in range(n) if zlib.crc32(str(i).encode()) % 7 == 2)
        rows = [(i, t + " " + passage if i in train else passage if i == held else t) for i, t in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found.append(suffix_tree_scores(docs).where(f"doc_id = {held}").first())
    small, large = found
    assert large.train_tokens > 1_200_000 and small.base_score < -200
    assert small.score > -20 and large.score > -20


def test_only_what_is_read_again_stays_on_disk(spark, documents):
    """Of the work tables the coded texts and the branches' answers stay, and no exchange before them."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_\d+_\d+_0\.data", disk.getAllFiles().mkString("\n")))
    tables, files = set(os.listdir(folder)), shuffled()
    scores = suffix_tree_scores(documents)
    made = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - tables}
    assert made == {"suffix-coded", "suffix-branches"}
    for _ in range(40):
        if len(left := {x.split("_")[1] for x in shuffled() - files}) <= 3:  # of the totals, a row each
            break
        time.sleep(0.25)
    assert len(left) <= 3
    assert scores.count() == documents.count()
    assert spark.conf.get(FREE_SHUFFLES) == "false"


@pytest.mark.parametrize("share", [1e-3, 3e-3, 1.5e-2])
def test_light_pairs_of_the_trunk_are_stored(documents, share):
    """A frequent context stores every next symbol seen twice, whether the pair travels with the tasks or not."""
    s = Settings(least_context=share, held_pair=share, chunk_bytes=30_000, buckets=3, part_tokens=20_000)
    rows = documents.select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    plain = Plain([split(r.text) + ["\n"] for r in rows if not held[r.doc_id]], s)
    least = math.ceil(share * plain.n)
    assert sum(2 <= v < least <= plain.size[c] for c in plain.next for v in plain.next[c].values()) > 100
    expected = {r.doc_id: plain.score(split(r.text) + ["\n"]) for r in rows}
    got = {r.doc_id: r.score for r in suffix_tree_scores(documents, s=s).collect()}
    assert got == pytest.approx(expected, rel=1e-6)


def test_frequent_contexts_learn_rare_pairs_at_every_size(spark):
    """Among 2.6 million tokens, a frequent word with 1000 next words, four times each, which no share of the input decides."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(60_000)}"
    train = [i for i in range(9_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(9_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = {i: [word() for _ in range(300)] for i in range(9_000)}
    for k in range(4_000):
        rows[train[k]] += ["key", f"w{k % 1_000}"]
    rows[held] = [x for k in range(1_000) for x in (f"w{k + 30_000}", "key", f"w{k}")]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], "doc_id long, text string")
    found = suffix_tree_scores(docs).where(f"doc_id = {held}").first()
    assert found.train_tokens > 2_000_000
    # after the word each of the 1000 has 3.25 / 4000 and little more; by the words' own share about 1.6e-5
    assert found.score - found.base_score > 1_500
