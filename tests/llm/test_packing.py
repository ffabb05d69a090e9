import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyspark.llm.packing import Bins, WordIds, pack, pack_documents
from tallyspark.llm.queries import WORD_BPE, tokenizer


def test_first_fit_against_a_scan():
    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = sorted(r.integers(1, 50, 40).tolist(), reverse=True)
        bins, free = Bins(50, len(sizes)), []
        for s in sizes:
            at = next((i for i, f in enumerate(free) if f >= s), len(free))
            if at == len(free):
                free.append(50)
            free[at] -= s
            assert bins.first_fit(s) == at


def test_pack_covers_and_fills():
    r = np.random.default_rng(1)
    for _ in range(40):
        lengths = r.integers(0, 300, r.integers(1, 60)).tolist()
        covered, bins = {i: [] for i in range(len(lengths))}, {}
        for doc, start, n, seq, off in pack(lengths, 64):
            assert n > 0
            covered[doc] += range(start, start + n)
            bins.setdefault(seq, []).append((off, n))
        assert all(sorted(covered[i]) == list(range(n)) for i, n in enumerate(lengths))
        for pieces in bins.values():
            at = 0
            for off, n in sorted(pieces):
                assert off == at
                at += n
            assert at <= 64
        assert sum(sum(n for _, n in p) < 64 for p in bins.values()) <= 1


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_pieces_hold_the_tokenizers_ids(request, which):
    docs = request.getfixturevalue(which)
    t = Tokenizer.from_file(tokenizer(WORD_BPE))
    expected = sorted((-1 if r.doc_id is None else r.doc_id,
                       np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
                      for r in docs.select("doc_id", "text").collect())
    rows = pack_documents(docs, tokenizer(WORD_BPE), group_tokens=20_000, with_ids=True).collect()
    total = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 4096
    # pieces of repeated ids can't be told apart; compare the others exactly
    ids = [x[0] for x in expected]
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        got.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
    for key, value in expected:
        if ids.count(key) == 1:
            assert b"".join(r.ids for r in got[key]) == value
            assert {r.doc_tokens for r in got[key]} == {len(value) // 4}
    assert sum(len(v) for _, v in expected) == sum(len(r.ids) for r in rows)


def test_ids_of_random_texts():
    t, r = Tokenizer.from_file(tokenizer(WORD_BPE)), np.random.default_rng(5)
    coder = WordIds(open(tokenizer(WORD_BPE), encoding="utf-8").read())
    alphabets = ["aAbB'st rell dvm09.,#", "aÀÉßöøÿ÷×¿¡«»–—‘’“”…€ 'S.8\n\t", "".join(map(chr, [*range(32, 127), *range(192, 256)])), "".join(map(chr, range(0, 400))), "eE\u0301 \u03a3\u03c3\u0130ſ\u212a \u00a0\u3000中<|>\x01", "<|endoftext|> "]
    texts = ["".join(r.choice(list(a), r.integers(0, 200))) for a in alphabets for _ in range(60)]
    texts += ["<|ENDOFTEXT|> <|endoftext|>x", "a\x01b \x01 c", "It'S 'RE ''s don't"]
    for got, text in zip(coder.encode(texts, 2), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [2]


def test_empty(empty):
    assert pack_documents(empty, tokenizer(WORD_BPE)).collect() == []
