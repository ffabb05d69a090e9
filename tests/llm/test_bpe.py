import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tallyspark.llm import bpe
from tallyspark.llm.bpe import Encoder, Merges, encode_documents
from tallyspark.llm.queries import BYTE_BPE, op5_bpe, tokenizer


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer(BYTE_BPE))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("many", [1, 48, 10 ** 9])
def test_random_texts_as_the_library(library, many, monkeypatch):
    monkeypatch.setattr(bpe, "MANY", many)
    r = random.Random(many)
    encoder = Encoder(Merges.load(open(tokenizer(BYTE_BPE), encoding="utf-8").read()))
    alphabets = ["ab ", "the aeiou nrst'\n", "aAéß ñ中文\U0001f600\t  x0123456789", "".join(map(chr, range(1, 700)))]
    texts = ["".join(r.choices(r.choice(alphabets), k=r.randint(0, 400))) for _ in range(150)]
    texts += ["a" * 3001, " " * 77, "<|endoftext|>", "x<|endoftext|> <|endoftext|><|endoftext", "it's we'LL 'd", "=" * 500]
    for i in range(0, len(texts), 40):
        got = encoder.encode(texts[i:i + 40])
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[i:i + 40]]


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_query_as_the_library(request, spark, library, which, tmp_path):
    docs = request.getfixturevalue(which)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    null = lambda r: (r[0] is None, r)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(",".join(map(str, ids))),
                         sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, op5_bpe(spark, str(tmp_path)).collect()), key=null) == sorted(expected, key=null)


def test_round_trip_and_empty(docs, empty):
    rows = encode_documents(docs, tokenizer(BYTE_BPE)).collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert encode_documents(empty, tokenizer(BYTE_BPE)).collect() == []
