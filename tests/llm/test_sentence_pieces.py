import hashlib
import random
import struct

import pytest
import sentencepiece

from tallyspark.llm import sentence_pieces
from tallyspark.llm.queries import PIECE_BPE, op13_sentence_pieces, tokenizer
from tallyspark.llm.sentence_pieces import Pieces, piece_documents


@pytest.fixture(scope="module")
def model():
    with open(tokenizer(PIECE_BPE), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def random_texts(seed: int) -> list[str]:
    r = random.Random(seed)
    alphabets = ["ab ", "the aeiou nrst'\n ", "aAéß ñ中文\U0001f600\t  x0123456789▁ ", "".join(map(chr, range(700))),
                 " ▁a"]
    texts = ["".join(r.choices(r.choice(alphabets), k=r.randint(0, 90))) for _ in range(3000)]
    return texts + ["", " ", "  ", "<s></s><unk><0x41>", " ⁇ ", "a" * 20_001, "▁" * 33, "中" * 999, "=" * 500]


@pytest.mark.parametrize("short", [0, 24])
def test_random_texts_as_the_library(model, library, short, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "SHORT", short)
    pieces = Pieces.load(model)
    texts = random_texts(1)
    ids = library.encode(texts)
    assert pieces.encode(library.normalize(texts)) == ids
    assert [pieces.decode(i) for i in ids] == library.decode(ids)
    assert all(len(p) <= sentence_pieces.KEPT_LENGTH for p in pieces.known)


def test_decoding_any_ids_as_the_library(model, library):
    r, pieces = random.Random(2), Pieces.load(model)
    pool = [0, 1, 2, 259, 260, *range(3, 400)]
    for _ in range(5000):
        ids = r.choices(pool, k=r.randint(0, 12))
        assert pieces.decode(ids) == library.decode(ids)


def other_model(model: bytes, change) -> bytes:
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    change(spec)
    return spec.SerializeToString()


def no_bytes(spec):
    spec.trainer_spec.byte_fallback = False
    del spec.pieces[3:259]


def user_defined(spec):
    spec.pieces.add(piece="llozz", score=0, type=4)
    spec.pieces.add(piece="hello▁w", score=0, type=4)


def crossing(spec):
    spec.pieces.add(piece="s▁t", score=50, type=1)
    spec.pieces.add(piece="▁a▁", score=60, type=1)


def equal_scores(spec):
    for p in spec.pieces:
        if p.type == 1 and len(p.piece) > 1:
            p.score = -(-p.score // 1000)


def other_normalizer(spec):
    spec.normalizer_spec.remove_extra_whitespaces = True
    spec.normalizer_spec.add_dummy_prefix = False


@pytest.mark.parametrize("change", [no_bytes, user_defined, crossing, equal_scores])
def test_other_vocabularies_as_the_library(model, change):
    changed = other_model(model, change)
    pieces, library = Pieces.load(changed), sentencepiece.SentencePieceProcessor(model_proto=changed)
    for t in [*random_texts(3)[:800], "hello world llozzs", "this at a time", "yes to a b a c"]:
        assert pieces.encode([library.normalize(t)]) == [library.encode(t)], t


def test_encoding_under_another_normalizer(model):
    changed = other_model(model, other_normalizer)
    pieces, library = Pieces.load(changed), sentencepiece.SentencePieceProcessor(model_proto=changed)
    texts = random_texts(4)[:800]
    assert pieces.encode(library.normalize(texts)) == library.encode(texts)


def test_unigram_models_are_refused(model):
    def unigram(spec):
        spec.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        Pieces.load(other_model(model, unigram))


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_query_as_the_library(request, spark, library, which, tmp_path):
    docs = request.getfixturevalue(which)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    null = lambda r: (r[0] is None, r)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        expected.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    assert sorted(map(tuple, op13_sentence_pieces(spark, str(tmp_path)).collect()), key=null) == \
        sorted(expected, key=null)


def test_arrays_clashing_names_and_empty(docs, empty, library):
    got = piece_documents(docs, tokenizer(PIECE_BPE), out="quality")
    assert sorted(got.columns) == sorted(docs.columns)
    assert all(r.quality.ids == library.encode(r.text or "", add_bos=True, add_eos=True) and r.quality.agrees
               for r in got.collect())
    assert piece_documents(empty, tokenizer(PIECE_BPE)).collect() == []
