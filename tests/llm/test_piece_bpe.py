import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from caseweave.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Codec(piece_bpe.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encodes_and_decodes_as_the_library(codec, library):
    draw = random.Random(3)
    odd = [" ", "  ", "\n", "\t", "a", "th", "é", "ß", "中", "国", "𝔘", "▁", "\u0301", ".", "();", "0x", "12", "\x00", "the", "ing", "</s>", "<0x0A>", "и", "\r\n", " " * 12, "..."]
    pieces = list(codec.model.pieces)
    texts = ["".join(draw.choice(odd) for _ in range(draw.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 10))) for _ in range(2000)]
    texts += ["", " ", "a" * 3000, " " * 3000, "=-" * 500]
    for text in texts:
        want = library.encode(text, add_eos=True)
        assert codec.encode(text).tolist() == want
        assert codec.decode(np.array(want, "<i4")) == library.decode(want)


def test_decodes_any_ids_as_the_library(codec, library):
    draw = random.Random(4)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(5)]) for _ in range(draw.randint(0, 12))]
        assert codec.decode(np.array(ids, "<i4")) == library.decode(ids)


def test_backtracking_equals_plain_merging(codec):
    draw = random.Random(5)
    for _ in range(2000):
        part = "".join(draw.choice("▁abcdehinorst.()=") for _ in range(draw.randint(1, 25)))
        assert codec.tokens(part) == codec.merge(part)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_PARTS", 3)
    codec = piece_bpe.Codec(piece_bpe.read_model(PATH))
    text = "the cat and the other cat sat on the mat"
    assert codec.encode(text).tolist() == codec.encode(text).tolist() == library.encode(text, add_eos=True)


def test_rows(spark, docs_of, odd_rows, library):
    rows = piece_bpe.digests(docs_of(odd_rows), PATH).collect()
    assert len(rows) == len(odd_rows)
    want = []
    for doc_id, text in odd_rows:
        ids = library.encode(text or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert piece_bpe.digests(docs_of([]), PATH).count() == 0


def test_ids_and_texts_round_trip(spark, docs_of, odd_rows):
    tokens = piece_bpe.encode(docs_of(odd_rows), PATH, keep=("key",))
    assert tokens.columns == ["doc_id", "key", "token_ids"]
    texts = sorted(r.decoded for r in piece_bpe.decode(tokens, PATH).collect())
    assert texts == sorted(t or "" for _, t in odd_rows)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(PATH, "rb") as file:
        proto = pb.ModelProto.FromString(file.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.read_model(str(tmp_path / "m"))
