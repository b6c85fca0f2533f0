import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from caseweave.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(ranks, reference):
    random.seed(5)
    texts = ["".join(random.choice("aab bé1!\x1c\x85 ²ʼ  \n\U0001F600ß日本語x") for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 500, "ab" * 2000, "", "don't we'll", "<|endoftext|>"]
    got = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN).encode_block(texts)
    assert got == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_irregular_ranks_follow_the_lowest_rank_first():
    """After ab, the pair (ab, a) has a lower rank than ab itself: order inside a piece matters."""
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"ab": 50, b"aba": 3, b"bb": 60, b"abb": 7, b"aa": 10}
    merges = byte_bpe.Merges(ranks)
    random.seed(1)
    pieces = [bytes(random.choice(b"ab") for _ in range(n)) for n in range(1, 14) for _ in range(40)]
    want = [[ranks[p]] if p in ranks else merges.merge_alone(p) for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.replay(pieces)] == want


def test_digests_and_round_trip(docs_of, odd_rows, reference):
    got = byte_bpe.digests(docs_of(odd_rows), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc, text in odd_rows:
        ids = reference.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_encode_keeps_columns_and_decode_inverts(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    ids = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, keep=("lang", "key"))
    assert ids.columns == ["doc_id", "lang", "key", "token_ids"]
    back = byte_bpe.decode(ids, PATH).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == sorted((str(d), t or "") for d, t in odd_rows)


def test_empty_table(docs_of):
    assert byte_bpe.digests(docs_of([]), PATH, public_tokenizers.PATTERN).collect() == []
