import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagemill.llm import bpe

from .cases import empty, odd

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(PATH, PATTERN)


@pytest.fixture(scope="module")
def truth(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_hard_texts_as_the_library(ranks, truth):
    r = random.Random(1)
    alphabet = "     　​\x1d ab 中文é\n\t\r\x1c\x85\xa0  's'll12３½!?*“🙂 ́'"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5000, "ab" * 3000 + " x", "中" * 900, "  \n\n  a  ", "", "the" * 400, "!" * 700, "<|endoftext|>"]
    for t, ids in zip(texts, bpe.encode_texts(ranks, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == truth.encode_ordinary(t)


def test_batch_and_long_trees_agree(ranks):
    r = random.Random(2)
    pieces = ["".join(r.choices("theraionsd", k=r.randint(2, 60))).encode() for _ in range(300)]
    pieces = [p for p in set(pieces) if p not in ranks.rank]
    assert all(bpe.merge_pieces(ranks, [p])[p] == bpe.merge_long(ranks, p) for p in pieces)


def test_memory_of_chunks_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "SLICE", 100)
    texts = [f"alpha{i} beta{i % 7} gamma" for i in range(200)]
    fresh = bpe.Ranks(PATH, PATTERN)
    assert bpe.encode_texts(fresh, texts) == bpe.encode_texts(ranks, texts)


def test_digests_and_round_trip(spark, truth):
    docs = odd(spark)
    rows = bpe.digests(docs, PATH, PATTERN).collect()
    assert len(rows) == docs.count()
    want = sorted((str(d.doc_id), hashlib.sha256((d.text or "").encode()).hexdigest(), len(truth.encode_ordinary(d.text or ""))) for d in docs.collect())
    assert sorted((str(r.doc_id), r.decoded_sha256, r.n_tokens) for r in rows) == want
    ids = {r.doc_id: r.ids_sha256 for r in rows}
    one = next(d.text for d in docs.collect() if d.doc_id == 11)
    assert ids[11] == hashlib.sha256(np.array(truth.encode_ordinary(one), "<u4").tobytes()).hexdigest()
    assert bpe.digests(empty(spark), PATH, PATTERN).collect() == []
