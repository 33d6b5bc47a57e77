import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import lm

from .cases import empty, odd


def small():
    model = lm.Model([b"w%d" % i for i in range(70)], 10, {b"w%d" % i: 100 - i for i in range(70)}, 5000, 400)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    return model


def test_gradients():
    model, g = small(), np.random.default_rng(0)
    aim, before, fresh = g.integers(0, 72, (8, 5)), g.integers(0, 73, (8, 5)), np.zeros((8, 5), bool)
    fresh[3, 2] = True
    h = g.standard_normal((lm.H, 5)) * 0.1
    found, _, _ = model.gradients(before, aim, h, fresh)
    for k, v in found.items():
        for i in np.argsort(-np.abs(v).reshape(-1))[:3]:
            at = np.unravel_index(i, v.shape)
            old, loss = model.p[k][at], []
            for d in (1e-4, -1e-4):
                model.p[k][at] = old + d
                loss.append(model.gradients(before, aim, h, fresh)[2])
            model.p[k][at] = old
            assert v[at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=1e-3, abs=1e-7)


def test_chances_sum_to_one():
    model = small()
    hs = np.random.default_rng(1).standard_normal((lm.H, 1))
    every = np.arange(model.own + 2)
    own = np.exp(model.output(np.repeat(hs, len(every), 1), every))
    assert own.sum() == pytest.approx(1)


def test_state_runs_through_a_document(monkeypatch):
    model, g = small(), np.random.default_rng(2)
    texts = [np.append(g.integers(1, 72, n), 0).astype(np.int32) for n in (0, 1, 40, 200, 3)]

    def alone(t):
        h, before, total = np.zeros((lm.H, 1)), model.start, 0.0
        for x in t:
            h, _ = model.step(model.p["e"][:, [before]], h)
            total += model.output(h, np.array([x]))[0]
            before = x
        return total

    want = [alone(t) for t in texts]
    assert model.score(texts).tolist() == pytest.approx(want, rel=1e-5)
    monkeypatch.setattr(lm, "CHUNK", 7)
    assert model.score(texts).tolist() == pytest.approx(want, rel=1e-5)


def base_of(docs):
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0
    toks = [(d.doc_id, held(d.doc_id), lm.tokens((d.text or "").encode())) for d in docs]
    c = Counter(w for _, h, ws in toks if not h for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    score = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])
    return sorted(((str(k), h, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, score(ws)) for k, h, ws in toks), key=str)


@pytest.mark.parametrize("hot", [100_000, 40])
def test_base_scores(spark, sf, monkeypatch, hot):
    """Words beyond the frequent ones get their counts by the join."""
    monkeypatch.setattr(lm, "HOT", hot)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(odd(spark).select("doc_id", "text"))
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.digests(docs).collect()), key=str)
    want = base_of(docs.collect())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], rel=1e-9)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = lm.digests(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in rows)


def test_long_words_and_texts(spark):
    """A word of 100 bytes in every document is a frequent one; a text of over a megabyte is split at blanks."""
    long = "u" * 100
    texts = [f"{long} some words {i} {long}" for i in range(60)] + ["word other " * 120_000 + long, "v" * 3_000_000 + " " + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.digests(docs).collect())
    want = base_of(docs.collect())
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], rel=1e-9)
    found = lm.counts(docs.selectExpr("doc_id k", "text t", "doc_id % 2 = 0 learn")).where("octet_length(word) = 33").collect()
    assert max(r["every"] for r in found) == 122 and max(len(r["word"]) for r in found) <= lm.LONG


def test_every_row_is_learned_from(spark, monkeypatch):
    """What only a few rows beyond the start's sample say is learned; the average weighs tasks by tokens."""
    model = small()
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    rows = spark.createDataFrame([(i, "w1 w2 w3 w4 " * 300) for i in range(40)], "k long, t string").repartition(3)
    text = model.text(b"w1 w2 w3 w4 " * 20)
    before = model.score([text])[0]
    lm.taught(model, rows, "k", "t", rate=0.02)
    assert model.score([text])[0] > 0.7 * before
    monkeypatch.setattr(lm, "ROUNDS", 1)
    both = [("w5 w6 " * 400), ("w7 w8 w9 " * 900)]
    uneven = spark.createDataFrame(list(enumerate(both)), "k long, t string").repartitionByRange(2, "k")
    start, want, n = model.flat(), 0, 0
    for t in both:
        model.unflat(start)
        text = model.text(t.encode())
        model.fit([text], lm.STREAMS, 0.01, 1.0)
        model.settled()
        want, n = want + model.flat().astype(float) * len(text), n + len(text)
    model.unflat(start)
    lm.taught(model, uneven, "k", "t", rate=0.01)
    assert model.flat() == pytest.approx(want / n, rel=1e-3, abs=1e-5)


def test_nothing_to_learn_from(spark):
    assert lm.digests(empty(spark)).collect() == []
    only = spark.createDataFrame([(k, "a b a") for k in range(2000) if zlib.crc32(str(k).encode()) % 10 == 0][:3], "doc_id long, text string")
    rows = lm.digests(only).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 4 and r.base_score == pytest.approx(0) and math.isfinite(r.score) for r in rows)


def test_training_looks_words_up_among_the_networks_own():
    long = b"x" * 100
    hot = {b"a": 50, lm.name_of(long): 40, b"b": 30, b"rare": 1}
    m = lm.Model([b"a", lm.name_of(long), b"b"], 5, hot, 130, 6)
    text = b"a rare b " + long + b" unseen " + b"y" * 90
    want = [*m.typed(m.numbers(lm.tokens(text))).tolist(), 0]
    assert want == [1, 4, 3, 2, 4, 4, 0]
    m.hot = {}
    assert m.text(text).tolist() == want
