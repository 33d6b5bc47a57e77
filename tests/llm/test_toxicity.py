import numpy as np
import pytest

from pagemill.llm import toxicity

from .cases import EN, FR, empty, odd


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200, 1001):
        w = toxicity.cut(np.arange(n, dtype=np.int32))
        assert set(w.reshape(-1).tolist()) - {-1} == set(range(n))
        assert (w[:, 0] == np.arange(len(w)) * toxicity.STRIDE).all() and w.shape[1] == toxicity.WINDOW
        assert len(w) == (0 if not n else 1 + max(0, -(-(n - 32) // toxicity.STRIDE)))


def test_gradients():
    net = toxicity.Network({b"a": 1, b"bb": 2, b"c": 3}, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, y = [[b"a", b"bb", b"zzz"] * 15, [b"c"] * 5], np.array([1.0, 0.0])

    def loss():
        lexicon, total = net.lexicon(), 0.0
        for ws, label in zip(texts, y, strict=True):
            w = toxicity.cut(lexicon.numbers([ws])[0]).T
            z = net.run(lexicon.rows[np.maximum(w, 0)].astype(np.float64), (w >= 0)[:, :, None])
            d = np.log(np.exp(z).sum())
            total += np.log1p(np.exp(-d if label else d))
        return total / len(texts)

    for k, v in net.gradients(texts, y).items():
        at = np.unravel_index(np.argmax(np.abs(v)), v.shape)
        old, both = net.p[k][at], []
        for d in (1e-3, -1e-3):
            net.p[k][at] = old + d
            both.append(loss())
        net.p[k][at] = old
        assert v[at] == pytest.approx((both[0] - both[1]) / 2e-3, rel=2e-3, abs=1e-5)


def test_text_score_is_that_of_its_highest_window():
    net = toxicity.Network({b"cat": 1}, 2)
    words = (EN + " " + FR).split() * 12
    text = " ".join(words)
    one = [" ".join(words[i : i + 32]) for i in range(0, len(words), toxicity.STRIDE)]
    whole = net.logits(net.lexicon(), [text])[0]
    starts = range(0, toxicity.STRIDE * len(toxicity.cut(np.zeros(len(words), np.int32))), toxicity.STRIDE)
    assert whole == pytest.approx(max(net.logits(net.lexicon(), [" ".join(words[i : i + 32]) for i in starts])), rel=1e-4)
    assert len(one) >= len(starts)


def planted(spark, bad="snorgle", n=400):
    g = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "tkpmn" for b in ("ar", "el", "ino", "us") for c in ("a", "et", "is", "on", "")]
    texts, toxic = [], []
    for i in range(n):
        ws = list(g.choice(words, g.integers(20, 150)))
        if i % 4 == 0:
            for k in g.integers(0, len(ws), 3):
                ws[k] = bad
        texts.append(" ".join(ws))
        toxic.append(int(i % 4 == 0))
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = planted(spark)
    rows = toxicity.digests(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    long = " ".join(["tara"] * 5000)
    net = toxicity.learned(docs, labels)
    out = {r.row.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, long), (2, long + " snorgle snorgle " + long)], "doc_id long, text string"), net).collect()}
    assert out[1] < 0.5 < out[2]


def test_odd_rows(spark):
    _, labels = planted(spark, n=300)
    docs = odd(spark)
    rows = toxicity.digests(docs, labels.union(labels.selectExpr("doc_id", "quality", "cast(null as int)"))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    wordless = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(wordless) == 1 and wordless.pop() < 0.5
    assert toxicity.digests(empty(spark), labels).collect() == []
    assert all(r.score == 0 for r in toxicity.digests(docs, labels.limit(0)).collect())


def test_slices_of_a_batch_add_up(monkeypatch):
    net = toxicity.Network({b"a": 1, b"bb": 2}, 1)
    texts, y = [[b"a", b"bb", b"zzz"] * 200, [b"c"] * 5, [b"bb"] * 90], np.array([1.0, 0.0, 1.0])
    whole = net.gradients(texts, y)
    monkeypatch.setattr(toxicity, "SLICE", 3)
    for k, v in net.gradients(texts, y).items():
        assert v == pytest.approx(whole[k], rel=1e-3, abs=1e-6)


def test_a_passage_across_window_edges(spark):
    """Wherever a toxic passage of up to 17 words begins, a window has it whole."""
    for n in (1, 9, 17):
        for at in range(100):
            assert any(set(range(at, at + n)) <= set(w.tolist()) for w in toxicity.cut(np.arange(300, dtype=np.int32)))


@pytest.mark.parametrize(("table", "recall", "precision"), [("sf0.01", 0.5, 0.5), ("sf0.1", 0.8, 0.85)])
def test_held_out_rows_of_the_tables(spark, table, recall, precision):
    sf = f"/root/testdata/{table}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.digests(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted and r.toxic for r in rows)
    assert right >= recall * sum(r.toxic for r in rows)
    assert right >= precision * sum(r.predicted for r in rows)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    from pagemill.llm import sample

    docs, labels = planted(spark)
    marks = labels.select("doc_id", "toxic")
    every, counts = sample.of_keys(docs, marks, "toxic", "doc_id", "text", {0: 100, 1: 100}, 10**9)
    few, same = sample.of_keys(docs, marks, "toxic", "doc_id", "text", {0: 100, 1: 100}, 20_000)
    assert counts == same == {0: 300, 1: 100} and len(every) == 200
    for c in (0, 1):
        assert 5_000 < sum(len(t) for k, t in few if k == c) <= 10_000
    texts = {r.text for r in docs.collect()}
    assert all(t in texts for _, t in few)
    rows = docs.join(labels, "doc_id")
    by = sample.by_class(rows, "toxic", "doc_id", "text", 100, 20_000)
    assert all(5_000 < sum(len(t) for k, t in by if k == c) <= 10_000 for c in (0, 1)) and all(t in texts for _, t in by)
