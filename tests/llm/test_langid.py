import numpy as np

from pagemill.llm import langid
from pagemill.llm.scratch import remainder

from .cases import empty, odd


def test_n_grams_by_hand():
    words = ["né".encode(), b"a", "中文字x".encode()]
    f, at = langid.features(words)

    def grams(w):
        s = f" {w.decode()} "
        return sum(1 for n in langid.N_GRAMS for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1] and (n > 1 or s[i] != " "))

    assert np.diff(at).tolist() == [grams(w) for w in words]
    alone, _ = langid.features([words[2]])
    assert sorted(alone.tolist()) == sorted(f[at[2] : at[3]].tolist())


def test_training_step_against_the_closed_form():
    fit = langid.Ftrl(3)
    at, x = np.array([4, 9]), np.array([1.5, -2.0])
    fit.step(at, x, 1)
    g = x[:, None] * (np.full(3, 1 / 3) - np.eye(3)[1])
    assert np.allclose(fit.z[at], g) and np.allclose(fit.n[at], g * g)
    z, n = fit.z[at], fit.n[at]
    want = np.where(np.abs(z) <= fit.l1, 0, -(z - np.sign(z) * fit.l1) / ((fit.beta + np.sqrt(n)) / fit.alpha + fit.l2))
    assert np.allclose(fit.weights(at), want)
    assert (langid.Ftrl(3).weights() == 0).all()


def test_document_frequencies_are_of_all_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    df, n = langid.document_frequency(docs, "text")
    want = np.zeros(1 << langid.BITS, int)
    for r in docs.collect():
        if ws := langid.words_of(r.text):
            want[np.unique(langid.features(ws)[0])] += 1
    assert n == 60 and (df == want).all()


def test_scores_don_t_depend_on_memory(spark, sf, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()] + [None, ""]
    g = np.random.default_rng(0)
    model = langid.Model(["a", "b"], g.standard_normal((1 << langid.BITS, 2)), 1.0)
    want = model.scores(model.lexicon(), texts)
    monkeypatch.setattr(langid, "KEPT", 100)
    monkeypatch.setattr(langid, "slices", lambda t, c=0: (slice(i, i + 1) for i in range(len(t))))
    assert np.allclose(model.scores(model.lexicon(), texts), want, atol=1e-5)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000000", "text", "lang", "source", "n_chars"))
    got = langid.digests(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 300 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    docs = odd(spark)
    got = langid.digests(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == docs.count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 8))
    assert {r.lang_pred for r in rows.values()} <= {"en", "fr", "und"}
    held = {r.doc_id: r.h for r in docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("h")).collect()}
    assert all(rows[k].held_out == h for k, h in held.items())
    assert langid.digests(empty(spark)).collect() == []
    blind = langid.digests(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()
    assert all(r.lang_pred == "und" for r in blind)


def test_equal_probabilities_give_the_first_class(spark):
    model = langid.Model(["aa", "bb"], np.zeros((1 << langid.BITS, 2)), 1.0)
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()] == [("aa", 0.5)]
