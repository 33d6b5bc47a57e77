import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import minhash

from .cases import empty, odd


def classes_by_force(docs, least=0.8):
    words = minhash.Words()
    sets = [minhash.shingles(words, (d.text or "").encode()) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (docs[i].text or "") == (docs[j].text or "") or minhash.similarity(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i].doc_id)
    least_of = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(d.doc_id), str(least_of[find(i)])) for i, d in enumerate(docs)), len(groups)


def agree(spark, docs):
    got = minhash.classes(docs).collect()
    want, n = classes_by_force(docs.collect())
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == want
    assert sum(r.kept for r in got) == n
    return n


def test_coordinates_agree_as_weighted_jaccard():
    g, words, off = np.random.default_rng(0), minhash.Words(), []
    for _ in range(60):
        a = [b"w%d" % x for x in g.integers(0, 10**6, g.integers(10, 400))]
        b = list(a)
        for i in g.integers(0, len(b), max(1, int(len(b) * g.uniform(0, 0.06)))):
            b[i] = b"z%d" % g.integers(10**9)
        if g.random() < 0.4:
            a, b = a * 5, b * g.integers(3, 6)
        x, y = minhash.shingles(words, b" ".join(a)), minhash.shingles(words, b" ".join(b))
        s = minhash.signatures([x, y])
        off.append((s[0] == s[1]).mean() - minhash.similarity(x, y))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def test_signatures_are_of_the_set_alone():
    words = minhash.Words()
    sets = [minhash.shingles(words, f"a b c d e {i} g h i j".encode()) for i in range(20)] + [minhash.shingles(words, b"")]
    every = minhash.signatures(sets)
    assert all((minhash.signatures([s])[0] == every[i]).all() for i, s in enumerate(sets))


def test_odd_rows(spark):
    assert agree(spark, odd(spark)) < odd(spark).count()
    assert minhash.classes(empty(spark)).collect() == []
    out = minhash.deduplicated(odd(spark))
    assert out.columns == odd(spark).columns
    assert out.count() == sum(r.kept for r in minhash.classes(odd(spark)).collect())


def test_table(spark, sf):
    agree(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def test_chains_and_a_large_group(spark, monkeypatch):
    """Neighbours in a chain are alike, its ends are not; a shared passage makes buckets of unlike texts."""
    monkeypatch.setattr(minhash, "WORDS", 900)
    monkeypatch.setattr(minhash, "WANTED", 5)
    monkeypatch.setattr(minhash, "COPIES", 4)
    monkeypatch.setattr(minhash, "HOT", 10)
    g = np.random.default_rng(3)
    base = [f"w{x}" for x in g.integers(0, 10**6, 120)]
    rows = []
    now = list(base)
    for _ in range(12):
        rows.append(" ".join(now))
        at = int(g.integers(0, 115))
        now[at : at + 3] = [f"n{x}" for x in g.integers(0, 10**6, 3)]
    for _ in range(40):
        near = list(base)
        near[int(g.integers(120))] = f"m{g.integers(10**6)}"
        rows.append(" ".join(near))
    passage = " ".join(f"p{x}" for x in g.integers(0, 10**6, 90))
    rows += [passage + " " + " ".join(f"q{x}" for x in g.integers(0, 10**6, int(n))) for n in g.integers(15, 60, 40)]
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(g.permutation(len(rows)), rows, strict=True)], "doc_id long, text string").withColumn("class_id", F.lit("x"))
    agree(spark, docs)


@pytest.mark.parametrize("similar", [0.81, 0.79])
def test_limit(spark, similar):
    g = np.random.default_rng(1)
    a = [f"w{x}" for x in g.integers(0, 10**6, 404)]
    cut = next(k for k in range(400) if (400 - k) / (400 + k) < similar)
    b = a[: 404 - cut] + [f"z{x}" for x in g.integers(0, 10**6, cut)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    agree(spark, docs)
