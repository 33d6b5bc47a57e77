import hashlib

import corpus_pipeline
import pytest

from pagemill.llm import langid, mixing, toxicity


def test_stages_in_turn(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "bpe"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    assert all(s.columns == docs.columns for s in seen[:-1])
    clean = toxicity.digests(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0")
    assert ids(seen[1]) == ids(clean)
    told = langid.digests(seen[1]).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}")
    assert ids(seen[2]) == ids(told)
    texts = [r.text for r in seen[3].collect()]
    assert len(texts) == len(set(texts)) < seen[2].count()
    taken = {r.doc_id: r.taken for r in mixing.digests(seen[3]).where("taken > 0").collect()}
    words: dict[int, int] = {}
    for r in seen[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == taken
    assert sorted(r.decoded_sha256 for r in seen[5].collect()) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in seen[4].collect())
    assert seen[5].count() == seen[4].count()


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.not_toxic(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert left.join(clean, "doc_id", "left_semi").count() > 0.93 * clean.count()
    assert corpus_pipeline.known_language(spark, docs, sf).count() > 0.99 * docs.count()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_and_odd(spark, stage):
    from .cases import empty, odd

    sf = "/root/testdata/sf0.001"
    docs = odd(spark)
    assert stage[1](spark, empty(spark), sf).collect() == []
    rows = stage[1](spark, docs, sf).collect()
    ids = [r.doc_id for r in rows]
    kept = sorted(map(str, ids))
    every = [r.doc_id for r in docs.collect()]
    if stage[0] == "toxicity":  # what no label speaks against stays: nulls, blanks, long and repeated rows
        assert {1, 2, 3, None} <= set(ids) and ids.count(5) == 2
    if stage[0] == "language":
        assert not {1, 2, 3, 8} & set(ids) and ids.count(5) == 2
    if stage[0] == "near_duplicates":
        assert len(ids) == len(set(ids)) and {1, 4} <= set(ids) and not {2, 5} & set(ids)
    if stage[0] == "mixing":
        assert not {1, 2, 3} & set(ids)
    if stage[0] == "bpe":
        assert kept == sorted(map(str, every))
    if stage[0] != "bpe":
        names = {"_h": "1", "_s": "2", "row": "3", "k": "4", "same": "5", "t": "6", "rid": "7", "lang_pred": "8", "class_id": "9"}
        clash = docs.selectExpr("*", *(f"'{v}' as {n}" for n, v in names.items()))
        out = stage[1](spark, clash, sf)
        assert out.columns == clash.columns and all(r[n] == v for r in out.collect() for n, v in names.items())
