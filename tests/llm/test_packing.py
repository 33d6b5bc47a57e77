import zlib
from collections import Counter, defaultdict

import numpy as np

from pagemill.llm import packing

from .cases import empty, odd, row


def checked(docs, **more):
    rows = packing.assign(docs, **more).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == docs.count()
    return rows


def test_place_takes_the_highest_dot_product():
    v = np.array([[0.5, 0.1, 0.1], [0.1, 0.5, 0.1], [0.3, 0.3, 0.3], [0.2, 0.2, 0.2]])
    residual = np.ones((2, 3))
    bins = packing.place(v, residual.copy())
    left = np.ones((2, 3))
    for x, b in zip(v, bins, strict=True):
        products = [float(np.dot(r, x * packing.LAW)) for r in left]
        assert products[b] == max(products)
        left[b] -= x


def test_odd_rows(spark):
    docs = odd(spark)
    rows = checked(docs, shards=5)
    texts = {d.doc_id: d.text for d in docs.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert packing.assign(empty(spark)).collect() == []


def test_balance_and_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(30).selectExpr("doc_id + 1000000", "text", "lang", "source", "n_chars"))
    rows = checked(docs, shards=4)
    size = Counter()
    shards = defaultdict(set)
    for r in rows:
        size[r.shard] += r["size"]
        shards[bytes(r.text_sha)].add(r.shard)
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 4
    assert all(len(s) == 1 for s in shards.values())


def test_light_groups_in_buckets_and_a_hot_text(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 9)) for i in range(3000)] + [(10_000 + i, "hot text of many rows") for i in range(1500)], "doc_id long, text string")
    rows = checked(docs, shards=8, heavy_share=0.05, bucket_groups=256)
    size, hot = Counter(), Counter()
    for r in rows:
        size[r.shard] += r["size"]
        hot[r.shard] += r.doc_id >= 10_000
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 8
    assert max(hot.values()) < 0.3 * 1500
    again = {(r.doc_id, r.shard, r.slot) for r in packing.assign(docs, shards=8, heavy_share=0.05, bucket_groups=256).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([row(i, f"text {i}") for i in range(40)], odd(spark).schema)
    packing.write_shards(docs, f"file://{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == 40 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_bytes_tokens_and_rows_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.assign(docs).collect()
    sums = [Counter(), Counter(), Counter()]
    for r in rows:
        for c, v in zip(sums, (r["size"], r.tokens, 1), strict=True):
            c[r.shard] += v
    for c, within in zip(sums, (0.03, 0.15, 0.15), strict=True):
        assert len(c) == 40 and max(c.values()) - min(c.values()) < within * sum(c.values()) / 40 * 2


def test_only_a_text_of_over_half_a_shard_is_cut(spark):
    docs = spark.createDataFrame([(i, f"text {i % 97} of some words") for i in range(4000)], "doc_id long, text string")
    shards = defaultdict(set)
    for r in packing.assign(docs, shards=4).collect():
        shards[bytes(r.text_sha)].add(r.shard)
    assert len(shards) == 97 and all(len(s) == 1 for s in shards.values())


def test_equal_products_take_the_first_shard():
    assert packing.place(np.full((3, 3), 0.1), np.ones((4, 3))).tolist() == [0, 1, 2]


def test_one_key_and_text_in_most_rows(spark):
    docs = spark.createDataFrame([(1, "the same row")] * 6000 + [(i, f"other text {i}") for i in range(10, 1000)], "doc_id long, text string")
    rows = checked(docs, shards=8)
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.3 * sum(size.values()) / 8
