from collections import defaultdict

import numpy as np
import pytest

from pagemill.llm import mixing

from .cases import empty, odd


def by_quotients(votes, seats, most=None):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i, v in enumerate(votes) if v > 0 and (most is None or got[i] < most[i])]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_seats_by_highest_quotients():
    g = np.random.default_rng(0)
    for _ in range(150):
        n = g.integers(1, 12)
        votes = g.integers(0, 1000, n).astype(float)
        seats = int(g.integers(0, 80))
        most = g.integers(0, 30, n) if g.random() < 0.5 else None
        assert mixing.sainte_lague(votes, seats, most).tolist() == by_quotients(votes, seats, most)


def test_targets_by_hand():
    # 150 % of 1000 is 1500: shares 937.5, 375, 187.5; the first stops at 200, its excess goes 2 : 1.
    assert mixing.targets([100, 500, 400], [5, 2, 1]).tolist() == pytest.approx([200, 1300 * 2 / 3, 1300 / 3])
    assert mixing.targets([100, 200, 700], [5, 2, 1]).tolist() == pytest.approx([200, 400, 900])
    assert mixing.targets([0, 0], [5, 2]).tolist() == [0, 0]


def test_blocks_meet_a_quota_exactly():
    g = np.random.default_rng(1)
    for _ in range(100):
        sizes = g.integers(0, 50, g.integers(0, 30))
        words, block = int(g.integers(0, 2 * sizes.sum() + 5)), int(g.integers(1, 40))
        passes, chosen, some = mixing.take(sizes, words, block, 1, 2)
        taken = passes * sizes + some
        assert taken.sum() == min(words, 2 * sizes.sum()) and (some <= sizes).all() and (taken <= 2 * sizes).all()
        ends = np.cumsum(sizes)
        for s, n, e in zip(some, sizes, ends, strict=True):
            assert sum(r["hi"] - r["lo"] for r in mixing.ranges(int(e - n), int(e), chosen, block)) == s


def test_odd_rows(spark):
    docs = odd(spark)
    rows = mixing.digests(docs).collect()
    texts = defaultdict(list)
    for d in docs.collect():
        texts[d.doc_id].append(len((d.text or "").encode().split()))
    assert len(rows) == docs.count()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] in texts[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {r.source: r.source_size for r in rows} == dict(size)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]))
    assert all(abs(taken[s] - target[s]) <= 1024 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.digests(docs).collect()))
    assert mixing.digests(empty(spark)).collect() == []


def test_whole_tables_near_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.digests(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.02 * t + 16 for s, t in target.items())


def test_texts_hold_the_words_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    words, own = defaultdict(int), {r.doc_id: r.text.split() for r in docs.collect()}
    for r in out.collect():
        got = r.text.split()
        words[r.doc_id] += len(got)
        assert got == own[r.doc_id] or set(got) <= set(own[r.doc_id])
    assert {k: n for k, n in words.items() if n} == {r.doc_id: r.taken for r in mixing.digests(docs).collect() if r.taken}


def test_shards_share_a_source(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 3 if i % 5 else 0}") for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, shard_rows=100, block=64).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_thin_sources_get_their_target():
    g = np.random.default_rng(2)
    for docs, words, times in ((500, 100, 2.0), (500, 100, 1.0), (5000, 100, 1.0), (500, 400, 1.5), (5000, 400, 0.2)):
        sizes = np.bincount(g.integers(0, 5860, docs), minlength=5860) * words
        target = times * sizes.sum()
        block = max(8, min(1024, int(target // 100)))
        seats = round(target / block)
        got = mixing.shard_words(sizes, seats, block)
        assert got.sum() == min(seats * block, 2 * sizes.sum()) and (got >= 0).all() and (got <= 2 * sizes).all()
        assert all(mixing.take(np.array([n]), int(w), block, 1)[2][0] + mixing.take(np.array([n]), int(w), block, 1)[0] * n == w for n, w in zip(sizes, got, strict=True) if n)


def test_few_rows_of_a_source_over_many_shards(spark):
    docs = spark.createDataFrame([(i, "w " * (30 + i % 40), "b" if i % 50 == 0 else "a") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, shard_rows=2).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == 6000 and all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def by_force(rows, block, seed=7):
    """taken of each rid: quotas dealt by quotients one seat at a time, and every shard's words walked one by one."""
    size, shards = defaultdict(int), defaultdict(lambda: defaultdict(list))
    for r in rows:
        size[r.source] += r["size"]
        shards[r.source][r.shard].append(r)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    seats = by_quotients(target, round(target.sum() / block))
    out = {}
    for sid, s in enumerate(order):
        names = sorted(shards[s])
        own = [sum(r["size"] for r in shards[s][k]) for k in names]
        got = by_quotients([float(x) for x in own], seats[sid], [2 * x // block for x in own])
        quota = [x * block for x in got]
        if sum(got) < seats[sid]:  # too few whole blocks: in proportion
            whole, upto = sum(own), np.cumsum(own).tolist()
            total = min(seats[sid] * block, 2 * whole)
            quota = [total * b // whole - total * a // whole for a, b in zip([0, *upto], upto, strict=False)]
        for shard, q in zip(names, quota, strict=True):
            part = sorted(shards[s][shard], key=lambda r: (r.at, r.text_hash, r["size"], r.rid))
            stream = [r.rid for r in part for _ in range(r["size"])]
            passes, rest = divmod(q, len(stream)) if stream else (0, 0)
            for r in part:
                out[r.rid] = passes * r["size"]
            blocks = [stream[i : i + block] for i in range(0, len(stream), block)]
            for b in mixing.seeded(len(blocks), seed, shard, sid):
                for rid in blocks[b][: max(0, rest)]:
                    out[rid] += 1
                rest -= len(blocks[b])
    return out


def test_every_shard_as_by_force(spark):
    g = np.random.default_rng(4)
    docs = [(i, "w " * int(g.integers(0, 60)), ("a", "b", None)[int(g.integers(0, 3))]) for i in range(1200)]
    docs += [(7000, "r " * 40, "a")] * 30
    src = spark.createDataFrame([(rid, *d) for rid, d in enumerate(docs)], "rid long, doc_id long, text string, source string")
    shards = 7
    rows = src.selectExpr("rid", "source", "cast(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') as long) size", "xxhash64(text) text_hash", "cast(pmod(xxhash64(7, doc_id, xxhash64(text)), 7) as int) shard", "xxhash64(8, doc_id, xxhash64(text)) at").collect()
    block = 16
    got = {r.rid: r.taken for r in mixing.mix(src, shard_rows=-(-len(docs) // shards), block=block, rid="rid").collect()}
    assert got == by_force(rows, block)


def test_repeated_rows_each_have_their_share(spark):
    docs = odd(spark).union(spark.createDataFrame([(5000, "one two three four five six seven " * 3, "en", "a", 99, "x", "y", "z")] * 60, odd(spark).schema))
    out, taken = mixing.mixed_texts(docs).collect(), mixing.digests(docs).collect()
    assert sum(len((r.text or "").encode().split()) for r in out) == sum(r.taken for r in taken)
    assert all(r.n_chars == len(r.text) for r in out)


def test_clashing_names_stay(spark):
    names = {"_h": "1", "_k": "2", "_m": "3", "row": "4", "k": "5", "t": "6", "rid": "7", "passes": "8", "ranges": "9", "a.b": "10"}
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 9, "ab"[i % 2], *names.values()) for i in range(50)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    rows = mixing.mixed_texts(docs).collect()
    assert rows and all(r[n] == v for r in rows for n, v in names.items())


def test_many_repeats_are_dealt_out(spark, monkeypatch):
    from pagemill.llm import scratch

    docs = spark.createDataFrame([(1, 5)] * 500 + [(i, 5) for i in range(10, 60)], "k long, h long").selectExpr("*", "monotonically_increasing_id() rid")
    got = scratch.repeats(docs, ["k", "h"], line=50).collect()
    assert len(got) == 550 and len({r.salt for r in got if r.k == 1}) == 500 and all(r.salt == 0 for r in got if r.k != 1)
