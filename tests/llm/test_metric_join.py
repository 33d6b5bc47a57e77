import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import graph, metric_join


def brute(rows, least=0.98):
    seen = sorted({(r[0], r[2], None if r[1] is None else tuple(r[1])) for r in rows}, key=str)
    good = [i for i, (k, label, v) in enumerate(seen) if None not in (k, label) and v and None not in v and np.isfinite(v).all() and any(v)]
    root = {k: k for k, _, _ in seen}
    links = [0] * len(seen)
    pairs = []
    for x, i in enumerate(good):
        for j in good[x + 1 :]:
            (a, la, v), (b, lb, w) = seen[i], seen[j]
            if la == lb and len(v) == len(w):
                v, w = (np.array(z, float) / np.abs(z).max() for z in (v, w))
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= least:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sorted(((k, n, root[k], k is None or root[k] == k) for (k, _, _), n in zip(seen, links, strict=True)), key=str)


def made(n=240, dims=6, seed=0):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((n // 6, dims))
    rows = []
    for i in range(n):
        v = centres[g.integers(len(centres))] + g.standard_normal(dims) * g.choice([0.02, 0.15, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(g.integers(2))))
    rows += [(n + i, rows[i % 7][1], rows[i % 7][2]) for i in range(40)]
    return rows


@pytest.mark.parametrize(("cell", "block"), [(2048, 2048), (16, 8), (40, 1000)])
def test_as_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "FAN", 4 if cell < 2048 else 64)
    monkeypatch.setattr(metric_join, "STREAM", 30 if cell < 2048 else 20_000)
    monkeypatch.setattr(metric_join, "CHUNK", block)
    rows = made()
    got = metric_join.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    want = brute([(k, [float(np.float32(x)) for x in v], label) for k, v, label in rows])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(n for _, n, _, _ in want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [0.0, 0.0], 1), (10, [nan, 1.0], 1), (11, [nan, 1.0], 1), (12, [1.0, None], 1), (13, [inf, 0.0], 1), (14, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (15, [1e300, 1e290], 1), (16, [1e-300, 0.0], 1), (17, [-1.0, 0.0], 1)]
    src = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("x")).withColumn("n_links", F.lit(1))
    got = metric_join.near_links(src).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert metric_join.near_links(src.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (500, 500), (None, 3)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[201] == 200 and got[500] == 500 and len(got) == 64
