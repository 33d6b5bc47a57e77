"""Operators over all lines, boxes and samples of a page, against brute force."""

import os
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from pagemill.operators import raster, recognition
from pagemill.queries import fixtures, objects

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_pages(spark, tmp_path_factory):
    """Documents of up to 150 lines, many alike, some of several hundred characters."""
    g = np.random.default_rng(0)
    line = lambda: " ".join(["alpha beta", "alpha gamma", "a", "word " * 40, "x" * 150][int(g.integers(0, 5))].split())
    rows = [(i, "\n".join(line() for _ in range(n)), "en", "web", 0) for i, n in enumerate((150, 90, 3, 1))]
    at = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(at, "documents.parquet"))
    return at


def test_wrapped_lines_hold_texts(spark, long_pages):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{long_pages}/documents.parquet").collect()}
    got = sorted(fixtures.pieces(spark, long_pages).collect(), key=lambda r: (r.doc, r.n))
    for d, text in docs.items():
        own = [r for r in got if r.doc == d]
        assert [r.n for r in own] == list(range(len(own))) and all(len(r.text) <= 60 for r in own)
        assert "".join(r.text for r in own) == text.replace("\n", "")


def style_by_pairs(rows):
    out = set()
    for a in rows:
        near = [b for b in rows if b.page == a.page and b.text == a.text and 0.85 < b.height / a.height < 1.18]
        best = max(near, key=lambda b: (b.fit, -b.n))
        out.add((a.page, a.n, best.family, best.fit))
    return out


def number_by_pairs(rows):
    out, label = set(), [r for r in rows if len(r.text) == 2 and r.text.isdigit()]
    for a in label:
        near = [b for b in label if b.page == a.page and 0.72 < b.height / a.height < 1.4]
        if len(near) >= 3:
            votes = Counter(b.family for b in near)
            family = min(votes, key=lambda f: (-votes[f], f))
            out.add((a.page, a.n, family, max(b.fit for b in near if b.family == family)))
    return out


def test_peers_of_all_lines(spark, long_pages):
    boxes = fixtures.boxes(spark, long_pages)
    rows = boxes.collect()
    assert max(r.n for r in rows) >= 150
    got = {tuple(r) for r in entry.queries()["style_peers"](spark, long_pages).select("page", "n", "family", "fit").collect()}
    assert got == style_by_pairs(rows) and len(got) == len(rows)
    numbers = boxes.selectExpr("page", "n", "height", "family", "fit", "if(n % 2 = 0, cast(10 + n % 80 as string), 'word') as text").collect()
    got = {tuple(r) for r in entry.queries()["number_peers"](spark, long_pages).select("page", "n", "family", "fit").collect()}
    assert got == number_by_pairs(numbers) and max(n for _, n, _, _ in got) >= 150


def test_equal_lines_of_a_page_do_not_meet(spark):
    g = np.random.default_rng(1)
    rows = [(1, i, "12" if i % 2 else "ab", float(g.integers(8, 20)), "fgh"[int(g.integers(0, 3))], float(g.integers(0, 9)) / 8) for i in range(20_000)]
    lines = spark.createDataFrame(rows, "page long, n int, text string, height double, family string, fit double")
    for f, n in ((recognition.style_peers, 20_000), (recognition.number_peers, 10_000)):
        assert f(lines).count() == n
        small = lines.where("n < 120")
        assert {tuple(r) for r in f(small).collect()} == (style_by_pairs if f is recognition.style_peers else number_by_pairs)(small.collect())


def merged_by_pairs(boxes, width, height):
    b, gap = [list(x) for x in boxes], max(5, min(width, height) / 52)

    def pair():
        for i in range(len(b)):
            for j in range(i + 1, len(b)):
                (p, q, r, s), (t, u, v, w) = b[i], b[j]
                if max(p, t) - min(r, v) <= gap and max(q, u) - min(s, w) <= gap and max(r, v) - min(p, t) < 0.28 * width and max(s, w) - min(q, u) < 0.32 * height:
                    return i, j
        return None

    while (found := pair()) is not None:
        i, j = found
        o = b.pop(j)
        b[i] = [min(b[i][0], o[0]), min(b[i][1], o[1]), max(b[i][2], o[2]), max(b[i][3], o[3])]
    return [tuple(x) for x in b]


def test_merging_by_neighbourhood_is_that_by_pairs():
    g = np.random.default_rng(3)
    for k in range(120):
        n = int(g.integers(0, 60))
        at, size = g.integers(0, (40, 200, 900)[k % 3], (n, 2)).astype(float), g.integers(-3 if k % 10 == 0 else 0, 40, (n, 2))
        boxes = [tuple(map(float, x)) for x in np.hstack([at, at + size])]
        width, height = float(g.integers(20, 900)), float(g.integers(20, 900))
        assert raster.merged_boxes(boxes, width, height) == merged_by_pairs(boxes, width, height)


def test_box_merge_of_all_boxes(spark, long_pages):
    pages = {}
    for r in sorted(fixtures.boxes(spark, long_pages).collect(), key=lambda r: r.n):
        pages.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    got = {}
    for r in sorted(entry.queries()["box_merge"](spark, long_pages).collect(), key=lambda r: r.n):
        got.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    assert got == {p: merged_by_pairs(b, 960.0, 1200.0) for p, b in pages.items()}
    assert max(b[3] for bs in got.values() for b in bs) > 20 + 19 * 50


def test_nested_boxes_of_all_boxes(spark, long_pages):
    g = np.random.default_rng(4)
    rows = [(int(g.integers(0, 3)), i, *map(float, (*at, *(at + g.integers(0, (20, 300)[i % 9 == 0], 2))))) for i, at in enumerate(g.integers(-50, 400, (400, 2)))]
    boxes = spark.createDataFrame(rows, "page long, n int, x0 double, y0 double, x1 double, y1 double")
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])

    def swallowed(a, o):
        both = max(0, min(a[2], o[2]) - max(a[0], o[0])) * max(0, min(a[3], o[3]) - max(a[1], o[1]))
        part, times = both / max(1, area(a)), area(o) / max(1, area(a))
        return part > 0.94 and times > 1.3 or part > 0.15 and times > 5

    left = {(r[0], r[1]) for r in rows if not any(o[0] == r[0] and swallowed(r[2:], o[2:]) for o in rows)}
    assert 0 < len(left) < len(rows)
    assert {(r.page, r.n) for r in raster.without_nested(boxes).collect()} == left
    assert max(r.n for r in entry.queries()["nested_boxes"](spark, long_pages).collect()) >= 150


def test_rims_and_events_of_all_boxes(spark, long_pages):
    pages = {}
    for r in sorted(fixtures.boxes(spark, long_pages).collect(), key=lambda r: r.n):
        pages.setdefault(r.page, []).append(r)
    got = entry.queries()["ellipse_rims"](spark, long_pages).collect()
    assert sorted((r.page, r.n, r.k) for r in got) == sorted((p, r.n, k) for p, rs in pages.items() for r in rs for k in range(5))
    expected = set()
    for p, rs in pages.items():
        free = [r for r in rs if r.n % 3 == 0]
        for b in (r for r in rs if r.n % 2 == 0):
            near = min(free, key=lambda e: (sum(abs(getattr(e, c) - getattr(b, c)) for c in ("x0", "y0", "x1", "y1")), e.n), default=None)
            expected.add((p, b.n, near.n if near else b.n + 100))
            free = [e for e in free if e is not near]
    assert {(r.page, r.n, r.seq) for r in entry.queries()["image_events"](spark, long_pages).collect()} == expected


def test_panels_by_all_samples(spark):
    shades, near = objects.SHADES, Counter()
    for r in fixtures.samples(spark, SF).collect():
        v = r.value // 40 * 40
        d = min(sum((v - (c >> k & 255)) ** 2 for k in (16, 8, 0)) for _, c in shades)
        near[r.vec // 50, r.vec % 50, "all"] += 1
        near[r.vec // 50, r.vec % 50, "near"] += d < 18 * 18
    got = entry.queries()["panel_rows"](spark, SF).collect()
    assert len(got) == sum(k[2] == "all" for k in near)
    assert all(r.share == pytest.approx(near[r.pic, r.row, "near"] / near[r.pic, r.row, "all"], abs=1e-8) for r in got)
    assert min(n for k, n in near.items() if k[2] == "all") > 12
