"""Lettering, round shapes and pictures of drawn pages, whose places are known."""

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from pagemill.operators import artwork
from pagemill.operators.raster import pixels
from pagemill.queries import fixtures

SF = "/root/testdata/sf0.001"


def drawn(spark):
    pages = fixtures.drawn_pages(spark, SF).where("page < 24").cache()
    return pages, {r.page: pixels(r.picture.asDict()) for r in pages.collect()}


def test_lettering_leaves_its_panel(spark):
    pages, pictures = drawn(spark)
    rows = artwork.without_text(pages, ["page"]).collect()
    assert len(rows) == 2 * len(pictures)
    for r in rows:
        chars, top = 4 + r.page % 4, 8 + 24 * r.n
        assert (r.x0, r.y0, r.x1, r.y1) == (13, top + 3, 13 + 7 * (chars - 1) + 3, top + 13)
        assert r.flat and list(r.color) == [20, 30, 40 + r.page % 8] and list(r.background) == [250, 250, 240]
        left, was = pixels(r.picture.asDict()), pictures[r.page]
        assert (left[:56, :70, :3] == (250, 250, 240)).all()
        assert (left[60:] == was[60:]).all() and (left[:, 72:] == was[:, 72:]).all()


def test_lettering_on_a_picture_is_grown_over():
    g = np.random.default_rng(0)
    a = np.full((60, 120, 4), 255, np.uint8)
    a[:, :, :3] = (np.linspace(100, 160, 120)[None, :, None] + g.normal(0, 6, (60, 120, 3))).clip(0, 255)
    was = a.copy()
    for i in range(5):
        a[22:38, 30 + 12 * i : 32 + 12 * i, :3] = (255, 0, 0)
    left, found = artwork.erased(a, [{"n": 1, "text": "lettering on it", "x0": 24.0, "y0": 18.0, "x1": 90.0, "y1": 42.0}])
    assert len(found) == 1 and not found[0]["flat"]
    assert np.abs(left[18:42, 24:90, :3].astype(float) - was[18:42, 24:90, :3]).mean() < 18
    assert artwork.erased(a, []) [1] == [] and artwork.erased(a, [{"n": 1, "text": "x", "x0": 500.0, "y0": 0.0, "x1": 510.0, "y1": 5.0}])[1] == []


def test_marks(spark):
    pages, pictures = drawn(spark)
    got = {(r.page, r.n): r for r in artwork.marks(pages, ["page"]).collect()}
    assert {k for k in got if k[1] < 10} == {(p, n) for p in pictures for n in (0, 1)}
    assert {p for p, n in got if n == 11} == {p for p in pictures if p % 3}
    assert all(got[p, 11].color == f"1E78{60 + p % 16:02X}" and got[p, 11].part == 1 for p in pictures if p % 3)
    assert not artwork.text_mask(pictures[1], [(100, 40, 140, 60)], np.array([[250, 250, 240]])).any()


def test_pictures_leave_their_panels(spark):
    pages, pictures = drawn(spark)
    rows = artwork.apart(pages, ["page"]).collect()
    assert len(rows) == 2 * len(pictures)
    for r in rows:
        cut, behind, was = pixels(r.picture.asDict()), pixels(r.behind.asDict()), pictures[r.page]
        if r.kind == "photo":
            assert (cut == was[30:70, 95:145]).all()
            assert (behind[30:70, 95:145, :3] == ((200, 220, 250) if r.page % 2 else (250, 250, 240))).all()
        else:
            assert cut[20, 20, 3] == 255 and cut[0, 0, 3] == 0
            assert (behind[72:108, 25:55, :3] == (250, 250, 240)).all()


def test_a_division_runs_down_behind_a_picture():
    palette = np.array([[250, 250, 240], [200, 220, 250]], float)
    a = np.full((100, 160, 4), 255, np.uint8)
    a[:, :80, :3], a[:, 80:, :3] = palette
    was = a.copy()
    a[30:70, 60:110, :3] = 7
    _, left = artwork.taken_out(a, a, (60, 30, 110, 70), "photo", np.repeat(palette[:1], 40, axis=0), palette)
    assert (left == was).all()


def test_masks_grow_evenly():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert artwork.grown(mask, 2).sum() == 25 and artwork.grown(mask, 1)[3:6, 3:6].all() and not artwork.grown(~(mask | True), 2).any()


class Caught:
    """A frame that keeps the function given to mapInArrow."""

    schema = T.StructType([T.StructField("page", T.LongType())])

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        self.work = work
        return self


def test_pictures_are_handed_on_in_batches_of_few_bytes(spark, monkeypatch):
    table = Caught()
    monkeypatch.setattr(fixtures, "table", lambda *_: table)
    fixtures.drawn_pages(spark, SF)
    drawn = list(table.work(iter([pa.RecordBatch.from_arrays([pa.array(range(300))], names=["doc_id"])])))
    assert [p for b in drawn for p in b.column(0).to_pylist()] == list(range(300))
    assert max(b.nbytes for b in drawn) < 1.1 * artwork.HELD and len(drawn) > 4
    a = np.full((400, 500, 4), 9, np.uint8)
    objects = [{"n": k, "kind": "photo", "x0": 10 * k, "y0": 10, "x1": 10 * k + 9, "y1": 30} for k in range(1, 41)]
    page = {"page": 1, "picture": {"h": 400, "w": 500, "data": a.tobytes()}, "palette": [[9, 9, 9]], "objects": objects}
    pages = Caught()
    artwork.apart(pages, ["page"])
    got = list(pages.work(iter([pa.RecordBatch.from_pylist([page])])))
    assert [n for b in got for n in b.column("n").to_pylist()] == list(range(1, 41))
    assert max(b.nbytes for b in got) < 1.3 * artwork.HELD and len(got) > 4


def test_lines_without_ink_have_no_row():
    a = np.full((60, 120, 4), 255, np.uint8)
    a[20:30, 30:34, :3] = 0
    left, found = artwork.erased(a, [{"n": 1, "text": "nothing", "x0": 60.0, "y0": 10.0, "x1": 110.0, "y1": 40.0}])
    assert found == [] and (left == a).all()


def test_marks_measure_a_page_once(monkeypatch):
    a = np.full((60, 120, 4), 9, np.uint8)
    seen = []
    monkeypatch.setattr(artwork, "distance_map", lambda *x, own=artwork.distance_map: seen.append(1) or own(*x))
    pages = Caught()
    artwork.marks(pages, ["page"])
    lines = [{"n": k, "text": "x", "x0": 10.0, "y0": 8.0 * k, "x1": 60.0, "y1": 8.0 * k + 6} for k in range(5)]
    page = {"page": 1, "picture": {"h": 60, "w": 120, "data": a.tobytes()}, "palette": [[9, 9, 9]], "lines": lines, "objects": []}
    got = [r for b in pages.work(iter([pa.RecordBatch.from_pylist([page])])) for r in b.to_pylist()]
    assert [r["n"] for r in got] == [0, 1, 2, 3, 4] and all(r["part"] == 1 for r in got) and len(seen) == 1
