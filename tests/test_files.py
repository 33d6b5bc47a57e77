import io
import json
import zipfile
import xml.etree.ElementTree as ET

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import files, pages, panels, raster
from pagemill.plans import formats, tools
from pagemill.sinks import files as sink
from pagemill.sinks import office as writer
from pagemill.sources import external, office, pictures
from pagemill.sources import files as source
from pagemill.streaming import progress


def test_names_never_replace(spark, tmp_path):
    (tmp_path / "sample.txt").write_text("old")
    rows = spark.createDataFrame([(str(tmp_path), "sample", "txt", bytearray(b"new")), (str(tmp_path), "other", "txt", bytearray(b"x"))], "folder string, stem string, ext string, content binary")
    got = {r.stem: r for r in sink.published(rows.coalesce(1)).collect()}
    assert got["sample"].path.endswith("sample-1.txt") and got["other"].path.endswith("other.txt")
    assert (tmp_path / "sample.txt").read_text() == "old" and (tmp_path / "sample-1.txt").read_bytes() == b"new"


def test_a_failed_write_leaves_no_file(tmp_path):
    with pytest.raises(TypeError):
        sink.publish(tmp_path, "a", "txt", "not bytes")
    assert list(tmp_path.iterdir()) == []


def test_planned_names_as_one_by_one(spark):
    there = {"a.txt", "a-1.txt", "a-3.txt", "a-1-1.txt", "b-2.txt", "a-01.txt"}
    new = [("a", "txt"), ("a", "txt"), ("a", "txt"), ("b", "txt"), ("a-1", "txt"), ("a-1", "txt"), ("c", "png"), ("a", "txt")]
    rows = spark.createDataFrame([("f", s, e, i) for i, (s, e) in enumerate(new)], "folder string, stem string, ext string, ord int")
    got = {r.ord: r.name for r in files.published_names(rows, spark.createDataFrame([("f", n) for n in there], "folder string, name string")).collect()}
    for (s, e), i in zip(new, range(len(new)), strict=True):
        k = 0
        taken = there | {got[j] for j in range(i) if new[j] == (s, e)}
        while (name := f"{s}{f'-{k}' if k else ''}.{e}") in taken:
            k += 1
        assert got[i] == name


def test_binary_and_text_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes("﻿hello\r\nwörld".encode())
    rows = {r.path.rpartition("/")[2]: r for r in source.binary_files(spark, str(tmp_path)).withColumn("pdf", source.is_pdf(F.col("content"))).collect()}
    assert (rows["a.pdf"].pdf, rows["a.pdf"].kind, rows["b.txt"].pdf, rows["b.txt"].ext) == (True, "document", False, "txt")
    assert source.text_files(spark, str(tmp_path)).first().text == "hello\r\nwörld"
    one = files.manifest(source.binary_files(spark, str(tmp_path)))
    assert files.changed(one, one).collect() == []
    (tmp_path / "c.txt").write_text("c")
    assert [r.change for r in files.changed(one.localCheckpoint(), files.manifest(source.binary_files(spark, str(tmp_path)))).collect()] == ["added"]


def test_extensions(spark):
    rows = spark.createDataFrame([("/a/b.PDF",), ("x.tar.gz",), ("/a.b/c",), (".hidden",), ("d.",), ("a/.x.txt",)], "p string")
    assert [r[0] for r in rows.select(formats.extension(F.col("p"))).collect()] == ["pdf", "gz", "", "", "", "txt"]


def test_intersection_doesn_t_depend_on_order(spark):
    a = [("b", e, i) for i, e in enumerate(("png", "pdf", "jpeg"))]
    one = formats.common_targets(spark.createDataFrame(a, "batch string, ext string, ord int"))
    two = formats.common_targets(spark.createDataFrame(a[::-1], "batch string, ext string, ord int"))
    assert sorted(one.collect()) == sorted(two.collect()) and one.count()


def test_ocr_is_offered_for_images(spark):
    rows = spark.createDataFrame([(1, "png"), (1, "JPG"), (2, "pdf"), (3, "mp4"), (3, "png"), (4, "pdf"), (4, "pdf"), (5, None)], "batch int, ext string")
    got: dict[int, set] = {}
    for r in tools.applicable(rows).collect():
        got.setdefault(r.batch, set()).add(r.tool)
    assert "ocr" in got[1] and "images_pdf" in got[1] and "pdf_merge" not in got[2] and "pdf_merge" in got[4] and 3 not in got and 5 not in got


def docx(text):
    return writer.word_file([writer.word_paragraph(t) for t in text.split("\n")])


def test_documents_are_read(spark):
    x = io.BytesIO()
    with zipfile.ZipFile(x, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    e = io.BytesIO()
    with zipfile.ZipFile(e, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="b" href="2.html"/><item id="a" href="1.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/1.html", "<h1>One</h1><p>x &amp; y</p>")
        z.writestr("o/2.html", "<script>no</script><ul><li>i</li></ul>")
    deck = writer.slide_file([writer.text_box(1, 0, 0, 10, 10, ["Hello", "there"], 20)])
    rows = [("a", "docx", docx("one\ntwo\x0b")), ("b", "xlsx", x.getvalue()), ("c", "epub", e.getvalue()), ("d", "pptx", deck), ("e", "csv", b"a,b\n1,\"2,3\"\n"), ("f", "json", b'{"a": 1}'), ("g", "json", b"{"), ("h", "xml", b"<a>t<b>u</b></a>"), ("i", "txt", b"  "), ("j", "docx", b"no zip"), ("k", "xls", b""), ("l", "xml", b"<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>")]
    got = {r.path: r for r in office.read_texts(spark.createDataFrame([(p, t, bytearray(d)) for p, t, d in rows], "path string, ext string, content binary")).collect()}
    assert got["a"].text.split("\n")[0] == "one"
    assert "| name |  | 7 |" in got["b"].text and "| ab |  |  |" in got["b"].text
    assert got["c"].text == "# One\nx & y\n\n- i" and "Hello\nthere" in got["d"].text
    assert "| 1 | 2,3 |" in got["e"].text and got["h"].text == "t\nu"
    assert all(got[k].text is None and got[k].error for k in "gijkl")


def test_written_documents_are_well_formed(spark):
    lines = spark.createDataFrame([(1, 0, "Title & <x>", 1), (1, 1, "plain", None), (2, 0, "other", None)], "doc int, line_no int, text string, level int")
    word = {r.doc: bytes(r.content) for r in writer.word_documents(lines).collect()}
    with zipfile.ZipFile(io.BytesIO(word[1])) as z:
        for n in z.namelist():
            ET.fromstring(z.read(n))
    assert office.docx(word[1]) == "Title & <x>\nplain"
    slides = spark.createDataFrame([(1, s, i, f"t {s}", f"line {i}") for s in (1, 2) for i in range(3)], "doc int, slide int, line_no int, title string, text string")
    deck = bytes(writer.slide_documents(slides).first().content)
    with zipfile.ZipFile(io.BytesIO(deck)) as z:
        assert sum(n.startswith("ppt/slides/slide") for n in z.namelist()) == 2
        for n in z.namelist():
            ET.fromstring(z.read(n))
    png = pictures.encode_png(np.zeros((2, 3, 4), np.uint8))
    objects = [(1, 1, 960.0, 540.0, 0, "shape", 0.0, 0.0, 10.0, 10.0, None, None, None, None, None, None, "rect", 0xFF0000, None, None), (1, 1, 960.0, 540.0, 1, "text", 1.0, 1.0, 50.0, 20.0, "a\nb", 12.0, 16, 0x333333, "Arial", 0.5, None, None, None, None), (1, 2, 480.0, 540.0, 0, "image", 0.0, 0.0, 9.0, 9.0, None, None, None, None, None, None, None, None, None, bytearray(png))]
    kind = "doc int, page int, width double, height double, seq int, kind string, x0 double, y0 double, x1 double, y1 double, text string, size double, flags int, color int, font string, spacing double, geometry string, fill int, line int, data binary"
    with zipfile.ZipFile(io.BytesIO(bytes(writer.layout_slides(spark.createDataFrame(objects, kind)).first().content))) as z:
        assert any(n.startswith("ppt/media/") for n in z.namelist())
        one = z.read("ppt/slides/slide1.xml").decode()
        assert one.count("<a:br/>") == 1 and 'b="1"' in one and "FF0000" in one


def test_pictures_round_trip(spark):
    g = np.random.default_rng(0)
    a = g.integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert (pictures.decode_png(pictures.encode_png(a)) == a).all()
    assert pictures.encode_bmp(a)[:2] == b"BM" and len(pictures.encode_bmp(a)) == 54 + 5 * 24
    files_df = spark.createDataFrame([("a", bytearray(pictures.encode_png(a))), ("b", bytearray(b"x"))], "path string, content binary")
    got = {r.path: r for r in pictures.decoded(files_df).collect()}
    assert got["b"].error and bytes(got["a"].picture.data) == a.tobytes()


def test_filters_of_png():
    g = np.random.default_rng(1)
    a = g.integers(0, 256, (6, 5, 4)).astype(int)
    import struct
    import zlib

    rows, above = b"", np.zeros(20, int)
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        line = a[y].reshape(-1)
        left, corner = (np.concatenate([np.zeros(4, int), v[:-4]]) for v in (line, above))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: paeth}[kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    data = pictures.MAGIC + pictures.chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 6, 0, 0, 0)) + pictures.chunk(b"IDAT", zlib.compress(rows)) + pictures.chunk(b"IEND", b"")
    assert (pictures.decode_png(data) == a).all()


def test_tools_on_pixels():
    a = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype(np.uint8)
    assert (raster.rotated(a, 90)[0, -1] == a[0, 0]).all() and (raster.rotated(a, -90)[-1, 0] == a[0, 0]).all()
    assert (raster.rotated(raster.rotated(a, 180), 180) == a).all()
    assert (raster.mirrored(a)[:, ::-1] == a).all() and (raster.mirrored(a, True)[::-1] == a).all()
    assert (raster.grey(a)[:, :, 3] == a[:, :, 3]).all()
    assert raster.halved(np.full((5, 1, 4), 9, np.uint8)).shape == (2, 1, 4)
    assert (raster.on_white(np.zeros((1, 1, 4), np.uint8))[0, 0] == 255).all()
    assert len(np.unique(raster.quantised(np.random.default_rng(0).integers(0, 256, (40, 40, 4)).astype(np.uint8), 128).reshape(-1, 4), axis=0)) <= 128


def test_connected_parts():
    mask = np.zeros((6, 8), bool)
    mask[0, 0] = mask[1, 1] = mask[2, 0] = True
    mask[4:6, 5:8] = True
    labels, boxes = raster.labelled(mask)
    assert sorted(map(tuple, boxes.tolist())) == [(0, 0, 2, 3, 3), (5, 4, 8, 6, 6)]
    assert labels[0, 0] == labels[1, 1] == labels[2, 0] != labels[5, 7] and labels[3, 3] == 0


def test_boxes_merge_as_one_by_one():
    def slow(boxes, w, h):
        boxes, gap = list(boxes), max(5, min(w, h) / 52)
        while True:
            for i in range(len(boxes)):
                for j in range(i + 1, len(boxes)):
                    a, b = boxes[i], boxes[j]
                    x, y = max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3])
                    u = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    if x <= gap and y <= gap and u[2] - u[0] < 0.28 * w and u[3] - u[1] < 0.32 * h:
                        boxes[i] = u
                        del boxes[j]
                        break
                else:
                    continue
                break
            else:
                return boxes

    g = np.random.default_rng(2)
    for _ in range(20):
        boxes = [(float(x), float(y), float(x + 12), float(y + 9)) for x, y in g.integers(0, 300, (25, 2))]
        assert raster.merged_boxes(boxes, 400, 300) == slow(boxes, 400, 300)


def test_parts_of_a_split_hold_every_page(spark):
    from pagemill.functions import parsers

    rows = spark.createDataFrame([("all", 7), (None, 3), ("1-3,4,5-9", 9)], "expression string, pages int")
    for (_, n), own in {(r.expression, r.pages): None for r in rows.collect()}.items():
        got = parsers.page_groups(rows.where(F.col("pages") == n)).collect()
        assert sorted(p for r in got for p in range(r.first, r.last + 1)) == list(range(1, n + 1)), own


def test_a_document_of_blank_pages_is_an_error(spark):
    rows = spark.createDataFrame([(1, 1, " "), (1, 2, None), (2, 1, "x"), (2, 2, "")], "doc int, page int, text string")
    got = {r.doc: r for r in pages.document_text(rows).collect()}
    assert got[1].text is None and got[1].error and got[2].text == "===== 第 1 页 =====\nx\n\n===== 第 2 页 =====\n"


def test_feed_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"progress": "one"}), "bad", json.dumps({"x": 1}), json.dumps({"progress": "two"})]
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    seen = []
    q = progress.polled(progress.feed(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r.progress for r in df.collect()), str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    assert sorted(seen) == ["one", "two"]


def test_what_is_missing_is_said(spark):
    rows = {r.capability: r.provider for r in external.capabilities(spark).collect()}
    assert set(rows) == {"render", "media", "pdf", "picture", "recognise"}
    for name, provider in rows.items():
        if provider is None:
            with pytest.raises(RuntimeError):
                external.need(name)


def test_events_are_taken_once(spark):
    kind = "page int, n int, number int, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(1, 0, 50, 0.0, 0.0, 10.0, 10.0), (1, 1, 51, 1.0, 0.0, 10.0, 10.0), (1, 2, 52, 0.0, 0.0, 9.0, 9.0), (2, 0, 53, 0.0, 0.0, 1.0, 1.0)], kind)
    events = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0), (1, 9, 100.0, 0.0, 110.0, 10.0)], "page int, seq int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.n): r.seq for r in panels.drawn_by(blocks, events, ["page"]).collect()}
    assert got == {(1, 0): 7, (1, 1): 9, (1, 2): 52, (2, 0): 53}


def test_a_division_runs_through():
    palette = np.array([[255, 255, 255], [0, 0, 0]], np.uint8)
    above = np.array([[255, 255, 255]] * 6 + [[120, 130, 120]] + [[2, 2, 2]] * 5)
    rows = np.full((3, 3), 255, np.uint8)
    left, right = np.array([[255, 255, 255]] * 3), np.array([[0, 0, 0], [255, 255, 255], [90, 90, 90]])
    fill = panels.divided(rows, above, left, right, palette)
    assert (fill[0, :6] == 255).all() and (fill[0, 7:] == 0).all() and (fill[1:] == 255).all()


def test_notes_round_ties_as_sql_does(spark):
    sizes = [(2000, 933), (2000, 733), (2000, 827), (2000, 1863), (2000, 1451), (1000, 875), (8, 7), (0, 0), (3, 3)]
    rows = spark.createDataFrame(sizes, "before long, after long")
    got = [r.note for r in rows.select(files.size_note(F.col("before"), F.col("after")).alias("note")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT CASE WHEN $a < $b THEN '体积减小 ' || format('{:.1f}', round_even((1 - $a / greatest(1, $b)) * 100, 1)) || '%' ELSE '原文件已较精简，本次没有进一步减小体积。' END", {"a": a, "b": b}).fetchone()[0] for b, a in sizes]
    assert got == want and "53.4" in got[0] and "58.6" in got[2]
