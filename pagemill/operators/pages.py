"""Pages of documents: which to recognise, their objects, text and order (J1-J3, J6, J11, P9-P12, A18, A20, A21, R4, R17, R19, SK6, SK15, T8, U5, U6, W7-W9, Q1, Q5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import capped, intersection
from ..functions.text import blank, comparable, lines, strip


def image_pages(pages: DataFrame, images: DataFrame, dominant: bool = False) -> DataFrame:
    """doc, page of pages that are a picture: one has half of the page, or there is no text unless dominant is asked.

    pages: doc, page, width, height, text; images: doc, page, x0 to y1.
    """
    own = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    frame = [F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double")]
    part = intersection(own, frame) / (F.col("width") * F.col("height"))
    large = images.join(pages.select("doc", "page", "width", "height", "text"), ["doc", "page"]).groupBy("doc", "page").agg(F.max(part).alias("part"), F.max(F.coalesce(~blank(F.col("text")), F.lit(False))).alias("has_text"))
    return large.where((F.col("part") >= 0.50) | (F.lit(not dominant) & ~F.col("has_text"))).select("doc", "page")


def rich_text(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page of pages whose own text is worth keeping (P10): 80 visible characters, 3 baselines, a quarter of the height.

    glyphs: doc, page, n, ch, baseline, size, y0, y1, visible. A glyph begins a baseline if none so far
    is within the greater of 2 and a quarter of its size (A10); the fold ends at the third.
    """
    seen = glyphs.where(F.col("visible") & ~blank(F.col("ch")))
    entry = F.struct("n", F.col("baseline").cast("double").alias("b"), F.greatest(F.lit(2.0), F.col("size") * 0.25).alias("t"))
    got = seen.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("chars"), (F.max("y1") - F.min("y0")).alias("tall"), F.array_sort(F.collect_list(entry)).alias("g"))
    none = F.array().cast("array<double>")
    known = lambda acc, x: (F.size(acc) >= 3) | F.exists(acc, lambda b: F.abs(x["b"] - b) <= x["t"])
    rows = F.aggregate("g", none, lambda acc, x: F.when(known(acc, x), acc).otherwise(F.concat(acc, F.array(x["b"]))))
    return got.where("chars >= 80").withColumn("rows", F.size(rows)).join(pages.select("doc", "page", "height"), ["doc", "page"]).where((F.col("rows") >= 3) & (F.col("tall") >= 0.25 * F.col("height"))).select("doc", "page")


def to_recognise(pages: DataFrame, images: DataFrame, glyphs: DataFrame, force: bool = False) -> DataFrame:
    """doc, page, scale of pages to read as pictures: all if forced, else those of a dominant picture without rich text."""
    scale = capped(F.col("width"), F.col("height"), 3, 3200)
    if force:
        return pages.select("doc", "page", scale.alias("scale"))
    wanted = image_pages(pages, images, dominant=True).join(rich_text(glyphs, pages), ["doc", "page"], "left_anti")
    return pages.join(wanted, ["doc", "page"], "left_semi").select("doc", "page", scale.alias("scale"))


def with_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """pages with the background and objects of recognised ones in place of their own.

    recognised: doc, page, background, lines, images, shapes; one without any of the three doesn't count (P12).
    """
    some = recognised.where("size(lines) > 0 or size(images) > 0 or size(shapes) > 0")
    other = some.select("doc", "page", F.col("background").alias("new"), F.lit(True).alias("recognised"))
    both = pages.join(other, ["doc", "page"], "left")
    return both.withColumn("background", F.coalesce("new", "background")).withColumn("recognised", F.coalesce("recognised", F.lit(False))).drop("new")


def native_only(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages whose own objects are to be read."""
    return pages.join(recognised.select("doc", "page"), ["doc", "page"], "left_anti")


def surviving_lines(native: Column, recognised: Column) -> Column:
    """Lines of a page's own text that recognition hasn't read: with letters or digits, and not contained in its text."""
    other = comparable(recognised)
    return F.filter(lines(native), lambda x: (comparable(x) != "") & ~other.contains(comparable(x)))


def merged_text(native: Column, recognised: Column) -> Column:
    """Recognised text, then the native lines that survive, trimmed."""
    return strip(F.concat_ws("\n", F.array(recognised), surviving_lines(native, recognised)))


def document_text(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """doc, text, error: pages in order, each under its heading, parted by a blank line (A21, SK15, R19).

    A blank page has its heading too (Q5); a document of blank pages alone is an error.
    """
    part = F.concat(F.lit("===== 第 "), F.col("place").cast("string"), F.lit(" 页 =====\n"), F.col("body"))
    placed = pages.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(page))).withColumn("body", strip(F.coalesce(text, F.lit(""))))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda p: p["part"])
    got = placed.groupBy(doc).agg(F.array_join(parts, "\n\n").alias("text"), F.bool_or(F.col("body") != "").alias("any"))
    return got.select(doc, F.when(F.col("any"), F.col("text")).alias("text"), F.when(~F.col("any"), "no text").alias("error"))


def numbered(objects: DataFrame, keys: list[str]) -> DataFrame:
    """seq counts a page's objects anew: graphics below text, each in the order they had."""
    layer = F.when(F.col("kind") == "text", 1).otherwise(0)
    return objects.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(layer, "seq", "n")) - 1)


def page_objects(texts: DataFrame, graphics: DataFrame, keys: list[str]) -> DataFrame:
    """Text and graphics of pages in one relation, numbered (U5, R17); what one of them lacks is null."""
    return numbered(texts.unionByName(graphics, allowMissingColumns=True), keys)


def canvas(pages: DataFrame, doc: str = "doc", page: str = "page", side: float = 40.0, unit: float = 72.0) -> DataFrame:
    """pages with the document's canvas and the page's place on it, in inches (W7, SK6, F12).

    The first page makes the canvas, shrunk to a side of ``side``; all pages are fitted and centred.
    """
    first = Window.partitionBy(doc).orderBy(page)
    w0, h0 = F.first("width").over(first) / unit, F.first("height").over(first) / unit
    shrink = F.least(F.lit(1.0), F.lit(side) / F.greatest(w0, h0))
    out = pages.withColumns({"canvas_w": w0 * shrink, "canvas_h": h0 * shrink})
    fit = F.least(F.col("canvas_w") / (F.col("width") / unit), F.col("canvas_h") / (F.col("height") / unit))
    out = out.withColumn("scale", fit)
    return out.withColumns({"left": (F.col("canvas_w") - F.col("width") / unit * fit) / 2, "top": (F.col("canvas_h") - F.col("height") / unit * fit) / 2})


def frames_used(frames: DataFrame, policy: str) -> DataFrame:
    """Frames of pictures (file, ext, frame, animated) that become pages (SC10, T8, Q1).

    first: one of each; tiff: all of tiff files, else one; still: all of files that aren't animated.
    """
    tiff = F.lower("ext").isin("tif", "tiff")
    every = {"first": F.lit(False), "tiff": tiff, "still": ~F.col("animated")}[policy]
    return frames.where((F.col("frame") == 0) | every)


def merge_map(files: DataFrame, pages: DataFrame) -> DataFrame:
    """batch, target_page, file, page: pages of a batch's files in their order, counted through.

    files: batch, file, ord; pages: file, page. Files before a file shift its pages by their number, so
    a batch's pages are never brought together.
    """
    counts = pages.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("batch").orderBy("ord", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.join(counts, "file").withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("batch", "file").orderBy("page"))
    return starts.join(pages, "file").select("batch", (F.col("start") + place).cast("long").alias("target_page"), "file", "page")


def nearest_trace(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """page, n, seq: of traces of a span's first character the nearest to its origin, the lowest seqno among equals.

    spans: page, n, ch, x, y, drawn (where no trace has the character); traces: page, seqno, ch, tx, ty.
    """
    far = F.pow(F.col("tx") - F.col("x"), F.lit(2)) + F.pow(F.col("ty") - F.col("y"), F.lit(2))
    best = spans.join(traces, ["page", "ch"], "left").groupBy("page", "n").agg(F.min(F.struct(far.alias("d"), "seqno")).alias("b"), F.first("drawn").alias("drawn"))
    return best.select("page", "n", F.coalesce("b.seqno", "drawn").cast("long").alias("seq"))
