"""Objects of pages: recognised text and graphics on the page's scale, fonts, drawings, pictures to shrink.

(A9, A16, J4, P17, P18, R5, R6, R17, SC13, D11, D13, D14)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, flags, pack_rgb

# Family, file, bold and italic of fonts looked for, in their order.
FONTS = [
    ("Arial", "arial.ttf", False, False),
    ("Arial", "arialbd.ttf", True, False),
    ("Times New Roman", "times.ttf", False, False),
    ("Times New Roman", "timesbd.ttf", True, False),
    ("Calibri", "calibri.ttf", False, False),
    ("Calibri", "calibrib.ttf", True, False),
    ("Cambria", "cambria.ttc", False, False),
    ("Cambria", "cambriab.ttf", True, False),
    ("Microsoft YaHei", "msyh.ttc", False, False),
    ("Microsoft YaHei", "msyhbd.ttc", True, False),
    ("SimSun", "simsun.ttc", False, False),
    ("Times New Roman", "timesi.ttf", False, True),
    ("Arial", "ariali.ttf", False, True),
    ("Georgia", "georgia.ttf", False, False),
    ("Georgia", "georgiab.ttf", True, False),
    ("Garamond", "gara.ttf", False, False),
    ("Garamond", "garabd.ttf", True, False),
    ("Trebuchet MS", "trebuc.ttf", False, False),
    ("Trebuchet MS", "trebucbd.ttf", True, False),
    ("Arial Narrow", "arialn.ttf", False, False),
    ("Arial Narrow", "arialnb.ttf", True, False),
]
# Quality and longest side of pictures by level of compression; lossless leaves them.
LEVELS = [
    ("balanced", 80, 2400),
    ("strong", 60, 1600),
]
#: Bytes under which a picture isn't worth shrinking.
LEAST_BYTES = 20_000


def fonts(spark: SparkSession) -> DataFrame:
    """ord, family, file, bold, italic."""
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FONTS)], "ord int, family string, file string, bold boolean, italic boolean")


def with_font_files(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows (family, bold, italic) with the first file of just that style, or null."""
    keys = ["family", "bold", "italic"]
    first = catalogue.groupBy(*keys).agg(F.min_by("file", "ord").alias("file"))
    return rows.join(F.broadcast(first), keys, "left")


def shrinkable(images: DataFrame, level: str = "balanced") -> DataFrame:
    """doc, xref, quality, bound, scale of the pictures of files to encode anew.

    images: doc, page, n, xref, mask, colours (of its space), bytes, alpha, width, height. A picture
    that stands on several pages comes once. Those with a mask, transparency, or other than one or
    three colours (CMYK among them) stay as they are, as do small ones.
    """
    options = {k: (q, b) for k, q, b in LEVELS}
    fits = (F.coalesce("mask", F.lit(0)) == 0) & F.col("colours").isin(1, 3) & (F.col("bytes") >= LEAST_BYTES) & ~F.col("alpha")
    chosen = images.where(fits & F.lit(level in options))
    quality, bound = options.get(level, (None, None))
    once = chosen.groupBy("doc", "xref").agg(F.min_by(F.struct("width", "height"), F.struct("page", "n")).alias("s"))
    scale = F.least(F.lit(1.0), F.lit(bound).cast("double") / F.greatest("s.width", "s.height"))
    return once.select("doc", "xref", F.lit(quality).cast("int").alias("quality"), F.lit(bound).cast("int").alias("bound"), scale.alias("scale"))


def glyph_part(left: Column, top: Column, width: Column, height: Column, area: Column, crop_w: Column, crop_h: Column, flat: Column, chars: Column) -> Column:
    """Whether a component of a line's crop is part of its letters (P17, A.14)."""
    tiny = area < F.greatest(F.lit(3.0), 0.10 * crop_h)
    rule = (width > 4 * crop_h) & (height < 0.18 * crop_h)
    most = area > 0.70 * crop_h * crop_w
    edge = (left == 0) | (top == 0) | (left + width == crop_w) | (top + height == crop_h)
    letter = flat & (chars > 3) & (width < 2.5 * crop_h) & (height > 0.30 * crop_h) & (area < 0.18 * crop_h * crop_w)
    return ~tiny & ~rule & ~most & (~edge | letter)


def text_objects(lines: DataFrame) -> DataFrame:
    """Recognised lines as text objects in points.

    lines: page, n, width (of the picture), page_width, x0 to y1, px0, py0, px1, py1 (its first two
    points), size_px, family, bold, italic, r, g, b, text, width_ratio, fit.
    """
    k = F.col("page_width") / F.col("width")
    return lines.select(
        "page", "n", F.lit("text").alias("kind"), *((F.col(c) * k).alias(c) for c in ("x0", "y0", "x1", "y1")), (F.col("size_px") * k).alias("size"),
        (F.col("y0") * k + 0.92 * F.col("size_px") * k).alias("origin_y"), F.col("family").alias("font"), flags(F.col("bold"), F.col("italic")).alias("flags"),
        pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("color"), "text", F.col("n").alias("seq"), F.coalesce("width_ratio", F.lit(1.0)).alias("width_ratio"), F.coalesce("fit", F.lit(0.0)).alias("fit"),
        angle(F.col("px0"), F.col("py0"), F.col("px1"), F.col("py1")).alias("angle"),
    )


def graphic_objects(shapes: DataFrame, images: DataFrame) -> DataFrame:
    """Recognised shapes and pictures of a page in points, numbered by seq.

    shapes: page, n, sx, sy, x0 to y1, type, color, fill, line_color, line_width, seq; images: page, n,
    sx, sy, x0 to y1, path, seq. Other shapes than rectangles, ellipses and lines are left out. A line
    has no fill and its colour as stroke; other shapes the reverse. Channels are clamped, as 0 to 1.
    """
    unit = lambda c: F.transform(c, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)) / F.lit(255.0))
    line = F.col("type") == "line"
    colour = F.coalesce("color", F.array(*(F.lit(0),) * 3))
    placed = [(F.col(c) * F.col(s)).alias(c) for c, s in (("x0", "sx"), ("y0", "sy"), ("x1", "sx"), ("y1", "sy"))]
    drawn = shapes.where(F.col("type").isin("rect", "ellipse", "line")).select(
        "page", "n", F.lit("shape").alias("kind"), *placed, F.col("type").alias("geometry"), unit(F.coalesce("fill", F.when(~line, colour))).alias("fill"), unit(F.coalesce("line_color", F.when(line, colour))).alias("stroke"),
        (F.coalesce("line_width", F.lit(1.0)) * F.col("sx")).alias("line_width"), F.coalesce("seq", "n").alias("seq"),
    )
    pictures = images.select("page", "n", F.lit("image").alias("kind"), *placed, "path", F.coalesce("seq", "n").alias("seq"))
    both = drawn.unionByName(pictures, allowMissingColumns=True)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("page").orderBy("seq", F.col("kind") == "image", "n")) - 1)


def drawing_kind(items: Column, fill_opacity: Column, stroke_opacity: Column) -> Column:
    """native for one opaque rectangle, error for an item of an unknown kind, else picture."""
    opaque = (F.coalesce(fill_opacity, F.lit(1.0)) == 1) & (F.coalesce(stroke_opacity, F.lit(1.0)) == 1)
    known = F.forall(items, lambda k: k.isin("l", "c", "re", "qu"))
    return F.when(~known, "error").when((F.size(items) == 1) & (F.element_at(items, 1) == "re") & opaque, "native").otherwise("picture")
