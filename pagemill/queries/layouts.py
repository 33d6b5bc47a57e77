"""Queries over boxes, paragraphs, pages and pictures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import flow, pages, paragraphs, raster, recognition
from ..plans import media
from ..sources.tables import table
from .fixtures import BOXES, COLOURS, LINES, PARAGRAPH_LINES, SAMPLES, SPANS, boxes, colours, lines, paragraph_lines, samples, spans, values
from .plans import query

D = "::DOUBLE"
SIZES = [(1, 1000, 700), (2, 1800, 900), (3, 1801, 900), (4, 4000, 3000), (5, 2560, 1400), (6, 1400, 5000), (7, 1, 1), (8, 0, 2000), (9, 3720, 2560)]


def origins(side: str) -> str:
    return f"list_sort(list_distinct(list_concat(list_filter(range(0, greatest({side}, 1), 1160), lambda x: x <= greatest(0, {side} - 1400)), [greatest(0, {side} - 1400)])))"


@query(f"""
WITH s AS (SELECT id, w, h FROM {values(SIZES, 'id, w, h')}),
t AS (SELECT id, w, h, y, unnest({origins('w')}) AS x FROM (SELECT id, w, h, unnest({origins('h')}) AS y FROM s WHERE greatest(w, h) > 1800))
SELECT id, 0::INT AS x, 0::INT AS y, w::INT AS w, h::INT AS h, false AS tile FROM s
UNION ALL SELECT id, x::INT, y::INT, least(1400, w)::INT, least(1400, h)::INT, true FROM t
""")
def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in which a picture is read."""
    rows = spark.createDataFrame(SIZES, "id int, w int, h int")
    return rows.select("id", F.inline(geo.tiles(F.col("w"), F.col("h"))))


@query(f"""
WITH {BOXES}, m AS (SELECT page, n, text, confidence, x0, y0, x1, y1, n % 3 <> 0 AS tile, CASE n % 3 WHEN 1 THEN 30 WHEN 2 THEN 480 ELSE 0 END AS x, CASE n % 3 WHEN 1 THEN 15 ELSE 0 END AS y, CASE n % 3 WHEN 0 THEN 1000 ELSE 400 END AS w, CASE n % 3 WHEN 0 THEN 2000 ELSE 300 END AS h FROM boxes),
r AS (SELECT *, x0 - x AS a0, y0 - y AS b0, x1 - x AS a1, y1 - y AS b1 FROM m)
SELECT page, n, trim(text) AS text, x0, y0, x1, y1 FROM r WHERE confidence >= 0.5 AND NOT (tile AND ((x > 0 AND a0 < 8) OR (y > 0 AND b0 < 8) OR (x + w < 1000 AND a1 > w - 8) OR (y + h < 2000 AND b1 > h - 8)))
""")
def tile_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on the page, without those that an inner edge of a tile cuts."""
    n = F.col("n") % 3
    x, y = F.when(n == 1, 30).when(n == 2, 480).otherwise(0), F.when(n == 1, 15).otherwise(0)
    b = boxes(spark, sf_dir).withColumns({"x": x, "y": y, "w": F.when(n == 0, 1000).otherwise(400), "h": F.when(n == 0, 2000).otherwise(300), "tile": n != 0, "width": F.lit(1000), "height": F.lit(2000)})
    b = b.withColumns({"x0": F.col("x0") - F.col("x"), "x1": F.col("x1") - F.col("x"), "y0": F.col("y0") - F.col("y"), "y1": F.col("y1") - F.col("y")})
    return recognition.located(b).select("page", "n", "text", "x0", "y0", "x1", "y1")


OVERLAP = "(greatest(0, least(k.x1, x.x1) - greatest(k.x0, x.x0)) * greatest(0, least(k.y1, x.y1) - greatest(k.y0, x.y0))) / greatest(1, least((k.x1 - k.x0) * (k.y1 - k.y0), (x.x1 - x.x0) * (x.y1 - x.y0)))"


@query(f"""
WITH {BOXES}, ranked AS (SELECT page, list({{'n': n, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY confidence DESC, length(text) DESC, n) AS r FROM boxes GROUP BY page),
kept AS (SELECT page, list_reduce(list_transform(r, lambda x: [x]), lambda acc, one: CASE WHEN len(list_filter(acc, lambda k: {OVERLAP.replace('x.', 'one[1].')} > 0.60)) > 0 THEN acc ELSE list_concat(acc, one) END) AS kept FROM ranked)
SELECT page, unnest(list_transform(kept, lambda k: k.n)) AS n FROM kept
""".replace("kone[1].", "k."))
def nms_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates left of those that overlap."""
    return recognition.distinct_lines(boxes(spark, sf_dir)).select("page", "n")


FLOW = f"""{BOXES}, m AS (SELECT page, n, CASE WHEN n % 6 = 0 THEN (10 + n % 80)::VARCHAR ELSE trim(text) END AS text, confidence, height, family, fit, x0, y0, x1, y1, n % 3 <> 0 AS tile, CASE n % 3 WHEN 1 THEN 30 WHEN 2 THEN 480 ELSE 0 END AS x, CASE n % 3 WHEN 1 THEN 15 ELSE 0 END AS y, CASE n % 3 WHEN 0 THEN 1000 ELSE 400 END AS w, CASE n % 3 WHEN 0 THEN 2000 ELSE 300 END AS h FROM boxes),
moved AS (SELECT *, x0 - x AS a0, y0 - y AS b0, x1 - x AS a1, y1 - y AS b1 FROM m),
located AS (SELECT * FROM moved WHERE confidence >= 0.5 AND NOT (tile AND ((x > 0 AND a0 < 8) OR (y > 0 AND b0 < 8) OR (x + w < 1000 AND a1 > w - 8) OR (y + h < 2000 AND b1 > h - 8)))),
ranked AS (SELECT page, list({{'n': n, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY confidence DESC, length(text) DESC, n) AS r FROM located GROUP BY page),
kept AS (SELECT page, unnest(list_transform(list_reduce(list_transform(r, lambda x: [x]), lambda acc, one: CASE WHEN len(list_filter(acc, lambda k: {OVERLAP.replace('x.', 'one[1].').replace('kone[1].', 'k.')} > 0.60)) > 0 THEN acc ELSE list_concat(acc, one) END), lambda k: k.n)) AS n FROM ranked),
l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 12, 0), x0, n) - 1 AS place FROM located SEMI JOIN kept USING (page, n)),
s AS (SELECT * FROM (SELECT a.page, a.n, a.place, a.text, a.height, b.family, b.fit, row_number() OVER (PARTITION BY a.page, a.n ORDER BY b.fit DESC, b.n) AS r FROM l a JOIN l b ON a.page = b.page AND a.text = b.text AND b.height / a.height > 0.85 AND b.height / a.height < 1.18) WHERE r = 1),
d AS (SELECT * FROM s WHERE regexp_full_match(text, '[0-9]{{2}}')),
v AS (SELECT a.page, a.n, b.family, count(*) AS votes, max(b.fit) AS fit, sum(count(*)) OVER (PARTITION BY a.page, a.n) AS peers FROM d a JOIN d b ON a.page = b.page AND b.height / a.height > 0.72 AND b.height / a.height < 1.4 GROUP BY a.page, a.n, b.family),
o AS (SELECT page, n, family AS lf, fit AS lt FROM (SELECT *, row_number() OVER (PARTITION BY page, n ORDER BY votes DESC, family) AS r FROM v) WHERE r = 1 AND peers >= 3),
lines AS (SELECT page, n, place, text, CASE WHEN lf IS NULL THEN family ELSE lf END AS family, CASE WHEN lf IS NULL THEN fit ELSE lt END AS fit FROM s LEFT JOIN o USING (page, n))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n") % 3
    x, y = F.when(n == 1, 30).when(n == 2, 480).otherwise(0), F.when(n == 1, 15).otherwise(0)
    text = F.when(F.col("n") % 6 == 0, (10 + F.col("n") % 80).cast("string")).otherwise(F.col("text"))
    b = boxes(spark, sf_dir).withColumns({"text": text, "x": x, "y": y, "w": F.when(n == 0, 1000).otherwise(400), "h": F.when(n == 0, 2000).otherwise(300), "tile": n != 0, "width": F.lit(1000), "height": F.lit(2000)})
    return b.withColumns({"x0": F.col("x0") - F.col("x"), "x1": F.col("x1") - F.col("x"), "y0": F.col("y0") - F.col("y"), "y1": F.col("y1") - F.col("y")})


@query(f"WITH {FLOW} SELECT page, n, place, text, family, fit FROM lines")
def recognised_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an engine's candidates to a page's lines."""
    got = flow.recognised_lines(candidates(spark, sf_dir))
    return got.select("page", "n", F.col("place").cast("long").alias("place"), "text", "family", "fit")


@query(f"WITH {FLOW} SELECT page, string_agg(text, chr(10) ORDER BY place) AS text FROM lines GROUP BY page")
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of recognised pages."""
    return flow.page_texts(flow.recognised_lines(candidates(spark, sf_dir)))


@query(f"WITH {BOXES} SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 12, 0), x0, n) - 1 AS place FROM boxes")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the order they are read."""
    return recognition.reading_order(boxes(spark, sf_dir)).select("page", "n", F.col("place").cast("long").alias("place"))


@query(f"""
WITH {BOXES}, r AS (SELECT page, n, text AS t0, confidence AS c0, 'x' || n AS t1, confidence + (n % 3) / 50{D} AS c1, CASE WHEN n % 4 = 0 THEN ' ' ELSE 'y' || n END AS t2, confidence + (n % 6) / 50{D} AS c2 FROM boxes),
s AS (SELECT *, c0 < 0.93 AND c1 > c0 + 0.02 AS a1 FROM r), t AS (SELECT *, CASE WHEN a1 THEN t1 ELSE t0 END AS t, CASE WHEN a1 THEN c1 ELSE c0 END AS c FROM s),
u AS (SELECT *, c < 0.93 AND c2 > c + 0.02 AND trim(t2) <> '' AS a2 FROM t)
SELECT page, n, CASE WHEN a2 THEN t2 ELSE t END AS text, round(CASE WHEN a2 THEN c2 ELSE c END, 9) AS score FROM u
""")
def retry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the reading kept after further ones."""
    n, c = F.col("n"), F.col("confidence")
    reading = lambda t, s: F.struct(t.alias("text"), s.cast("double").alias("score"))
    more = F.array(reading(F.concat(F.lit("x"), n.cast("string")), c + (n % 3) / 50), reading(F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("y"), n.cast("string"))), c + (n % 6) / 50))
    got = boxes(spark, sf_dir).withColumn("r", recognition.retried(c, F.col("text"), more))
    return got.select("page", "n", "r.text", F.round("r.score", 9).alias("score"))


@query(f"""
WITH {BOXES}, p AS (SELECT a.page, a.n, b.n AS m, b.family, b.fit FROM boxes a JOIN boxes b ON a.page = b.page AND a.text = b.text AND b.height / a.height > 0.85 AND b.height / a.height < 1.18)
SELECT page, n, family, fit FROM (SELECT *, row_number() OVER (PARTITION BY page, n ORDER BY fit DESC, m) AS r FROM p) WHERE r = 1
""")
def style_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of lines of one text."""
    return recognition.style_peers(boxes(spark, sf_dir))


@query(f"""
WITH {BOXES}, labels AS (SELECT page, n, (10 + n % 80)::VARCHAR AS text, height, family, fit FROM boxes WHERE n % 2 = 0),
p AS (SELECT a.page, a.n, b.n AS m, b.family, b.fit FROM labels a JOIN labels b ON a.page = b.page AND b.height / a.height > 0.72 AND b.height / a.height < 1.4),
v AS (SELECT page, n, family, count(*) AS votes, max(fit) AS fit, sum(count(*)) OVER (PARTITION BY page, n) AS peers FROM p GROUP BY page, n, family)
SELECT page, n, family, fit FROM (SELECT *, row_number() OVER (PARTITION BY page, n ORDER BY votes DESC, family) AS r FROM v) WHERE r = 1 AND peers >= 3
""")
def number_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style of labels of two digits."""
    b = boxes(spark, sf_dir).withColumn("text", F.when(F.col("n") % 2 == 0, (10 + F.col("n") % 80).cast("string")).otherwise("word"))
    return recognition.number_peers(b)


@query(f"""
WITH {BOXES}, b AS (SELECT page, n // 6 AS paragraph, n, text, family, CASE WHEN n % 7 = 0 THEN NULL ELSE fit END AS fit, flags + CASE WHEN (n // 6) % 3 = 0 THEN 2 ELSE 0 END AS flags, size FROM boxes),
v AS (SELECT page, paragraph, family, sum(length(text) * coalesce(fit, 0.65{D})) AS votes, min(n) AS first FROM b GROUP BY ALL),
f AS (SELECT page, paragraph, family FROM (SELECT *, row_number() OVER (PARTITION BY page, paragraph ORDER BY votes DESC, first) AS r FROM v) WHERE r = 1)
SELECT page, paragraph::BIGINT AS paragraph, family, bold, italic, size FROM f JOIN (SELECT page, paragraph, avg(CASE WHEN flags & 16 = 0 THEN 1.0 ELSE 0.0 END) < 0.30 AS bold, bool_and(flags & 2 <> 0) AS italic, median(size) AS size FROM b GROUP BY ALL) USING (page, paragraph)
""")
def font_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One style for the lines of a paragraph."""
    k = F.floor(F.col("n") / 6)
    b = boxes(spark, sf_dir).withColumns({"paragraph": k, "fit": F.when(F.col("n") % 7 == 0, None).otherwise(F.col("fit")), "flags": F.col("flags") + F.when(k % 3 == 0, 2).otherwise(0)})
    return recognition.paragraph_style(b, ["page", "paragraph"])


@query(f"""
WITH {BOXES}, p AS (SELECT a.page, a.n, b.n AS m, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS p, (b.x1 - b.x0) * (b.y1 - b.y0) AS q, degrees(atan2(b.y0 - a.y0, b.x0 - a.x0)) AS angle FROM boxes a JOIN boxes b ON a.page = b.page AND b.n = a.n + 1)
SELECT page, n, round(i / greatest(1, least(p, q)), 9) AS overlap, round(i / greatest(1, p), 9) AS coverage, round(angle, 6) AS angle FROM p
""")
def overlap_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, coverage and angle of neighbouring lines."""
    a = boxes(spark, sf_dir).select("page", "n", *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")))
    b = boxes(spark, sf_dir).select("page", (F.col("n") - 1).alias("n"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    p, q = geo.box("a"), geo.box("b")
    return a.join(b, ["page", "n"]).select("page", "n", F.round(geo.overlap(p, q), 9).alias("overlap"), F.round(geo.coverage(p, q), 9).alias("coverage"), F.round(geo.angle(p[0], p[1], q[0], q[1]), 6).alias("angle"))


CROPS = [(1, 100, 80, 0.0, 0.0, 1.0, 1.0), (2, 101, 51, 0.105, 0.25, 0.505, 0.75), (3, 10, 10, 0.5, 0.5, 0.51, 0.55), (4, 10, 10, 0.6, 0.1, 0.5, 0.9), (5, 10, 10, -0.1, 0.0, 1.0, 1.0), (6, 1, 1, 0.2, 0.2, 0.9, 0.8), (7, 1920, 1080, 0.125, 0.5, 0.875, 1.0), (8, 720, 1281, 0.0, 0.0, 0.5, 0.5), (9, 4001, 3000, 0.0, 0.1, 0.3, 0.7)]


@query(f"""
SELECT id, ok, CASE WHEN ok THEN floor(x0 * w)::BIGINT END AS l, CASE WHEN ok THEN floor(y0 * h)::BIGINT END AS t, CASE WHEN ok THEN least(w, greatest(floor(x0 * w)::BIGINT + 1, round_even(x1 * w, 0)::BIGINT)) END AS r, CASE WHEN ok THEN least(h, greatest(floor(y0 * h)::BIGINT + 1, round_even(y1 * h, 0)::BIGINT)) END AS b,
  greatest(1, w // 2)::BIGINT AS half_w, round(least(2.0{D}, 4000.0{D} / greatest(w, h)), 9) AS scale, greatest(2, floor(w * f / 2) * 2)::BIGINT AS fit_w, greatest(2, floor(h * f / 2) * 2)::BIGINT AS fit_h, (ceil(w / 2) * 2)::BIGINT AS even_w
FROM (SELECT *, x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1 AS ok, least(1.0{D}, CASE WHEN w >= h THEN least(1280.0{D} / w, 720.0{D} / h) ELSE least(720.0{D} / w, 1280.0{D} / h) END) AS f FROM {values(CROPS, 'id, w, h, x0, y0, x1, y1')})
""")
def crop_fit_720p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops, halves, capped scales, video sizes."""
    rows = spark.createDataFrame(CROPS, "id int, w int, h int, x0 double, y0 double, x1 double, y1 double")
    w, h = F.col("w"), F.col("h")
    left, top, right, bottom, ok = geo.crop(w, h, geo.box())
    fw, fh = media.fit_720p(w, h)
    return rows.select("id", ok.alias("ok"), left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"), geo.half(w).alias("half_w"), F.round(geo.capped(w, h, 2, 4000), 9).alias("scale"), fw.alias("fit_w"), fh.alias("fit_h"), media.even_size(w).alias("even_w"))


UNITS = [(1, 10.0, 1.1, 50.0, 12, 255, 128, 0), (2, 12.0, 0.4, 300.0, 3, 1, 2, 3), (3, 8.0, 1.0, 90.0, 1, 0, 0, 0), (4, 20.0, 2.5, 10.0, 40, 17, 254, 99)]
MATRICES = [(1, 2.0, 0.0, 0.0, 4.0, 10.0, 20.0), (2, 0.0, 1.0, -1.0, 0.0, 5.0, 5.0), (3, 1.0, 2.0, 2.0, 4.0, 0.0, 0.0), (4, 1.5, 0.5, -0.25, 2.0, -3.0, 7.0)]


@query(f"""
SELECT id, round(greatest(-0.08{D} * size, least(0.25{D} * size, (w - w * ratio) / greatest(1, chars - 1))), 9) AS spacing, r * 65536 + g * 256 + b AS packed, printf('%06X', r * 65536 + g * 256 + b) AS hex, round(sqrt(((r - 10) ^ 2 + (g - 20) ^ 2 + (b - 30) ^ 2){D}), 9) AS distance, round_even(size * 12700, 0)::BIGINT AS emu, greatest(0, least(255, round_even(ratio / 2 * 255, 0)))::INT AS unit
FROM {values(UNITS, 'id, size, ratio, w, chars, r, g, b')}
""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F16, F18, F19, SK13, SK14: letter spacing, colours, units."""
    rows = spark.createDataFrame(UNITS, "id int, size double, ratio double, w double, chars int, r int, g int, b int")
    packed = geo.pack_rgb(F.col("r"), F.col("g"), F.col("b"))
    return rows.select("id", F.round(geo.letter_spacing(F.col("size"), F.col("ratio"), F.col("w"), F.col("chars")), 9).alias("spacing"), packed.alias("packed"), geo.rgb_hex(packed).alias("hex"), F.round(geo.colour_distance(packed, F.lit(10 * 65536 + 20 * 256 + 30)), 9).alias("distance"), F.bround(F.col("size") * geo.EMU_POINT).cast("long").alias("emu"), geo.from_unit(F.col("ratio") / 2).alias("unit"))


@query(f"""
SELECT id, ok, {', '.join(f'CASE WHEN ok THEN round(({e}) / det, 9) + 0.0{D} END AS m{i}' for i, e in enumerate(('d', '-b', '-c', 'a', 'c * f - d * e', 'b * e - a * f')))}
FROM (SELECT *, a * d - b * c AS det, abs(a * d - b * c) >= 1e-10 AS ok FROM {values(MATRICES, 'id, a, b, c, d, e, f')})
""")
def affine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how a placed picture's pixels are found."""
    rows = spark.createDataFrame(MATRICES, "id int, a double, b double, c double, d double, e double, f double")
    inverse, ok = geo.inverse_affine(*(F.col(x) for x in "abcdef"))
    return rows.select("id", ok.alias("ok"), *((F.round(m, 9) + F.lit(0.0)).alias(f"m{i}") for i, m in enumerate(inverse)))


@query(f"""
WITH {SPANS}, o AS (SELECT *, row_number() OVER w AS place, x0 - lag(x1) OVER w AS gap, first_value(size) OVER w AS size0 FROM spans WHERE line IS NOT NULL WINDOW w AS (PARTITION BY page, block, line ORDER BY x0, n)),
g AS (SELECT page, block, line, arg_min(n, place) AS n, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*)::INT AS runs, string_agg(CASE WHEN gap > 0.12{D} * size0 THEN ' ' || text ELSE text END, '' ORDER BY place) AS text FROM o GROUP BY page, block, line)
SELECT page, n, x0, y0, x1, y1, runs, text FROM g UNION ALL SELECT page, n, x0, y0, x1, y1, 1::INT, text FROM spans WHERE line IS NULL
""")
def inline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: spans of a native line as one."""
    return paragraphs.merge_inline(spans(spark, sf_dir)).select("page", "n", "x0", "y0", "x1", "y1", "runs", "text")


GLYPHS = LINES + f""", chars AS (SELECT doc, n, text, unnest(range(length(text)))::INT AS place FROM lines),
glyphs AS (SELECT doc AS page, n, place, substring(text, place + 1, 1) AS ch, (place * 10 + CASE WHEN place % 5 = 4 THEN 3 ELSE 0 END){D} AS x0, (place * 10 + CASE WHEN place % 5 = 4 THEN 3 ELSE 0 END + 8 - place % 3){D} AS x1, 10.0{D} AS size FROM chars)"""


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).where("length(text) > 0")
    each = rows.select(F.col("doc").alias("page"), "n", F.posexplode(F.split("text", "")).alias("place", "ch"))
    x0 = F.col("place") * 10 + F.when(F.col("place") % 5 == 4, 3).otherwise(0)
    return each.select("page", "n", "place", "ch", x0.cast("double").alias("x0"), (x0 + 8 - F.col("place") % 3).cast("double").alias("x1"), F.lit(10.0).alias("size"))


@query(f"""
WITH {GLYPHS}, g AS (SELECT *, x0 - lag(x1) OVER w AS gap, lag(ch) OVER w AS before FROM glyphs WINDOW w AS (PARTITION BY page, n ORDER BY place))
SELECT page, n, string_agg(CASE WHEN gap > 0.18{D} * size AND trim(ch) <> '' AND trim(before) <> '' THEN repeat(' ', greatest(1, round_even(gap / (0.25{D} * size), 0)::INT)) || ch ELSE ch END, '' ORDER BY place) AS text FROM g GROUP BY page, n
""")
def glyph_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces where glyphs stand apart."""
    return paragraphs.spaced(glyphs(spark, sf_dir), ["page", "n"])


ALIKE = f"""(abs(a.angle) <= 3 AND abs(b.angle) <= 3
  AND NOT (a.block IS NOT NULL AND a.block IS DISTINCT FROM b.block AND b.y0 - a.y1 > 0.55{D} * h)
  AND hb / ha > 0.72 AND hb / ha < 1.39 AND b.y0 - a.y0 > 0.30{D} * h AND b.y0 - a.y0 < 2.15{D} * h AND b.y0 - a.y1 >= -0.12{D} * h AND b.y0 - a.y1 <= 1.12{D} * h
  AND length(trim(a.text)) >= 4 AND length(trim(b.text)) >= 4
  AND NOT regexp_matches(b.text, '^\\s*(?:[•●▪◆\\-–]|\\p{{Nd}}{{1,2}}[.)、])\\s+')
  AND sqrt((((a.color >> 16) & 255) - ((b.color >> 16) & 255)) ^ 2 + (((a.color >> 8) & 255) - ((b.color >> 8) & 255)) ^ 2 + ((a.color & 255) - (b.color & 255)) ^ 2) <= 35
  AND NOT coalesce(sqrt((((a.panel >> 16) & 255) - ((b.panel >> 16) & 255)) ^ 2 + (((a.panel >> 8) & 255) - ((b.panel >> 8) & 255)) ^ 2 + ((a.panel & 255) - (b.panel & 255)) ^ 2) > 25, false)
  AND (abs(a.x0 - b.x0) < 0.85{D} * h OR abs((a.x0 + a.x1 - b.x0 - b.x1) / 2) < 0.55{D} * h)
  AND NOT (length(a.text) < 25 AND length(b.text) > 1.5{D} * length(a.text) AND a.flags & 16 <> 0)
  AND NOT (a.width_ratio IS NULL AND abs(a.size - b.size) > 0.18{D} * least(a.size, b.size)))"""
HEIGHTS = f"greatest(1, y1 - y0, 0.70{D} * size)"


@query(f"""
WITH {PARAGRAPH_LINES}, h AS (SELECT *, {HEIGHTS} AS fh FROM plines),
p AS (SELECT a.page, a, b, a.fh AS ha, b.fh AS hb, (a.fh + b.fh) / 2 AS h FROM h a JOIN h b ON a.page = b.page AND a.n <> b.n AND b.n > a.n AND b.n < a.n + 6)
SELECT page, a.n AS a, b.n AS b FROM p WHERE {ALIKE}
""")
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that may follow another, met by bands of a page."""
    return paragraphs.pairs(paragraph_lines(spark, sf_dir))


ISLANDS = f"""{PARAGRAPH_LINES}, h AS (SELECT *, {HEIGHTS} AS fh FROM plines), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, n) AS place FROM h),
j AS (SELECT b.page, b.n, b.place, coalesce({ALIKE}, false) AS joined FROM (SELECT b, a, a.fh AS ha, b.fh AS hb, (a.fh + b.fh) / 2 AS h FROM o b LEFT JOIN o a ON a.page = b.page AND a.place = b.place - 1)),
i AS (SELECT page, n, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY place)::INT AS paragraph FROM j)"""


@query(f"WITH {ISLANDS} SELECT page, n, paragraph FROM i")
def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 by windows: paragraphs of a single column."""
    return paragraphs.islands(paragraph_lines(spark, sf_dir))


@query(f"""
WITH {ISLANDS}, r AS (SELECT p.*, paragraph FROM plines p JOIN i USING (page, n)),
s AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY page, paragraph ORDER BY n) AS step FROM r),
g AS (SELECT page, paragraph, count(*)::BIGINT AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, median(step) AS step, string_agg(text, chr(10) ORDER BY n) AS text, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS middles, max(x0) - min(x0) AS lefts, arg_min(size, n) AS size FROM s GROUP BY page, paragraph)
SELECT page, paragraph, lines, x0, y0, x1, y1, text, step AS line_spacing, CASE WHEN middles < lefts AND lefts > 0.35{D} * size THEN 'center' ELSE 'left' END AS alignment FROM g
""")
def paragraph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, spacing, alignment and text of paragraphs."""
    rows = paragraph_lines(spark, sf_dir)
    return paragraphs.summary(rows.join(paragraphs.islands(rows), ["page", "n"]), ["page", "paragraph"])


@query()
def paragraph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by the greedy chain, with lines that part them."""
    rows = paragraph_lines(spark, sf_dir)
    parts = rows.where("n % 10 = 9").select("page", "x0", (F.col("y1") + 1).alias("y0"), "x1", (F.col("y1") + 2).alias("y1"), F.lit("line").alias("geometry"))
    return paragraphs.chain(rows, parts, F.lit(960.0 * 5400.0))


@query(f"""
WITH {PARAGRAPH_LINES}, g AS (SELECT page, n, x0, y1 + 1 AS y0, x1, y1 + 2 AS y1, 'line' AS geometry FROM plines WHERE n % 5 = 4 UNION ALL SELECT page, n, 0.0{D}, y0 - 50, 2000.0{D}, y1 + 500, 'rect' FROM plines WHERE n % 5 = 1),
p AS (SELECT a.page, a.n, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM plines a JOIN plines b ON a.page = b.page AND b.n = a.n + 1)
SELECT p.page, p.n, count(g.page)::BIGINT AS barriers FROM p LEFT JOIN g ON g.page = p.page AND abs(g.n - p.n) < 8
  AND NOT (g.x0 <= least(ax0, bx0) AND g.x1 >= greatest(ax1, bx1) AND g.y0 <= ay0 AND g.y1 >= by1)
  AND greatest(0, least(ax1, bx1, g.x1) - greatest(ax0, bx0, g.x0)) > 0.35{D} * least(ax1 - ax0, bx1 - bx0)
  AND ((g.y0 <= (ay1 + by0) / 2 AND g.y1 >= (ay1 + by0) / 2) OR (g.geometry = 'line' AND g.y0 >= ay1 AND g.y0 <= by0)) GROUP BY p.page, p.n
""")
def separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphics between neighbouring lines."""
    rows = paragraph_lines(spark, sf_dir).select("page", "n", "x0", "y0", "x1", "y1")
    line = rows.where("n % 5 = 4").select("page", "n", "x0", (F.col("y1") + 1).alias("y0"), "x1", (F.col("y1") + 2).alias("y1"), F.lit("line").alias("geometry"))
    rect = rows.where("n % 5 = 1").select("page", "n", F.lit(0.0).alias("x0"), (F.col("y0") - 50).alias("y0"), F.lit(2000.0).alias("x1"), (F.col("y1") + 500).alias("y1"), F.lit("rect").alias("geometry"))
    g = line.unionByName(rect).select(F.col("page").alias("gp"), F.col("n").alias("gn"), *(F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1", "geometry")))
    own = [c for c in rows.columns if c not in ("page", "n")]
    a = rows.select("page", "n", *(F.col(c).alias(f"a_{c}") for c in own))
    b = rows.select("page", (F.col("n") - 1).alias("n"), *(F.col(c).alias(f"b_{c}") for c in own))
    both = a.join(b, ["page", "n"])
    hit = both.join(g, (F.col("page") == F.col("gp")) & (F.abs(F.col("gn") - F.col("n")) < 8) & paragraphs.separates("a_", "b_", "g_"), "left")
    return hit.groupBy("page", "n").agg(F.count("gp").alias("barriers"))


IMAGE_PAGES = f"""pg AS (SELECT conv_id AS doc, turn AS page, (500 + turn % 3 * 100){D} AS width, 700.0{D} AS height, CASE WHEN turn % 4 = 0 THEN ' ' ELSE text END AS text FROM conversations),
im AS (SELECT doc, page, 0 AS k, -20.0{D} AS x0, 0.0{D} AS y0, (page % 5 * 150){D} AS x1, 650.0{D} AS y1 FROM pg WHERE page % 2 = 0 UNION ALL SELECT doc, page, 1, 10.0{D}, 10.0{D}, 60.0{D}, 60.0{D} FROM pg WHERE page % 3 = 0)"""


def image_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = F.col("turn")
    pg = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), t.alias("page"), (500 + t % 3 * 100).cast("double").alias("width"), F.lit(700.0).alias("height"), F.when(t % 4 == 0, " ").otherwise(F.col("text")).alias("text"))
    a = pg.where("page % 2 = 0").select("doc", "page", F.lit(-20.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("page") % 5 * 150).cast("double").alias("x1"), F.lit(650.0).alias("y1"))
    b = pg.where("page % 3 = 0").select("doc", "page", F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(60.0).alias("y1"))
    return pg, a.unionByName(b)


PAGE_PART = "greatest(0, least(x1, width) - greatest(x0, 0)) * greatest(0, least(y1, height) - greatest(y0, 0)) / (width * height)"


@query(f"""
WITH {IMAGE_PAGES}, m AS (SELECT doc, page, max({PAGE_PART}) AS part, bool_or(trim(text) <> '') AS has_text FROM im JOIN pg USING (doc, page) GROUP BY doc, page)
SELECT doc, page, part >= 0.5 AS dominant FROM m WHERE part >= 0.5 OR NOT has_text
""")
def image_page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are pictures, and of one picture above all."""
    pg, im = image_pages(spark, sf_dir)
    wide = pages.image_pages(pg, im, dominant=True).withColumn("dominant", F.lit(True))
    return pages.image_pages(pg, im).join(wide, ["doc", "page"], "left").select("doc", "page", F.coalesce("dominant", F.lit(False)).alias("dominant"))


@query(f"""
WITH {IMAGE_PAGES}, c AS (SELECT doc, page, text, height, unnest(range(length(text)))::INT AS n FROM pg),
g AS (SELECT doc, page, height, n, substring(text, n + 1, 1) AS ch, (20 + (n // 40) * (CASE WHEN doc % 2 = 0 THEN 90 ELSE 3 END)){D} AS base FROM c WHERE n % 11 <> 10 AND trim(substring(text, n + 1, 1), ' ' || chr(9) || chr(10)) <> ''),
r AS (SELECT doc, page, any_value(height) AS height, count(*) AS chars, count(DISTINCT CASE WHEN doc % 2 = 0 THEN base ELSE floor((base - 20) / 3) END) AS bases, max(base) - min(base - 10) AS tall FROM g GROUP BY doc, page),
rich AS (SELECT doc, page FROM r WHERE chars >= 80 AND bases >= 3 AND tall >= 0.25 * height),
m AS (SELECT doc, page FROM im JOIN pg USING (doc, page) GROUP BY doc, page HAVING max({PAGE_PART}) >= 0.5)
SELECT doc, page, round(least(3.0{D}, 3200.0{D} / greatest(width, height)), 9) AS scale FROM pg SEMI JOIN m USING (doc, page) ANTI JOIN rich USING (doc, page)
""")
def recognition_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to be read as pictures, and their scale."""
    pg, im = image_pages(spark, sf_dir)
    each = pg.where("length(text) > 0").select("doc", "page", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("n"))
    base = (20 + F.floor(F.col("n") / 40) * F.when(F.col("doc") % 2 == 0, 90).otherwise(3)).cast("double")
    g = each.select("doc", "page", "n", F.substring("text", F.col("n") + 1, F.lit(1)).alias("ch"), base.alias("baseline"), F.lit(8.0).alias("size"), (base - 10).alias("y0"), base.alias("y1"), (F.col("n") % 11 != 10).alias("visible"))
    got = pages.to_recognise(pg, im, g)
    return got.select("doc", "page", F.round("scale", 9).alias("scale"))


@query("""
SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 3 = 1 AND turn % 6 <> 4 THEN 'r' || turn ELSE 'n' || turn END AS background, turn % 3 = 1 AND turn % 6 <> 4 AS recognised FROM conversations
""")
def page_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised pages in place of their own; empty results don't count."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    own = c.select(F.col("conv_id").alias("doc"), t.alias("page"), F.concat(F.lit("n"), t.cast("string")).alias("background"))
    none, some = F.array().cast("array<int>"), F.array(F.lit(1))
    read = c.where("turn % 3 = 1").select(F.col("conv_id").alias("doc"), t.alias("page"), F.concat(F.lit("r"), t.cast("string")).alias("background"), F.when(t % 6 != 4, some).otherwise(none).alias("lines"), none.alias("images"), none.alias("shapes"))
    return pages.with_recognised(own, read)


@query("SELECT conv_id AS doc, turn AS page FROM conversations WHERE turn % 3 <> 1")
def native_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that recognition didn't take."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"))
    return pages.native_only(own, own.where("page % 3 = 1"))


@query(f"""
WITH {BOXES}, o AS (SELECT page, n, 'text' AS kind, text, NULL AS geometry, n AS seq FROM boxes WHERE n % 2 = 0 UNION ALL SELECT page, n, 'shape', NULL, 'rect', 1000 - n FROM boxes WHERE n % 2 = 1)
SELECT page, n, kind, text, geometry, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN kind = 'text' THEN 1 ELSE 0 END, seq, n) - 1 AS seq FROM o
""")
def resequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a page in the order they are painted."""
    b = boxes(spark, sf_dir)
    t = b.where("n % 2 = 0").select("page", "n", F.lit("text").alias("kind"), "text", F.col("n").alias("seq"))
    g = b.where("n % 2 = 1").select("page", "n", F.lit("shape").alias("kind"), F.lit("rect").alias("geometry"), (1000 - F.col("n")).alias("seq"))
    return pages.page_objects(t, g, ["page"]).select("page", "n", "kind", "text", "geometry", F.col("seq").cast("long").alias("seq"))


@query(f"""
WITH p AS (SELECT conv_id AS doc, turn AS page, (400 + turn * 100 + conv_id % 7 * 500){D} AS width, (600 + turn % 3 * 50){D} AS height FROM conversations),
f AS (SELECT *, first_value(width) OVER w / 72 AS w0, first_value(height) OVER w / 72 AS h0 FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)),
c AS (SELECT *, w0 * least(1.0{D}, 40.0{D} / greatest(w0, h0)) AS cw, h0 * least(1.0{D}, 40.0{D} / greatest(w0, h0)) AS ch FROM f),
s AS (SELECT *, least(cw / (width / 72), ch / (height / 72)) AS s FROM c)
SELECT doc, page, round(cw, 6) AS canvas_w, round(ch, 6) AS canvas_h, round(s, 6) AS scale, round((cw - width / 72 * s) / 2, 6) AS l, round((ch - height / 72 * s) / 2, 6) AS t FROM s
""")
def canvas_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, SK6, F12, F18: pages on the canvas of the first."""
    t, k = F.col("turn"), F.col("conv_id")
    p = table(spark, sf_dir, "conversations").select(k.alias("doc"), t.alias("page"), (400 + t * 100 + k % 7 * 500).cast("double").alias("width"), (600 + t % 3 * 50).cast("double").alias("height"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return pages.canvas(p).select("doc", "page", r("canvas_w", "canvas_w"), r("canvas_h", "canvas_h"), r("scale", "scale"), r("left", "l"), r("top", "t"))


@query("""
WITH f AS (SELECT doc_id AS file, doc_id // 5 AS batch, (doc_id * 7) % 5 AS ord FROM documents), p AS (SELECT doc_id AS file, unnest(range(1 + doc_id % 4)) AS page FROM documents)
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY ord, file, page)::BIGINT AS target_page, file, page::BIGINT AS page FROM f JOIN p USING (file)
""")
def merge_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of merged files."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    return pages.merge_map(d.select(F.floor(k / 5).alias("batch"), k.alias("file"), ((k * 7) % 5).alias("ord")), d.select(k.alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), k % 4)).alias("page")))


FRAMES = [(f, e, i, a) for f, (e, n, a) in enumerate([("tif", 3, False), ("gif", 3, True), ("webp", 2, True), ("png", 1, False), ("TIFF", 2, True), ("gif", 2, False)]) for i in range(n)]


@query(f"""
SELECT p.policy, file, frame FROM {values(FRAMES, 'file, ext, frame, animated')}, (VALUES ('first'), ('tiff'), ('still')) p(policy)
WHERE frame = 0 OR CASE p.policy WHEN 'tiff' THEN lower(ext) IN ('tif', 'tiff') WHEN 'still' THEN NOT animated ELSE false END
""")
def frame_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5, SC10, T8, Q1: frames that become pages."""
    rows = spark.createDataFrame(FRAMES, "file int, ext string, frame int, animated boolean")
    every = [pages.frames_used(rows, p).select(F.lit(p).alias("policy"), "file", "frame") for p in ("first", "tiff", "still")]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query(f"""
WITH {GLYPHS}, s AS (SELECT page, n, ch, x0 AS x, (n * 12){D} AS y FROM glyphs WHERE place = 0), t AS (SELECT page, (n * 3 + place % 7)::BIGINT AS seqno, ch, (place * 10 + n){D} AS tx, (n * 12 + place % 2){D} AS ty FROM glyphs),
b AS (SELECT s.page, s.n, t.seqno, row_number() OVER (PARTITION BY s.page, s.n ORDER BY (tx - x) ^ 2 + (ty - y) ^ 2 NULLS LAST, seqno) AS r FROM s LEFT JOIN t ON s.page = t.page AND s.ch = t.ch)
SELECT page, n, coalesce(seqno, 999)::BIGINT AS seq FROM b WHERE r = 1
""")
def nearest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paint order of a span from its nearest trace."""
    g = glyphs(spark, sf_dir)
    s = g.where("place = 0").select("page", "n", "ch", F.col("x0").alias("x"), (F.col("n") * 12).cast("double").alias("y"), F.lit(999).alias("drawn"))
    t = g.select("page", (F.col("n") * 3 + F.col("place") % 7).cast("long").alias("seqno"), "ch", (F.col("place") * 10 + F.col("n")).cast("double").alias("tx"), (F.col("n") * 12 + F.col("place") % 2).cast("double").alias("ty"))
    return pages.nearest_trace(s, t)


@query(f"""
WITH {SAMPLES}, b AS (SELECT vec, value // 16 AS bin, count(*) AS n, median(value) AS m FROM samples GROUP BY ALL)
SELECT vec, m AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY vec ORDER BY n DESC, bin) AS r FROM b) WHERE r = 1
""")
def dominant_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of the fullest bin."""
    return raster.dominant(samples(spark, sf_dir), ["vec"])


@query(f"WITH {SAMPLES} SELECT vec, round(entropy(value // 8), 9) AS entropy FROM samples GROUP BY vec")
def entropy32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of 32 bins."""
    return raster.entropy(samples(spark, sf_dir), ["vec"]).select("vec", F.round("entropy", 9).alias("entropy"))


PALETTE = f"""{COLOURS}, e AS (SELECT grp, colour, count(*) AS n FROM colours GROUP BY ALL),
bins AS (SELECT grp, (((colour >> 16) & 255) // 12 * 32 + ((colour >> 8) & 255) // 12) * 32 + (colour & 255) // 12 AS bin, sum(n)::BIGINT AS n, arg_min(colour, (-n, colour)) AS colour FROM e GROUP BY grp, bin),
top AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY grp) AS every, row_number() OVER (PARTITION BY grp ORDER BY n DESC, bin) AS r FROM bins) WHERE r <= 80 AND n >= 0.0003 * every)"""
FAR = "sqrt((((k.colour >> 16) & 255) - ((x[1].colour >> 16) & 255)) ^ 2 + (((k.colour >> 8) & 255) - ((x[1].colour >> 8) & 255)) ^ 2 + ((k.colour & 255) - (x[1].colour & 255)) ^ 2)"


@query(f"""
WITH {PALETTE}, l AS (SELECT grp, list({{'bin': bin, 'n': n, 'colour': colour}} ORDER BY r) AS c FROM top GROUP BY grp),
k AS (SELECT grp, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {FAR} <= 20)) > 0 THEN acc ELSE list_concat(acc, x) END) AS c FROM l),
u AS (SELECT grp, unnest(range(len(c)))::INT AS place, unnest(c) AS x FROM k)
SELECT grp, place, x.bin::BIGINT AS bin, x.n AS n, x.colour::INT AS colour FROM u
""")
def palette_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours by frequency, apart from each other."""
    return raster.palette(colours(spark, sf_dir), ["grp"])


SHADES = [(0, 0x000000), (1, 0x787878), (2, 0xC8C8C8), (3, 0x28A028)]
NEAR = "sqrt((((colour >> 16) & 255) - ((shade >> 16) & 255)) ^ 2 + (((colour >> 8) & 255) - ((shade >> 8) & 255)) ^ 2 + ((colour & 255) - (shade & 255)) ^ 2)"


@query(f"""
WITH {COLOURS}, d AS (SELECT grp, place, shade, row_number() OVER (PARTITION BY grp, rid ORDER BY {NEAR}, place) AS r FROM (SELECT *, row_number() OVER () AS rid FROM colours) c, {values(SHADES, 'place, shade')}),
v AS (SELECT grp, place, shade, count(*) AS n, sum(count(*)) OVER (PARTITION BY grp) AS every FROM d WHERE r = 1 GROUP BY grp, place, shade)
SELECT grp, shade::INT AS colour, round(n / every, 9) AS share FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, place) AS r FROM v) WHERE r = 1
""")
def palette_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palette's colour that most samples are nearest to."""
    shades = spark.createDataFrame(SHADES, "place int, colour int")
    return raster.palette_votes(colours(spark, sf_dir), shades, ["grp"]).select("grp", "colour", F.round("share", 9).alias("share"))


GAPS = "gaps AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_id % 3 = 0 OR event_id % 7 = 1 THEN event_id END AS v FROM events)"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select("user_id", k.alias("k"), F.when((F.col("event_id") % 3 == 0) | (F.col("event_id") % 7 == 1), F.col("event_id")).alias("v"))


@query(f"""
WITH {GAPS}, f AS (SELECT user_id, k, max(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS b, min(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM gaps)
SELECT f.user_id, f.k, g.v FROM f LEFT JOIN gaps g ON g.user_id = f.user_id AND g.k = CASE WHEN b IS NULL THEN a WHEN a IS NULL OR a - f.k >= f.k - b THEN b ELSE a END
""")
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled from the nearest row."""
    return raster.nearest_filled(gaps(spark, sf_dir), ["user_id"], "k", "v")


@query(f"""
WITH {GAPS}, r AS (SELECT user_id, k, count(*) OVER w AS n, bool_and(v IS NULL) OVER w AS flat, count(*) OVER (PARTITION BY user_id) AS h FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT user_id, min(CASE WHEN flat AND n = 3 AND k - 1 >= 0.20{D} * h THEN k END) AS start FROM r GROUP BY user_id
""")
def first_flat_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a picture's rows are flat for long enough."""
    g = gaps(spark, sf_dir).withColumn("flat", F.col("v").isNull())
    return raster.first_flat_run(g, ["user_id"], "k", "flat", 3)


@query(f"""
WITH {BOXES}, c AS (SELECT page, n, x1 - x0 AS w, (y1 - y0) * (1 + n % 9) AS h, ((n * 13) % 100) / 100{D} AS fill, 2 + ((n * 29) % 200) / 100{D} AS bits FROM boxes)
SELECT page, n, least(w, h) >= greatest(14.0{D}, 960 / 80{D}) AND w * h * fill >= 0.015{D} * 960 * 1200 AND w * h <= 0.80{D} * 960 * 1200 AND fill >= 0.13 AND ((fill > 0.66 AND bits > 2.85) OR (fill > 0.42 AND bits > 3.25)) AND least(w, h) > 0.055{D} * 960 AS photo,
  abs(w * h * fill / greatest(pi() / 4 * w * h, 1.0{D}) - 1) <= 0.09 AND (n % 10) / 100{D} <= 0.06 AS ellipse FROM c
""")
def photo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components told apart by their measures."""
    n = F.col("n")
    c = boxes(spark, sf_dir).select("page", "n", (F.col("x1") - F.col("x0")).alias("w"), ((F.col("y1") - F.col("y0")) * (1 + n % 9)).alias("h"), (((n * 13) % 100) / 100).alias("fill"), (2 + ((n * 29) % 200) / 100).alias("bits"))
    w, h, fill = F.col("w"), F.col("h"), F.col("fill")
    return c.select("page", "n", raster.photo_like(w, h, fill, F.col("bits"), F.lit(960.0), F.lit(1200.0)).alias("photo"), geo.ellipse_like(w * h * fill, w, h, (n % 10) / 100).alias("ellipse"))


@query(f"""
WITH {BOXES}, b AS (SELECT page, n, x0, y0, x0 + (x1 - x0) * (1 + n % 3) AS x1, y0 + (y1 - y0) * (1 + n % 4) AS y1 FROM boxes),
p AS (SELECT a.page, a.n FROM b a JOIN b o ON a.page = o.page WHERE (greatest(0, least(a.x1, o.x1) - greatest(a.x0, o.x0)) * greatest(0, least(a.y1, o.y1) - greatest(a.y0, o.y0)) / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)) > 0.94 AND (o.x1 - o.x0) * (o.y1 - o.y0) / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)) > 1.3)
  OR (greatest(0, least(a.x1, o.x1) - greatest(a.x0, o.x0)) * greatest(0, least(a.y1, o.y1) - greatest(a.y0, o.y0)) / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)) > 0.15 AND (o.x1 - o.x0) * (o.y1 - o.y0) / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)) > 5))
SELECT page, n FROM b ANTI JOIN p USING (page, n)
""")
def nested_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, A.16: boxes that no larger one swallows."""
    n = F.col("n")
    b = boxes(spark, sf_dir).select("page", "n", "x0", "y0", (F.col("x0") + (F.col("x1") - F.col("x0")) * (1 + n % 3)).alias("x1"), (F.col("y0") + (F.col("y1") - F.col("y0")) * (1 + n % 4)).alias("y1"))
    return raster.without_nested(b).select("page", "n")


@query(f"""
WITH {BOXES}, l AS (SELECT page, CASE WHEN page % 3 = 0 THEN left(text, 3) ELSE text END AS text, confidence FROM boxes)
SELECT page FROM l WHERE page % 2 = 0 GROUP BY page HAVING bool_and(length(text) < 4 AND confidence < 0.97)
""")
def photo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose few unsure marks are no text."""
    b = boxes(spark, sf_dir).withColumn("text", F.when(F.col("page") % 3 == 0, F.left("text", F.lit(3))).otherwise(F.col("text")))
    return raster.whole_page_photo(b, b.where("page % 2 = 1").select("page"))


@query()
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of icons joined to a fixpoint."""
    b = boxes(spark, sf_dir).withColumns({"width": F.lit(960.0), "height": F.lit(1200.0)})
    return raster.merge_boxes(b, ["page"])


@query(f"""
WITH {SAMPLES}, p AS (SELECT vec, pos // 32 AS y, pos % 32 // 4 AS x, pos % 4 AS c, value AS v, max(CASE WHEN pos % 4 = 3 THEN value END) OVER q AS a, max(CASE WHEN pos % 4 = 0 THEN value END) OVER q AS r, max(CASE WHEN pos % 4 = 1 THEN value END) OVER q AS g, max(CASE WHEN pos % 4 = 2 THEN value END) OVER q AS b FROM samples WHERE pos < 64 WINDOW q AS (PARTITION BY vec, pos // 4)),
t AS (SELECT vec, 'rotate' AS tool, 8 AS h, 2 AS w, x AS y, 1 - y AS x, c, v FROM p
  UNION ALL SELECT vec, 'mirror', 2, 8, 1 - y, x, c, v FROM p
  UNION ALL SELECT vec, 'grayscale', 2, 8, y, x, c, CASE WHEN c = 3 THEN v ELSE (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 END FROM p
  UNION ALL SELECT vec, 'half', 1, 4, 0, x // 2, c, round_even(avg(v), 0)::INT FROM p GROUP BY vec, x // 2, c
  UNION ALL SELECT vec, 'flatten', 2, 8, y, x, c, CASE WHEN c = 3 THEN 255 ELSE round_even(v * (a / 255{D}) + 255 * (1 - a / 255{D}), 0)::INT END FROM p)
SELECT vec, tool, any_value(h)::INT AS h, any_value(w)::INT AS w, string_agg(printf('%02X', v::INT), '' ORDER BY y, x, c) AS data FROM t GROUP BY vec, tool
""")
def picture_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R3, SK2, SC4: vectors as pictures of 8 x 2 pixels, turned, mirrored, greyed, halved, on white."""
    e = samples(spark, sf_dir).where("pos < 64")
    data = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: F.lpad(F.hex(s["value"]), 2, "0")), ""))
    p = e.groupBy("vec").agg(data.alias("data")).select("vec", F.struct(F.lit(2).alias("h"), F.lit(8).alias("w"), "data").alias("picture"))
    out = None
    for tool, options in (("rotate", {"angle": 90}), ("mirror", {"vertical": True}), ("grayscale", {}), ("half", {}), ("flatten", {})):
        one = raster.apply(p, tool, **options).select("vec", F.lit(tool).alias("tool"), "picture.h", "picture.w", F.hex("picture.data").alias("data"))
        out = one if out is None else out.unionByName(one)
    return out
