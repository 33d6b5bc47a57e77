"""Paragraphs of a page of 960 x 540."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators import paragraphs, recognition

KIND = T.StructType([T.StructField(n, t) for n, t in (("page", T.IntegerType()), ("n", T.IntegerType()), *((c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1", "size", "angle")), ("text", T.StringType()), ("color", T.IntegerType()), ("panel", T.IntegerType()), ("flags", T.IntegerType()), ("block", T.IntegerType()), ("width_ratio", T.DoubleType()))])


def line(n, text="some words of a line", x=40.0, y=60.0, width=220.0, height=18.0, size=22.0, angle=0.0, color=0x333333, panel=None, flags=0, block=None, ratio=1.0):
    return (1, n, float(x), float(y), float(x + width), float(y + height), float(size), float(angle), text, color, panel, flags, block, ratio)


def groups(spark, rows, graphics=()):
    df = spark.createDataFrame(rows, KIND)
    g = spark.createDataFrame([(1, *map(float, b), k) for *b, k in graphics], "page int, x0 double, y0 double, x1 double, y1 double, geometry string") if graphics else None
    got = paragraphs.chain(df, g, F.lit(960.0 * 540.0)).collect()
    out: dict[int, list[int]] = {}
    for r in sorted(got, key=lambda r: (r.paragraph, r.place)):
        out.setdefault(r.paragraph, []).append(r.n)
    return sorted(out.values())


def test_two_columns(spark):
    rows = [line(i, x=x, y=y) for i, (x, y) in enumerate((x, y) for x in (40, 500) for y in (60, 88, 160, 188))]
    assert groups(spark, rows) == [[0, 1], [2, 3], [4, 5], [6, 7]]


@pytest.mark.parametrize(
    ("second", "graphics", "together"),
    [
        ({"y": 95, "block": 2, "ratio": None}, (), False),
        ({"y": 86, "block": 2, "ratio": None}, (), True),
        ({"y": 116 - 28, "width": 50, "height": 17, "text": "word"}, (), True),
        ({"y": 88, "text": "• item of a list"}, (), False),
        ({"y": 88, "text": "2. item of a list"}, (), False),
        ({"y": 88, "panel": 0x663333}, (), False),
        ({"y": 88, "color": 0x993333}, (), False),
        ({"y": 88, "angle": 5}, (), False),
        ({"y": 88, "text": "abc"}, (), False),
        ({"y": 88, "x": 300}, (), False),
        ({"y": 120}, (), False),
        ({"y": 88}, ((20, 84, 300, 84, "line"),), False),
        ({"y": 88}, ((20, 40, 300, 140, "rect"),), True),
        ({"y": 88}, ((0, 0, 960, 540, "rect"),), True),
        ({"y": 88}, ((20, 70, 60, 100, "rect"),), True),
    ],
)
def test_pairs_of_lines(spark, second, graphics, together):
    first = {"block": 1, "ratio": None} if "block" in second else {"panel": 0xFFFFFF} if "panel" in second else {}
    got = groups(spark, [line(0, **first), line(1, **second)], graphics)
    assert got == ([[0, 1]] if together else [[0], [1]])


def test_bold_heading_above_a_body(spark):
    assert groups(spark, [line(0, "Heading", y=32, flags=16), line(1, "a longer line of the body below", y=60)]) == [[0], [1]]
    assert groups(spark, [line(0, "Heading", y=32), line(1, "a longer line of the body below", y=60)]) == [[0, 1]]


def test_a_closer_line_keeps_its_follower(spark):
    """A caption beside a column doesn't take the column's next line."""
    rows = [line(0, x=40, y=60), line(1, x=45, y=70, height=18), line(2, x=50, y=96)]
    assert [1, 2] in groups(spark, rows)


def test_inline_bold_is_one_line(spark):
    spans = spark.createDataFrame([(1, 0, 1, 7, 40.0, 60.0, 90.0, 78.0, 22.0, "plain"), (1, 1, 1, 7, 95.0, 60.0, 150.0, 79.0, 22.0, "bold"), (1, 2, 1, 7, 151.0, 60.0, 160.0, 78.0, 22.0, ","), (1, 3, None, None, 300.0, 60.0, 320.0, 78.0, 22.0, "alone")], "page int, n int, block int, line int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    got = {r.n: (r.text, r.runs, r.x1, r.y1) for r in paragraphs.merge_inline(spans).collect()}
    assert got == {0: ("plain bold,", 3, 160.0, 79.0), 3: ("alone", 1, 320.0, 78.0)}


def test_one_noisy_bold_line(spark):
    rows = spark.createDataFrame([(1, n, f"line {n}", "Arial", 0.9, 16 if n == 1 else 0, 20.0 + n) for n in range(3)], "p int, n int, text string, family string, fit double, flags int, size double")
    r = recognition.paragraph_style(rows, ["p"]).first()
    assert (r.family, r.bold, r.italic, r["size"]) == ("Arial", False, False, 21.0)


def test_summary_of_centred_lines(spark):
    rows = [line(0, x=100, width=200, y=60), line(1, x=120, width=160, y=88), line(2, x=60, width=280, y=116)]
    df = spark.createDataFrame(rows, KIND).withColumn("paragraph", F.lit(0))
    r = paragraphs.summary(df, ["page", "paragraph"]).first()
    assert (r.alignment, r.line_spacing, r.x0, r.x1, r.lines) == ("center", 28.0, 60.0, 340.0, 3)


def test_kept_boxes_hardly_overlap(spark):
    import numpy as np

    g = np.random.default_rng(0)
    rows = [(1, i, float(x), float(y), float(x + 60), float(y + 20), float(c), "t" * int(n)) for i, (x, y, c, n) in enumerate(zip(g.integers(0, 200, 80), g.integers(0, 100, 80), g.random(80).round(1), g.integers(1, 9, 80)))]
    df = spark.createDataFrame(rows, "page int, n int, x0 double, y0 double, x1 double, y1 double, confidence double, text string")
    kept = recognition.distinct_lines(df).collect()
    box = lambda r: (r.x0, r.y0, r.x1, r.y1)

    def over(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / 1200

    assert all(over(box(a), box(b)) <= 0.6 for a in kept for b in kept if a.n < b.n)
    dropped = [r for r in df.collect() if r.n not in {k.n for k in kept}]
    assert dropped and all(any(over(box(r), box(k)) > 0.6 and (k.confidence, len(k.text)) >= (r.confidence, len(r.text)) for k in kept) for r in dropped)
