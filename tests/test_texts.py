import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import text


@given(st.text(alphabet=st.sampled_from("ab \t中文ｗé🙂-"), max_size=200))
@settings(max_examples=200, deadline=None)
def test_folds_hold_the_line_and_the_limit(line):
    parts = text.folded(line)
    assert "".join(parts) == line.expandtabs(4)
    assert all(text.columns_of(p) <= 80 for p in parts)
    # A part ends only where the next character would pass the limit.
    for a, b in zip(parts, parts[1:], strict=False):
        assert text.columns_of(a) + (2 if unicodedata.east_asian_width(b[0]) in "WF" else 1) > 80


def test_both_ways_of_folding_agree(spark):
    rows = ["", "a" * 79, "b" * 80, "c" * 81, "d e" * 60, "é" * 161, "中" * 41, "a" * 79 + "中", "\tx" * 30, "🙂" * 50, "한글" * 30]
    got = {r.line: list(r.pieces) for r in text.wrap(spark.createDataFrame([(r,) for r in rows], "line string")).collect()}
    assert got == {r: text.folded(r) for r in rows}


def test_every_uneven_character_leaves_the_expression(spark):
    wide = [chr(c) for c in range(0x80, 0x40000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co") and unicodedata.east_asian_width(chr(c)) in "WF"]
    df = spark.createDataFrame([(c,) for c in [*wide, "\t"]], "c string")
    missed = [r.c for r in df.where(~df.c.rlike(text.UNEVEN)).collect()]
    assert missed == []


def test_lines_as_splitlines(spark):
    rows = ["", "a", "a\n", "\n", "a\r\nb\rc\n\nd\x0b\x0ce\x1cf\x85g h ", "x\n\n"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    assert {r.i: list(r.l) for r in df.select("i", text.lines(df.x).alias("l")).collect()} == {i: r.splitlines() for i, r in enumerate(rows)}


def test_strip_as_python(spark):
    rows = [" 　a b\xa0\x1c", "\x85x ", "​x", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    assert {r.i: r.s for r in df.select("i", text.strip(df.x).alias("s")).collect()} == {i: r.strip() for i, r in enumerate(rows)}
