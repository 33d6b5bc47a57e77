"""Text functions with the semantics of Unicode-aware string code.

Expressions for Catalyst throughout; lines with wide characters or tabs, whose columns depend on each
character, go through an Arrow function of their own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as string methods strip it.
SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Breaks between lines.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
#: Characters that make a text's columns differ from its characters: tabs and all that may be wide.
UNEVEN = r"[\t\x{1100}-\x{115F}\x{231A}-\x{23FF}\x{25FD}-\x{27BF}\x{2B1B}-\x{2B55}\x{2E80}-\x{A4CF}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE10}-\x{FE6F}\x{FF00}-\x{FFE6}\x{16FE0}-\x{18DFF}\x{1AFF0}-\x{1B2FF}\x{1D300}-\x{1D37F}\x{1F000}-\x{3FFFD}]"
COLUMNS, SLIDE_LINES, TITLE = 80, 13, 40


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{SPACE}]")


def lines(c: Column) -> Column:
    """An array of lines; a break at the end begins no further line, and an empty text has none."""
    parts = F.split(c, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def clean(c: Column, keep_returns: bool = True) -> Column:
    """Without control characters but tab and line feed, and return where wanted."""
    return F.regexp_replace(c, CONTROLS if keep_returns else r"[\x00-\x08\x0B-\x1F]", "")


def without_bom(c: Column) -> Column:
    """A text file's content as read with an optional byte-order mark (SC2)."""
    return F.regexp_replace(c, r"^\x{FEFF}", "")


def bare(c: Column) -> Column:
    """Markdown without comments and images."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"!\[[^\]]*\]\([^)]*\)", "")


def meaningful(c: Column) -> Column:
    """Whether anything but comments, images and white space is there."""
    return ~blank(bare(c))


def comment_line(c: Column) -> Column:
    """A line that is a comment from its start to its end (Q4)."""
    return c.startswith("<!--") & F.regexp_replace(c, rf"[{SPACE}]+$", "").endswith("-->")


def heading_level(c: Column) -> Column:
    """1 to 3 for a heading of one to six signs, null for other lines (SK7, F9)."""
    signs = F.regexp_extract(c, rf"^(#{{1,6}})[{SPACE}]+", 1)
    return F.when(signs != "", F.least(F.length(signs), F.lit(3)))


def without_heading(c: Column) -> Column:
    return F.regexp_replace(c, rf"^#{{1,6}}[{SPACE}]+", "")


def comparable(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{3400}-\x{9FFF}]")


def two_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]{2}$")


def list_start(c: Column) -> Column:
    """A bullet, or a number of one or two digits with its mark, and white space begin the line."""
    return c.rlike(rf"^[{SPACE}]*(?:[•●▪◆\-–]|\p{{Nd}}{{1,2}}[.)、])[{SPACE}]+")


def tail(c: Column, n: int) -> Column:
    """The last n characters, as of a long diagnostic."""
    return F.right(c, F.lit(n))


def columns_of(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(ch) in "WF" else 1 for ch in text)


def folded(line: str, limit: int = COLUMNS) -> list[str]:
    """A line cut before the character that would pass the limit of columns; wide ones take two."""
    out, held, width = [], [], 0
    for ch in line.expandtabs(4):
        units = 2 if unicodedata.east_asian_width(ch) in "WF" else 1
        if held and width + units > limit:
            out.append("".join(held))
            held, width = [], 0
        held.append(ch)
        width += units
    return [*out, "".join(held)]


def wrap(rows: DataFrame, line: str = "line", limit: int = COLUMNS) -> DataFrame:
    """rows with pieces, the array of a line's folded pieces; one empty piece for an empty line.

    Lines whose columns are their characters are cut by an expression; only the others leave the JVM.
    """
    uneven = F.coalesce(F.col(line).rlike(UNEVEN), F.lit(False))
    cut = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{limit}}}"), 0)
    even = rows.where(~uneven).withColumn("pieces", F.when(F.col(line) == "", F.array(F.lit(""))).otherwise(cut))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(line)
            yield b.append_column("pieces", pa.array([folded(x, limit) for x in b.column(at).to_pylist()], pa.list_(pa.string())))

    schema = T.StructType([*rows.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))])
    return even.unionByName(rows.where(uneven).mapInArrow(fold, schema))
