"""Parsers of short user input, as expressions: a result and an error in place of an exception (F1, F2, F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: Longest time that a frame may be asked for, in seconds.
LONGEST = 8_640_000

# The first token that a font's name contains, in any case, gives its family.
FONTS = [
    ("MicrosoftYaHei", "Microsoft YaHei"),
    ("SimHei", "黑体"),
    ("SimSun", "宋体"),
    ("Arial", "Arial"),
    ("Calibri", "Calibri"),
    ("TimesNewRoman", "Times New Roman"),
]


def page_tokens(expression: Column) -> Column:
    return F.transform(F.split(F.replace(expression, F.lit("，"), F.lit(",")), ","), strip)


def page_error(expression: Column, count: Column) -> Column:
    """syntax, range or null for a page-range expression over a file of count pages (F1, A.5)."""
    every = expression.isNull() | (expression == "") | F.lower(strip(expression)).isin("all", "每页")

    def bounds(token: Column) -> Column:
        first = F.regexp_extract(token, "^([0-9]{1,18})", 1).cast("long")
        last = F.regexp_extract(token, "([0-9]{1,18})$", 1).cast("long")
        return (first >= 1) & (first <= last) & (last <= count)

    tokens = page_tokens(expression)
    shape = F.forall(tokens, lambda t: t.rlike(r"^[0-9]{1,18}(?:\s*-\s*[0-9]{1,18})?$"))
    return F.when(every, F.lit(None)).when(~shape, "syntax").when(~F.forall(tokens, bounds), "range")


def page_groups(rows: DataFrame, expression: str = "expression", count: str = "pages") -> DataFrame:
    """rows beside each part of a split: part (from 0), first and last page (from 1), name, error.

    No expression, ``all`` or ``每页`` make every page a part. Parts come in the order written; they
    may overlap or repeat. A bad expression gives one row with an error and no part.
    """
    e, n = F.col(expression), F.col(count)
    every = e.isNull() | (e == "") | F.lower(strip(e)).isin("all", "每页")
    number = lambda t, side: F.regexp_extract(t, "^([0-9]+)" if side else "([0-9]+)$", 1).cast("long")
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    pages = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("long")), lambda p: pair(p, p))).otherwise(none)
    named = F.transform(page_tokens(e), lambda t: pair(number(t, True), number(t, False)))
    checked = rows.withColumn("error", page_error(e, n))
    parts = F.when(F.col("error").isNotNull(), none).when(every, pages).otherwise(named)
    out = checked.select(*rows.columns, "error", F.posexplode_outer(parts).alias("part", "span"))
    first, last = F.col("span.first"), F.col("span.last")
    name = F.when(first == last, F.concat(F.lit("第"), first.cast("string"), F.lit("页"))).otherwise(F.concat(F.lit("第"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("页")))
    return out.select(*rows.columns, "part", first.alias("first"), last.alias("last"), name.alias("name"), "error")


def seconds(value: Column) -> Column:
    """Seconds of ``s[.f]``, ``m:ss[.f]`` or ``h:mm:ss[.f]``; null where seconds_error isn't (F8, A.6)."""
    v = strip(value)
    total = F.aggregate(F.split(v, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))
    return F.when(seconds_error(value).isNull() & v.isNotNull(), total)


def seconds_error(value: Column) -> Column:
    """syntax, minutes (a later part of 60 or more), range or null."""
    v = strip(value)
    plain = v.rlike(r"^[0-9]+(?:\.[0-9]+)?$")
    clock = v.rlike(r"^[0-9]+:[0-9]{1,2}(?::[0-9]{1,2})?(?:\.[0-9]+)?$")
    parts = F.split(v, ":")
    safe = F.when(plain | clock, parts).otherwise(F.array(F.lit("0")))
    number = lambda x: x.cast("double")
    over = F.exists(F.slice(safe, 2, 9), lambda x: number(x) >= 60)
    total = F.aggregate(safe, F.lit(0.0), lambda acc, x: acc * 60 + number(x))
    return F.when(v.isNull() | ~(plain | clock), "syntax").when(over, "minutes").when(total > LONGEST, "range")


def font_name(name: Column) -> Column:
    """Family of a font as a file names it: no subset tag, known families by their token, no style ending (F2)."""
    bare = F.regexp_replace(name, "^[A-Z]{6}\\+", "")
    out = F.regexp_replace(bare, "(?is)[-,](bold|italic|regular).*$", "")
    for token, family in reversed(FONTS):
        out = F.when(F.lower(bare).contains(token.lower()), family).otherwise(out)
    return out
