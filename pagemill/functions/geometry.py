"""Boxes, sizes, units and colours as expressions.

A box is four columns x0, y0, x1, y1. Halves round to even, as the callers' numbers do (S2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]

EMU_POINT, EMU_INCH, TWIPS_POINT = 12_700, 914_400, 20
#: Side of a tile, and from the start of one to that of the next; smaller pictures have none.
TILE, STEP, UNTILED = 1400, 1160, 1800


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1")]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return wide * high


def overlap(a: Box, b: Box) -> Column:
    """Of the smaller box's area, which counts as 1 at least."""
    return intersection(a, b) / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def coverage(inner: Box, outer: Box) -> Column:
    """Part of inner's own area in outer."""
    return intersection(inner, outer) / F.greatest(F.lit(1.0), area(inner))


def angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Of a line from its first to its second point, in degrees."""
    return F.degrees(F.atan2(y1 - y0, x1 - x0))


def tile_origins(side: Column) -> Column:
    """Starts of tiles along a side, the last clamped to the edge."""
    last = F.greatest(F.lit(0), side - TILE).cast("int")
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), F.greatest(side - 1, F.lit(0)).cast("int"), F.lit(STEP)), lambda x: x <= last), F.array(last))))


def tiles(width: Column, height: Column) -> Column:
    """Windows of a picture: itself, then, if a side is over UNTILED, its tiles by rows; structs of a box and tile."""
    window = lambda x, y, w, h, tile: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.lit(tile).alias("tile"))
    i = lambda c: c.cast("int")
    whole = F.array(window(F.lit(0), F.lit(0), i(width), i(height), False))
    some = F.flatten(F.transform(tile_origins(height), lambda y: F.transform(tile_origins(width), lambda x: window(x, y, i(F.least(F.lit(TILE), width)), i(F.least(F.lit(TILE), height)), True))))
    return F.when(F.greatest(width, height) > UNTILED, F.concat(whole, some)).otherwise(whole)


def crop(width: Column, height: Column, b: Box) -> tuple[Column, Column, Column, Column, Column]:
    """left, top, right, bottom of a crop by parts of 0 to 1, one pixel at least, and whether it is valid."""
    ok = (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= 1) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= 1)
    left, top = F.floor(b[0] * width), F.floor(b[1] * height)
    right = F.least(width, F.greatest(left + 1, F.bround(b[2] * width).cast("long")))
    bottom = F.least(height, F.greatest(top + 1, F.bround(b[3] * height).cast("long")))
    return *(F.when(ok, x.cast("long")) for x in (left, top, right, bottom)), ok


def half(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(x / 2)).cast("long")


def capped(width: Column, height: Column, most: float, side: float) -> Column:
    """A scale of ``most``, less where the longer side would pass ``side``."""
    return F.least(F.lit(float(most)), F.lit(float(side)) / F.greatest(width, height))


def letter_spacing(size: Column, width_ratio: Column, width: Column, chars: Column) -> Column:
    """Room between characters that makes text as wide as its box, -.08 to +.25 of the size."""
    spare = (width - width * width_ratio) / F.greatest(F.lit(1), chars - 1)
    return F.greatest(-0.08 * size, F.least(0.25 * size, spare))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def channel(colour: Column, shift: int) -> Column:
    return F.shiftright(colour, shift).bitwiseAND(F.lit(255))


def unpack_rgb(colour: Column) -> tuple[Column, Column, Column]:
    return tuple(channel(colour, s) for s in (16, 8, 0))


def from_unit(c: Column) -> Column:
    """0..1 as 0..255, clamped (F16)."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c * 255))).cast("int")


def rgb_hex(colour: Column) -> Column:
    return F.format_string("%06X", colour)


def colour_distance(a: Column, b: Column) -> Column:
    """Euclidean, over the three channels of packed colours."""
    return F.sqrt(sum((F.pow(channel(a, s) - channel(b, s), F.lit(2)) for s in (16, 8, 0)), F.lit(0.0)))


def flags(bold: Column, italic: Column) -> Column:
    """Bold 16, italic 2."""
    return F.when(bold, 16).otherwise(0).bitwiseOR(F.when(italic, 2).otherwise(0))


def is_bold(f: Column) -> Column:
    return f.bitwiseAND(F.lit(16)) != 0


def is_italic(f: Column) -> Column:
    return f.bitwiseAND(F.lit(2)) != 0


def flow_height(y0: Column, y1: Column, size: Column) -> Column:
    """A line's height, or that of its font's frame where the ink is lower."""
    return F.greatest(F.greatest(F.lit(1.0), y1 - y0), 0.70 * size)


def inverse_affine(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[list[Column], Column]:
    """The inverse of x' = a x + c y + e, y' = b x + d y + f, and whether there is one."""
    det = a * d - b * c
    ok = F.abs(det) >= 1e-10
    by = lambda x: F.when(ok, x / F.when(ok, det))
    return [by(d), by(-b), by(-c), by(a), by(c * f - d * e), by(b * e - a * f)], ok


def ellipse_like(part: Column, width: Column, height: Column, radius_error: Column) -> Column:
    """A contour of an area within 9 % of its box's ellipse, whose radius strays by .06 at most."""
    ideal = F.lit(3.141592653589793) / 4 * width * height
    return (F.abs(part / F.greatest(ideal, F.lit(1.0)) - 1) <= 0.09) & (radius_error <= 0.06)
