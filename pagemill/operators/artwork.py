"""Pictures of pages taken apart: lettering, round shapes and pictures, and what lies behind them.

A page is a row of a picture and arrays of its lines or objects; pages are worked on one by one, and what
comes of them is handed on in Arrow batches of few bytes. Positions are pixels of the page's picture, colours RGB.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .panels import NEAR, divided
from .raster import DOMINANT_BIN, distance_map, labelled, packed, pixels

#: Part of a box that must be panel for its text to count as lying on it, and the pixels around the box that go with it.
ON_PANEL, AROUND = 0.54, 2
#: Distance within which a pixel is the background, and the part of a crop that makes it flat.
SAME, FLAT = 12, 0.65
#: Part of an ellipse that has its colour, part that may be other ink, and least distance from the panel.
ONE_FILL, OTHER_INK, UNLIKE = 0.67, 0.015, 35

#: Bytes of pictures that are handed on at once.
HELD = 4_000_000

Box = tuple[int, int, int, int]


def inside(box: tuple[float, ...], height: int, width: int, pad: int = 0) -> tuple[slice, slice]:
    x0, y0, x1, y1 = box
    return slice(max(0, math.floor(y0) - pad), min(height, math.ceil(y1) + pad)), slice(max(0, math.floor(x0) - pad), min(width, math.ceil(x1) + pad))


def most_of(colours: np.ndarray) -> np.ndarray:
    """The median of the colours in the fullest bin; among equals that of the least bin."""
    side = 256 // DOMINANT_BIN
    r, g, b = (colours.astype(int) // DOMINANT_BIN).T
    bins = (r * side + g) * side + b
    own = np.sort(colours[bins == np.bincount(bins).argmax()], axis=0)
    return (own[(len(own) - 1) // 2].astype(float) + own[len(own) // 2]) / 2


def on_panel(near: np.ndarray) -> bool:
    """Whether enough of a box's pixels, given as near the panel or not, are panel."""
    return bool(near.size and near.mean() > ON_PANEL)


def text_mask(a: np.ndarray, boxes: list[tuple[float, ...]], palette: np.ndarray) -> np.ndarray:
    """Where text lies on a panel of the palette; text on a picture is part of the picture."""
    near = distance_map(a, palette) < NEAR
    out = np.zeros(a.shape[:2], bool)
    for box in boxes:
        at = inside(box, *out.shape, AROUND)
        if on_panel(near[at]):
            out[at] = True
    return out


def letters(ink: np.ndarray, flat: bool, chars: int) -> np.ndarray:
    """Of a line's crop the ink that belongs to letters: no specks, rules, fills, or parts that the crop's edge cuts."""
    high, wide = ink.shape
    label, parts = labelled(ink)
    if not len(parts):
        return ink
    w, h, size = parts[:, 2] - parts[:, 0], parts[:, 3] - parts[:, 1], parts[:, 4]
    whole = (parts[:, 0] > 0) & (parts[:, 1] > 0) & (parts[:, 2] < wide) & (parts[:, 3] < high)
    plain = (w < 2.5 * high) & (h > 0.30 * high) & (size < 0.18 * high * wide) & (flat and chars > 3)
    ok = (size >= max(3, 0.10 * high)) & ((w <= 4 * high) | (h >= 0.18 * high)) & (size <= 0.70 * high * wide) & (whole | plain)
    return np.concatenate([[False], ok])[label]


def grown(mask: np.ndarray, by: int) -> np.ndarray:
    """A mask and what lies within ``by`` rows and columns of it."""
    n = 2 * by + 1
    sums = np.zeros([side + n for side in mask.shape], np.int64)
    sums[by + 1 : -by or None, by + 1 : -by or None] = mask
    sums = sums.cumsum(axis=0).cumsum(axis=1)
    return sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n] > 0


def diffused(a: np.ndarray, hole: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Colours of a with those in the hole grown in from around it, then evened out."""
    out, known = a.astype(float), ~hole
    if not known.any():
        return out
    out[hole] = 0
    reach = known.copy()
    for k in range(sum(a.shape[:2]) + rounds):
        if reach.all() and k >= rounds:
            break
        total, n = np.zeros_like(out), np.zeros(hole.shape)
        for axis in (0, 1):
            for step in (1, -1):
                edge = np.s_[:1] if step == 1 else np.s_[-1:]
                seen, value = np.roll(reach, step, axis), np.roll(out, step, axis)
                (seen if axis == 0 else seen.T)[edge] = False
                total += value * seen[:, :, None]
                n += seen
        new = hole & (n > 0)
        out[new] = total[new] / n[new][:, None]
        reach |= new
    return out


def erased(a: np.ndarray, lines: list[dict]) -> tuple[np.ndarray, list[dict]]:
    """The picture without its lines' lettering, and of each line with some its box, colours and flatness.

    On a flat background letters take its colour; elsewhere the colours around them grow in.
    """
    out, found = a.copy(), []
    for line in lines:
        box, chars = (line["x0"], line["y0"], line["x1"], line["y1"]), len(line["text"])
        aside = max(2, min(12, round((box[3] - box[1]) * 0.08))) if chars > 3 else 0
        rows, columns = inside((box[0] - aside, box[1], box[2] + aside, box[3] + aside), *a.shape[:2])
        crop = a[rows, columns, :3]
        high, wide = crop.shape[:2]
        if not high or not wide:
            continue
        back = most_of(crop[high // 6 : max(1, high - high // 6), wide // 10 : max(1, wide - wide // 10)].reshape(-1, 3))
        far = np.linalg.norm(crop.astype(float) - back, axis=2)
        flat = bool((far < SAME).mean() > FLAT)
        own = letters(far > max(28, 0.30 * np.percentile(far, 90)), flat, chars)
        if own.sum() < 4:
            continue
        y, x = np.nonzero(own)
        found.append({"n": line["n"], "flat": flat, "color": [int(v) for v in most_of(crop[own])], "background": [int(v) for v in back], "x0": columns.start + int(x.min()), "y0": rows.start + int(y.min()), "x1": columns.start + int(x.max()) + 1, "y1": rows.start + int(y.max()) + 1})
        by = max(1, min(3, round(high / 35)))
        # Letters grow by no more than that margin.
        around = inside((columns.start, rows.start, columns.stop, rows.stop), *a.shape[:2], by if flat else max(8, high // 2))
        mask = np.zeros(a.shape[:2], bool)
        mask[rows, columns] = own if flat or chars <= 10 else True
        mask[around] = grown(mask[around], by)
        if flat:
            out[around][mask[around], :3] = np.round(back).astype(np.uint8)
        else:
            out[around][mask[around], :3] = np.rint(diffused(out[around][:, :, :3], mask[around])).astype(np.uint8)[mask[around]]
    return out, found


def rounded(high: int, wide: int) -> np.ndarray:
    """Distance of a box's pixels from its middle, 1 at the rim of the ellipse in it."""
    y, x = np.ogrid[:high, :wide]
    return np.hypot((x - (wide - 1) / 2) / max(1, wide / 2), (y - (high - 1) / 2) / max(1, high / 2))


def flat_ellipse(a: np.ndarray, box: Box, texts: list[tuple[float, ...]], behind: np.ndarray) -> np.ndarray | None:
    """The colour of an ellipse in a box that can be drawn anew, or none.

    Most of its inside is one colour, unlike that of the panel behind, and other ink in it is recognised
    text, whose boxes are given; a sign in it would be lost.
    """
    rows, columns = inside(box, *a.shape[:2])
    crop = a[rows, columns, :3].astype(float)
    core = rounded(*crop.shape[:2]) < 0.8
    if not core.any():
        return None
    colour = np.median(crop[core], axis=0)
    other = core & (np.linalg.norm(crop - colour, axis=2) >= NEAR)
    if 1 - other.sum() / core.sum() < ONE_FILL or np.linalg.norm(colour - np.median(behind, axis=0)) < UNLIKE:
        return None
    for x0, y0, x1, y1 in texts:
        at = inside((x0 - columns.start, y0 - rows.start, x1 - columns.start, y1 - rows.start), *core.shape, AROUND)
        other[at] = False
    return colour if other.sum() <= OTHER_INK * core.sum() else None


def taken_out(a: np.ndarray, background: np.ndarray, box: Box, kind: str, behind: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A picture cut out of a page, and the background with the panel where it was.

    behind: a colour for each of the box's rows. kind: photo (the whole box), ellipse (with a soft rim)
    or drawing (what differs from the panel). A division of the panel seen above runs down behind it.
    """
    rows, columns = inside(box, *a.shape[:2])
    crop = a[rows, columns, :3]
    high, wide = crop.shape[:2]
    band = max(3, min(15, round(min(a.shape[:2]) / 140)))
    over = a[max(0, rows.start - band) : max(1, rows.start - 1), columns, :3]
    beside = [a[rows, max(0, columns.start - band) : max(1, columns.start - 1), :3], a[rows, min(a.shape[1] - 1, columns.stop + 1) : min(a.shape[1], columns.stop + band), :3]]
    panel = np.repeat(behind[:, None, :].astype(float), wide, axis=1)
    if kind != "ellipse" and rows.start and columns.start and columns.stop < a.shape[1] and all(s.size for s in beside):
        panel = divided(behind.astype(float), np.median(over, axis=0), *(np.median(s, axis=1) for s in beside), palette.astype(float))
    if kind == "photo":
        alpha = np.full((high, wide), 255.0)
    elif kind == "ellipse":
        alpha = np.clip((1 - rounded(high, wide)) * min(high, wide) / 2 + 0.5, 0, 1) * 255
    else:
        alpha = np.clip((np.linalg.norm(crop - panel, axis=2) - 7) / 12, 0, 1) * 255
    left = background.copy()
    left[rows, columns][alpha > 0, :3] = np.rint(panel[alpha > 0]).astype(np.uint8)
    return np.dstack([crop, alpha.astype(np.uint8)]), left


def handed(rows: Iterable[tuple], into: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each of ``HELD`` bytes of pictures or of one row over that."""
    some, held = [], 0
    for r in rows:
        some.append(dict(zip(into.names, r, strict=True)))
        held += 256 + sum(len(v["data"]) for v in r if isinstance(v, dict) and "data" in v)
        if held >= HELD:
            yield pa.RecordBatch.from_pylist(some, schema=into)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=into)


def by_page(pages: DataFrame, work: Callable[[np.ndarray, dict], Iterable[tuple]], columns: list[str], uses: list[str], schema: str) -> DataFrame:
    """Rows that work gives for each page's picture and the columns it ``uses``, under the page's own ``columns``."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), schema])
    into = to_arrow_schema(T.StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            b = b.select(list(dict.fromkeys([*columns, *uses, "picture"])))
            for i in range(b.num_rows):
                page = b.slice(i, 1).to_pylist()[0]
                if page["picture"] is not None:
                    for r in work(pixels(page["picture"]), page):
                        yield *(page[c] for c in columns), *r

    return pages.mapInArrow(lambda b: handed(each(b), into), schema)


def without_text(pages: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n, flat, color, background, x0 to y1 (of the lettering) of each line with lettering, and picture without all of it.

    pages: columns, picture, lines (array of n, text, x0, y0, x1, y1). Null pictures have no rows.
    """

    def work(a: np.ndarray, page: dict) -> Iterator[tuple]:
        left, found = erased(a, page["lines"] or [])
        whole = packed(left)
        for f in found:
            yield f["n"], f["flat"], f["color"], f["background"], f["x0"], f["y0"], f["x1"], f["y1"], whole

    return by_page(pages, work, columns, ["lines"], "n int, flat boolean, color array<int>, background array<int>, x0 int, y0 int, x1 int, y1 int, picture struct<h:int,w:int,data:binary>")


def apart(pages: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n, kind, picture, behind: each object of a page cut out, and the page's background after it.

    pages: columns, picture, palette (array of array of r, g, b), objects (array of n, kind, x0, y0, x1,
    y1). The colour behind a row is the palette's nearest to what lies beside it.
    """

    def work(a: np.ndarray, page: dict) -> Iterator[tuple]:
        palette, left = np.array(page["palette"], float).reshape(-1, 3), a.copy()
        for o in page["objects"] or []:
            rows, columns = inside((o["x0"], o["y0"], o["x1"], o["y1"]), *a.shape[:2])
            beside = np.concatenate([a[rows, max(0, columns.start - 4) : columns.start, :3], a[rows, columns.stop : columns.stop + 4, :3]], axis=1)
            if not beside.size or not len(palette):
                continue
            near = np.linalg.norm(np.median(beside, axis=1)[:, None, :] - palette[None], axis=2).argmin(axis=1)
            cut, left = taken_out(a, left, (o["x0"], o["y0"], o["x1"], o["y1"]), o["kind"], palette[near], palette)
            yield o["n"], o["kind"], packed(cut), packed(left)

    return by_page(pages, work, columns, ["palette", "objects"], "n int, kind string, picture struct<h:int,w:int,data:binary>, behind struct<h:int,w:int,data:binary>")


def marks(pages: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n, kind (text or ellipse), color, part: lines on a page's panels, and ellipses to be drawn anew.

    pages as in ``apart``, with lines. part: of a text's box, that which is panel; of an ellipse, that of
    its colour. Lines on pictures and ellipses with other ink than text have no row.
    """

    def work(a: np.ndarray, page: dict) -> list[tuple]:
        palette, out = np.array(page["palette"], float).reshape(-1, 3), []
        boxes = [(x["x0"], x["y0"], x["x1"], x["y1"]) for x in page["lines"] or []]
        near = distance_map(a, palette) < NEAR
        for line, box in zip(page["lines"] or [], boxes, strict=True):
            if on_panel(part := near[inside(box, *near.shape, AROUND)]):
                out.append((line["n"], "text", None, round(float(part.mean()), 6)))
        for o in page["objects"] or []:
            box = (o["x0"], o["y0"], o["x1"], o["y1"])
            rows, columns = inside(box, *near.shape)
            behind = a[rows, max(0, columns.start - 4) : columns.start, :3].reshape(-1, 3)
            if o["kind"] == "ellipse" and len(behind) and (colour := flat_ellipse(a, box, boxes, behind)) is not None:
                core = a[rows, columns, :3][rounded(rows.stop - rows.start, columns.stop - columns.start) < 0.8]
                out.append((o["n"], "ellipse", "%02X%02X%02X" % tuple(int(v) for v in colour), round(float((np.linalg.norm(core - colour, axis=1) < NEAR).mean()), 6)))
        return out

    return by_page(pages, work, columns, ["lines", "palette", "objects"], "n int, kind string, color string, part double")
