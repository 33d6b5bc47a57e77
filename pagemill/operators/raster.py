"""Colours and pictures (A7, A8, A11-A16, J12, J15, R1-R3, R9-R15, W5, W6, SK2).

Counting, voting and filling are relations of (picture, position, value). Whole pictures are binary
columns, worked on by Arrow functions in batches: a picture is a struct of h, w and its RGBA bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import colour_distance

PIXELS = "struct<h: int, w: int, data: binary>"
#: Bin widths of dominant colour, entropy and palette; the palette's size, least share and least distance.
DOMINANT_BIN, ENTROPY_BIN, PALETTE_BIN = 16, 8, 12
PALETTE, LEAST_SHARE, APART = 80, 0.0003, 20


def dominant(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, dominant: the median of the values in the fullest bin of 16, the lowest among equals."""
    binned = samples.withColumn("bin", F.floor(F.col(value) / DOMINANT_BIN))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("dominant"))
    best = F.max(F.struct("n", (-F.col("bin")).alias("low"), "dominant"))["dominant"]
    return counts.groupBy(*keys).agg(best.alias("dominant"))


def entropy(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, entropy in bits of the histogram of 32 bins."""
    counts = samples.groupBy(*keys, F.floor(F.col(value) / ENTROPY_BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # -sum p log p = log N - (sum n log n) / N, so one pass over the counts does.
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    return counts.groupBy(*keys).agg((F.log2(total) - weighted / total).alias("entropy"))


def palette(colours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, bin, n, colour: colours of a picture by frequency, each far enough from those before.

    colours: keys, colour (packed). Bins of 12 for each channel, the 80 fullest (lowest bin among
    equals) with .0003 of the pixels or more. A bin stands for its most frequent colour.
    """
    ch = lambda s: F.floor(F.shiftright("colour", s).bitwiseAND(F.lit(255)) / PALETTE_BIN)
    each = colours.groupBy(*keys, "colour").agg(F.count(F.lit(1)).alias("n"))
    bins = each.groupBy(*keys, ((ch(16) * 32 + ch(8)) * 32 + ch(0)).alias("bin")).agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("colour")).alias("low")))["low"].alias("low"))
    w = Window.partitionBy(*keys)
    top = bins.withColumn("all", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "bin")))
    top = top.where((F.col("rank") <= PALETTE) & (F.col("n") >= LEAST_SHARE * F.col("all")))
    entry = F.struct("rank", "bin", "n", (-F.col("low")).cast("int").alias("colour"))
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    near = lambda acc, x: F.exists(acc, lambda k: colour_distance(k["colour"], x["colour"]) <= APART)
    kept = F.aggregate("c", F.filter("c", lambda _: F.lit(False)), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    out = listed.select(*keys, F.posexplode(kept).alias("place", "x"))
    return out.select(*keys, "place", "x.bin", "x.n", "x.colour")


def shades(colours: DataFrame, most: int = 4096) -> DataFrame:
    """place, shade of a palette for broadcast; one of over ``most`` colours is refused with ValueError."""
    own = colours.select("place", F.col("colour").alias("shade"))
    if own.limit(most + 1).count() > most:
        raise ValueError(f"a palette of over {most} colours")
    return F.broadcast(own)


def palette_votes(samples: DataFrame, colours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, colour, share: the palette colour that most samples are nearest to, and its share.

    samples: keys, colour; colours: place, colour, a palette of 4,096 colours at most. Ties go to the lower place.
    """
    own = shades(colours)
    distinct = samples.groupBy(*keys, "colour").agg(F.count(F.lit(1)).alias("n"))
    near = distinct.crossJoin(own).groupBy(*keys, "colour", "n").agg(F.min(F.struct(colour_distance(F.col("colour"), F.col("shade")).alias("d"), "place", "shade")).alias("b"))
    votes = near.groupBy(*keys, F.col("b.place").alias("place"), F.col("b.shade").alias("shade")).agg(F.sum("n").alias("n"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("place")).alias("first"), "shade")).alias("m"), F.sum("n").alias("all"))
    return best.select(*keys, F.col("m.shade").alias("colour"), (F.col("m.n") / F.col("all")).alias("share"))


def nearest_filled(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """rows whose null values take that of the nearest row with one, the earlier among equals."""
    w = Window.partitionBy(*keys).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("a"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = rows.withColumn("_b", before).withColumn("_a", after)
    nearer = (F.col("_a.a") - F.col(at)) < (F.col(at) - F.col("_b.a"))
    filled = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | ~nearer, F.col("_b.v")).otherwise(F.col("_a.v"))
    return both.withColumn(value, filled).drop("_a", "_b")


def first_flat_run(rows: DataFrame, keys: list[str], at: str, flat: str, needed: int, after: float = 0.20) -> DataFrame:
    """keys, start: the first row after a fifth of the height from which ``needed`` rows are flat (W6); null without."""
    w = Window.partitionBy(*keys).orderBy(at)
    run = w.rowsBetween(Window.currentRow, needed - 1)
    seen = rows.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_f", F.bool_and(flat).over(run)).withColumn("_h", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_r", F.row_number().over(w) - 1)
    ok = F.col("_f") & (F.col("_n") == needed) & (F.col("_r") >= after * F.col("_h"))
    return seen.groupBy(*keys).agg(F.min(F.when(ok, F.col(at))).alias("start"))


def photo_like(width: Column, height: Column, fill: Column, bits: Column, page_width: Column, page_height: Column) -> Column:
    """Whether a component of a page is a photograph by its box, fill and entropy (R11, A.16)."""
    short, side = F.least(page_width, page_height), F.least(width, height)
    box = width * height
    sized = (side >= F.greatest(F.lit(14.0), short / 80)) & (box * fill >= 0.015 * page_width * page_height) & (box <= 0.80 * page_width * page_height)
    rich = ((fill > 0.66) & (bits > 2.85)) | ((fill > 0.42) & (bits > 3.25))
    return sized & (fill >= 0.13) & rich & (side > 0.055 * short)


def without_nested(boxes: DataFrame, page: str = "page") -> DataFrame:
    """Boxes (n, x0 to y1) but those over .94 in one 1.3 times larger, or over .15 in one 5 times larger (J9, A.16)."""
    from ..functions.geometry import area, coverage

    # Only boxes that overlap count, so boxes meet in bands of a page as high as its boxes are on average.
    names = ["x0", "y0", "x1", "y1"]
    each = boxes.select(page, *names).distinct()
    high = each.groupBy(page).agg(F.greatest(F.lit(1.0), F.avg(F.col("y1") - F.col("y0"))).alias("_high"))
    band = lambda c: F.floor(F.col(c) / F.col("_high"))
    banded = each.where("y1 >= y0").join(high, page).withColumn("_band", F.explode(F.sequence(band("y0"), band("y1")))).drop("_high")
    other = banded.select(F.col(page).alias("_p"), F.col("_band").alias("_b"), *(F.col(c).alias(f"_{c}") for c in names))
    own, out = [F.col(c) for c in names], [F.col(f"_{c}") for c in names]
    part, times = coverage(own, out), area(out) / F.greatest(F.lit(1.0), area(own))
    inside = ((part > 0.94) & (times > 1.3)) | ((part > 0.15) & (times > 5))
    gone = banded.join(other, (F.col(page) == F.col("_p")) & (F.col("_band") == F.col("_b")) & inside, "left_semi")
    return boxes.join(gone.select(page, *names).distinct(), [page, *names], "left_anti")


def whole_page_photo(lines: DataFrame, palettes: DataFrame, page: str = "page") -> DataFrame:
    """page of pages without a palette whose lines are all short and unsure, so that no text is to be kept."""
    weak = lines.groupBy(page).agg(F.bool_and((F.length("text") < 4) & (F.col("confidence") < 0.97)).alias("weak"))
    return weak.where("weak").join(palettes.select(page).distinct(), page, "left_anti").select(page)


# --- whole pictures -----------------------------------------------------------------------------


def pixels(p: dict) -> np.ndarray:
    return np.frombuffer(p["data"], np.uint8).reshape(p["h"], p["w"], 4)


def packed(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "data": np.ascontiguousarray(a, np.uint8).tobytes()}


def rotated(a: np.ndarray, angle: int = 90) -> np.ndarray:
    """90 is clockwise."""
    return np.rot90(a, {90: -1, -90: 1, 180: 2}[angle])


def mirrored(a: np.ndarray, vertical: bool = False) -> np.ndarray:
    return a[::-1] if vertical else a[:, ::-1]


def grey(a: np.ndarray) -> np.ndarray:
    """Luma of each pixel; alpha stays."""
    r, g, b = (a[:, :, i].astype(np.uint32) for i in range(3))
    luma = ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)
    return np.dstack([luma, luma, luma, a[:, :, 3]])


def halved(a: np.ndarray) -> np.ndarray:
    """Half as wide and high, rounded down, one pixel at least, each pixel the mean of those it covers."""
    h, w = max(1, a.shape[0] // 2), max(1, a.shape[1] // 2)

    def along(x: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, x.shape[0], n + 1)
        sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        low = np.minimum(np.floor(edges).astype(int), x.shape[0] - 1)
        at = sums[low] + x[low] * (edges - low).reshape(-1, *[1] * (x.ndim - 1))
        return np.diff(at, axis=0) * n / x.shape[0]

    out = along(along(a.astype(float), h).transpose(1, 0, 2), w).transpose(1, 0, 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def on_white(a: np.ndarray) -> np.ndarray:
    """Opaque, as formats without transparency take it (SK2)."""
    alpha = a[:, :, 3:].astype(float) / 255
    rgb = np.rint(a[:, :, :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.dstack([rgb, np.full(a.shape[:2], 255, np.uint8)])


def cut(a: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    return a[top:bottom, left:right]


def quantised(a: np.ndarray, colours: int) -> np.ndarray:
    """At most so many colours, by the coarsest bits that give them."""
    for bits in range(8, 0, -1):
        step = 1 << (8 - bits)
        out = (a // step) * step + step // 2 if step > 1 else a
        if len(np.unique(out.reshape(-1, 4), axis=0)) <= colours:
            return out.astype(np.uint8)
    return np.full_like(a, 128)


TOOLS: dict[str, Callable[..., np.ndarray]] = {"rotate": rotated, "mirror": mirrored, "grayscale": grey, "half": halved, "privacy": lambda a: a, "flatten": on_white}


def apply(pictures: DataFrame, tool: str, column: str = "picture", **options) -> DataFrame:
    """pictures with a tool run on each; pixels alone are carried on, so no metadata is (R1, R2). Nulls stay."""
    run = TOOLS[tool]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            got = [None if p is None else packed(run(pixels(p), **options)) for p in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(got, b.schema.field(at).type))

    return pictures.mapInArrow(work, pictures.schema)


def distance_map(a: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Of each pixel to the nearest of colours."""
    rgb = a[:, :, :3].astype(np.float32)
    out = np.full(a.shape[:2], np.inf, np.float32)
    for c in np.asarray(colours, np.float32).reshape(-1, 3):
        np.minimum(out, np.sqrt(((rgb - c) ** 2).sum(axis=2)), out=out)
    return out


def flat_background(a: np.ndarray, colour: np.ndarray, within: float = 12, share: float = 0.65) -> bool:
    """Whether most pixels are near a colour, so that it may be painted over."""
    return bool((distance_map(a, colour) <= within).mean() > share)


def labelled(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the 8-connected parts of a mask, 0 outside; and of each part x0, y0, x1, y1, its pixels."""
    h, w = mask.shape
    where = np.flatnonzero(mask.reshape(-1))
    number = np.full(h * w, -1)
    number[where] = np.arange(len(where))
    grid = number.reshape(h, w)
    links = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = grid[: h - dy, max(0, -dx) : w - max(0, dx)]
        b = grid[dy:, max(0, dx) : w - max(0, -dx)]
        on = (a >= 0) & (b >= 0)
        links.append(np.stack([a[on], b[on]]))
    p, q = np.concatenate(links, axis=1) if links else np.zeros((2, 0), int)
    root = np.arange(len(where))
    while True:
        new = root.copy()
        low = np.minimum(root[p], root[q])
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    # A root is its own, so roots are numbered in their order.
    first = root == np.arange(len(where))
    part, names = np.cumsum(first)[root] - 1, np.flatnonzero(first)
    out = np.zeros(h * w, int)
    out[where] = part + 1
    y, x = np.divmod(where, w)
    boxes = np.zeros((len(names), 5), int)
    boxes[:, :2] = [w, h]
    for col, v, f in ((0, x, np.minimum), (1, y, np.minimum), (2, x + 1, np.maximum), (3, y + 1, np.maximum)):
        f.at(boxes[:, col], part, v)
    boxes[:, 4] = np.bincount(part, minlength=len(names))
    return out.reshape(h, w), boxes


def merged_boxes(boxes: list[tuple[float, ...]], width: float, height: float) -> list[tuple[float, ...]]:
    """Boxes joined while a pair is near and its union small, the first such pair each time (R12, A.17).

    A pair's edges differ by less than the union's limit, so a box is compared with those whose corner
    is in the cells of that size around its own; one over the limit by itself has no pair. Boxes before
    ``front`` have no pair left.
    """
    b = np.array(boxes, float).reshape(-1, 4)
    gap = max(5, min(width, height) / 52)
    most = np.array([0.28 * width, 0.32 * height])
    cellular = most.min() > 0 and np.isfinite(b).all() and (b[:, 2:] >= b[:, :2]).all()
    cells: dict[tuple[int, int], set[int]] = {}

    def cell(i: int) -> tuple[int, int]:
        return (int(b[i, 0] // (1.001 * most[0])), int(b[i, 1] // (1.001 * most[1]))) if cellular else (0, 0)

    def first(i: int) -> int | None:
        x, y = cell(i)
        near = np.array(sorted(j for u in (x - 1, x, x + 1) for v in (y - 1, y, y + 1) for j in cells.get((u, v), ()) if j != i), int)
        o, c = b[near], b[i]
        low, high = np.minimum(o, c), np.maximum(o, c)
        ok = (high[:, 0] - low[:, 2] <= gap) & (high[:, 1] - low[:, 3] <= gap) & (high[:, 2] - low[:, 0] < most[0]) & (high[:, 3] - low[:, 1] < most[1])
        return int(near[ok.argmax()]) if ok.any() else None

    fit = np.flatnonzero((b[:, 2:] - b[:, :2] < most).all(axis=1)).tolist()
    for i in fit:
        cells.setdefault(cell(i), set()).add(i)
    alive = np.ones(len(b), bool)
    for front in fit:
        i = front
        while alive[i] and (j := first(i)) is not None:
            i, j = min(i, j), max(i, j)
            cells[cell(j)].remove(j)
            cells[cell(i)].remove(i)
            alive[j] = False
            b[i] = (*np.minimum(b[i, :2], b[j, :2]), *np.maximum(b[i, 2:], b[j, 2:]))
            cells.setdefault(cell(i), set()).add(i)
    return [tuple(r) for r in b[alive].tolist()]


def merge_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, x0 to y1: merged_boxes of each page's boxes (keys, n, x0 to y1, width, height)."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        got = merged_boxes(list(part[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), part["width"].iloc[0], part["height"].iloc[0])
        out = pd.DataFrame(got, columns=["x0", "y0", "x1", "y1"])
        out.insert(0, "n", range(len(out)))
        for k in reversed(keys):
            out.insert(0, k, part[k].iloc[0])
        return out

    return boxes.groupBy(*keys).applyInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n int, x0 double, y0 double, x1 double, y1 double")
