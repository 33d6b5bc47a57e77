"""What follows text recognition: tiles, duplicates, retries, order, styles.

A page is the unit of work: every window and join has the page among its keys, so pages are dealt over
the cluster and no page meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap
from ..functions.text import blank, strip, two_digits

#: Least score of a candidate, from where a line isn't read again, and by how much a new reading must be better.
LEAST, SURE, BETTER = 0.50, 0.93, 0.02
#: Pixels within which a fragment touches the edge of its tile, and the overlap that makes a duplicate.
EDGE, SAME = 8, 0.60


def at_inner_edge(x: Column, y: Column, right: Column, bottom: Column, width: Column, height: Column, b: list[Column]) -> Column:
    """Whether a box, relative to its tile, touches an edge of the tile that is not one of the picture."""
    return (
        ((x > 0) & (b[0] < EDGE))
        | ((y > 0) & (b[1] < EDGE))
        | ((right < width) & (b[2] > right - x - EDGE))
        | ((bottom < height) & (b[3] > bottom - y - EDGE))
    )


def usable(text: Column, score: Column) -> Column:
    """Recognitions with text and a fair score."""
    return ~blank(text) & (score >= LEAST)


def located(rows: DataFrame) -> DataFrame:
    """Candidates of windows on the page: usable, no fragments at inner edges, boxes moved to the page.

    rows: page, width, height (of the page), x, y, w, h (of the window), tile, x0 to y1 (in the window),
    text, confidence, and any others.
    """
    b = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    cut = F.col("tile") & at_inner_edge(F.col("x"), F.col("y"), right, bottom, F.col("width"), F.col("height"), b)
    moved = {"x0": F.col("x0") + F.col("x"), "x1": F.col("x1") + F.col("x"), "y0": F.col("y0") + F.col("y"), "y1": F.col("y1") + F.col("y"), "text": strip(F.col("text"))}
    return rows.where(usable(F.col("text"), F.col("confidence")) & ~cut).withColumns(moved)


def distinct_lines(rows: DataFrame, page: str = "page") -> DataFrame:
    """Of candidates that overlap by more than SAME, the most confident, then the longest, then the first.

    rows: page, n (a page's own number of the candidate), x0, y0, x1, y1, confidence, text. Greedy by
    rank: a candidate is dropped if it overlaps one that was kept. The fold runs in the JVM over the
    array of one page's candidates.
    """
    entry = F.struct((-F.col("confidence")).alias("c"), (-F.length("text")).alias("l"), "n", *(F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")))
    of = lambda s: [s[k] for k in ("x0", "y0", "x1", "y1")]
    ranked = rows.groupBy(page).agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    none = F.filter("ranked", lambda _: F.lit(False))
    keep = F.aggregate("ranked", none, lambda kept, x: F.when(F.exists(kept, lambda k: overlap(of(k), of(x)) > SAME), kept).otherwise(F.concat(kept, F.array(x))))
    kept = ranked.select(page, F.explode(F.transform(keep, lambda x: x["n"])).alias("n"))
    return rows.join(kept, [page, "n"], "left_semi")


def reading_order(rows: DataFrame, page: str = "page") -> DataFrame:
    """rows with place: by bands of 12 pixels of the top edge, halves to even, then from the left."""
    w = Window.partitionBy(page).orderBy(F.bround(F.col("y0") / 12), "x0", "n")
    return rows.withColumn("place", F.row_number().over(w) - 1)


def retried(confidence: Column, text: Column, readings: Column) -> Column:
    """A line's text and confidence after further readings, structs of text and score, in turn (T5).

    A reading is taken if it is better by more than BETTER; readings end once the line is sure.
    """
    start = F.struct(text.alias("text"), confidence.cast("double").alias("score"))
    better = lambda now, r: (now["score"] < SURE) & (strip(r["text"]) != "") & (r["score"] > now["score"] + BETTER)
    return F.aggregate(readings, start, lambda now, r: F.when(better(now, r), F.struct(strip(r["text"]).alias("text"), r["score"].cast("double").alias("score"))).otherwise(now))


def style_peers(rows: DataFrame, page: str = "page") -> DataFrame:
    """page, n, family, fit: the best-fitting style among lines of equal text and a height ratio in (.85, 1.18).

    A line alone keeps its own style. Ties go to the first line. Styles are those given, not such as
    other lines have already taken over. Only the heights of a page's text meet, not its lines.
    """
    best = F.max(F.struct(F.col("fit").alias("g"), (-F.col("n")).alias("first"), F.col("family").alias("f")))
    own = rows.groupBy(page, "text", "height").agg(best.alias("b"))
    other = own.select(F.col(page).alias("p"), F.col("text").alias("t"), F.col("height").alias("h"), F.col("b").alias("o"))
    near = (F.col("h") / F.col("height") > 0.85) & (F.col("h") / F.col("height") < 1.18)
    both = own.join(other, (F.col(page) == F.col("p")) & (F.col("text") == F.col("t")) & near).groupBy(page, "text", "height").agg(F.max("o").alias("b"))
    return rows.select(page, "n", "text", "height").join(both, [page, "text", "height"]).select(page, "n", F.col("b.f").alias("family"), F.col("b.g").alias("fit"))


def number_peers(rows: DataFrame, page: str = "page") -> DataFrame:
    """page, n, family, fit for two-digit labels with two or more peers: the family most of them have, its best fit.

    Peers' heights have a ratio in (.72, 1.4). Equal families by the alphabet, equal fits by number. Only
    a page's heights meet, not its lines.
    """
    label = rows.where(two_digits(F.col("text"))).select(page, "n", "height", "family", "fit")
    own = label.groupBy(page, "height", F.col("family").alias("f")).agg(F.count(F.lit(1)).alias("votes"), F.max(F.struct(F.col("fit").alias("g"), (-F.col("n")).alias("first"))).alias("best"))
    other = own.withColumnsRenamed({page: "p", "height": "h"})
    near = (F.col("h") / F.col("height") > 0.72) & (F.col("h") / F.col("height") < 1.4)
    both = own.select(page, "height").distinct().join(other, (F.col(page) == F.col("p")) & near)
    each = both.groupBy(page, "height", "f").agg(F.sum("votes").alias("votes"), F.max("best").alias("best"))
    w = Window.partitionBy(page, "height")
    ranked = each.withColumn("peers", F.sum("votes").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "f")))
    chosen = ranked.where("peers >= 3 and rank = 1").select(page, "height", "f", "best")
    return label.select(page, "n", "height").join(chosen, [page, "height"]).select(page, "n", F.col("f").alias("family"), F.col("best.g").alias("fit"))


def paragraph_style(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, family, bold, italic, size of a paragraph's recognised lines.

    family: the most of length times fit (.65 where unknown), the first in order among equals; bold:
    under .30 of the lines are regular; italic: all are; size: the median.
    """
    vote = rows.groupBy(*keys, "family").agg(F.sum(F.length("text") * F.coalesce("fit", F.lit(0.65))).alias("votes"), F.min("n").alias("first"))
    family = vote.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("first")).alias("o"), "family"))["family"].alias("family"))
    regular = F.avg(F.when(F.col("flags").bitwiseAND(F.lit(16)) == 0, 1.0).otherwise(0.0))
    rest = rows.groupBy(*keys).agg((regular < 0.30).alias("bold"), F.bool_and(F.col("flags").bitwiseAND(F.lit(2)) != 0).alias("italic"), F.median("size").alias("size"))
    return family.join(rest, keys)


def font_fit(iou: Column, rendered: Column, target: Column) -> tuple[Column, Column]:
    """Score of a candidate font, and whether its size is to be shrunk (F23, given the measures)."""
    ratio = rendered / F.greatest(F.lit(1.0), target)
    score = 0.7 * iou + 0.3 * F.exp(-F.abs(F.log(ratio)))
    return score, (ratio > 1.12) & (score < 0.55)
