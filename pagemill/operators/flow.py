"""A page's recognition as one flow: candidates of windows to lines, styles, objects and text.

The engine's candidates are given; everything after it is a relation keyed by the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import objects, pages, recognition


def recognised_lines(candidates: DataFrame) -> DataFrame:
    """Lines of pages in reading order with one style for equal texts and for number labels.

    candidates: as ``recognition.located`` takes them, with n, family and fit. Adds place; family and fit
    are those of the best peer; height is the line's.
    """
    found = recognition.located(candidates).withColumn("height", F.col("y1") - F.col("y0"))
    lines = recognition.reading_order(recognition.distinct_lines(found))
    own = lines.drop("family", "fit")
    styled = own.join(recognition.style_peers(lines), ["page", "n"])
    labels = recognition.number_peers(styled).select("page", "n", F.col("family").alias("label_family"), F.col("fit").alias("label_fit"))
    both = styled.join(labels, ["page", "n"], "left")
    style = {c: F.when(F.col("label_family").isNotNull(), F.col(f"label_{c}")).otherwise(F.col(c)) for c in ("family", "fit")}
    return both.withColumns(style).drop("label_family", "label_fit")


def page_texts(lines: DataFrame) -> DataFrame:
    """page, text: a page's lines in their order."""
    each = F.array_sort(F.collect_list(F.struct("place", "text")))
    return lines.groupBy("page").agg(F.array_join(F.transform(each, lambda x: x["text"]), "\n").alias("text"))


def layout(lines: DataFrame, shapes: DataFrame, pictures: DataFrame) -> DataFrame:
    """Objects of pages in painting order: recognised graphics, then text.

    lines: as ``objects.text_objects`` takes them; shapes, pictures: as ``objects.graphic_objects``.
    """
    text = objects.text_objects(lines)
    graphics = objects.graphic_objects(shapes, pictures)
    return pages.page_objects(text, graphics, ["page"])
