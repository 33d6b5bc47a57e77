"""Names, sizes and results of files (SK1, W10, J13, A16, A17, A19, F27, I5, I6, D7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tools import TOOLS


def published_names(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new with name: the first of stem.ext, stem-1.ext, ... that neither exists nor an earlier row took (SK1, A.19).

    new: folder, stem, ext, ord; existing: folder, name. Names are compared as they are. The free
    suffixes of a stem are at most as many as its rows and its existing names together, so the list of
    candidates is made of the group's own numbers and an anti-join leaves the free ones.
    """
    keys = ["folder", "stem", "ext"]
    name = lambda k: F.concat("stem", F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise(F.lit("")), F.lit("."), "ext")
    order = Window.partitionBy(*keys).orderBy("ord")
    asked = new.withColumn("place", F.row_number().over(order))
    groups = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    there = existing.select("folder", F.col("name").alias("taken")).distinct()
    # An existing name stands for one stem and ext at each of its dots, and for one more where a number ends the stem.
    dots = F.filter(F.sequence(F.lit(1), F.length("taken")), lambda i: F.substring("taken", i, F.lit(1)) == ".")
    cut = there.withColumn("i", F.explode(dots)).select("folder", F.substring("taken", F.lit(1), F.col("i") - 1).alias("body"), F.substring("taken", F.col("i") + 1, F.length("taken")).alias("ext"))
    number = F.regexp_extract("body", "-([1-9][0-9]{0,8})$", 1)
    whole = cut.select("folder", F.col("body").alias("stem"), "ext", F.lit(0).alias("k"))
    parted = cut.where(number != "").select("folder", F.regexp_replace("body", "-[0-9]+$", "").alias("stem"), "ext", number.cast("int").alias("k"))
    used = whole.unionByName(parted).join(groups.select(*keys), keys, "left_semi").distinct()
    held = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    all_k = groups.join(held, keys, "left").select(*keys, F.explode(F.sequence(F.lit(0), (F.col("n") + F.coalesce("m", F.lit(0))).cast("int"))).alias("k"))
    free = all_k.join(used, [*keys, "k"], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("k")))
    return asked.join(free, [*keys, "place"]).withColumn("name", name(F.col("k"))).drop("k", "place")


def size_note(before: Column, after: Column) -> Column:
    """How much smaller a result is, to a tenth of a percent, ties to the even one, or that it isn't.

    The double's tenfold is rounded, not its decimals: from 2000 to 933 it is 53.349999999999994, which is a tie.
    """
    percent = F.format_string("%.1f", F.rint((1 - after / F.greatest(F.lit(1), before)) * 100 * 10) / 10)
    return F.when(after < before, F.concat(F.lit("体积减小 "), percent, F.lit("%"))).otherwise("原文件已较精简，本次没有进一步减小体积。")


def smaller(before: Column, after: Column) -> Column:
    """Size of what is kept: the source where the result isn't smaller."""
    return F.when(after >= before, before).otherwise(after)


def manifest(files: DataFrame, root: str = "") -> DataFrame:
    """path (relative to root), bytes, sha256 of files read as binaryFile."""
    start = F.length(F.lit(root)) + 1
    path = F.when(F.col("path").startswith(root), F.regexp_replace(F.substring("path", start, F.length("path")), "^/+", "")).otherwise(F.col("path"))
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two manifests."""
    a, b = before.select("path", F.col("sha256").alias("x")), after.select("path", F.col("sha256").alias("y"))
    both = a.join(b, "path", "full")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def batch_summary(results: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, good, failed, notes, first_error: what a batch reports (A19): two notes at most, by ord."""
    notes = F.array_sort(F.collect_list(F.when(F.col("note") != "", F.struct("ord", "note"))))
    return results.groupBy(batch).agg(
        F.count_if(F.col("error").isNull()).alias("good"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.array_join(F.transform(F.slice(notes, 1, 2), lambda n: n["note"]), "\n").alias("notes"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("ord", "error")))["error"].alias("first_error"),
    )


# What tools whose results aren't named by their label add to the stem.
SUFFIXES = [
    ("ocr", "-OCR文字"),
    ("images_pdf", "-合并"),
    ("pdf_merge", "-合并"),
    ("pdf_compress", "-压缩"),
]


def output_stem(tool: Column, stem: Column, part: Column) -> Column:
    """Stem of a tool's result (F27): a split's has the name of its part, a page picture's its number."""
    out = F.concat(stem, F.lit("-"), part)
    for key, label, _, _ in TOOLS:
        if key != "pdf_split":
            out = F.when(tool == key, F.concat(stem, F.lit("-" + label))).otherwise(out)
    for key, suffix in SUFFIXES:
        out = F.when(tool == key, F.concat(stem, F.lit(suffix))).otherwise(out)
    return out
