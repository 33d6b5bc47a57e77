"""Tools and the files they apply to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import IMAGES, VIDEO

# Key, label, kind and least number of files of each tool, in the order offered.
TOOLS = [
    ("crop", "图片裁剪", "image", 1),
    ("image_compress", "图片压缩", "image", 1),
    ("privacy", "清除隐私信息", "image", 1),
    ("half", "缩小 50%", "image", 1),
    ("rotate", "旋转", "image", 1),
    ("mirror", "镜像", "image", 1),
    ("grayscale", "黑白", "image", 1),
    ("images_pdf", "多图合并 PDF", "image", 2),
    ("pdf_compress", "PDF 压缩", "pdf", 1),
    ("pdf_split", "PDF 拆分", "pdf", 1),
    ("pdf_merge", "PDF 合并", "pdf", 2),
    ("ocr", "OCR 提取文字", "pdf", 1),
    ("video_compress", "视频压缩", "video", 1),
    ("720p", "视频转 720p", "video", 1),
    ("mute", "视频静音", "video", 1),
    ("audio", "提取音频", "video", 1),
    ("frame", "视频截帧", "video", 1),
]
#: Tools that take all files at once; all others go file by file.
MERGES = ("images_pdf", "pdf_merge")


def tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TOOLS)], "ord int, tool string, label string, kind string, minimum int")


def batch_kinds(files: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, n, kind: image, video or pdf if every file is of that kind, else null."""
    e = F.lower("ext")
    every = lambda exts: F.bool_and(F.coalesce(e.isin(exts), F.lit(False)))
    kind = F.when(every(["pdf"]), "pdf").when(every(IMAGES), "image").when(every(VIDEO), "video")
    return files.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), kind.alias("kind"))


def applicable(files: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, tool, ord for the tools that a batch's kind and number of files allow; ocr takes images too."""
    own = F.broadcast(tools(files.sparkSession)).withColumnRenamed("kind", "tool_kind")
    fits = (F.col("tool_kind") == F.col("kind")) | ((F.col("tool") == "ocr") & (F.col("kind") == "image"))
    return batch_kinds(files, batch).join(own, fits & (F.col("n") >= F.col("minimum"))).select(batch, "tool", "ord")


def runs(files: DataFrame, choice: DataFrame, batch: str = "batch") -> DataFrame:
    """A row for each run of the tool chosen for a batch: tool, files in order, error if it doesn't apply.

    Merges are one run of all files in their ord; other tools run, and fail, file by file.
    """
    ok = applicable(files, batch).select(batch, "tool", F.lit(True).alias("ok"))
    asked = choice.join(ok, [batch, "tool"], "left")
    both = files.join(asked, batch)
    group = F.when(F.col("tool").isin(*MERGES), F.lit(-1)).otherwise(F.col("ord"))
    out = both.groupBy(batch, "tool", "ok", group.alias("run")).agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("f"))
    return out.select(batch, "tool", "run", F.col("f.path").alias("paths"), F.when(F.col("ok").isNull(), F.lit("tool doesn't apply")).alias("error"))
