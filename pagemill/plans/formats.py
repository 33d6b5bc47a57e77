"""Formats and the routes between them.

The registry is a few dozen rows, so it is the broadcast side of every join; a batch of files of any
size is reduced to its distinct extensions before it meets the routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats known, in their order.
IMAGES = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif"]
AUDIO = ["mp3", "wav", "flac", "aac", "ogg", "m4a"]
VIDEO = ["mp4", "mov", "avi", "mkv", "webm", "wmv", "flv"]
DOCUMENTS = ["pdf", "docx", "pptx", "xlsx", "xls", "html", "htm", "txt", "md", "csv", "json", "xml", "epub"]
OFFICE = ["docx", "pptx", "xlsx", "xls"]
IMAGE_TARGETS = ["png", "jpg", "webp", "bmp", "tiff", "gif"]
PAGE_TARGETS = ["pdf", "docx", "pptx", "md", "txt"]
VIDEO_TARGETS = ["mp4", "webm", "mov", "avi", "mkv", "wmv", "flv"]
AUDIO_TARGETS = ["mp3", "wav", "flac", "aac", "ogg", "m4a"]

KINDS = {"image": IMAGES, "audio": AUDIO, "video": VIDEO, "document": DOCUMENTS}
CANDIDATES = [*IMAGE_TARGETS, *PAGE_TARGETS, *VIDEO_TARGETS, *AUDIO_TARGETS]
MODES = ["pages", "layout", "text", "ocr"]


def normalised(ext: Column) -> Column:
    """Lower case; jpeg is jpg and tif is tiff."""
    low = F.lower(ext)
    return F.when(low == "jpeg", "jpg").when(low == "tif", "tiff").otherwise(low)


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part, empty without one (D1). A leading dot begins no extension."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))


def kind(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, exts in reversed(KINDS.items()):
        out = F.when(F.lower(ext).isin(exts), name).otherwise(out)
    return out


def label(ext: Column) -> Column:
    """The name shown for a format (P20)."""
    return F.when(ext == "docx", "Word").when(ext == "pptx", "PPT").otherwise(F.upper(ext))


def registry(spark: SparkSession) -> DataFrame:
    """ext, kind, is_office, is_target, ord."""
    rows = [(e, k, e in OFFICE, e in CANDIDATES, i) for k, es in KINDS.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "ext string, kind string, is_office boolean, is_target boolean, ord int")


def candidates(spark: SparkSession) -> DataFrame:
    """target, ord: every target in the order offered; formats of two kinds come once."""
    return spark.createDataFrame(list(enumerate(dict.fromkeys(CANDIDATES))), "ord int, target string")


def has_pages(ext: Column, renderer: Column) -> Column:
    """Documents that can be shown page by page."""
    return (F.lower(ext) == "pdf") | (F.lower(ext).isin(OFFICE) & renderer)


def route(ext: Column, target: Column, renderer: Column, word: Column) -> Column:
    """direct, pdf-images, office-pdf, text-word-pdf or null (P2, D4); the first rule that applies.

    renderer: whether an Office file of this extension can be rendered; word: whether Word files can.
    """
    e, t = normalised(ext), normalised(target)
    page = t.isin(IMAGE_TARGETS) | (t == "pdf")
    return (
        F.when(e == t, F.lit(None))
        .when(e.isin(IMAGES) & (t.isin(IMAGE_TARGETS) | t.isin(PAGE_TARGETS)), "direct")
        .when(e.isin(AUDIO) & t.isin(AUDIO_TARGETS), "direct")
        .when(e.isin(VIDEO) & (t.isin(VIDEO_TARGETS) | t.isin(AUDIO_TARGETS)), "direct")
        .when(~e.isin(DOCUMENTS), F.lit(None))
        .when(t.isin([x for x in PAGE_TARGETS if x != "pdf"]), "direct")
        .when((e == "pdf") & t.isin(IMAGE_TARGETS), "pdf-images")
        .when(page & e.isin(OFFICE) & renderer, "office-pdf")
        .when(page & ~e.isin(OFFICE) & word, "text-word-pdf")
    )


def beside_targets(rows: DataFrame) -> DataFrame:
    """rows with ord and target, once for every target."""
    names = [c for c in rows.columns if c not in ("ord", "target")]
    return rows.select(*names, F.posexplode(F.array(*(F.lit(t) for t in dict.fromkeys(CANDIDATES)))).alias("ord", "target"))


def routes(sources: DataFrame, renderer: Column | bool, word: Column | bool) -> DataFrame:
    """The rows of sources (with ext) beside every target that can be reached: target, ord, route."""
    both = beside_targets(sources)
    renderer, word = (F.lit(x) if isinstance(x, bool) else x for x in (renderer, word))
    return both.withColumn("route", route(F.col("ext"), F.col("target"), renderer, word)).where("route is not null")


def common_targets(files: DataFrame, batch: str = "batch", renderer: bool = True) -> DataFrame:
    """batch, target, ord: targets that all files of a batch can reach.

    Only distinct extensions meet the targets: a target is common if it is reached from as many
    extensions as the batch has.
    """
    exts = files.select(batch, F.lower("ext").alias("ext")).distinct()
    wanted = exts.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    reached = routes(exts, renderer, renderer).groupBy(batch, "target", "ord").agg(F.count(F.lit(1)).alias("m"))
    return reached.join(wanted, batch).where("m = n").select(batch, "target", "ord")


def export_mode(ext: Column, target: Column, mode: Column, renderer: Column) -> Column:
    """What an export of a document or image to Word or slides does (P7, P21, Q8); ``error`` where it can't.

    An image is one page; pdf and rendered Office files have pages; all else is text.
    """
    e = normalised(ext)
    paged = e.isin(IMAGES) | has_pages(e, renderer)
    office = normalised(target).isin("docx", "pptx")
    return (
        F.when(~office, F.lit(None))
        .when((mode == "ocr") & ~paged, "error")
        .when(paged & mode.isin("layout", "ocr"), F.concat(F.lit("rebuild-"), mode))
        .when(paged & (mode == "pages"), "page-images")
        .otherwise("text")
    )


def steps(ext: Column, target: Column, route_name: Column) -> Column:
    """The stages of a conversion in turn, as an array (P6, section 3.1); null without a route."""
    e, t = normalised(ext), normalised(target)
    last = F.when(t == "pdf", F.array(F.lit("publish"))).otherwise(F.array(F.lit("rasterise"), F.lit("publish")))
    kind_of = kind(e)
    direct = (
        F.when(kind_of.isin("audio", "video"), F.array(F.lit("transcode"), F.lit("publish")))
        .when(t.isin("docx", "pptx"), F.array(F.lit("export"), F.lit("publish")))
        .when(t.isin("md", "txt"), F.array(F.lit("extract"), F.lit("publish")))
        .otherwise(F.array(F.lit("image"), F.lit("publish")))
    )
    return (
        F.when(route_name == "direct", direct)
        .when(route_name == "pdf-images", F.array(F.lit("rasterise"), F.lit("publish")))
        .when(route_name == "office-pdf", F.concat(F.array(F.lit("render")), last))
        .when(route_name == "text-word-pdf", F.concat(F.array(F.lit("write-word"), F.lit("render")), last))
    )


def text_documents() -> list[str]:
    """Documents that are neither Office files nor pdf."""
    return [x for x in DOCUMENTS if x not in OFFICE and x != "pdf"]
