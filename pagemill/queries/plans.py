"""Queries over formats, tools, media and file names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as files_op
from ..plans import formats, media, tools
from ..sources.tables import table
from .fixtures import EXTENSIONS, FILES, files, listed, values

Q: dict = {}
SQL: dict[str, str] = {}

EXTS = [*formats.IMAGES, *formats.AUDIO, *formats.VIDEO, *formats.DOCUMENTS, "bin", "JPEG"]
CANDS = list(dict.fromkeys(formats.CANDIDATES))


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def norm(c: str) -> str:
    return f"CASE lower({c}) WHEN 'jpeg' THEN 'jpg' WHEN 'tif' THEN 'tiff' ELSE lower({c}) END"


def among(c: str, items) -> str:
    return f"{c} IN ({', '.join(repr(x) for x in items)})"


def route_sql(e: str, t: str, renderer: str) -> str:
    """The ordered rules over normalised names."""
    pages = f"({among(t, formats.IMAGE_TARGETS)} OR {t} = 'pdf')"
    return f"""CASE WHEN {e} = {t} THEN NULL
      WHEN {among(e, formats.IMAGES)} AND {among(t, formats.IMAGE_TARGETS + formats.PAGE_TARGETS)} THEN 'direct'
      WHEN {among(e, formats.AUDIO)} AND {among(t, formats.AUDIO_TARGETS)} THEN 'direct'
      WHEN {among(e, formats.VIDEO)} AND {among(t, formats.VIDEO_TARGETS + formats.AUDIO_TARGETS)} THEN 'direct'
      WHEN NOT {among(e, formats.DOCUMENTS)} THEN NULL
      WHEN {among(t, ['docx', 'pptx', 'md', 'txt'])} THEN 'direct'
      WHEN {e} = 'pdf' AND {among(t, formats.IMAGE_TARGETS)} THEN 'pdf-images'
      WHEN {pages} AND {among(e, formats.OFFICE)} AND {renderer} THEN 'office-pdf'
      WHEN {pages} AND NOT {among(e, formats.OFFICE)} AND {renderer} THEN 'text-word-pdf' END"""


EXT_VALUES = values([(e,) for e in EXTS], "ext")
CAND_VALUES = values([(i, c) for i, c in enumerate(CANDS)], "ord, target")


@query(f"""
WITH pairs AS (SELECT ext, target, renderer, {norm('ext')} AS e FROM (SELECT ext FROM {EXT_VALUES}) a, (SELECT target FROM {CAND_VALUES}) b, (VALUES (true), (false)) r(renderer))
SELECT ext, target, renderer, {route_sql('e', 'target', 'renderer')} AS route FROM pairs
""")
def route_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source beside every target, with and without a renderer."""
    src = spark.createDataFrame([(e, r) for e in EXTS for r in (True, False)], "ext string, renderer boolean")
    both = formats.beside_targets(src)
    return both.select("ext", "target", "renderer", formats.route(F.col("ext"), F.col("target"), F.col("renderer"), F.col("renderer")).alias("route"))


@query(f"""
WITH {FILES}, exts AS (SELECT DISTINCT batch, lower(ext) AS ext FROM files),
routes AS (SELECT batch, target, ord, {route_sql('e', 'target', 'true')} AS route FROM (SELECT batch, {norm('ext')} AS e, target, ord FROM exts, {CAND_VALUES}) x)
SELECT batch, target, ord::INT AS ord FROM routes WHERE route IS NOT NULL GROUP BY batch, target, ord
HAVING count(*) = (SELECT count(*) FROM exts x WHERE x.batch = routes.batch)
""")
def common_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that all files of a batch can reach."""
    return formats.common_targets(files(spark, sf_dir))


KIND_SQL = f"""kinds AS (SELECT batch, count(*) AS n, CASE WHEN bool_and(lower(ext) = 'pdf') THEN 'pdf' WHEN bool_and({among('lower(ext)', formats.IMAGES)}) THEN 'image' WHEN bool_and({among('lower(ext)', formats.VIDEO)}) THEN 'video' END AS kind FROM files GROUP BY batch)"""
TOOL_VALUES = values([(i, k, kind, m) for i, (k, _, kind, m) in enumerate(tools.TOOLS)], "ord, tool, kind, minimum")


@query(f"""
WITH {FILES}, {KIND_SQL}
SELECT batch, tool, ord::INT AS ord FROM kinds k JOIN (SELECT ord, tool, kind AS tool_kind, minimum FROM {TOOL_VALUES}) t
ON (tool_kind = kind OR (tool = 'ocr' AND kind = 'image')) AND n >= minimum
""")
def tool_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that fit a batch."""
    return tools.applicable(files(spark, sf_dir))


@query(f"""
WITH {FILES}, {KIND_SQL}, chosen AS (SELECT DISTINCT batch, CASE WHEN batch % 2 = 0 THEN 'pdf_merge' ELSE 'crop' END AS tool FROM files),
ok AS (SELECT batch, tool FROM kinds k JOIN (SELECT tool, kind AS tool_kind, minimum FROM {TOOL_VALUES}) t ON tool_kind = kind AND n >= minimum)
SELECT f.batch, c.tool, (CASE WHEN c.tool = 'pdf_merge' THEN -1 ELSE f.ord END)::INT AS run, string_agg(f.ext, ',' ORDER BY f.ord) AS exts, count(*)::BIGINT AS n,
       CASE WHEN bool_or(ok.tool IS NOT NULL) THEN NULL ELSE 'tool doesn''t apply' END AS error
FROM files f JOIN chosen c USING (batch) LEFT JOIN ok ON ok.batch = f.batch AND ok.tool = c.tool GROUP BY 1, 2, 3
""")
def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges are one run of all files in order, other tools go file by file."""
    f = files(spark, sf_dir)
    choice = f.select("batch").distinct().withColumn("tool", F.when(F.col("batch") % 2 == 0, "pdf_merge").otherwise("crop"))
    out = tools.runs(f, choice)
    exts = F.array_join(F.transform("paths", lambda p: F.element_at(F.split(p, r"\."), -1)), ",")
    return out.select("batch", "tool", "run", exts.alias("exts"), F.size("paths").cast("long").alias("n"), "error")


MODE_ROWS = [(e, t, m, r) for e in ("pdf", "png", "docx", "txt", "html") for t in ("docx", "pptx", "md", "png") for m in formats.MODES for r in (True, False)]


@query(f"""
WITH p AS (SELECT *, {norm('ext')} AS e FROM {values(MODE_ROWS, 'ext, target, mode, renderer')}),
q AS (SELECT *, {among('e', formats.IMAGES)} OR e = 'pdf' OR ({among('e', formats.OFFICE)} AND renderer) AS paged, {route_sql('e', 'target', 'renderer')} AS route FROM p)
SELECT ext, target, mode, renderer,
  CASE WHEN target NOT IN ('docx', 'pptx') THEN NULL WHEN mode = 'ocr' AND NOT paged THEN 'error' WHEN paged AND mode IN ('layout', 'ocr') THEN 'rebuild-' || mode WHEN paged AND mode = 'pages' THEN 'page-images' ELSE 'text' END AS export,
  CASE route WHEN 'direct' THEN CASE WHEN target IN ('docx', 'pptx') THEN 'export>publish' WHEN target = 'md' THEN 'extract>publish' ELSE 'image>publish' END
    WHEN 'pdf-images' THEN 'rasterise>publish' WHEN 'office-pdf' THEN 'render>rasterise>publish' WHEN 'text-word-pdf' THEN 'write-word>render>rasterise>publish' END AS steps
FROM q
""")
def conversion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export does by mode, and the stages of a conversion."""
    rows = spark.createDataFrame(MODE_ROWS, "ext string, target string, mode string, renderer boolean")
    e, t, r = F.col("ext"), F.col("target"), F.col("renderer")
    stages = formats.steps(e, t, formats.route(e, t, r, r))
    return rows.select("ext", "target", "mode", "renderer", formats.export_mode(e, t, F.col("mode"), r).alias("export"), F.array_join(stages, ">").alias("steps"))


@query(f"""
SELECT ext, kind, string_agg(label, ',') AS label, count(*)::BIGINT AS n FROM (
  SELECT lower(ext) AS ext, CASE WHEN {among('lower(ext)', formats.IMAGES)} THEN 'image' WHEN {among('lower(ext)', formats.AUDIO)} THEN 'audio' WHEN {among('lower(ext)', formats.VIDEO)} THEN 'video' WHEN {among('lower(ext)', formats.DOCUMENTS)} THEN 'document' END AS kind, NULL AS label
  FROM (SELECT {listed(EXTENSIONS)}[CASE WHEN (doc_id // 4) % 3 = 0 THEN doc_id ELSE doc_id // 4 END % {len(EXTENSIONS)} + 1] AS ext FROM documents)
  UNION ALL SELECT ext, 'text', CASE ext WHEN 'docx' THEN 'Word' WHEN 'pptx' THEN 'PPT' ELSE upper(ext) END FROM {values([(x,) for x in formats.DOCUMENTS if x not in formats.OFFICE and x != 'pdf'], 'ext')})
GROUP BY ext, kind
""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their paths; the documents that are plain text, by their label."""
    paths = files(spark, sf_dir).select(formats.extension(F.col("path")).alias("ext"))
    found = paths.select("ext", formats.kind(F.col("ext")).alias("kind"), F.lit(None).cast("string").alias("label"))
    text = spark.createDataFrame([(x,) for x in formats.text_documents()], "ext string").select("ext", F.lit("text").alias("kind"), formats.label(F.col("ext")).alias("label"))
    return found.unionByName(text).groupBy("ext", "kind").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))


MEDIA = [("in.mov", t, "out." + t) for t in [*dict.fromkeys(formats.VIDEO_TARGETS + formats.AUDIO_TARGETS), "png"]]
TOOL_ROWS = [("mute", "mkv", None, None, None), ("audio", "mp4", None, "mp3", None), ("audio", "mp4", None, "wav", None), ("audio", "mp4", None, "m4a", None), ("audio", "mp4", None, "ogg", None), ("audio", "mp4", None, None, None), ("video_compress", "mp4", 23, None, None), ("video_compress", "avi", None, None, None), ("720p", "mp4", 30, None, None), ("frame", "mp4", None, None, 12.5), ("frame", "mp4", None, None, None), ("crop", "png", None, None, None)]
CODEC_VALUES = values(media.CODECS, "container, video, audio, rate, channels")


def quoted(x: str) -> str:
    return x.replace("'", "''")


@query(f"""
SELECT target AS name, CASE WHEN {among('target', formats.AUDIO_TARGETS)} THEN '-nostdin -i ' || source || ' -vn -y ' || output
  WHEN container IS NOT NULL THEN '-nostdin -i ' || source || ' -c:v ' || video || ' -pix_fmt yuv420p -vf {media.EVEN} -c:a ' || audio || ' -ar ' || rate || CASE WHEN channels > 0 THEN ' -ac ' || channels ELSE '' END || ' -y ' || output END AS command, NULL AS format
FROM {values(MEDIA, 'source, target, output')} LEFT JOIN (SELECT * FROM {CODEC_VALUES}) c ON target = container
UNION ALL
SELECT tool || ' ' || ext || ' ' || coalesce(sound, '-') || ' ' || coalesce(crf, -1) || ' ' || coalesce(seconds, -1.0), '-nostdin -hide_banner -loglevel error -y' || CASE WHEN tool = 'frame' THEN ' -ss ' || coalesce(seconds, 0.0::DOUBLE) ELSE '' END || ' -i in ' ||
  CASE tool WHEN 'frame' THEN '-map 0:v:0 -frames:v 1 -update 1' WHEN 'mute' THEN '-map 0:v:0 -c:v copy -an' WHEN 'audio' THEN '-map 0:a:0 -vn' || CASE WHEN coalesce(sound, 'mp3') IN ('mp3', 'm4a') THEN ' -b:a 192k' ELSE '' END
    WHEN 'video_compress' THEN '-map 0:v:0 -map 0:a:0? -c:v libx264 -preset medium -crf ' || coalesce(crf, 28) || ' -pix_fmt yuv420p -c:a aac -b:a 128k -movflags +faststart -vf {media.EVEN}'
    WHEN '720p' THEN '-map 0:v:0 -map 0:a:0? -c:v libx264 -preset medium -crf 22 -pix_fmt yuv420p -c:a aac -b:a 128k -movflags +faststart -vf {quoted(media.SCALE_720)},{media.EVEN}' END || ' out',
  CASE tool WHEN 'frame' THEN 'png' WHEN 'audio' THEN CASE WHEN coalesce(sound, 'mp3') IN ('mp3', 'wav', 'flac', 'm4a') THEN coalesce(sound, 'mp3') END WHEN 'mute' THEN ext WHEN 'video_compress' THEN 'mp4' WHEN '720p' THEN 'mp4' END
FROM {values(TOOL_ROWS, 'tool, ext, crf, sound, seconds')}
""")
def media_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, F15, SK16, M1-M6: command lines by container and by tool."""
    m = media.conversions(spark.createDataFrame(MEDIA, "source string, target string, output string"))
    t = spark.createDataFrame(TOOL_ROWS, "tool string, ext string, crf int, sound string, seconds double")
    own = media.tool_command(F.col("tool"), F.lit("in"), F.lit("out"), F.col("crf"), F.col("sound"), F.col("seconds"))
    name = F.concat_ws(" ", "tool", "ext", F.coalesce("sound", F.lit("-")), F.coalesce("crf", F.lit(-1)).cast("string"), F.coalesce("seconds", F.lit(-1.0)).cast("string"))
    a = m.select(F.col("target").alias("name"), F.array_join("command", " ").alias("command"), F.lit(None).cast("string").alias("format"))
    b = t.select(name.alias("name"), F.array_join(own, " ").alias("command"), media.tool_format(F.col("tool"), F.col("ext"), F.col("sound")).alias("format"))
    return a.unionByName(b)


@query("""
WITH new AS (SELECT source AS folder, 'part' || (doc_id % 3) AS stem, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'txt' END AS ext, doc_id AS ord FROM documents),
existing AS (SELECT DISTINCT source AS folder, 'part' || (doc_id % 5) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '-' || (doc_id % 4) END || '.png' AS name FROM documents WHERE doc_id % 7 = 0),
used AS (SELECT DISTINCT n.folder, n.stem, n.ext, k FROM (SELECT DISTINCT folder, stem, ext FROM new) n, (SELECT unnest(range(0, 10)) AS k) JOIN existing e ON e.folder = n.folder AND e.name = n.stem || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.' || n.ext),
free AS (SELECT n.folder, n.stem, n.ext, c.k, row_number() OVER (PARTITION BY n.folder, n.stem, n.ext ORDER BY c.k) AS place
  FROM (SELECT folder, stem, ext, count(*) AS m FROM new GROUP BY ALL) n, (SELECT unnest(range(0, 200000)) AS k) c LEFT JOIN used u ON u.folder = n.folder AND u.stem = n.stem AND u.ext = n.ext AND u.k = c.k WHERE u.k IS NULL AND c.k <= n.m + 10),
asked AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY ord) AS place FROM new)
SELECT a.folder, a.ord, a.stem || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.' || a.ext AS name FROM asked a JOIN free USING (folder, stem, ext, place)
""")
def publish_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1, W10, J13: names that replace no file."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    new = d.select(F.col("source").alias("folder"), F.concat(F.lit("part"), (k % 3).cast("string")).alias("stem"), F.when(k % 2 == 0, "png").otherwise("txt").alias("ext"), k.alias("ord"))
    there = d.where(k % 7 == 0).select(F.col("source").alias("folder"), F.concat(F.lit("part"), (k % 5).cast("string"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("-"), (k % 4).cast("string"))), F.lit(".png")).alias("name")).distinct()
    return files_op.published_names(new, there).select("folder", "ord", "name")


@query("""
SELECT doc_id, n_chars AS before, after, CASE WHEN after < n_chars THEN '体积减小 ' || format('{:.1f}', round_even((1 - after / greatest(1, n_chars)) * 100, 1)) || '%' ELSE '原文件已较精简，本次没有进一步减小体积。' END AS note, CASE WHEN after >= n_chars THEN n_chars ELSE after END AS kept
FROM (SELECT doc_id, n_chars, length(regexp_replace(text, '[aeiou]+', '', 'g')) + CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 0 END AS after FROM documents)
""")
def size_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much smaller a result is, and which is kept."""
    after = (F.length(F.regexp_replace("text", "[aeiou]+", "")) + F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(0)).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("before"), after.alias("after"))
    return d.select("doc_id", "before", "after", files_op.size_note(F.col("before"), F.col("after")).alias("note"), files_op.smaller(F.col("before"), F.col("after")).alias("kept"))


@query("""
SELECT 'doc' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM documents
""")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, size and digest of files."""
    d = table(spark, sf_dir, "documents")
    as_files = d.select(F.concat(F.lit("/root/x/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return files_op.manifest(as_files, "/root/x")


@query("""
WITH r AS (SELECT source AS batch, doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN 'bad ' || doc_id END AS error, CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id ELSE '' END AS note FROM documents)
SELECT batch, count(*) FILTER (WHERE error IS NULL)::BIGINT AS good, count(*) FILTER (WHERE error IS NOT NULL)::BIGINT AS failed,
  coalesce(array_to_string(list(note ORDER BY ord) FILTER (WHERE note <> '')[1:2], chr(10)), '') AS notes, arg_min(error, ord) FILTER (WHERE error IS NOT NULL) AS first_error
FROM r GROUP BY batch
""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch reports."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("batch"), k.alias("ord"), F.when(k % 5 == 0, F.concat(F.lit("bad "), k.cast("string"))).alias("error"), F.when(k % 3 == 0, F.concat(F.lit("note "), k.cast("string"))).otherwise("").alias("note"))
    return files_op.batch_summary(rows)


@query(f"""
SELECT tool, stem || CASE tool WHEN 'pdf_split' THEN '-' || part WHEN 'page_image' THEN '-' || part WHEN 'ocr' THEN '-OCR文字' WHEN 'images_pdf' THEN '-合并' WHEN 'pdf_merge' THEN '-合并' WHEN 'pdf_compress' THEN '-压缩' ELSE '-' || label END AS name
FROM {values([(k, label, 'a b', '第2-3页') for k, label, _, _ in tools.TOOLS] + [('page_image', '', 'x', '第1页')], 'tool, label, stem, part')}
""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27, SK17: stems of results by tool."""
    rows = spark.createDataFrame([(k, "a b", "第2-3页") for k, _, _, _ in tools.TOOLS] + [("page_image", "x", "第1页")], "tool string, stem string, part string")
    return rows.select("tool", files_op.output_stem(F.col("tool"), F.col("stem"), F.col("part")).alias("name"))
