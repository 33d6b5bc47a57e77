"""Codecs and command lines of media conversions (F12-F15, SK16, M1-M6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import AUDIO_TARGETS

# Fixed values, in their order: container, video codec, audio codec, sample rate; and beside them channels (0: as the source has them).
CODECS = [
    ("mp4", "libx264", "aac", 44100, 0),
    ("mov", "libx264", "aac", 44100, 0),
    ("mkv", "libx264", "aac", 44100, 0),
    ("webm", "libvpx-vp9", "libopus", 48000, 0),
    ("avi", "mpeg4", "libmp3lame", 44100, 2),
    ("wmv", "wmv2", "wmav2", 44100, 2),
    ("flv", "libx264", "aac", 44100, 0),
]
EVEN = "pad=ceil(iw/2)*2:ceil(ih/2)*2"
SCALE_720 = "scale=w='if(gte(iw,ih),min(iw,1280),min(iw,720))':h='if(gte(iw,ih),min(ih,720),min(ih,1280))':force_original_aspect_ratio=decrease:force_divisible_by=2"
EXTRACTED = ("mp3", "wav", "flac", "m4a")
#: Audio targets whose bit rate is set when a track is extracted.
LOSSY = ("mp3", "m4a")


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODECS, "container string, video string, audio string, rate int, channels int")


def no_words() -> Column:
    return F.array().cast("array<string>")


def arguments(*parts: str | Column) -> Column:
    """Words of a command line; strings are cut at spaces, columns may be words or arrays of words."""
    out = [F.array(*(F.lit(w) for w in p.split())) if isinstance(p, str) else p for p in parts]
    return F.concat(*out)


def conversions(rows: DataFrame) -> DataFrame:
    """Adds command, an array of words, for media rows of source and target (M1); null for other targets."""
    both = rows.join(F.broadcast(codecs(rows.sparkSession)), F.col("target") == F.col("container"), "left")
    stereo = F.when(F.col("channels") > 0, F.array(F.lit("-ac"), F.col("channels").cast("string"))).otherwise(no_words())
    video = arguments("-c:v", F.array("video"), f"-pix_fmt yuv420p -vf {EVEN} -c:a", F.array("audio"), "-ar", F.array(F.col("rate").cast("string")), stereo)
    inner = F.when(F.col("target").isin(AUDIO_TARGETS), arguments("-vn")).when(F.col("container").isNotNull(), video)
    command = F.concat(arguments("-nostdin -i"), F.array("source"), inner, arguments("-y"), F.array("output"))
    return both.withColumn("command", command).drop("container", "video", "audio", "rate", "channels")


def tool_format(tool: Column, ext: Column, audio: Column) -> Column:
    """Extension of a video tool's result; null for an audio format that isn't offered."""
    sound = F.when(F.coalesce(audio, F.lit("mp3")).isin(*EXTRACTED), F.coalesce(audio, F.lit("mp3")))
    return F.when(tool == "frame", "png").when(tool == "audio", sound).when(tool == "mute", ext).when(tool.isin("video_compress", "720p"), "mp4")


def tool_command(tool: Column, source: Column, output: Column, crf: Column, audio: Column, seconds: Column) -> Column:
    """Of a video tool (M2-M6); crf is 28, audio mp3 and seconds 0 where null."""
    seek = F.when(tool == "frame", F.concat(arguments("-ss"), F.array(F.coalesce(seconds, F.lit(0.0)).cast("double").cast("string")))).otherwise(no_words())
    rate = F.when(F.coalesce(audio, F.lit("mp3")).isin(*LOSSY), arguments("-b:a 192k")).otherwise(no_words())
    strength = F.when(tool == "video_compress", F.coalesce(crf, F.lit(28))).otherwise(F.lit(22)).cast("string")
    picture = F.when(tool == "720p", F.lit(f"{SCALE_720},{EVEN}")).otherwise(F.lit(EVEN))
    body = (
        F.when(tool == "frame", arguments("-map 0:v:0 -frames:v 1 -update 1"))
        .when(tool == "mute", arguments("-map 0:v:0 -c:v copy -an"))
        .when(tool == "audio", F.concat(arguments("-map 0:a:0 -vn"), rate))
        .when(tool.isin("video_compress", "720p"), arguments("-map 0:v:0 -map 0:a:0? -c:v libx264 -preset medium -crf", F.array(strength), "-pix_fmt yuv420p -c:a aac -b:a 128k -movflags +faststart -vf", F.array(picture)))
    )
    return F.concat(arguments("-nostdin -hide_banner -loglevel error -y"), seek, arguments("-i"), F.array(source), body, F.array(output))


def fit_720p(width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height within 1280 x 720 (upright: 720 x 1280), never larger, even."""
    long, short = F.greatest(width, height), F.least(width, height)
    wide = width >= height
    limit = F.when(wide, F.least(F.lit(1280) / width, F.lit(720) / height)).otherwise(F.least(F.lit(720) / width, F.lit(1280) / height))
    scale = F.least(F.lit(1.0), limit)
    even = lambda x: F.greatest(F.lit(2), F.floor(x * scale / 2) * 2).cast("long")
    return F.when(long > 0, even(width)), F.when(short > 0, even(height))


def even_size(x: Column) -> Column:
    """Padded to the next even number."""
    return (F.ceil(x / 2) * 2).cast("long")
