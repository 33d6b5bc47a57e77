"""Files as relations (SC1, SC2, SC12, D1, D17, I2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import without_bom
from ..plans.formats import extension, kind

PDF_MAGIC = b"%PDF-"
JOB = "kind string, files array<string>, output_dir string"


def resolved(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, status (file, directory or missing), length of named inputs, in any store that Spark reads (SC1).

    Only files may be converted; the names are a user's choice, so they are looked up on the driver.
    """
    rows = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        there = system.getFileStatus(path) if system.exists(path) else None
        rows.append((p, "missing" if there is None else "directory" if there.isDirectory() else "file", None if there is None or there.isDirectory() else there.getLen()))
    return spark.createDataFrame(rows, "path string, status string, length long")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content, ext, kind; the file's content is read only where it is used."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.drop("modificationTime").withColumn("ext", extension(F.col("path"))).withColumn("kind", kind(F.col("ext")))


def text_files(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """path, text of whole UTF-8 files, without a byte-order mark."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), without_bom(F.col("value")).alias("text"))


def is_pdf(content: Column) -> Column:
    """Whether bytes begin as a pdf does (SC12)."""
    return F.substring(content, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC)


def jobs(lines: DataFrame, column: str = "value") -> DataFrame:
    """kind, files, output_dir, error of JSON requests; a malformed one or one of an unknown kind has an error (SC15, I2)."""
    job = F.from_json(column, JOB)
    known = F.col("job.kind").isin("ocr_text", "ocr_layout", "ocr")
    parsed = lines.select(job.alias("job"))
    error = F.when(F.col("job.kind").isNull(), "malformed").when(~known, "unknown kind")
    return parsed.select("job.*", error.alias("error"))


def responses(items: DataFrame) -> DataFrame:
    """json of each result: its items, or its error (SK18). items: items array, error."""
    fields = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct("items")))
    return items.select(fields.alias("json"))
