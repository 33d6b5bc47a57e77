"""Written tables in the folder that the cluster shares, and other things each operator needs.

Executors can be lost at any time, so what is used twice is written as Parquet under
``spark.checkpoint.dir`` and read again; nothing depends on one executor's disk or memory.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words are runs of bytes other than ASCII white space, as ``bytes.split()`` cuts them.
WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one of this application's if driver and executors are one process;
    on a cluster, whose executors wouldn't see it, ValueError.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        where = _OWN[app]
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls get the same."""
    return f"{shared_dir(spark)}/pagemill-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df after a round trip through a table, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing will read again; others aren't touched."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def repeats(rows: DataFrame, keys: list[str], rid: str = "rid", line: int = 2048, most: int = 50_000) -> DataFrame:
    """rows and salt: 0, but for rows that are alike in keys in great number a hash of their own, to deal them out.

    Great is over ``line`` and over the ``most``-th part of all rows, so those kept in mind are ``most``.
    """
    n = rows.count()
    line = max(line, n // most)
    heavy = rows.groupBy(*(F.col(k).alias(f"own_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > line)
    met = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys]
    out = rows.join(F.broadcast(heavy), reduce(and_, met), "left")
    salt = F.when(F.col("times").isNotNull(), F.xxhash64(rid)).otherwise(F.lit(0))
    return out.select(*rows.columns, salt.alias("salt"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(rows: DataFrame) -> Column:
    """All columns of rows in one struct, ``row``, so that no name of theirs meets one of ours."""
    return F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo; a null key counts as the empty text."""
    text = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the repository lies on a shared path.

    On a cluster whose nodes don't see the repository, pass the package by ``--py-files`` instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if BATCH not in spark.conf.getAll:  # nobody chose: 10,000 long texts are too many for small executors
        spark.conf.set(BATCH, "1024")


def freed() -> None:
    """What this process has freed goes back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """batches; when they end, the worker's freed memory goes back to the system."""
    try:
        yield from batches
    finally:
        freed()
