"""Adapters to programs and libraries that may be there (SC6-SC12, SC14, SC16, M1-M6, R4-R8, C of the inventory).

What is missing isn't offered: ``capabilities`` says which, and its flags go into the routes. An
adapter runs a program for each row, in a folder of its own under the task's temporary folder.
"""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Seconds that a rendering may take.
RENDER_SECONDS = 240
PROGRAMS = {"render": ("soffice", "libreoffice"), "media": ("ffmpeg",)}
LIBRARIES = {"pdf": ("pymupdf", "pypdfium2"), "picture": ("PIL",), "recognise": ("rapidocr",)}


def program(name: str) -> str | None:
    return next((p for p in map(shutil.which, PROGRAMS[name]) if p), None)


def library(name: str) -> str | None:
    return next((x for x in LIBRARIES[name] if importlib.util.find_spec(x)), None)


def capabilities(spark: SparkSession) -> DataFrame:
    """capability, provider (null: missing), as the driver finds them."""
    found = [(k, program(k)) for k in PROGRAMS] + [(k, library(k)) for k in LIBRARIES]
    return spark.createDataFrame(found, "capability string, provider string")


def need(name: str) -> str:
    got = program(name) if name in PROGRAMS else library(name)
    if not got:
        raise RuntimeError(f"{name} needs one of: {', '.join((PROGRAMS | LIBRARIES)[name])}")
    return got


def ran(command: list[str], folder: str, seconds: float | None = None) -> None:
    got = subprocess.run(command, capture_output=True, cwd=folder, timeout=seconds)
    if got.returncode:
        raise RuntimeError(got.stderr.decode("utf-8", "replace")[-1200:])


def _files(work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for row in b.to_pylist():
                with tempfile.TemporaryDirectory() as folder:
                    try:
                        out.append(work(row, Path(folder)))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:1200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=["path", "result", "error"])

    return run


def rendered(files: DataFrame) -> DataFrame:
    """path, result (pdf), error of Office files (path, ext, content), each with a profile of its own (SC12)."""
    office = need("render")

    def work(row: dict, folder: Path) -> bytes:
        source = folder / f"source.{row['ext']}"
        source.write_bytes(row["content"])
        ran([office, f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "pdf", "--outdir", str(folder), str(source)], str(folder), RENDER_SECONDS)
        data = (folder / "source.pdf").read_bytes()
        if not data.startswith(b"%PDF-"):
            raise ValueError("the result is no pdf")
        return data

    return files.select("path", "ext", "content").mapInArrow(_files(work), "path string, result binary, error string")


def transcoded(files: DataFrame) -> DataFrame:
    """path, result, error of media (path, ext, content, command, output_ext), by the commands of plans.media.

    In a command the words ``{in}`` and ``{out}`` stand for the files.
    """
    media = need("media")

    def work(row: dict, folder: Path) -> bytes:
        source, output = folder / f"source.{row['ext']}", folder / f"output.{row['output_ext']}"
        source.write_bytes(row["content"])
        ran([media, *(w.replace("{in}", str(source)).replace("{out}", str(output)) for w in row["command"])], str(folder))
        data = output.read_bytes() if output.exists() else b""
        if not data:
            raise ValueError("there is no output")
        return data

    return files.select("path", "ext", "content", "command", "output_ext").mapInArrow(_files(work), "path string, result binary, error string")


def worker_threads(spark: SparkSession, n: int = 4) -> None:
    """Threads that libraries in Python workers may use."""
    spark.sparkContext.environment["OMP_NUM_THREADS"] = str(n)
    os.environ.setdefault("OMP_NUM_THREADS", str(n))
