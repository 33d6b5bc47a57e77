"""Files that never replace others (SK1), and texts (SK4)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame


def publish(folder: Path, stem: str, ext: str, data: bytes) -> Path:
    """Writes data to the first free name of stem.ext, stem-1.ext, ...; a failed write leaves no file."""
    k = 0
    while True:
        path = folder / f"{stem}{f'-{k}' if k else ''}.{ext}"
        try:
            file = path.open("xb")
        except FileExistsError:
            k += 1
            continue
        try:
            with file:
                file.write(data)
        except BaseException:
            path.unlink(missing_ok=True)
            raise
        return path


def published(files: DataFrame) -> DataFrame:
    """folder, stem, ext, path, error of files (folder, stem, ext, content) put in folders all nodes share.

    Each name is taken by an exclusive create. A task that runs again publishes again, under the next
    name; use operators.files.published_names and a table for outputs that must come once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, errors = [], []
            for r in b.to_pylist():
                try:
                    os.makedirs(r["folder"], exist_ok=True)
                    paths.append(str(publish(Path(r["folder"]), r["stem"], r["ext"], r["content"])))
                    errors.append(None)
                except OSError as e:
                    paths.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["folder", "stem", "ext", "path", "error"])

    return files.select("folder", "stem", "ext", "content").mapInArrow(run, "folder string, stem string, ext string, path string, error string")


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    """A text a file's record; errors if the folder exists (SK4)."""
    rows.select(text).write.mode("errorifexists").text(path)
