"""PNG and BMP by the standard library, to and from the picture struct of operators.raster (SC4, SK2)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.raster import PIXELS, on_white, packed, pixels

MAGIC = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(a: np.ndarray) -> bytes:
    """RGBA, 8 bits, no metadata."""
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a).reshape(h, w * 4)], axis=1)
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def unfiltered(data: bytes, h: int, stride: int, step: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) & 255
        elif kind == 2:
            now = (line + above) & 255
        elif kind in (3, 4):
            now = line.copy()
            for x in range(stride):
                left = now[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + above[x]) >> 1
                else:
                    corner = above[x - step] if x >= step else 0
                    p = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v: abs(p - v))
                now[x] = (line[x] + guess) & 255
        else:
            raise ValueError("unknown filter")
        out[y] = now
        above = now
    return out


def decode_png(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit PNG that isn't interlaced: grey, colour or palette, with or without alpha."""
    if not data.startswith(MAGIC):
        raise ValueError("not a PNG")
    at, parts, head, palette, alpha = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG without interlace")
    w, h, _, colour = head[:4]
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    x = unfiltered(zlib.decompress(b"".join(parts)), h, w * step, step).reshape(h, w, step)
    opaque = np.full((h, w, 1), 255, np.uint8)
    if colour == 6:
        return x
    if colour == 2:
        return np.concatenate([x, opaque], axis=2)
    if colour == 3:
        a = np.full(len(palette), 255, np.uint8)
        if alpha is not None:
            a[: len(alpha)] = alpha
        return np.concatenate([palette[x[:, :, 0]], a[x[:, :, 0]][:, :, None]], axis=2)
    return np.concatenate([x[:, :, :1].repeat(3, axis=2), x[:, :, 1:] if colour == 4 else opaque], axis=2)


def encode_bmp(a: np.ndarray) -> bytes:
    """24 bits, transparency on white."""
    rgb = on_white(a)[::-1, :, 2::-1]
    h, w = rgb.shape[:2]
    pad = -w * 3 % 4
    rows = b"".join(r.tobytes() + b"\0" * pad for r in rgb)
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def decoded(files: DataFrame) -> DataFrame:
    """path, picture, error of PNG files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"path": path, "picture": packed(decode_png(data)), "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({"path": path, "picture": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("picture", pa.struct([("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, f"path string, picture {PIXELS}, error string")


def encoded(pictures: DataFrame, ext: str = "png") -> DataFrame:
    """path, content of pictures (path, picture)."""
    write = {"png": encode_png, "bmp": encode_bmp}[ext]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if p is None else write(pixels(p)) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["path", "content"])

    return pictures.select("path", "picture").mapInArrow(run, "path string, content binary")
