"""Image files as packed rasters: binary PGM, PPM and PBM files through the binaryFile source, and their writer.

Only formats that need no image library are read; other files give a row with
a null raster and the status ``unrecognised``, so that no file is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, status string, width int, height int, data binary"
_HEAD = re.compile(rb"(P[456])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s", re.S)


def decode(content: bytes) -> tuple[int, int, bytes] | None:
    """Width, height and gray pixels of a binary PNM file; None for anything else or a file that is cut short."""
    kind = content[:2]
    m = _HEAD.match(content) if kind != b"P4" else re.compile(_HEAD.pattern.replace(rb"(?:(?:\s|#[^\n]*\n)+(\d+))?", b"()"), re.S).match(content)
    if not m:
        return None
    w, h = int(m[2]), int(m[3])
    raw = np.frombuffer(content, np.uint8, offset=m.end())
    if kind == b"P4":
        row = (w + 7) // 8
        if len(raw) < row * h:
            return None
        bits = np.unpackbits(raw[: row * h].reshape(h, row), axis=1)[:, :w]
        return w, h, np.where(bits == 1, 0, 255).astype(np.uint8).tobytes()
    planes = 3 if kind == b"P6" else 1
    if not m[4] or int(m[4]) != 255 or len(raw) < w * h * planes:
        return None
    px = raw[: w * h * planes].astype(np.int32)
    if planes == 3:
        px = px.reshape(-1, 3)
        px = (11 * px[:, 0] + 16 * px[:, 1] + 5 * px[:, 2]) >> 5
    return w, h, px.astype(np.uint8).tobytes()


def encode(width: int, height: int, data: bytes) -> bytes:
    """A binary PGM file."""
    return b"P5\n%d %d\n255\n" % (width, height) + data


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, status (loaded or unrecognised), width, height, data of each file that the path or pattern names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decode(c) for c in b.column("content").to_pylist()]
            status = pa.array(["unrecognised" if g is None else "loaded" for g in got], pa.string())
            cols = [pa.array([None if g is None else g[k] for g in got], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("path"), status, *cols], ["path", "status", "width", "height", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
