"""Rasters as relations: the long form pixel(img_id, y, x, g) and the packed form, and views of both over plain tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "img_id long, width int, height int, data binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray tiles of 8 x 8 pixels, one for each embedding; g = floor(256 v + 128), clamped to 0..255."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("i", "v"))
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v").cast("double") * 256 + 128))).cast("int")
    return cells.select("img_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), g.alias("g"))


TILE_SQL = """tile AS (SELECT img_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(greatest(0, least(255, floor(CAST(v AS DOUBLE) * 256 + 128))) AS INTEGER) AS g
  FROM (SELECT vec_id AS img_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)), bw AS (SELECT img_id, y, x, CAST(g < 128 AS INTEGER) AS bw FROM tile)"""


WIDTHS = [8, 5, 3, 9, 7, 1, 64, 11]


def odd_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray rasters of odd, unequal sizes and single lines from the same numbers: as many whole rows of WIDTHS[vec_id mod 8] pixels as they give."""
    width = F.get(F.array(*map(F.lit, WIDTHS)), F.pmod(F.col("vec_id"), F.lit(len(WIDTHS))).cast("int"))
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), width.alias("w"), F.posexplode("embedding").alias("i", "v"))
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v").cast("double") * 256 + 128))).cast("int")
    whole = cells.where(F.col("i") < F.expr("64 div w * w"))
    return whole.select("img_id", F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), g.alias("g"))


ODD_SQL = f"""tile AS (SELECT img_id, CAST(i // w AS INTEGER) AS y, CAST(i % w AS INTEGER) AS x, CAST(greatest(0, least(255, floor(CAST(v AS DOUBLE) * 256 + 128))) AS INTEGER) AS g
  FROM (SELECT vec_id AS img_id, {WIDTHS}[CAST(vec_id % 8 AS INTEGER) + 1] AS w, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < 64 // w * w), bw AS (SELECT img_id, y, x, CAST(g < 128 AS INTEGER) AS bw FROM tile)"""


def bitmaps(gray: DataFrame, t: int = 128) -> DataFrame:
    """Black (1) where g < t."""
    return gray.select("img_id", "y", "x", (F.col("g") < t).cast("int").alias("bw"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as rows of a text page: img_id, y, line."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("img_id"), F.posexplode(F.split("text", "\n")).alias("y", "line"))


def to_packed(gray: DataFrame) -> DataFrame:
    """One row per image; pixels in row-major order.  The grid must be dense."""
    cells = gray.groupBy("img_id").agg(
        (F.max("x") + 1).cast("int").alias("width"),
        (F.max("y") + 1).cast("int").alias("height"),
        F.array_sort(F.collect_list(F.struct("y", "x", "g"))).alias("c"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("c")
            data = cells.flatten().field("g").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            ends = np.append(0, np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column("img_id"), b.column("width"), b.column("height"), pa.array([data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["img_id", "width", "height", "data"])

    return cells.mapInArrow(run, PACKED)


def to_long(packed: DataFrame) -> DataFrame:
    """One row per pixel, without leaving the JVM."""
    i = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)
    cells = packed.select("img_id", "width", F.explode(F.zip_with(i, F.split(F.hex("data"), "(?<=\\G..)"), lambda k, h: F.struct(k.alias("i"), h.alias("h")))).alias("c"))
    cells = cells.where(F.col("c.i").isNotNull())
    return cells.select("img_id", F.expr("c.i div width").cast("int").alias("y"), (F.col("c.i") % F.col("width")).cast("int").alias("x"), F.conv(F.col("c.h"), 16, 10).cast("int").alias("g"))


WRAP, CELL, MARGIN = 48, (2, 4), 12


@lru_cache(16)
def _turned(turns: int) -> list[tuple[int, int, int]]:
    """Neighbouring columns of the text block that a turn by half degrees moves down equally: first, one past the last, lines."""
    w = WRAP * CELL[0]
    down = np.floor(np.tan(np.radians(turns * 0.5)) * (np.arange(w) + 0.5 - w / 2) + 0.5).astype(int)
    at = [0, *(np.flatnonzero(np.diff(down)) + 1).tolist(), w]
    return [(i, j, int(down[i])) for i, j in zip(at[:-1], at[1:], strict=True)]


def _rendered(doc: int, text: str) -> tuple[int, int, bytes]:
    """Width, height and gray pixels of ``drawn``."""
    page = drawn(doc, text)
    return page.shape[1], page.shape[0], page.tobytes()


def drawn(doc: int, text: str) -> np.ndarray:
    """A text as a page: 48 characters a line, ink where a character isn't blank, turned by up to two degrees (less than the margin), with a dark fold line on each third page."""
    ink = np.frombuffer((text or "").encode("utf-32-le"), np.uint32) > 32
    rows = max(1, -(-len(ink) // WRAP))
    grid = np.zeros(rows * WRAP, bool)
    grid[: len(ink)] = ink
    h, w = rows * CELL[1] + 2 * MARGIN, WRAP * CELL[0] + 2 * MARGIN
    paper = 235 - 10 * (doc % 3)
    page = np.full((h, w), paper, np.uint8)
    block = np.full((rows, CELL[1], WRAP, CELL[0]), paper, np.uint8)
    for dy in range(CELL[1] // 2):
        for dx in range(CELL[0]):
            block[:, dy, :, dx] = np.where(grid.reshape(rows, WRAP), np.uint8(30 + (MARGIN + dx + dy) % 2 * 20), np.uint8(paper))
    block = block.reshape(rows * CELL[1], WRAP * CELL[0])
    for i, j, down in _turned(doc % 9 - 4):
        page[MARGIN + down : h - MARGIN + down, MARGIN + i : MARGIN + j] = block[:, i:j]
    if doc % 3 == 0:
        page[:, w // 2 : w // 2 + 2] = 60
    return page


def draw(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The page of each text of a batch (img_id, text)."""
    for i in range(0, b.num_rows, 64):
        part = b.slice(i, 64)
        for k, t in zip(part.column("img_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            yield drawn(k or 0, t)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packed gray pages, each text whole; its attribute ``texts`` holds (img_id, text) for those who ``draw`` the pages where they use them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                got = list(draw(part))
                yield pa.RecordBatch.from_arrays([part.column("img_id"), pa.array([a.shape[1] for a in got], pa.int32()), pa.array([a.shape[0] for a in got], pa.int32()), pa.array([a.tobytes() for a in got], pa.binary())], ["img_id", "width", "height", "data"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("img_id"), "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.repartition(parts, F.xxhash64("img_id"))
    pages = texts.mapInArrow(run, PACKED)
    pages.texts = texts
    return pages
