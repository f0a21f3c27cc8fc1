"""Fixpoint operators on images: components, seed fill, reconstruction, distances, despeckling.

They iterate over a whole image, so each image goes to one Arrow kernel; the
rows of an image are bounded by its size, whatever the number of images.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import kernels as K



def dense(table: pa.Table, value: str) -> tuple[int, np.ndarray]:
    """Image id and its raster from the long form."""
    y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.int64)
    out[y, x] = table.column(value).to_numpy()
    return table.column("img_id")[0].as_py(), out


def kernel(df: DataFrame, value: str, out: str, f: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> DataFrame:
    """f over each image's raster; one row per pixel comes back."""

    def run(table: pa.Table) -> pa.Table:
        img, a = dense(table, value)
        r = f(a)
        y, x = np.indices(r.shape)
        return pa.table([pa.array(np.full(r.size, img)), pa.array(y.ravel().astype(np.int32)), pa.array(x.ravel().astype(np.int32)), pa.array(r.ravel().astype(np.int32 if kind == "int" else np.int64))], names=["img_id", "y", "x", out])

    return df.groupBy("img_id").applyInArrow(run, f"img_id long, y int, x int, {out} {kind}")


def components(bw: DataFrame, diagonal: bool = False) -> DataFrame:
    """img_id, y, x, label (0: white)."""
    return kernel(bw, "bw", "label", lambda a: K.components(a, diagonal)[0])


def component_stats(labelled: DataFrame) -> DataFrame:
    """Size and extent of each component."""
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    return labelled.where("label > 0").groupBy("img_id", "label").agg(F.count("*").alias("n"), *box)


def seed_fill(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pixels of the components that a black seed touches: a semi-join on the labels."""
    touched = labelled.where("label > 0").join(seeds.where("bw = 1"), ["img_id", "y", "x"]).select("img_id", "label").distinct()
    filled = touched.withColumn("on", F.lit(1))
    return labelled.join(filled, ["img_id", "label"], "left").select("img_id", "y", "x", F.coalesce("on", F.lit(0)).alias("bw"))


def distance_map(bw: DataFrame) -> DataFrame:
    return kernel(bw, "bw", "d2", K.distances, "long")


def influence(labelled: DataFrame) -> DataFrame:
    """Label of the nearest labelled pixel, of equally near ones the leftmost, then the topmost; 0 in an image without labels."""
    return kernel(labelled, "label", "zone", K.zones)


def reconstruct(gray: DataFrame, marker: Callable[[np.ndarray], np.ndarray], diagonal: bool = False) -> DataFrame:
    """Gray reconstruction of each image from a marker that is made of it."""
    return kernel(gray, "g", "g", lambda a: K.reconstructed(marker(a), a, diagonal))


def despeckle(bw: DataFrame, dpi: int = 300, level: str = "normal") -> DataFrame:
    """Big components, and small ones that hang on a kept one by close and comparable neighbours."""
    return kernel(bw, "bw", "bw", lambda a: K.despeckled(a.astype(np.uint8), dpi, level))


def big_components(bw: DataFrame, big: int, diagonal: bool = True) -> DataFrame:
    """Components whose box has a side of big or more stay, from labels and sizes of one kernel."""

    def run(a: np.ndarray) -> np.ndarray:
        label, n = K.components(a, diagonal)
        box = K.component_boxes(label, n)
        return np.append(False, (box[:, 3] - box[:, 1] + 1 >= big) | (box[:, 4] - box[:, 2] + 1 >= big))[label].astype(np.int64)

    return kernel(bw, "bw", "bw", run)


def skew_scores(bw: DataFrame, slopes: list[float]) -> DataFrame:
    """img_id, slope, score: squared steps between the black counts of neighbouring rows after a shear by each slope."""
    from pyspark.sql import Window

    angles = F.explode(F.array(*(F.lit(s) for s in slopes)))
    rows = bw.select("img_id", "x", "y", "bw", angles.alias("slope")).withColumn("r", F.col("y") + F.floor(F.col("x") * F.col("slope") + 0.5).cast("int"))
    counts = rows.groupBy("img_id", "slope", "r").agg(F.sum("bw").alias("n"))
    step = F.col("n") - F.lag("n").over(Window.partitionBy("img_id", "slope").orderBy("r"))
    return counts.select("img_id", "slope", step.alias("d")).groupBy("img_id", "slope").agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0)).cast("long").alias("score"))


def hough(gray: DataFrame, degrees: list[int]) -> DataFrame:
    """img_id, degree, bin, weight: votes of dark pixels for lines x cos + y sin."""
    angles = F.explode(F.array(*(F.struct(F.lit(d).alias("degree"), F.cos(F.radians(F.lit(float(d)))).alias("c"), F.sin(F.radians(F.lit(float(d)))).alias("s")) for d in degrees)))
    votes = gray.where("g < 128").select("img_id", "y", "x", (128 - F.col("g")).alias("w"), angles.alias("a"))
    at = F.floor(F.round(F.col("x") * F.col("a.c") + F.col("y") * F.col("a.s"), 6) + 0.5).cast("int")
    return votes.groupBy("img_id", F.col("a.degree").alias("degree"), at.alias("bin")).agg(F.sum("w").cast("long").alias("weight"))
