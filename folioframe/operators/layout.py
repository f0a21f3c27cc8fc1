"""Page geometry and project edits: margins, rectangles, transform chains, split positions, ordered inserts, relinking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_margins(before: Column, after: Column, free: Column) -> tuple[Column, Column]:
    """Shares of the free millimetres in proportion to the pixels before and after; none if these are less than one."""
    space = before + after
    some = F.when(space >= 1, space)
    return F.coalesce(before * free / some, F.lit(0.0)), F.coalesce(after * free / some, F.lit(0.0))


def millimetres(pixels: Column, dpi: Column) -> Column:
    return pixels * 25.4 / dpi


def at_dpi(pixels: Column, dpi: Column, to: int = 300) -> Column:
    """Length at another resolution, halves up, one at least."""
    return F.greatest(F.lit(1), F.floor(pixels * to / dpi + 0.5)).cast("long")


def transformed_size(pages: DataFrame, scale: float, degrees: Column) -> DataFrame:
    """pages with out_w, out_h: scaled, turned by whole quarters, then the box of a rotation by angle (degrees); each step works on the one before."""
    w, h = F.floor(F.col("width") * scale + 0.5), F.floor(F.col("height") * scale + 0.5)
    turned = F.pmod(degrees, F.lit(180)) == 90
    p = pages.withColumn("_w", F.when(turned, h).otherwise(w)).withColumn("_h", F.when(turned, w).otherwise(h))
    c, s = F.abs(F.cos(F.radians(F.col("angle").cast("double")))), F.abs(F.sin(F.radians(F.col("angle").cast("double"))))
    return p.withColumn("out_w", F.round(F.col("_w") * c + F.col("_h") * s, 6)).withColumn("out_h", F.round(F.col("_w") * s + F.col("_h") * c, 6)).drop("_w", "_h")


def split_position(spans: DataFrame, images: DataFrame, clear: int = 15, least: float = 0.25, near: float = 0.9) -> DataFrame:
    """img_id, at: where two pages part, from content spans (first, last) and images (img_id, width).

    A gap's balance is the smaller by the larger of the widths of content left
    and right of it.  Of the run of gaps around the best balanced one that are
    near times as balanced at least, the widest is taken (of equal ones the
    leftmost), at its middle.  With one span, or a best balance below least,
    the extent of all spans counts as one: the middle of the page if that is
    more than clear pixels off it, else beside it on the wider side.  Without
    spans it is the middle.
    """
    w = Window.partitionBy("img_id").orderBy("first")
    every = Window.partitionBy("img_id")
    s = spans.select("img_id", "first", (F.col("last") + 1).alias("end"))
    s = s.select("*", F.lead("first").over(w).alias("next"), F.min("first").over(every).alias("a"), F.max("end").over(every).alias("b"), F.row_number().over(w).alias("k"))
    left, right = F.col("end") - F.col("a"), F.col("b") - F.col("next")
    s = s.withColumn("balance", F.when(F.col("next").isNotNull(), F.round(F.least(left, right) / F.greatest(left, right), 9)))
    s = s.withColumn("best", F.max("balance").over(every)).withColumn("at", F.max(F.when(F.col("balance") == F.col("best"), -F.col("k"))).over(every) * -1)
    weak = F.col("balance").isNull() | (F.col("balance") < near * F.col("best"))
    s = s.withColumn("lo", F.coalesce(F.max(F.when(weak & (F.col("k") < F.col("at")), F.col("k"))).over(every), F.lit(0))).withColumn("hi", F.coalesce(F.min(F.when(weak & (F.col("k") > F.col("at")), F.col("k"))).over(every), F.lit(1 << 30)))
    gap = F.when((F.col("best") >= least) & (F.col("k") > F.col("lo")) & (F.col("k") < F.col("hi")) & F.col("next").isNotNull(), F.struct((F.col("next") - F.col("end")).alias("size"), (-F.col("k")).alias("k"), ((F.col("end") + F.col("next")) / 2).alias("mid")))
    one = s.groupBy("img_id").agg(F.max(gap)["mid"].alias("mid"), F.min("a").alias("a"), F.max("b").alias("b"))
    page, a, b = F.col("width"), F.col("a"), F.col("b")
    off = F.abs(page - (a + b)) / 2 - (b - a) / 2
    beside = F.when(a > page - b, F.greatest(F.lit(0), a - clear)).otherwise(F.least(page, b + clear)).cast("double")
    return images.join(one, "img_id", "left").select("img_id", F.when(a.isNull() | (F.col("mid").isNull() & (off > clear)), page / 2).otherwise(F.coalesce("mid", beside)).alias("at"))


def inserted(pages: DataFrame, new: DataFrame, by: str, order: str) -> DataFrame:
    """pages and new (each before the page whose order it names), renumbered from 1 by ``by``; of several before one page the order of id decides."""
    both = pages.select(by, order, "id", F.lit(1).alias("_k")).unionByName(new.select(by, order, "id", F.lit(0).alias("_k")))
    return both.select(by, "id", F.row_number().over(Window.partitionBy(by).orderBy(order, "_k", "id")).cast("long").alias("number"))


def relinked(files: DataFrame, moves: DataFrame, path: str) -> DataFrame:
    """files with path replaced where moves (old, new) has it."""
    return files.join(moves, F.col(path) == F.col("old"), "left").withColumn(path, F.coalesce("new", path)).drop("old", "new")


def updated(rows: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of fresh (one row a key) where it has the key; what is missing keeps its old value."""
    new = fresh.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in rows.columns))
