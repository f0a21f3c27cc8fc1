"""Thresholds beyond Otsu's: histogram peaks, edge means, edge-enhanced binarisation, dominant background."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import pixels as P


def dense_histogram(gray: DataFrame) -> DataFrame:
    """img_id, g, n with a row for each of the 256 levels."""
    levels = gray.select("img_id").distinct().select("img_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("g"))
    return levels.join(P.histogram(gray), ["img_id", "g"], "left").select("img_id", "g", F.coalesce("n", F.lit(0)).alias("n"))


def peak(gray: DataFrame, drop: float = 0.66, share: float = 0.75) -> DataFrame:
    """img_id, threshold: from either end the highest level before the counts first fall below drop of the highest so far; share of the way from the left to the right one."""
    up = Window.partitionBy("img_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("img_id").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("img_id")
    h = dense_histogram(gray).select("*", F.max("n").over(up).alias("u"), F.max("n").over(down).alias("d"))
    h = h.select("*", F.min(F.when(F.col("n") < F.col("u") * drop, F.col("g"))).over(every).alias("stop"), F.max(F.when(F.col("n") < F.col("d") * drop, F.col("g"))).over(every).alias("start"))
    left = F.max(F.when(F.col("g") < F.coalesce("stop", F.lit(256)), F.struct(F.col("n"), (-F.col("g")).alias("at"))))
    right = F.max(F.when(F.col("g") > F.coalesce("start", F.lit(-1)), F.struct(F.col("n"), F.col("g").alias("at"))))
    ends = h.groupBy("img_id").agg((-left["at"]).alias("l"), right["at"].alias("r"))
    return ends.select("img_id", F.floor(F.col("l") + (F.col("r") - F.col("l")) * share).cast("int").alias("threshold"))


def edge_mean(gray: DataFrame, width: int, magnitude: int) -> DataFrame:
    """img_id, threshold: mean middle of a pixel and the darkest around it, over pairs that differ by magnitude or more; 128 without any."""
    size = Window.partitionBy("img_id")
    near = P.passes(gray, {"m": ("min", "g")}, (-width, width), (-width, width))
    near = near.select("*", F.max("x").over(size).alias("w"), F.max("y").over(size).alias("h"))
    inner = F.col("x").between(width, F.col("w") - width) & F.col("y").between(width, F.col("h") - width)
    edge = inner & (F.col("g") - F.col("m") >= magnitude)
    sums = near.groupBy("img_id").agg(F.sum(F.when(edge, F.col("g") + F.col("m"))).alias("s"), F.count(F.when(edge, 1)).alias("n"))
    return sums.select("img_id", F.coalesce(F.when(F.col("n") > 0, F.expr("(s + n) div (2 * greatest(n, 1))")), F.lit(128)).cast("int").alias("threshold"))


def edge_divided(gray: DataFrame, size: int, plus: float, divide: float) -> DataFrame:
    """gray sharpened by its ratio to the local mean (plus), then divided by the inverse ratio of what that gave (divide); truncated to 0..255."""
    g, mean = F.col("g").cast("double"), F.col("mean")
    one = plus * (g * ((g + 1) / (mean + 1) - 0.5)) + (1 - plus) * g if plus > 0 else g
    two = one
    if divide > 0:
        norm = divide * ((mean + 1) / (one + 1) - 0.5) + (1 - divide)
        two = F.when(norm > 0, g / F.when(norm > 0, norm)).otherwise(g)
    return P.local_stats(gray, size).select(*P.KEY, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(two, 6)))).cast("int").alias("g"))


def dominant_background(gray: DataFrame, width: int = 10) -> DataFrame:
    """img_id, level: median of the fullest run of width levels among pixels that Otsu's threshold leaves white."""
    light = gray.join(P.otsu(gray), "img_id").where(F.col("g") >= F.col("threshold"))
    order = Window.partitionBy("img_id").orderBy("g")
    h = dense_histogram(light).select("*", F.sum("n").over(order.rowsBetween(0, width - 1)).alias("s"))
    best = h.where(F.col("g") <= 256 - width).groupBy("img_id").agg(F.max(F.struct("s", (-F.col("g")).alias("at"))).alias("b")).select("img_id", F.col("b.s").alias("s"), (-F.col("b.at")).alias("first"))
    run = h.drop("s").join(best, "img_id").where(F.col("g").between(F.col("first"), F.col("first") + width - 1))
    run = run.select("*", F.sum("n").over(order).alias("upto"))
    return run.where(F.col("upto") >= F.expr("s div 2")).groupBy("img_id").agg(F.min("g").alias("level"))
