"""Set-level analytics over page tables: deviations, sizes and margins, views of a project, orders and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deviations(pages: DataFrame, value: str, by: str = "project") -> DataFrame:
    """pages with mean and population deviation of an integer value over its project, from exact sums."""
    w = Window.partitionBy(by)
    v = F.col(value).cast("long")
    n, s, q = F.count(v).over(w), F.sum(v).over(w), F.sum(v * v).over(w)
    mean = s / n
    return pages.select("*", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0))), 6).alias("sigma"))


def stats(pages: DataFrame, value: str, by: str = "project") -> DataFrame:
    v = F.col(value).cast("long")
    mean = F.sum(v) / F.count(v)
    return pages.groupBy(by).agg(F.count(v).alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.sum(v * v) / F.count(v) - mean * mean, F.lit(0.0))), 6).alias("sigma"))


def aggregate_hard_size(pages: DataFrame, by: str = "project") -> DataFrame:
    """Largest width and height over the aligned pages; 0 where none is."""
    top = lambda c: F.coalesce(F.max(F.when(F.col("aligned"), F.col(c))), F.lit(0)).alias(c)
    return pages.groupBy(by).agg(top("width"), top("height"))


def hard_size_without(pages: DataFrame, key: list[str], by: str = "project") -> DataFrame:
    """For each page, the largest width over the other aligned pages of its project: the best unless it is the page's own, then the second best."""
    w = Window.partitionBy(by)
    on = F.when(F.col("aligned"), F.col("width"))
    df = pages.withColumn("v", on).withColumn("best", F.max("v").over(w))
    df = df.withColumn("times", F.sum((F.col("v") == F.col("best")).cast("int")).over(w)).withColumn("second", F.max(F.when(F.col("v") < F.col("best"), F.col("v"))).over(w))
    alone = (F.col("v") == F.col("best")) & (F.col("times") == 1)
    return df.select(*key, F.coalesce(F.when(F.coalesce(alone, F.lit(False)), F.col("second")).otherwise(F.col("best")), F.lit(0)).alias("width"))


def soft_margins(pages: DataFrame, by: str = "project") -> DataFrame:
    """Left and top share of what a page lacks of the project's size: none for left/top, half for centre, all for right/bottom alignment."""
    w = Window.partitionBy(by)
    lack = lambda c: F.coalesce(F.max(F.when(F.col("aligned"), F.col(c))).over(w), F.lit(0)) - F.col(c)
    df = pages.withColumn("dw", F.when(F.col("aligned"), lack("width")).otherwise(0)).withColumn("dh", F.when(F.col("aligned"), lack("height")).otherwise(0))
    part = lambda d, a: F.when(F.col(a) == 0, F.lit(0.0)).when(F.col(a) == 1, F.col(d) / 2).otherwise(F.col(d).cast("double"))
    return df.withColumn("left", part("dw", "halign")).withColumn("top", part("dh", "valign")).withColumn("right", F.col("dw") - F.col("left")).withColumn("bottom", F.col("dh") - F.col("top"))


def dpi_status(width: Column, dpi: Column) -> Column:
    """State of a resolution, tested in this order."""
    return F.when(dpi <= 1, "undefined").when(dpi < 150, "too_small").when(dpi > 9999, "too_large").when(25.4 * width / dpi > 500, "too_small_for_size").otherwise("ok")


def alike_share(pages: DataFrame, key: list[str], value: str, tolerance: int, by: str = "project") -> DataFrame:
    """Whether more than half (rounded down) of the others differ by more than the tolerance: a range frame, not a self-join."""
    near = Window.partitionBy(by).orderBy(value).rangeBetween(-tolerance, tolerance)
    every = Window.partitionBy(by)
    df = pages.withColumn("near", F.count("*").over(near)).withColumn("n", F.count("*").over(every))
    return df.select(*key, ((F.col("n") - F.col("near")) > F.expr("(n - 1) div 2")).alias("odd"))


def numbered(pages: DataFrame, order: list[Column], by: str, key: list[str]) -> DataFrame:
    """key and rank (from 0) of each page within by in an explicit order."""
    return pages.select(*key, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long").alias("rank"))


def natural_key(name: Column) -> Column:
    """Name with runs of digits padded to 20, so that text order is natural order."""
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def normalize_path(path: Column) -> Column:
    """Backslashes as slashes, empty and . parts gone, .. taking its parent along; null where it leaves the root."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    bad = F.lit(None).cast("array<string>")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"), lambda acc, p: F.when(acc.isNull(), bad).when((p == "..") & (F.size(acc) == 0), bad).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.concat(F.when(path.rlike("^[/\\\\]"), "/").otherwise(""), F.array_join(folded, "/"))


def disambiguated(files: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """label: how many files of the same name come before."""
    return files.withColumn("label", (F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1).cast("long"))


def output_name(base: Column, label: Column, page: Column, sub: Column) -> Column:
    """base(label)_pageNNNN_1L.tif and the like."""
    side = F.when(sub == 1, "_1L").when(sub == 2, "_2R").otherwise("")
    return F.concat(base, F.when(label > 0, F.concat(F.lit("("), label.cast("string"), F.lit(")"))).otherwise(""), F.when(page > 0, F.concat(F.lit("_page"), F.lpad(page.cast("string"), 4, "0"))).otherwise(""), side, F.lit(".tif"))


def runs(pages: DataFrame, by: str, position: str) -> DataFrame:
    """first, last and n of each run of adjacent positions."""
    k = F.col(position) - F.row_number().over(Window.partitionBy(by).orderBy(position))
    return pages.select(by, position, k.alias("_k")).groupBy(by, "_k").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_k")


def fingerprint(*columns: str) -> Column:
    """A hash of the parameters a result depends on."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)
