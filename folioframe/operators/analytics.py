"""Page analytics by the whole rule: content sizes, deviations of four margins, replaced pages, soft margins of all alignments, layouts, labels and names.

Every rule is a projection, an aggregate or a window by project; a project's
totals are broadcast by the window, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEFT, CENTER, RIGHT, AUTO, ORIGINAL = range(5)
SIDES = ("top", "bottom", "left", "right")


def content_value(width: Column, height: Column) -> Column:
    """Root of a quarter of the content's area, in thousandths, so that sums over pages are exact."""
    return F.round(F.sqrt(width * height / 4) * 1000).cast("long")


def _mean(value: Column, by: str) -> Column:
    w = Window.partitionBy(by)
    return F.sum(value).over(w) / F.count(value).over(w)


def deviations(pages: DataFrame, skew: float = 1.0, size: float = 20.0, margin: float = 5.0, by: str = "project") -> DataFrame:
    """pages with flags (1 skew, 2 content size, 4 margin), the dimension (width before height) and the side that deviate.

    The skew differs from its mean by more than skew degrees; the width, then
    the height, by more than size percent of its mean; of the four margins the
    one that is furthest from its mean (of equal ones the first of top, bottom,
    left and right) by more than margin, in projects of two pages or more.
    """
    n = F.count("*").over(Window.partitionBy(by))
    off = {c: F.abs(F.col(c) - _mean(F.col(c), by)) for c in ("angle", "width", "height", *SIDES)}
    df = pages.select("*", n.alias("_n"), *(F.round(v, 9).alias(f"_{c}") for c, v in off.items()), *(F.round(_mean(F.col(c), by), 9).alias(f"_mean_{c}") for c in ("width", "height")))
    wide = lambda c: (F.col(f"_mean_{c}") > 0) & (F.col(f"_{c}") * 100 > size * F.col(f"_mean_{c}"))
    dimension = F.when(wide("width"), "width").when(wide("height"), "height")
    most = F.greatest(*(F.col(f"_{c}") for c in SIDES))
    side = F.coalesce(*(F.when(F.col(f"_{c}") == most, c) for c in SIDES))
    bad = (F.col("_n") >= 2) & (most > margin)
    flags = F.when(F.col("_angle") > skew, 1).otherwise(0) + F.when(dimension.isNotNull(), 2).otherwise(0) + F.when(bad, 4).otherwise(0)
    return df.select(*pages.columns, flags.alias("flags"), dimension.alias("dimension"), F.when(bad, side).alias("side_off"))


def hard_size_with(pages: DataFrame, width: Column, height: Column, by: str = "project") -> DataFrame:
    """pages with what the project's size would be with the page's own size replaced, from the best and second best of the aligned pages."""
    w = Window.partitionBy(by)
    df = pages
    for c, new in (("width", width), ("height", height)):
        v = F.when(F.col("aligned"), F.col(c))
        df = df.withColumn("_v", v).withColumn("_best", F.max("_v").over(w))
        df = df.withColumn("_times", F.sum((F.col("_v") == F.col("_best")).cast("int")).over(w)).withColumn("_second", F.max(F.when(F.col("_v") < F.col("_best"), F.col("_v"))).over(w))
        alone = F.coalesce((F.col("_v") == F.col("_best")) & (F.col("_times") == 1), F.lit(False))
        others = F.when(alone, F.col("_second")).otherwise(F.col("_best"))
        df = df.withColumn(f"new_{c}", F.greatest(F.coalesce(others, F.lit(0)), F.when(F.col("aligned"), new).otherwise(0))).drop("_v", "_best", "_times", "_second")
    return df


def _auto(a: Column, b: Column, filled: Column, tolerance: Column, vertical: bool) -> Column:
    """Alignment of an automatic axis: first, middle or last by the shares a and b of the free space before and after the content; else as in the original."""
    t = tolerance * 0.7 if vertical else tolerance
    shift = b - a
    # along x a page whose right is wide goes right, along y one whose bottom is wide goes up
    far, near = (LEFT, RIGHT) if vertical else (RIGHT, LEFT)
    guard = (b if vertical else a), (a if vertical else b)
    found = F.when((shift > 0) & (guard[0] > 1.4 * t), far).when((shift <= 0) & (guard[1] > 1.4 * t), near).otherwise(ORIGINAL)
    return F.when(1 - filled < tolerance, LEFT if vertical else CENTER).when(F.abs(shift) < t, CENTER).otherwise(found)


def soft_margins(pages: DataFrame, original: bool = False, by: str = "project") -> DataFrame:
    """pages (width, height, aligned, halign, valign, tolerance; content box cx0, cy0, cx1, cy1 in the page box px0, py0, px1, py1) with left, right, top, bottom: what they lack of the project's size, by alignment.

    0 is left or top, 1 centre, 2 right or bottom, 3 automatic, 4 in proportion
    to the page around the content.  original: whether that last one is allowed
    where an axis is automatic; else it is the centre there.
    """
    w = Window.partitionBy(by)
    df = pages
    for c in ("width", "height"):
        df = df.withColumn(f"_all_{c}", F.coalesce(F.max(F.when(F.col("aligned"), F.col(c))).over(w), F.lit(0)))
    x, y = ("x", "width", "halign", False), ("y", "height", "valign", True)
    page = {a: F.col(f"p{a}1") - F.col(f"p{a}0") for a in "xy"}
    content = {a: F.col(f"c{a}1") - F.col(f"c{a}0") for a in "xy"}
    filled = content["x"] * content["y"] / (page["x"] * page["y"])
    any_auto = (content["x"] > 1) & ((F.col("halign") == AUTO) | (F.col("valign") == AUTO))
    out = []
    for a, size, align, vertical in (x, y):
        lack, first, last, kind = (f"_{n}_{a}" for n in ("lack", "first", "last", "kind"))
        before, after = (F.col(f"c{a}0") - F.col(f"p{a}0") + 1) / (page[a] + 1), (F.col(f"p{a}1") - F.col(f"c{a}1") + 1) / (page[a] + 1)
        df = df.withColumn(lack, F.col(f"_all_{size}") - F.col(size))
        df = df.withColumn(first, F.when(F.col(lack) > 0.1, F.col(lack) / (before + after) * before).otherwise(0.0))
        df = df.withColumn(last, F.when(F.col(lack) > 0.1, F.col(lack) - F.col(first)).otherwise(0.0))
        total = F.greatest(F.col(f"_all_{size}"), F.lit(1))
        df = df.withColumn(kind, F.when(any_auto & (F.col(align) == AUTO), _auto(F.col(first) / total, F.col(last) / total, filled, F.col("tolerance"), vertical)).otherwise(F.col(align)))
        if not original:
            df = df.withColumn(kind, F.when(any_auto & (F.col(kind) == ORIGINAL), CENTER).otherwise(F.col(kind)))
        k, whole, half = F.col(kind), F.col(lack).cast("double"), 0.5 * F.col(lack)
        given = F.when(k == LEFT, 0.0).when(k == CENTER, half).when(k == RIGHT, whole).otherwise(F.col(first))
        rest = F.when(k == LEFT, whole).when(k == CENTER, half).when(k == RIGHT, 0.0).otherwise(F.col(last))
        some = F.col("aligned") & (F.col(lack) > 0)
        out += [F.when(some, given).otherwise(0.0), F.when(some, rest).otherwise(0.0)]
    return df.select(*pages.columns, *(F.round(c, 6).alias(n) for c, n in zip(out, ("left", "right", "top", "bottom"), strict=True)))


def advised_pages(width: Column, height: Column, dpi_x: Column, dpi_y: Column, degrees: Column) -> Column:
    """Two logical pages where a turned page is physically wider than high, else one."""
    wide, high = width * dpi_y, height * dpi_x
    return F.when(F.when(F.pmod(degrees, F.lit(180)) == 90, high > wide).otherwise(wide > high), 2).otherwise(1)


def layout_pages(pages: Column, left_removed: Column, right_removed: Column) -> Column:
    """Logical pages of a layout, one less where one half of two is removed (both removed count as none)."""
    return F.when((pages == 2) & (left_removed != right_removed), 1).otherwise(pages)


def page_views(images: DataFrame, n: str, rtl: Column) -> DataFrame:
    """A row for each logical page with sub (0 whole, 1 left, 2 right) and place, in reading direction."""
    halves = F.when(rtl, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    views = F.when(F.col(n) == 2, halves).otherwise(F.array(F.lit(0)))
    return images.select("*", F.posexplode(views).alias("place", "sub"))


def inserted_after(pages: DataFrame, new: DataFrame, by: str, order: str) -> DataFrame:
    """pages and new (each after the page whose order it names), renumbered from 1 by ``by``."""
    both = pages.select(by, order, "id", F.lit(0).alias("_k")).unionByName(new.select(by, order, "id", F.lit(1).alias("_k")))
    return both.select(by, "id", F.row_number().over(Window.partitionBy(by).orderBy(order, "_k", "id")).cast("long").alias("number"))


def unremoved(pages: DataFrame, back: DataFrame, key: list[str]) -> DataFrame:
    """pages with removed set to false for those that come back."""
    hit = back.select(*key).distinct().withColumn("_back", F.lit(True))
    return pages.join(hit, key, "left").withColumn("removed", F.col("removed") & F.col("_back").isNull()).drop("_back")


def every_other(pages: DataFrame, order: list[Column], base: Column, by: str = "project") -> DataFrame:
    """Pages at an even distance from the base page of their project; none of a project without one."""
    w = Window.partitionBy(by)
    df = pages.withColumn("_at", F.row_number().over(w.orderBy(*order)))
    df = df.withColumn("_base", F.min(F.when(base, F.col("_at"))).over(w))
    return df.where((F.col("_at") - F.col("_base")) % 2 == 0).drop("_at", "_base")


def labelled(files: DataFrame, stored: DataFrame, name: str, key: str, order: list[Column]) -> DataFrame:
    """files with label: stored (key, label) keeps it, others follow the largest label of their name, from 0, in order of arrival."""
    df = files.join(stored.select(key, F.col("label").alias("_stored")), key, "left")
    w = Window.partitionBy(name)
    new = F.row_number().over(Window.partitionBy(name, F.col("_stored").isNull()).orderBy(*order))
    df = df.withColumn("_top", F.coalesce(F.max("_stored").over(w), F.lit(-1))).withColumn("_new", new)
    return df.withColumn("label", F.coalesce("_stored", F.col("_top") + F.col("_new")).cast("long")).drop("_stored", "_top", "_new")


def output_name(base: Column, override: Column, label: Column, page: Column, sub: Column, rtl: Column) -> Column:
    """override or base, (label), _pageNNNN, and the half with its number in reading direction, .tif; a %1 in an override stands for the base."""
    stem = F.coalesce(F.replace(override, F.lit("%1"), base), base)
    left, right = F.when(rtl, "_2L").otherwise("_1L"), F.when(rtl, "_1R").otherwise("_2R")
    half = F.when(sub == 1, left).when(sub == 2, right).otherwise("")
    return F.concat(stem, F.when(label > 0, F.concat(F.lit("("), label.cast("string"), F.lit(")"))).otherwise(""), F.when(page > 0, F.concat(F.lit("_page"), F.lpad(page.cast("string"), 4, "0"))).otherwise(""), half, F.lit(".tif"))


def between_name(first: Column, second: Column) -> Column:
    """Name of an empty page between two names, or after the one where second is null: base&epNNNN, halfway between their numbers if they share the base, else 1000 on."""
    parts = lambda c: (F.regexp_replace(c, "&ep[0-9]+$", ""), F.coalesce(F.expr("0") + F.nullif(F.regexp_extract(c, "&ep([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0)))
    (a, m), (b, n) = parts(first), parts(second)
    number = F.when(a == b, F.floor((m + n) / 2)).otherwise(m + 1000)
    return F.concat(a, F.lit("&ep"), F.lpad(F.coalesce(number, m + 1000).cast("string"), 4, "0"))


def propagated(target: DataFrame, cached: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """target with the columns of the cached results, and valid: whether there was one; without it the columns are null."""
    new = cached.select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    df = target.join(new, key, "left")
    return df.select(*(F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in target.columns), F.coalesce("_hit", F.lit(False)).alias("valid"))


def with_default(value: Column, own: Column, general: Column) -> Column:
    """A parameter with its two levels of defaults: stored, the image's own, the project's."""
    return F.coalesce(value, own, general)


def odd_ratios(pages: DataFrame, tolerance: float, by: str = "project") -> DataFrame:
    """pages with odd: more than half (rounded down) of all pages have a ratio of width to height that differs by more than the tolerance; ratios in millionths, counted by a range frame."""
    every = Window.partitionBy(by)
    ratio = F.round(F.col("width") / F.col("height") * 1_000_000).cast("long")
    t = round(tolerance * 1_000_000)
    df = pages.withColumn("_r", ratio)
    df = df.withColumn("_near", F.count("*").over(every.orderBy("_r").rangeBetween(-t, t))).withColumn("_n", F.count("*").over(every))
    return df.withColumn("odd", F.col("_n") - F.col("_near") > F.expr("_n div 2")).drop("_r", "_near", "_n")


def adjusted(pixels: Column, dpi: Column, unit: str) -> Column:
    """A length in a unit: inches (which pixels are shown by, too), millimetres or centimetres by whole dots a metre."""
    metre = F.round(dpi / 0.0254)
    return {"pixels": pixels / dpi, "inch": pixels / dpi, "mm": pixels / metre * 1000, "cm": pixels / metre * 100}[unit]


def turned(width: Column, height: Column, x: Column, y: Column, degrees: int) -> tuple[Column, Column, Column, Column]:
    """Size and a point of a page turned clockwise by whole quarters."""
    if degrees % 90:
        raise ValueError(f"rotation by {degrees} degrees")
    return {0: (width, height, x, y), 90: (height, width, height - y, x), 180: (width, height, width - x, height - y), 270: (height, width, y, width - x)}[degrees % 360]


def outlines(width: Column, height: Column, cutters: Column, kind: Column) -> Column:
    """Page outlines (part, x0, x1 at the top, x2, x3 at the bottom) from cutters (top, bottom): the whole, between two of them, or left and right of one."""
    cell = lambda part, a, b: F.struct(F.lit(part).alias("part"), a["top"].alias("x0"), b["top"].alias("x1"), a["bottom"].alias("x2"), b["bottom"].alias("x3"))
    edge = lambda v: F.struct(v.cast("double").alias("top"), v.cast("double").alias("bottom"))
    first, second = F.get(cutters, F.lit(0)), F.get(cutters, F.lit(1))
    lo, hi = edge(F.lit(0)), edge(width)
    return F.when(kind == "two_pages", F.array(cell("left", lo, first), cell("right", first, hi))).when(kind == "single_cut", F.array(cell("single", first, second))).otherwise(F.array(cell("single", lo, hi)))


def extended(corners: list[Column], margins: tuple[Column, Column, Column, Column]) -> list[Column]:
    """Corners (x, y of top left, top right, bottom right, bottom left) of a rectangle at any angle with left, top, right, bottom margins added along its own axes."""
    x, y = corners[::2], corners[1::2]
    unit = lambda i, j: ((x[j] - x[i]) / F.hypot(x[j] - x[i], y[j] - y[i]), (y[j] - y[i]) / F.hypot(x[j] - x[i], y[j] - y[i]))
    (ux, uy), (vx, vy) = unit(0, 1), unit(0, 3)
    left, top, right, bottom = margins
    out = []
    for k, (a, b) in enumerate(((-left, -top), (right, -top), (right, bottom), (-left, bottom))):
        out += [x[k] + ux * a + vx * b, y[k] + uy * a + vy * b]
    return out


def on_grid(points: Column, step: float) -> Column:
    """Points (x, y) moved to the nearest grid points, halves up."""
    at = lambda v: F.floor(v / step + 0.5) * step
    return F.transform(points, lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y")))


def same_polygon(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two polygons have the same number of points, each within the tolerance of its counterpart."""
    near = F.zip_with(a, b, lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))


# Names of parameters in project files.
NAMES = {
    "threshold": ["otsu", "sauvola", "wolf", "bradley", "grad", "edgeplus", "blurdiv", "edgediv"],
    "despeckle": ["off", "cautious", "normal", "aggressive"],
    "dewarping": ["off", "auto", "manual", "marginal"],
    "layout": ["auto-detect", "single-uncut", "single-cut", "two-pages"],
}


def coded(name: Column, kind: str) -> Column:
    """Number of a parameter's name, the first's for one that isn't known."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, NAMES[kind])), name), F.lit(0)) - 1, F.lit(0)).cast("int")


def named(code: Column, kind: str) -> Column:
    """Name of a parameter's number, the first for one that isn't known."""
    return F.coalesce(F.get(F.array(*map(F.lit, NAMES[kind])), code), F.lit(NAMES[kind][0]))


def bit_figures(value: Column) -> tuple[Column, Column, Column, Column]:
    """Ones, leading and trailing zeros and the reverse of a 32-bit word."""
    text = F.lpad(F.bin(value), 32, "0")
    return F.bit_count(value).cast("int"), (F.length(text) - F.length(F.ltrim(F.replace(text, F.lit("0"), F.lit(" "))))).cast("int"), (F.length(text) - F.length(F.rtrim(F.replace(text, F.lit("0"), F.lit(" "))))).cast("int"), F.conv(F.reverse(text), 2, 10).cast("long")


# Orders of each stage's pages, by the names under which ``order`` knows them.
ORDERS_OF_STAGE = {
    "fix_orientation": ["natural", "rotation"],
    "page_split": ["natural", "split_type", "page_size"],
    "deskew": ["natural", "angle", "abs_angle"],
    "select_content": ["natural", "content_width", "content_height"],
    "page_layout": ["natural", "alignment", "hard_width", "hard_height"],
    "output": ["natural", "mode", "dewarping", "source_colour"],
}
