"""Point operators, histograms and thresholds, neighbourhoods, geometry and raster algebra on the long form.

Every operator keeps ``img_id`` as the partitioning key: windows over rows and
columns of an image run on one exchange by image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["img_id", "y", "x"]
WHITE, BLACK = 0, 1


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 8-bit channels in integers: weights 11, 16 and 5 of 32."""
    return F.shiftright(11 * r + 16 * g + 5 * b, 5)


# --- aggregates -----------------------------------------------------------------------------------------------


def histogram(gray: DataFrame) -> DataFrame:
    """img_id, g, n."""
    return gray.groupBy("img_id", "g").agg(F.count("*").alias("n"))


def otsu(gray: DataFrame) -> DataFrame:
    """img_id, threshold: between-class variance is largest; ties take the middle of the first and last best; a flat image has threshold 0."""
    w = Window.partitionBy("img_id").orderBy("g")
    every = Window.partitionBy("img_id")
    h = histogram(gray).select(
        "img_id", "g", F.sum("n").over(w).alias("nb"), F.sum(F.col("n") * F.col("g")).over(w).alias("sb"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("g")).over(every).alias("s"), F.lead("g").over(w).alias("next")
    )
    nb, na = F.col("nb").cast("double"), (F.col("n") - F.col("nb")).cast("double")
    mean = (F.col("s") - F.col("sb")) / na - F.col("sb") / nb
    h = h.where("nb < n").select("img_id", "g", "next", F.round(mean * mean * nb * na, 6).alias("v"))
    best = h.withColumn("m", F.max("v").over(every)).where("v = m and v > 0").groupBy("img_id").agg(F.min("g").alias("lo"), (F.max("next") - 1).alias("hi"))
    found = best.select("img_id", (F.expr("(lo + hi) div 2") + 1).cast("int").alias("t"))
    return gray.select("img_id").distinct().join(found, "img_id", "left").select("img_id", F.coalesce("t", F.lit(0)).alias("threshold"))


def binarized_count(gray: DataFrame, thresholds: DataFrame) -> DataFrame:
    """img_id, threshold, black: pixels darker than the image's threshold."""
    return gray.join(thresholds, "img_id").groupBy("img_id", "threshold").agg(F.sum((F.col("g") < F.col("threshold")).cast("long")).alias("black"))


def bounding_box(bw: DataFrame, colour: int = BLACK) -> DataFrame:
    """img_id, x0, y0, x1, y1 (inclusive), n of the pixels of a colour; images without one have none."""
    return bw.where(F.col("bw") == colour).groupBy("img_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


def profile(bw: DataFrame, axis: str) -> DataFrame:
    """img_id, pos, n: black pixels of each row (axis y) or column (axis x)."""
    return bw.groupBy("img_id", F.col(axis).alias("pos")).agg(F.sum("bw").cast("long").alias("n"))


def stretch(gray: DataFrame, low: float, high: float) -> DataFrame:
    """Contrast stretch: fractions low and high are clipped from the histogram's ends, integer rounding; degenerate ranges become a step."""
    w = Window.partitionBy("img_id").orderBy("g")
    back = Window.partitionBy("img_id").orderBy(F.desc("g"))
    every = Window.partitionBy("img_id")
    h = histogram(gray).select("img_id", "g", F.sum("n").over(w).alias("up"), F.sum("n").over(back).alias("down"), F.sum("n").over(every).alias("all"))
    ends = h.groupBy("img_id").agg(F.min(F.when(F.col("up") > F.col("all") * low, F.col("g"))).alias("lo"), F.max(F.when(F.col("down") > F.col("all") * high, F.col("g"))).alias("hi"))
    d, g = F.col("hi") - F.col("lo"), F.col("g")
    value = F.when(d <= 0, F.when(g < F.expr("(lo + hi) div 2"), 0).otherwise(255)).when(g <= F.col("lo"), 0).when(g >= F.col("hi"), 255).otherwise(F.expr("(255 * (g - lo) + (hi - lo) div 2) div greatest(hi - lo, 1)"))
    return gray.join(ends, "img_id").select(*KEY, value.cast("int").alias("g"))


# --- neighbourhoods -------------------------------------------------------------------------------------------


def passes(df: DataFrame, columns: dict[str, tuple[str, str]], x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Separable frames: name -> (aggregate, column) over x offsets, then y offsets, clipped to the image."""
    wx = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(*x)
    wy = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(*y)
    df = df.repartition("img_id")
    df = df.select("*", *(getattr(F, f)(c).over(wx).alias(f"_{n}") for n, (f, c) in columns.items()))
    return df.select("*", *(getattr(F, f)(f"_{n}").over(wy).alias(n) for n, (f, _) in columns.items())).drop(*(f"_{n}" for n in columns))


def frame(size: int) -> tuple[int, int]:
    """Offsets of a window of that size: half of it, rounded down, before the pixel."""
    return -(size >> 1), size - (size >> 1) - 1


def local_stats(gray: DataFrame, size: int) -> DataFrame:
    """gray with mean and deviation of the clipped size x size window (integer sums, one division)."""
    df = gray.select("*", F.lit(1).alias("one"), (F.col("g") * F.col("g")).alias("gg"))
    df = passes(df, {"s": ("sum", "g"), "q": ("sum", "gg"), "a": ("sum", "one")}, frame(size), frame(size))
    mean = F.col("s") / F.col("a")
    return df.select(*KEY, "g", mean.alias("mean"), F.sqrt(F.abs(F.col("q") / F.col("a") - mean * mean)).alias("dev"))


def sauvola(gray: DataFrame, size: int, k: float, delta: float = 0.0) -> DataFrame:
    s = local_stats(gray, size)
    return s.select(*KEY, (F.col("g") < F.round(F.col("mean") * (1 + k * (F.col("dev") / 128 - 1)) + delta, 6)).cast("int").alias("bw"))


def bradley(gray: DataFrame, size: int, k: float, delta: float = 0.0) -> DataFrame:
    s = local_stats(gray, size)
    return s.select(*KEY, (F.col("g") < F.round(F.col("mean") * (1 - k) + delta, 6)).cast("int").alias("bw"))


def wolf(gray: DataFrame, size: int, k: float, low: int = 1, high: int = 254, delta: float = 0.0) -> DataFrame:
    """Deviation and darkest level are the image's; a flat image has no relative deviation and stays white above low."""
    every = Window.partitionBy("img_id")
    s = local_stats(gray, size).select("*", F.max("dev").over(every).alias("top"), F.min("g").over(every).alias("dark"))
    t = F.col("mean") - k * (1 - F.col("dev") / F.col("top")) * (F.col("mean") - F.col("dark")) + delta
    t = F.round(F.when(F.col("top") > 0, t), 6)
    return s.select(*KEY, F.coalesce((F.col("g") < low) | ((F.col("g") <= high) & (F.col("g") < t)), F.col("g") < low).cast("int").alias("bw"))


def grad(gray: DataFrame, size: int, k: float, delta: float = 0.0) -> DataFrame:
    """Threshold from the gradient-weighted mean of the image and the local mean."""
    every = Window.partitionBy("img_id")
    s = local_stats(gray, size).select("*", F.floor(F.col("mean") + 0.5).alias("m"))
    s = s.select("*", F.sum(F.abs(F.col("m") - F.col("g")) * F.col("g")).over(every).alias("up"), F.sum(F.abs(F.col("m") - F.col("g"))).over(every).alias("down"))
    centre = F.when(F.col("down") > 0, F.col("up") / F.when(F.col("down") > 0, F.col("down"))).otherwise(127.5)
    return s.select(*KEY, (F.col("g") < F.round(centre * (1 - k) + F.col("m") * k + delta, 6)).cast("int").alias("bw"))


def dilate(bw: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Black spreads over the brick; outside is white."""
    return passes(bw, {"o": ("max", "bw")}, (-x[1], -x[0]), (-y[1], -y[0])).select(*KEY, F.col("o").alias("bw"))


def erode(bw: DataFrame, x: tuple[int, int], y: tuple[int, int], outside: int = BLACK) -> DataFrame:
    """Black stays where the whole brick is black; outside counts as given (black: frames are clipped)."""
    if outside == BLACK:
        return passes(bw, {"o": ("min", "bw")}, x, y).select(*KEY, F.col("o").alias("bw"))
    area = (x[1] - x[0] + 1) * (y[1] - y[0] + 1)
    return passes(bw, {"o": ("sum", "bw")}, x, y).select(*KEY, (F.col("o") == area).cast("int").alias("bw"))


def open_(bw: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    return dilate(erode(bw, x, y, WHITE), x, y)


def close(bw: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    return erode(dilate(bw, x, y), x, y)


def spread(gray: DataFrame, darker: bool, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """Gray dilation (the darker spreads) or erosion (the lighter spreads)."""
    return passes(gray, {"o": ("min" if darker else "max", "g")}, x, y).select(*KEY, F.col("o").alias("g"))


def sobel(gray: DataFrame, axis: str) -> DataFrame:
    """Central difference along the axis of the 1-2-1 sums across it; edge pixels are replicated."""
    along, across = ("x", "y") if axis == "x" else ("y", "x")
    wa = Window.partitionBy("img_id", along).orderBy(across)
    wd = Window.partitionBy("img_id", across).orderBy(along)
    near = lambda c, w: (F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c)))
    p, n = near("g", wa)
    s = gray.repartition("img_id").withColumn("s", p + 2 * F.col("g") + n)
    p, n = near("s", wd)
    return s.select(*KEY, (n - p).cast("int").alias("d"))


def neighbours(bw: DataFrame, offsets: list[tuple[int, int]], outside: int = WHITE) -> DataFrame:
    """bw with columns o0, o1, ...: the pixel at each (dx, dy), by rows first and then by columns."""
    rows = Window.partitionBy("img_id", "y").orderBy("x")
    cols = Window.partitionBy("img_id", "x").orderBy("y")
    out = bw.repartition("img_id")
    for dx in sorted({dx for dx, _ in offsets}):
        out = out.withColumn(f"_r{dx}", F.coalesce(F.lead("bw", dx).over(rows), F.lit(outside)))
    for i, (dx, dy) in enumerate(offsets):
        out = out.withColumn(f"o{i}", F.coalesce(F.lead(f"_r{dx}", dy).over(cols), F.lit(outside)))
    return out.drop(*(c for c in out.columns if c.startswith("_r")))


def hit_miss(bw: DataFrame, pattern: list[str], origin: tuple[int, int], replace: bool = False, outside: int = WHITE) -> DataFrame:
    """Pixels where the pattern matches: X and - black, blank and + white, ? either; replace: - becomes white and + black at each match."""
    cells = [(c, x - origin[0], y - origin[1]) for y, line in enumerate(pattern) for x, c in enumerate(line)]
    used = [(c, dx, dy) for c, dx, dy in cells if c != "?"]
    marked = neighbours(bw, [(dx, dy) for _, dx, dy in used], outside)
    match = F.lit(True)
    for i, (c, _, _) in enumerate(used):
        match = match & (F.col(f"o{i}") == (BLACK if c in "X-" else WHITE))
    hits = marked.select(*KEY, "bw", match.cast("int").alias("hit"))
    if not replace:
        return hits.select(*KEY, F.col("hit").alias("bw"))
    change = [(c, dx, dy) for c, dx, dy in cells if c in "-+"]
    at = neighbours(hits.select(*KEY, F.col("hit").alias("bw"), F.col("bw").alias("was")), [(-dx, -dy) for _, dx, dy in change])
    value = F.col("was")
    for i, (c, _, _) in enumerate(change):
        value = F.when(F.col(f"o{i}") == 1, WHITE if c == "-" else BLACK).otherwise(value)
    return at.select(*KEY, value.cast("int").alias("bw"))


# --- raster algebra and geometry ------------------------------------------------------------------------------


def combine(one: DataFrame, two: DataFrame, op: Column, name: str, dx: int = 0, dy: int = 0) -> DataFrame:
    """op over a (of one) and b (of two, moved by dx, dy), where both have a pixel; co-partitioned by image."""
    v = one.columns[3]
    a = one.select(*KEY, F.col(v).alias("a"))
    b = two.select("img_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col(two.columns[3]).alias("b"))
    return a.join(b, KEY).select(*KEY, op.cast("int").alias(name))




def binary_op(name: str) -> Column:
    a, b = F.col("a"), F.col("b")
    return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b), "subtract": a * (1 - b), "subtract_white": 1 - (1 - a) * b}[name]


def gray_op(name: str) -> Column:
    a, b = F.col("a"), F.col("b")
    return {
        "subtract_clipped": F.greatest(a - b, F.lit(0)),
        "add_clipped": F.least(a + b, F.lit(255)),
        "subtract": F.pmod(a - b, F.lit(256)),
        "add": F.pmod(a + b, F.lit(256)),
        "darkest": F.least(a, b),
        "lightest": F.greatest(a, b),
        "divide_light": F.when(b <= a, 255).otherwise(F.expr("(255 * a + b div 2) div greatest(b, 1)")),
    }[name]


def rotate(df: DataFrame, degrees: int) -> DataFrame:
    """Clockwise by 0, 90, 180 or 270; any other angle is an error."""
    value = df.columns[3]
    if degrees % 360 == 0:
        return df
    if degrees % 90:
        raise ValueError(f"rotation by {degrees} degrees")
    size = Window.partitionBy("img_id")
    df = df.withColumn("h", F.max("y").over(size)).withColumn("w", F.max("x").over(size))
    y, x = {90: ("x", "h - y"), 180: ("h - y", "w - x"), 270: ("w - x", "y")}[degrees % 360]
    return df.select("img_id", F.expr(y).alias("y"), F.expr(x).alias("x"), value)


def shear(df: DataFrame, factor: float, origin: float, axis: str = "x", outside: int = WHITE) -> DataFrame:
    """Whole lines move by the rounded factor times their distance (from pixel centres) to the origin; what leaves the image is lost."""
    value, (along, across) = df.columns[3], (("x", "y") if axis == "x" else ("y", "x"))
    size = Window.partitionBy("img_id")
    move = F.floor(factor * (F.col(across) + 0.5 - origin) + 0.5).cast("int")
    df = df.withColumn("last", F.max(along).over(size))
    moved = df.withColumn("to", F.col(along) + move).where("`to` between 0 and last").select("img_id", F.col(across), F.col("to").alias(along), F.col(value).alias("v"))
    return df.select(*KEY).join(moved, KEY, "left").select(*KEY, F.coalesce("v", F.lit(outside)).cast("int").alias(value))


def reduce2x(bw: DataFrame, threshold: int) -> DataFrame:
    """Half the size: black where at least threshold of the four pixels are; an odd line is left out.  Pixels of a single line count twice."""
    size = Window.partitionBy("img_id")
    df = bw.withColumn("h", F.max("y").over(size) + 1).withColumn("w", F.max("x").over(size) + 1)
    whole = ((F.col("h") == 1) | (F.col("y") < F.expr("h div 2 * 2"))) & ((F.col("w") == 1) | (F.col("x") < F.expr("w div 2 * 2")))
    times = F.when(F.col("h") == 1, 2).otherwise(1) * F.when(F.col("w") == 1, 2).otherwise(1)
    df = df.where(whole).withColumn("n", F.col("bw") * times)
    return df.groupBy("img_id", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x")).agg((F.sum("n") >= threshold).cast("int").alias("bw"))


def upscale(df: DataFrame, times: int) -> DataFrame:
    value = df.columns[3]
    steps = F.sequence(F.lit(0), F.lit(times - 1))
    df = df.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return df.select("img_id", (F.col("y") * times + F.col("dy")).alias("y"), (F.col("x") * times + F.col("dx")).alias("x"), value)


def fill(df: DataFrame, value: int, x: tuple[int, int], y: tuple[int, int], inside: bool = True) -> DataFrame:
    """The rectangle (inclusive), or all but it, set to a value."""
    name = df.columns[3]
    within = F.col("x").between(*x) & F.col("y").between(*y)
    return df.select(*KEY, F.when(within if inside else ~within, value).otherwise(F.col(name)).cast("int").alias(name))


def framed(df: DataFrame, inner: int, edge: int) -> DataFrame:
    """A raster of the same size: inner within a frame of one pixel."""
    size = Window.partitionBy("img_id")
    on = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.max("x").over(size)) | (F.col("y") == F.max("y").over(size))
    return df.select(*KEY, F.when(on, edge).otherwise(inner).alias(df.columns[3]))


def near_border(df: DataFrame, width: Column | None = None) -> Column:
    """Whether a pixel lies within max(5, a fiftieth of the shorter side) pixels of the edge, or width."""
    size = Window.partitionBy("img_id")
    h, w = F.max("y").over(size) + 1, F.max("x").over(size) + 1
    b = F.greatest(F.lit(5), F.floor(F.least(h, w) / 50)) if width is None else width
    return (F.col("y") < b) | (F.col("x") < b) | (F.col("y") >= h - b) | (F.col("x") >= w - b)


# --- runs -----------------------------------------------------------------------------------------------------


def content_spans(profiles: DataFrame, min_content: int = 1, min_gap: int = 1) -> DataFrame:
    """img_id, first, last: runs of non-zero positions; gaps shorter than min_gap are bridged, then runs shorter than min_content dropped."""
    w = Window.partitionBy("img_id").orderBy("pos")
    on = profiles.where("n > 0").select("img_id", "pos", (F.col("pos") - F.lag("pos").over(w) > min_gap).alias("new"))
    on = on.select("img_id", "pos", F.sum(F.coalesce("new", F.lit(False)).cast("int")).over(w).alias("run"))
    spans = on.groupBy("img_id", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return spans.where(F.col("last") - F.col("first") + 1 >= min_content).select("img_id", "first", "last")
