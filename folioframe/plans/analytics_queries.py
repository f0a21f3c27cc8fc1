"""Queries on page analytics by the whole rule, pixels in rectangles and palettes, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.operators import analytics as N
from folioframe.operators import pages as A
from folioframe.operators import pixels as P
from folioframe.operators import regions as G
from folioframe.plans.page_queries import KEY, PAGE, pages
from folioframe.plans.raster_queries import T, bw, gray
from folioframe.plans.region_queries import _labels
from folioframe.sources.rasters import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def add(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(full(spark, d))
    ORACLE[name] = f"{FULL} {sql}"


def raster(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, f"{T} {sql}"


MORE = {
    "top": "margin * 2",
    "bottom": "margin + valign * 3",
    "left": "margin + halign * 4",
    "right": "halign * 2 + margin",
    "value": None,
    "hkind": "CAST((img * 3 + page) % 5 AS INT)",
    "vkind": "CAST((img + page * 2) % 5 AS INT)",
    "rotation": "halign * 90",
    "dpi_x": "CAST(150 + 50 * (page % 3) AS INT)",
    "dpi_y": "CAST(150 + 75 * (img % 3) AS INT)",
}


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with four margins, alignments with automatic ones, resolutions, rotation and content value."""
    p = pages(spark, sf_dir).select("*", *(F.expr(e).alias(k) for k, e in MORE.items() if e))
    return p.withColumn("value", N.content_value(c("width"), c("height")))


FULL = PAGE + ", more AS (SELECT *, CAST(round(sqrt(width * height / 4.0::DOUBLE) * 1000) AS BIGINT) AS value, " + ", ".join(f'{e.replace(" AS INT)", " AS INTEGER)")} AS "{k}"' for k, e in MORE.items() if e) + " FROM page)"
MEAN = "CAST(sum({0}) OVER w AS DOUBLE) / count({0}) OVER w"

add("content_area_stats", lambda p: A.stats(p, "value"), """SELECT project, count(*) AS n, round(CAST(sum(value) AS DOUBLE) / count(*), 6) AS mean,
round(sqrt(greatest(CAST(sum(value * value) AS DOUBLE) / count(*) - (CAST(sum(value) AS DOUBLE) / count(*)) * (CAST(sum(value) AS DOUBLE) / count(*)), 0.0)), 6) AS sigma FROM more GROUP BY project""")
add(
    "content_area_outliers",
    lambda p: A.deviations(p, "value").where(1.6 * c("sigma") < F.abs(c("mean") - c("value"))).select(*KEY, "value"),
    f""", d AS (SELECT *, {MEAN.format("value")} AS m, CAST(sum(value * value) OVER w AS DOUBLE) / count(*) OVER w AS q FROM more WINDOW w AS (PARTITION BY project))
SELECT img, page, value FROM d WHERE 1.6 * round(sqrt(greatest(q - m * m, 0.0)), 6) < abs(round(m, 6) - value)""",
)
add("layout_outliers", lambda p: p.where(~c("aligned")).select(*KEY, "project"), "SELECT img, page, project FROM more WHERE NOT aligned")
OFF = ", ".join(f'round(abs("{k}" - {MEAN.format(chr(34) + k + chr(34))}), 9) AS "o_{k}"' for k in ("angle", "width", "height", *N.SIDES))
add(
    "project_deviations",
    lambda p: N.deviations(p).select(*KEY, "flags", "dimension", "side_off"),
    f""", o AS (SELECT *, count(*) OVER w AS n, round({MEAN.format("width")}, 9) AS mw, round({MEAN.format("height")}, 9) AS mh, {OFF} FROM more WINDOW w AS (PARTITION BY project)),
d AS (SELECT *, greatest(o_top, o_bottom, o_left, o_right) AS most, CASE WHEN mw > 0 AND o_width * 100 > 20.0 * mw THEN 'width' WHEN mh > 0 AND o_height * 100 > 20.0 * mh THEN 'height' END AS dimension FROM o)
SELECT img, page, CAST(CASE WHEN o_angle > 1.0 THEN 1 ELSE 0 END + CASE WHEN dimension IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN n >= 2 AND most > 5.0 THEN 4 ELSE 0 END AS INTEGER) AS flags, dimension,
CASE WHEN n >= 2 AND most > 5.0 THEN CASE most WHEN o_top THEN 'top' WHEN o_bottom THEN 'bottom' WHEN o_left THEN 'left' ELSE 'right' END END AS side_off FROM d""",
)
REST = "max(CASE WHEN aligned THEN {0} END) OVER (PARTITION BY project ORDER BY img, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)"
add(
    "whatif_replaced",
    lambda p: N.hard_size_with(p, c("width") + 7, c("height") - 3).select(*KEY, "new_width", "new_height"),
    f"SELECT img, page, greatest(coalesce({REST.format('width')}, 0), CASE WHEN aligned THEN width + 7 ELSE 0 END) AS new_width, greatest(coalesce({REST.format('height')}, 0), CASE WHEN aligned THEN height - 3 ELSE 0 END) AS new_height FROM more",
)


def boxed(p: DataFrame) -> DataFrame:
    """Pages with alignments, a tolerance and a content box in a page box."""
    box = {"px0": F.lit(0), "py0": F.lit(0), "px1": c("width") + 30, "py1": c("height") + 40, "cx0": c("margin") * 3, "cy0": c("margin") * 2, "cx1": c("width") + c("margin") * 2, "cy1": c("height") + c("margin")}
    return p.select("project", *KEY, "width", "height", "aligned", c("hkind").alias("halign"), c("vkind").alias("valign"), (F.lit(0.05) * (1 + c("side"))).alias("tolerance"), *(v.cast("double").alias(k) for k, v in box.items()))


def _soft_sql(original: bool) -> str:
    """Twin of the soft margins."""
    axis = []
    for a, size, kind, vertical in (("x", "width", "hkind", False), ("y", "height", "vkind", True)):
        t = "tol * 0.7::DOUBLE" if vertical else "tol"
        far, near, g0, g1 = (0, 2, "lb", "fb") if vertical else (2, 0, "fb", "lb")
        middle = 0 if vertical else 1
        auto = f"CASE WHEN 1 - filled < tol THEN {middle} WHEN abs(lb{a} - fb{a}) < {t} THEN 1 WHEN lb{a} - fb{a} > 0 AND {g0}{a} > 1.4::DOUBLE * ({t}) THEN {far} WHEN lb{a} - fb{a} <= 0 AND {g1}{a} > 1.4::DOUBLE * ({t}) THEN {near} ELSE 4 END"
        picked = f"CASE WHEN any_auto AND {kind} = 3 THEN {auto} ELSE {kind} END"
        axis.append((a, picked if original else f"CASE WHEN any_auto AND ({picked}) = 4 THEN 1 ELSE {picked} END"))
    return f""", b AS (SELECT *, 0.05::DOUBLE * (1 + side) AS tol, coalesce(max(CASE WHEN aligned THEN width END) OVER w, 0) AS aw, coalesce(max(CASE WHEN aligned THEN height END) OVER w, 0) AS ah,
  (margin * 3 + 1) / CAST(width + 31 AS DOUBLE) AS bx, (width + 30 - width - margin * 2 + 1) / CAST(width + 31 AS DOUBLE) AS ex, (margin * 2 + 1) / CAST(height + 41 AS DOUBLE) AS by_, (height + 40 - height - margin + 1) / CAST(height + 41 AS DOUBLE) AS ey,
  CAST((width - margin) * (height - margin) AS DOUBLE) / CAST((width + 30) * (height + 40) AS DOUBLE) AS filled, width - margin > 1 AND (hkind = 3 OR vkind = 3) AS any_auto FROM more WINDOW w AS (PARTITION BY project)),
l AS (SELECT *, aw - width AS dx, ah - height AS dy FROM b),
f AS (SELECT *, CASE WHEN dx > 0.1 THEN dx / (bx + ex) * bx ELSE 0.0 END AS fx, CASE WHEN dy > 0.1 THEN dy / (by_ + ey) * by_ ELSE 0.0 END AS fy FROM l),
g AS (SELECT *, CASE WHEN dx > 0.1 THEN dx - fx ELSE 0.0 END AS lx, CASE WHEN dy > 0.1 THEN dy - fy ELSE 0.0 END AS ly FROM f),
h AS (SELECT *, fx / greatest(aw, 1) AS fbx, lx / greatest(aw, 1) AS lbx, fy / greatest(ah, 1) AS fby, ly / greatest(ah, 1) AS lby FROM g),
k AS (SELECT *, {", ".join(f"{e} AS k{a}" for a, e in axis)} FROM h)
SELECT img, page, """ + ", ".join(
        f"round(CASE WHEN aligned AND d{a} > 0 THEN CASE k{a} WHEN 0 THEN {'0.0' if first else f'd{a}'} WHEN 1 THEN 0.5::DOUBLE * d{a} WHEN 2 THEN {f'd{a}' if first else '0.0'} ELSE {'f' if first else 'l'}{a} END ELSE 0.0 END::DOUBLE, 6) AS \"{name}\""
        for name, a, first in (("left", "x", True), ("right", "x", False), ("top", "y", True), ("bottom", "y", False))
    ) + " FROM k"


for name, original in (("soft_margins_auto", False), ("soft_margins_original", True)):
    add(name, lambda p, o=original: N.soft_margins(boxed(p), o).select(*KEY, "left", "right", "top", "bottom"), _soft_sql(original))
ADVISED = "CASE WHEN CASE WHEN rotation % 180 = 90 THEN height * dpi_x > width * dpi_y ELSE width * dpi_y > height * dpi_x END THEN 2 ELSE 1 END"
add("advised_pages", lambda p: p.select(*KEY, N.advised_pages(c("width"), c("height"), c("dpi_x"), c("dpi_y"), c("rotation")).alias("n")), f"SELECT img, page, {ADVISED} AS n FROM more")
add(
    "layout_pages",
    lambda p: p.select(*KEY, N.layout_pages(N.advised_pages(c("width"), c("height"), c("dpi_x"), c("dpi_y"), c("rotation")), c("hkind") == 0, c("vkind") < 2).alias("n")),
    f"SELECT img, page, CASE WHEN {ADVISED} = 2 AND (hkind = 0) <> (vkind < 2) THEN 1 ELSE {ADVISED} END AS n FROM more",
)
add(
    "page_views",
    lambda p: N.page_views(p.select(*KEY, F.when(c("width") > c("height"), 2).otherwise(1).alias("n"), (c("side") == 2).alias("rtl")), "n", c("rtl")).select(*KEY, "place", "sub"),
    "SELECT img, page, CAST(r AS INTEGER) AS place, CAST(CASE WHEN width <= height THEN 0 WHEN (side = 2) = (r = 0) THEN 2 ELSE 1 END AS INTEGER) AS sub FROM more, range(2) t(r) WHERE r = 0 OR width > height",
)
add(
    "insert_after",
    lambda p: N.inserted_after(p.select("img", "page", (c("page") * 10).cast("long").alias("id")), p.where("aligned").select("img", "page", (c("page") * 10 + 5).cast("long").alias("id")), "img", "page"),
    ", u AS (SELECT img, page, page * 10 AS id, 0 AS k FROM more UNION ALL SELECT img, page, page * 10 + 5, 1 FROM more WHERE aligned) SELECT img, CAST(id AS BIGINT) AS id, row_number() OVER (PARTITION BY img ORDER BY page, k, id) AS number FROM u",
)
add(
    "unremoved_pages",
    lambda p: N.unremoved(p.select(*KEY, (~c("aligned")).alias("removed")), p.where("margin > 3").select(*KEY), KEY),
    "SELECT img, page, NOT aligned AND NOT EXISTS (SELECT 1 FROM more b WHERE b.img = a.img AND b.page = a.page AND b.margin > 3) AS removed FROM more a",
)
add(
    "last_page_of_file",
    lambda p: p.select("img").distinct().join(p.where("aligned").groupBy("img").agg(F.max("page").alias("m")), "img", "left").select("img", F.coalesce("m", F.lit(-1)).alias("last")),
    "SELECT img, coalesce(max(CASE WHEN aligned THEN page END), -1) AS last FROM more GROUP BY img",
)
add("dpis_all_ok", lambda p: p.groupBy("project").agg(F.every((c("margin") > 1) & (c("dpi_x") > 1)).alias("ok")), "SELECT project, bool_and(margin > 1 AND dpi_x > 1) AS ok FROM more GROUP BY project")
add(
    "every_other_from_base",
    lambda p: N.every_other(p, [c("img"), c("page")], ~c("aligned") & (c("margin") == 4)).select("project", *KEY),
    ", r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY img, page) AS pos FROM more), b AS (SELECT *, min(CASE WHEN NOT aligned AND margin = 4 THEN pos END) OVER (PARTITION BY project) AS base FROM r) SELECT project, img, page FROM b WHERE (pos - base) % 2 = 0",
)
add(
    "orientation_propagated",
    lambda p: N.propagated(p.select(*KEY, "rotation", "width"), p.where("aligned and page = 1").groupBy(*KEY).agg(F.max("valign").alias("rotation")).withColumn("rotation", c("rotation") * 180), KEY, ["rotation"]),
    "SELECT a.img, a.page, b.v * 180 AS rotation, width, b.img IS NOT NULL AS valid FROM more a LEFT JOIN (SELECT img, page, max(valign) AS v FROM more WHERE aligned AND page = 1 GROUP BY img, page) b ON b.img = a.img AND b.page = a.page",
)
add(
    "content_box_propagated",
    lambda p: N.propagated(p.select(*KEY, "width", "height"), p.where("margin > 4").groupBy(*KEY).agg((F.max("width") - 8).alias("width"), (F.max("height") - 8).alias("height")), KEY, ["width", "height"]),
    "SELECT a.img, a.page, b.w - 8 AS width, b.h - 8 AS height, b.img IS NOT NULL AS valid FROM more a LEFT JOIN (SELECT img, page, max(width) AS w, max(height) AS h FROM more WHERE margin > 4 GROUP BY img, page) b ON b.img = a.img AND b.page = a.page",
)
add(
    "layout_with_defaults",
    lambda p: p.select(*KEY, N.with_default(F.when(c("aligned"), c("halign")), F.when(c("side") == 1, c("valign")), F.lit(9)).alias("layout")),
    "SELECT img, page, coalesce(CASE WHEN aligned THEN halign END, CASE WHEN side = 1 THEN valign END, 9) AS layout FROM more",
)
add(
    "odd_ratios",
    lambda p: N.odd_ratios(p, 0.4).select(*KEY, "odd"),
    """, r AS (SELECT *, CAST(round(width / CAST(height AS DOUBLE) * 1000000) AS BIGINT) AS r FROM more)
SELECT img, page, (SELECT count(*) FROM r b WHERE b.project = a.project AND abs(a.r - b.r) > 400000) > count(*) OVER (PARTITION BY project) // 2 AS odd FROM r a""",
)
add("physical_units", lambda p: p.select(*KEY, *(F.round(N.adjusted(c("width"), c("dpi_x"), u), 6).alias(u) for u in ("inch", "mm", "cm"))), "SELECT img, page, round(width / CAST(dpi_x AS DOUBLE), 6) AS inch, round(width / round(dpi_x / 0.0254::DOUBLE) * 1000, 6) AS mm, round(width / round(dpi_x / 0.0254::DOUBLE) * 100, 6) AS cm FROM more")
add(
    "turned_points",
    lambda p: p.select(*KEY, *(F.array(*N.turned(c("width"), c("height"), c("margin"), c("margin") * 2, d)).cast("array<bigint>").alias(f"t{d}") for d in (90, 180, 270))),
    "SELECT img, page, [height, width, height - margin * 2, margin] AS t90, [width, height, width - margin, height - margin * 2] AS t180, [height, width, margin * 2, width - margin] AS t270 FROM more",
)
add(
    "outlines_from_cutters",
    lambda p: p.select(*KEY, F.explode(N.outlines(c("width"), c("height"), F.array(*(F.struct((c("width") * a / 8).cast("double").alias("top"), (c("width") * b / 8).cast("double").alias("bottom")) for a, b in ((3, 4), (6, 5)))), F.when(c("hkind") < 2, "two_pages").when(c("hkind") == 2, "single_cut").otherwise("single_uncut"))).alias("o")).select(*KEY, "o.*"),
    """SELECT img, page, 'left' AS part, 0.0::DOUBLE AS x0, width * 3 / 8.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, width * 4 / 8.0::DOUBLE AS x3 FROM more WHERE hkind < 2
UNION ALL SELECT img, page, 'right', width * 3 / 8.0::DOUBLE, width::DOUBLE, width * 4 / 8.0::DOUBLE, width::DOUBLE FROM more WHERE hkind < 2
UNION ALL SELECT img, page, 'single', width * 3 / 8.0::DOUBLE, width * 6 / 8.0::DOUBLE, width * 4 / 8.0::DOUBLE, width * 5 / 8.0::DOUBLE FROM more WHERE hkind = 2
UNION ALL SELECT img, page, 'single', 0.0, width::DOUBLE, 0.0, width::DOUBLE FROM more WHERE hkind > 2""",
)


def extended_rect(p: DataFrame) -> DataFrame:
    """Corners of a turned content box with margins along its own axes."""
    w, h = c("width").cast("double"), c("height").cast("double")
    corners = [F.lit(0.0), F.lit(0.0), w * 0.8, w * 0.6, w * 0.8 - h * 0.6, w * 0.6 + h * 0.8, -h * 0.6, h * 0.8]
    out = N.extended(corners, tuple(c(s).cast("double") for s in ("left", "top", "right", "bottom")))
    return p.select(*KEY, *((F.round(v, 4) + 0.0).alias(n) for v, n in zip(out, ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3"), strict=True)))


_corner = lambda a, b, x, y: f"round({x} + 0.8::DOUBLE * ({a}) - 0.6::DOUBLE * ({b}), 4), round({y} + 0.6::DOUBLE * ({a}) + 0.8::DOUBLE * ({b}), 4)"
_flat = ", ".join(f"{v} + 0.0 AS {n}" for k, (a, b, x, y) in enumerate((('-"left"', "-top", "0", "0"), ('"right"', "-top", "w * 0.8::DOUBLE", "w * 0.6::DOUBLE"), ('"right"', "bottom", "w * 0.8::DOUBLE - h * 0.6::DOUBLE", "w * 0.6::DOUBLE + h * 0.8::DOUBLE"), ('-"left"', "bottom", "-h * 0.6::DOUBLE", "h * 0.8::DOUBLE"))) for v, n in zip(_corner(a, b, x, y).replace(", 4), ", ", 4)|").split("|"), (f"x{k}", f"y{k}"), strict=True))
add("extended_rect", extended_rect, f", q AS (SELECT *, width::DOUBLE AS w, height::DOUBLE AS h FROM more) SELECT img, page, {_flat} FROM q")
add(
    "orders_by_unit",
    lambda p: A.numbered(p, [c("margin") == 0, N.adjusted(c("width"), c("dpi_x"), "mm"), c("img"), c("page")], "project", KEY),
    "SELECT img, page, row_number() OVER (PARTITION BY project ORDER BY margin = 0, width / round(dpi_x / 0.0254::DOUBLE) * 1000, img, page) - 1 AS rank FROM more",
)
add(
    "order_by_colour_mode",
    lambda p: A.numbered(p, [c("halign"), c("aligned"), c("side"), c("margin") > 4, c("angle"), c("img"), c("page")], "project", KEY),
    "SELECT img, page, row_number() OVER (PARTITION BY project ORDER BY halign, aligned, side, margin > 4, angle, img, page) - 1 AS rank FROM more",
)
add(
    "order_by_hard_size",
    lambda p: A.numbered(p, [c("width") < 30, c("width") + c("left") + c("right"), c("height") + c("top") + c("bottom"), c("img"), c("page")], "project", KEY),
    'SELECT img, page, row_number() OVER (PARTITION BY project ORDER BY width < 30, width + "left" + "right", height + top + bottom, img, page) - 1 AS rank FROM more',
)
add("order_natural", lambda p: A.numbered(p, [c("img"), c("page"), c("side")], "project", KEY), "SELECT img, page, row_number() OVER (PARTITION BY project ORDER BY img, page, side) - 1 AS rank FROM more")
add(
    "widest_pages",
    lambda p: A.numbered(p, [F.desc("width"), c("img"), c("page")], "project", ["project", *KEY, "width"]).where("rank < 3").drop("rank"),
    "SELECT project, img, page, width FROM more QUALIFY row_number() OVER (PARTITION BY project ORDER BY width DESC, img, page) <= 3",
)
add(
    "parameter_names",
    lambda p: p.select(*KEY, N.named(c("hkind"), "despeckle").alias("name"), N.coded(N.named(c("hkind"), "despeckle"), "despeckle").alias("code"), F.coalesce(F.element_at(F.create_map(F.lit("0"), F.lit("zero"), F.lit("1"), F.lit("one")), c("vkind").cast("string")), F.lit("default")).alias("property")),
    "SELECT img, page, CASE hkind WHEN 1 THEN 'cautious' WHEN 2 THEN 'normal' WHEN 3 THEN 'aggressive' ELSE 'off' END AS name, CASE WHEN hkind BETWEEN 1 AND 3 THEN hkind ELSE 0 END AS code, CASE vkind WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'default' END AS property FROM more",
)
add(
    "zones_and_properties_equal",
    lambda p: (lambda z: z.alias("a").join(z.select((c("img") + 1).alias("img"), c("zones").alias("before"), c("props").alias("old")), "img").select("img", ((c("zones") == c("before")) & (c("props") == c("old"))).alias("equal")))(
        p.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("page", "halign"))).alias("zones"), F.array_sort(F.collect_set(F.concat_ws("=", F.lit("layer"), c("valign").cast("string")))).alias("props"))
    ),
    ", z AS (SELECT img, list((page, halign) ORDER BY page, halign) AS zones, list_sort(list(DISTINCT 'layer=' || valign)) AS props FROM more GROUP BY img) SELECT a.img, a.zones = b.zones AND a.props = b.props AS equal FROM z a JOIN z b ON a.img = b.img + 1",
)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with labels: every seventh has a stored one, the others follow."""
    files = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_size").alias("name"))
    return N.labelled(files, files.where("id % 7 = 0").select("id", (c("id") % 5).alias("label")), "name", "id", [c("id")])


QUERIES["labels_after_stored"], ORACLE["labels_after_stored"] = labels, """WITH f AS (SELECT p_partkey AS id, p_size AS name, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 5 END AS s FROM part)
SELECT id, name, coalesce(s, coalesce(max(s) OVER (PARTITION BY name), -1) + row_number() OVER (PARTITION BY name, s IS NULL ORDER BY id)) AS label FROM f"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names with overrides and reading direction, and names between two."""
    f = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.concat(F.lit("b"), c("p_size")).alias("base"), F.when(c("p_partkey") % 3 == 0, "x%1y").when(c("p_partkey") % 3 == 1, "plain").alias("o"), (c("p_partkey") % 2).alias("label"), (c("p_size") % 4).alias("page"), (c("p_partkey") % 5).alias("sub"))
    second = F.when(c("id") % 4 == 0, F.concat("base", F.lit("&ep0500"))).when(c("id") % 4 == 1, F.concat(F.lit("z"), "base"))
    return f.select("id", N.output_name(c("base"), c("o"), c("label"), c("page"), c("sub"), c("id") % 2 == 0).alias("name"), N.between_name(F.concat("base", F.lit("&ep0100")), second).alias("between"))


QUERIES["output_names_by_template"], ORACLE["output_names_by_template"] = names, """WITH f AS (SELECT p_partkey AS id, 'b' || p_size AS base, CASE p_partkey % 3 WHEN 0 THEN 'xb' || p_size || 'y' WHEN 1 THEN 'plain' ELSE 'b' || p_size END AS stem, p_partkey % 2 AS label, p_size % 4 AS page, p_partkey % 5 AS sub FROM part)
SELECT id, stem || CASE WHEN label > 0 THEN '(' || label || ')' ELSE '' END || CASE WHEN page > 0 THEN '_page' || lpad(page::VARCHAR, 4, '0') ELSE '' END || CASE WHEN sub = 1 THEN CASE WHEN id % 2 = 0 THEN '_2L' ELSE '_1L' END WHEN sub = 2 THEN CASE WHEN id % 2 = 0 THEN '_1R' ELSE '_2R' END ELSE '' END || '.tif' AS name,
base || '&ep' || CASE id % 4 WHEN 0 THEN '0300' ELSE '1100' END AS "between" FROM f"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their image, file and folder: four inner joins, in which what leads nowhere is lost."""
    from folioframe.sources import project

    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    tables = {
        "directories": table(spark, sf_dir, "nation").where("n_nationkey % 4 > 0").select(c("n_nationkey").cast("long").alias("id"), F.concat(F.lit("/in/"), "n_nationkey").alias("path")),
        "files": table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_nationkey").cast("long").alias("dir_id"), F.concat(c("c_custkey"), F.lit(".tif")).alias("name")),
        "images": o.select(c("o_orderkey").alias("id"), c("o_custkey").alias("file_id"), F.lit(0).alias("file_image"), (c("o_orderkey") % 4).cast("int").alias("sub_pages"), F.lit(10).alias("width"), F.lit(20).alias("height"), F.lit(300).alias("dpi_x"), F.lit(300).alias("dpi_y"), F.lit(False).alias("grayscale")),
        "pages": l.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_orderkey").alias("image_id"), (c("l_linenumber") % 3).cast("int").alias("sub_page")),
    }
    return project.resolved(tables).select("page_id", "image_id", "sub_page", "path")


QUERIES["project_references"], ORACLE["project_references"] = references, """SELECT l_orderkey * 10 + l_linenumber AS page_id, l_orderkey AS image_id, CAST(l_linenumber % 3 AS INTEGER) AS sub_page, '/in/' || n_nationkey || '/' || c_custkey || '.tif' AS path
FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 4 BETWEEN 1 AND 2 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 4 > 0"""

# pixels
raster("fill_frame", bw(lambda b: P.fill(b, 1, (1, 5), (1, 2), False)), "SELECT img_id, y, x, CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 2 THEN bw ELSE 1 END AS bw FROM bw")
raster("pixel_at", gray(lambda t: t.where("x = 2 and y = 1").select("img_id", "g")), "SELECT img_id, g FROM tile WHERE x = 2 AND y = 1")
raster("pixel_set", gray(lambda t: P.fill(t, 77, (2, 2), (1, 1))), "SELECT img_id, y, x, CASE WHEN x = 2 AND y = 1 THEN 77 ELSE g END AS g FROM tile")
raster("black_count_in_rect", bw(lambda b: b.groupBy("img_id").agg(F.coalesce(F.sum(F.when(c("x").between(1, 20) & c("y").between(-3, 3), c("bw"))), F.lit(0)).cast("long").alias("black"))), "SELECT img_id, CAST(coalesce(sum(CASE WHEN x BETWEEN 1 AND 20 AND y BETWEEN -3 AND 3 THEN bw END), 0) AS BIGINT) AS black FROM bw GROUP BY img_id")


def area_profile(b: DataFrame) -> DataFrame:
    """Row profile of an area; null for images that it isn't inside of."""
    size = Window.partitionBy("img_id")
    inside = (F.max("x").over(size) >= 2) & (F.max("y").over(size) >= 4)
    rows = b.withColumn("ok", inside).where("y between 1 and 4 and x between 0 and 2")
    return rows.groupBy("img_id", c("y").alias("pos")).agg(F.sum(F.when(c("ok"), c("bw"))).cast("long").alias("n"))


raster("row_profile_of_area", bw(area_profile), ", z AS (SELECT *, max(x) OVER (PARTITION BY img_id) >= 2 AND max(y) OVER (PARTITION BY img_id) >= 4 AS ok FROM bw) SELECT img_id, y AS pos, CAST(sum(CASE WHEN ok THEN bw END) AS BIGINT) AS n FROM z WHERE y BETWEEN 1 AND 4 AND x BETWEEN 0 AND 2 GROUP BY img_id, y")
raster("rect_sum", gray(lambda t: t.where("x between 1 and 3 and y between 2 and 5").groupBy("img_id").agg(F.sum("g").cast("long").alias("s"))), "SELECT img_id, CAST(sum(g) AS BIGINT) AS s FROM tile WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 5 GROUP BY img_id")
raster("region_mean", gray(lambda t: t.groupBy("img_id").agg(F.round(F.coalesce(F.avg(F.when((c("x") < 3) & (c("y") > 8), c("g"))), F.lit(128.0)), 6).alias("mean"))), "SELECT img_id, round(coalesce(avg(CASE WHEN x < 3 AND y > 8 THEN g END), 128.0), 6) AS mean FROM tile GROUP BY img_id")
raster("palette_by_image", gray(lambda t: t.select("img_id", "g").distinct()), "SELECT DISTINCT img_id, g FROM tile")
raster("contrast_stretch_levels", gray(lambda t: t.select(*P.KEY, F.when(c("g") <= 40, 0).when(c("g") >= 200, 255).otherwise(F.expr("(255 * (g - 40) + 80) div 160")).cast("int").alias("g"))), "SELECT img_id, y, x, CAST(CASE WHEN g <= 40 THEN 0 WHEN g >= 200 THEN 255 ELSE (255 * (g - 40) + 80) // 160 END AS INTEGER) AS g FROM tile")
raster("rotate90_of_area", gray(lambda t: P.rotate(t.where("x between 1 and 4 and y between 0 and 2").select("img_id", "y", (c("x") - 1).alias("x"), "g"), 90)), ", a AS (SELECT img_id, y, x - 1 AS x, g FROM tile WHERE x BETWEEN 1 AND 4 AND y BETWEEN 0 AND 2) SELECT img_id, x AS y, max(y) OVER (PARTITION BY img_id) - y AS x, g FROM a")
raster("blend_argb", gray(lambda t: t.select(*P.KEY, *(F.floor((v * 64 + F.lit(o) * 192) / 256 + 0.5).cast("int").alias(n) for n, v, o in (("a", F.lit(255), 128), ("r", c("g"), 10), ("gr", 255 - c("g"), 200), ("b", F.expr("g div 2"), 99))))), "SELECT img_id, y, x, CAST(floor((255 * 64 + 128 * 192) / 256.0 + 0.5) AS INTEGER) AS a, CAST(floor((g * 64 + 10 * 192) / 256.0 + 0.5) AS INTEGER) AS r, CAST(floor(((255 - g) * 64 + 200 * 192) / 256.0 + 0.5) AS INTEGER) AS gr, CAST(floor((g // 2 * 64 + 99 * 192) / 256.0 + 0.5) AS INTEGER) AS b FROM tile")
raster(
    "component_adjacency",
    bw(lambda b: (lambda z: z.alias("a").join(z.select("img_id", c("y").alias("y2"), c("x").alias("x2"), c("zone").alias("other")), "img_id").where("(y2 = y and x2 = x + 1 or y2 = y + 1 and x2 = x) and zone <> other").select("img_id", F.least("zone", "other").alias("a"), F.greatest("zone", "other").alias("b")).distinct())(G.influence(G.components(b)))),
    "SELECT 1",
)
ORACLE["component_adjacency"] = f"""{_labels(False)}, z AS (SELECT a.img_id, a.y, a.x, coalesce(arg_min(b.label, ((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x), b.x, b.y)), 0) AS zone FROM lab a LEFT JOIN lab b ON b.img_id = a.img_id AND b.label > 0 GROUP BY a.img_id, a.y, a.x)
SELECT DISTINCT p.img_id, CAST(least(p.zone, q.zone) AS INTEGER) AS a, CAST(greatest(p.zone, q.zone) AS INTEGER) AS b FROM z p JOIN z q ON q.img_id = p.img_id AND (q.y = p.y AND q.x = p.x + 1 OR q.y = p.y + 1 AND q.x = p.x) AND p.zone <> q.zone"""
raster("component_seeds", bw(lambda b: G.components(b).where("label > 0").groupBy("img_id", "label").agg(F.min(F.struct("y", "x")).alias("s"), F.count("*").alias("n")).select("img_id", "label", "s.y", "s.x", "n")), "SELECT 1")
ORACLE["component_seeds"] = f"{_labels(False)} SELECT img_id, label, arg_min(y, (y, x)) AS y, arg_min(x, (y, x)) AS x, count(*) AS n FROM lab WHERE label > 0 GROUP BY img_id, label"
raster("component_erased", bw(lambda b: (lambda d: d.select(*P.KEY, F.when(c("label") == 1, 0).otherwise((c("label") > 0).cast("int")).alias("bw")))(G.components(b, True))), "SELECT 1")
ORACLE["component_erased"] = f"{_labels(True)} SELECT img_id, y, x, CASE WHEN label = 1 THEN 0 ELSE bw END AS bw FROM lab"
raster("component_image", bw(lambda b: (lambda d: d.select("img_id", (c("y") - F.min("y").over(Window.partitionBy("img_id"))).alias("y"), (c("x") - F.min("x").over(Window.partitionBy("img_id"))).alias("x")))(G.components(b, True).where("label = 1"))), "SELECT 1")
ORACLE["component_image"] = f"{_labels(True)} SELECT img_id, y - min(y) OVER (PARTITION BY img_id) AS y, x - min(x) OVER (PARTITION BY img_id) AS x FROM lab WHERE label = 1"


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit figures of the orders' keys."""
    ones, lead, trail, back = N.bit_figures(c("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ones.alias("ones"), lead.alias("lead"), trail.alias("trail"), back.alias("reverse"))


QUERIES["bit_figures"], ORACLE["bit_figures"] = bits, """WITH b AS (SELECT o_orderkey, lpad(bin(o_orderkey), 32, '0') AS t FROM orders)
SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS ones, CAST(32 - length(ltrim(t, '0')) AS INTEGER) AS lead, CAST(32 - length(rtrim(t, '0')) AS INTEGER) AS trail, CAST(list_sum(list_transform(range(0, 32), lambda i: CAST(t[i + 1] AS BIGINT) << i)) AS BIGINT) AS reverse FROM b"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved to a grid, and whether the polygon is the same within a tolerance."""
    v = lambda k: c("embedding")[k].cast("double") * 100
    points = F.array(*(F.struct(v(2 * k).alias("x"), v(2 * k + 1).alias("y")) for k in range(3)))
    df = table(spark, sf_dir, "embeddings").select("vec_id", points.alias("p"))
    df = df.select("vec_id", "p", N.on_grid(c("p"), 0.5).alias("q"))
    return df.select("vec_id", N.same_polygon(c("p"), c("q"), 0.2).alias("same"), F.round(F.aggregate("q", F.lit(0.0), lambda s, p: s + p["x"] + 2 * p["y"]), 6).alias("total"))


_g = lambda k: f"floor(embedding[{k}]::DOUBLE * 100 / 0.5::DOUBLE + 0.5::DOUBLE) * 0.5::DOUBLE"
QUERIES["polygon_grid"], ORACLE["polygon_grid"] = polygons, f"SELECT vec_id, {' AND '.join(f'abs(embedding[{k}]::DOUBLE * 100 - {_g(k)}) <= 0.2' for k in range(1, 7))} AS same, round({' + '.join(f'{1 + (k + 1) % 2} * ({_g(k)})' for k in range(1, 7))}, 6) AS total FROM embeddings"


# palettes
def uniform(t: DataFrame, levels: int) -> DataFrame:
    """Each gray at the nearest of evenly spaced levels, and its index."""
    index = F.floor(c("g") * (levels - 1) / 255 + 0.5).cast("int")
    return t.select(*P.KEY, index.alias("at"), F.floor(index * 255 / (levels - 1) + 0.5).cast("int").alias("g"))


raster("palette_uniform", gray(lambda t: uniform(t, 6)), "SELECT img_id, y, x, CAST(floor(g * 5 / 255.0::DOUBLE + 0.5) AS INTEGER) AS at, CAST(floor(floor(g * 5 / 255.0::DOUBLE + 0.5) * 255 / 5.0::DOUBLE + 0.5) AS INTEGER) AS g FROM tile")


def median_cut(t: DataFrame, depth: int) -> DataFrame:
    """2 to the depth boxes of equally many pixels in order of gray (ntile by rank), each with the rounded mean of its grays; boxes are numbered from dark to light."""
    n = 1 << depth
    w = Window.partitionBy("img_id").orderBy("g", "y", "x")
    boxes = t.select("img_id", "g", F.ntile(n).over(w).alias("box"))
    return boxes.groupBy("img_id", "box").agg(F.floor(F.avg("g") + 0.5).cast("int").alias("g"), F.count("*").alias("n"))


raster("palette_median_cut", gray(lambda t: median_cut(t, 2)), ", b AS (SELECT img_id, g, ntile(4) OVER (PARTITION BY img_id ORDER BY g, y, x) AS box FROM tile) SELECT img_id, CAST(box AS INTEGER) AS box, CAST(floor(avg(g) + 0.5) AS INTEGER) AS g, count(*) AS n FROM b GROUP BY img_id, box")


def merged_segments(t: DataFrame, levels: int, least: int) -> DataFrame:
    """Colours of a posterised image with at least least pixels, and the pixels of smaller ones in the nearest of them (the darker of two); none kept, none returned."""
    n = uniform(t, levels).groupBy("img_id", "g").agg(F.count("*").alias("n"))
    kept = n.where(c("n") >= least)
    small = n.where(c("n") < least).select("img_id", c("g").alias("s"), c("n").alias("m"))
    near = small.join(kept, "img_id").groupBy("img_id", "s", "m").agg(F.min(F.struct(F.abs(c("g") - c("s")).alias("d"), "g"))["g"].alias("g"))
    return kept.unionByName(near.select("img_id", "g", c("m").alias("n"))).groupBy("img_id", "g").agg(F.sum("n").alias("n"))


raster("segments_merged", gray(lambda t: merged_segments(t, 6, 10)), """, n AS (SELECT img_id, CAST(floor(floor(g * 5 / 255.0::DOUBLE + 0.5) * 255 / 5.0::DOUBLE + 0.5) AS INTEGER) AS g, count(*) AS n FROM tile GROUP BY ALL),
m AS (SELECT s.img_id, s.n, arg_min(k.g, (abs(k.g - s.g), k.g)) AS g FROM n s JOIN n k ON k.img_id = s.img_id AND k.n >= 10 WHERE s.n < 10 GROUP BY s.img_id, s.g, s.n)
SELECT img_id, g, CAST(sum(n) AS BIGINT) AS n FROM (SELECT img_id, g, n FROM n WHERE n >= 10 UNION ALL SELECT img_id, g, n FROM m) GROUP BY img_id, g""")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and rate (thousandths a unit of time) of each operation and backend."""
    e = table(spark, sf_dir, "events").where("value is not null").select(c("event_type"), (c("user_id") % 2).alias("backend"), F.floor(c("value") * 1000).cast("long").alias("t"))
    g = e.groupBy("event_type", "backend").agg(F.count("*").alias("n"), F.sum("t").alias("total"))
    return g.select("event_type", "backend", "n", F.round(c("total") / c("n"), 6).alias("mean"), F.round(F.when(c("total") > 0, c("n") * 1_000_000 / F.when(c("total") > 0, c("total"))), 6).alias("rate"))


QUERIES["throughput"], ORACLE["throughput"] = throughput, """WITH g AS (SELECT event_type, user_id % 2 AS backend, count(*) AS n, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, backend, n, round(total / n::DOUBLE, 6) AS mean, round(CASE WHEN total > 0 THEN n * 1000000 / total::DOUBLE END, 6) AS rate FROM g"""
