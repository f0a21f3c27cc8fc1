"""Queries on the packed form: kernels under the twins of the long form's operators, and whole-page operators on rendered pages.

The latter have no twin; tests hold them against brute force and planted pages.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import dewarp as D
from folioframe.operators import kernels as K
from folioframe.operators import scans as S
from folioframe.plans import raster_queries, region_queries
from folioframe.plans.raster_queries import BRICK, Query
from folioframe.sources import rasters as R

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def same(name: str, f: Callable[[np.ndarray], np.ndarray], value: str = "bw", binary: bool = True) -> None:
    """A packed query with the twin of the long form's."""

    def query(spark, sf_dir: str) -> DataFrame:
        packed = R.to_packed(R.odd_tiles(spark, sf_dir))
        out = S.rasters(packed, (lambda g: f((g < 128).astype(np.uint8))) if binary else f)
        return R.to_long(out).withColumnRenamed("g", value)

    QUERIES[f"packed_{name}"] = query
    ORACLE[f"packed_{name}"] = (raster_queries.ORACLE | region_queries.ORACLE)[name]


X, Y = BRICK
same("bin_sauvola", lambda g: K.sauvola(g, 5, 0.34), binary=False)
same("bin_bradley", lambda g: K.bradley(g, 4, 0.1), binary=False)
same("bin_wolf", lambda g: K.wolf(g, 5, 0.3), binary=False)
same("bin_grad", lambda g: K.grad(g, 5, 0.3), binary=False)
same("dilate_bw", lambda b: K.spread(b, (-X[1], -X[0]), (-Y[1], -Y[0]), False, 0))
same("erode_bw", lambda b: K.spread(b, X, Y, True, 1))
same("open_bw", lambda b: K.dilate(K.erode(b, 3, 3, 0), 3, 3))
same("close_gray", lambda g: K.lighter(K.darker(g, 3, 3), 3, 3), "g", False)
same("contrast_stretch", lambda g: K.stretched(g, 0.05, 0.05), "g", False)
same("big_components", lambda b: _big(b))
for t in (1, 2, 3, 4):
    same(f"reduce2x_t{t}", lambda b, t=t: K.reduced(b, t))
for diagonal, k in ((False, 4), (True, 8)):
    same(f"components{k}", lambda b, d=diagonal: K.components(b, d)[0], "label")
    same(f"seed_fill{k}", lambda b, d=diagonal: K.filled(np.where(np.arange(len(b))[:, None] == 0, b, 0), b, d))


def _big(b: np.ndarray) -> np.ndarray:
    label, n = K.components(b, True)
    box = K.component_boxes(label, n)
    return np.append(False, (box[:, 3] - box[:, 1] + 1 >= 3) | (box[:, 4] - box[:, 2] + 1 >= 3))[label]


def page(name: str, f: Callable[..., tuple | list[tuple]], columns: str, many: bool = False, before: Callable[[list[np.ndarray]], list] | None = None) -> None:
    """A query that gives columns of each rendered page, or of what before makes of several."""
    QUERIES[f"page_{name}"] = lambda spark, d: S.figures(R.scans(spark, d), f, columns, many, before)


def with_models(pages: list[np.ndarray]) -> list[tuple]:
    """Pages, their text lines and their models."""
    lines = D.text_lines_of(pages)
    return list(zip(pages, lines, D.models(pages, lines), strict=True))


def total(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], tuple]:
    """Size and sum of the raster that f gives."""

    def run(g: np.ndarray) -> tuple:
        out = f(g)
        return int(out.shape[1]), int(out.shape[0]), int(out.sum(dtype=np.int64))

    return run


SUM = "width int, height int, total long"
for method in ("otsu", *K.BINARIZERS):
    page(f"binarized_{method}", total(lambda g, m=method: K.binarized(g, m, 31, 0.34)), SUM)
page("components", lambda g: (K.components(S.black(g), True)[1],), "components int")
page("distances", lambda g: (int(K.distances(S.black(g), white=False).max()),), "farthest long")
page("zones", lambda g: (len(np.unique(K.zones(K.components(S.black(g), True)[0]))),), "zones int")
page("eroded_points", total(lambda g: K.eroded_points(S.black(g))), SUM)
for level in K.DESPECKLE:
    page(f"despeckled_{level}", lambda g, lv=level: S.speckles(g, 150, lv), "before long, after long, removed long")
page("skew", S.skew, "angle double, confidence double, accepted boolean")
page("without_shadows", total(lambda g: K.without_shadows(S.black(g), 150)), SUM)
page("deskewed", total(lambda g: (lambda b: K.sheared(b, -np.tan(np.radians(K.find_skew(b)[0])), b.shape[1] / 2))(S.black(g))), SUM)
page("turned", total(lambda g: S.orientation(g, 90)), SUM)
page("smoothed", total(lambda g: K.smoothed(S.black(g))), SUM)
page("pictures", total(K.pictures), SUM)
page("content_mask", total(lambda g: K.content_mask(g, 150)), SUM)
page("background", total(K.background), SUM)
page("lit", total(K.lit), SUM)
page("fold_lines", lambda g: [(k, round(a, 6), round(b, 6)) for k, (a, b) in enumerate(K.fold_lines(g))], "line int, top double, bottom double", many=True)
page("layout_one", lambda g: S.layout(g, False), "kind string, cutters array<double>")
page("layout_two", lambda g: S.layout(g, True), "kind string, cutters array<double>")
BOX = "x0 int, y0 int, x1 int, y1 int"
page("page_box", lambda g: K.page_box(S.black(g)) or (None,) * 4, BOX)
page("content_box", lambda g: K.content_box(g) or (None,) * 4, BOX)
page("white_rectangles", lambda g: [(k, *r) for k, r in enumerate(K.white_rectangles(S.black(g), 4, (8, 8), 200))], f"rank int, {BOX}", many=True)
page("rectangles", lambda g: [(k, *r) for k, r in enumerate(K.rectangles(K.reduced(S.black(g), 1)))], f"rank int, {BOX}", many=True)
page("lines", lambda g: [(k, round(a, 6), round(d, 6), n) for k, (a, d, n) in enumerate(K.line_finder(np.argwhere(K.eroded_points(K.reduced(K.reduced(S.black(g), 1), 2)))[:, ::-1].reshape(-1, 2), 2, 20))], "rank int, angle double, distance double, points int", many=True)
page("polarity", lambda g: (lambda p: (p[0], round(p[1], 6), K.needs_inversion(g)))(K.polarity(g)), "polarity string, confidence double, inverted boolean")
page("text_lines", lambda curves: [(k, len(c), round(float(c[:, 1].mean()), 6)) for k, c in enumerate(curves)], "line int, points int, y double", many=True, before=D.text_lines_of)
page("vertical_bounds", lambda g: (lambda b: (None,) * 4 if b is None else (round(b[0][0], 6), round(b[0][1], 6), round(b[1][0], 6), round(b[1][1], 6)))(D.vertical_bounds(S.black(g))), "left double, left_slope double, right double, right_slope double")
page("edges", lambda g: (lambda e: (round(float(e[0].mean()), 6), round(float(e[1].mean()), 6)))(D.edges(g)) if g.shape[0] > 2 else (None, None), "top double, bottom double")
page("dewarp_model", lambda p: (p[2] is not None, None if p[2] is None else round(D.residual(p[1], *p[2]), 6)), "found boolean, residual double", before=with_models)
page("dewarped", total(lambda p: p[0] if p[2] is None else D.straightened(p[0], *p[2])), SUM, before=with_models)
for mode in ("as_is", "gray", "bw", "mixed"):
    page(f"output_{mode}", total(lambda g, m=mode: S.routed(g, m, dpi=100)), SUM)


def layers(spark, sf_dir: str) -> DataFrame:
    """Foreground, background and mask of each page, counted."""
    return S.figures(R.scans(spark, sf_dir), lambda g: [(k, int(np.count_nonzero(v < 255))) for k, v in S.layers(S.routed(g, "mixed", dpi=100)).items()], "layer string, ink long", many=True)


QUERIES["page_layers"] = layers
QUERIES["scan_histogram"] = lambda spark, d: S.figures(R.scans(spark, d), lambda g: [(int(k), int(n)) for k, n in enumerate(K.histogram(g)) if n], "g int, n long", many=True).groupBy("img_id").agg(F.sum("n").alias("pixels"), F.min("g").alias("darkest"), F.max_by("g", F.struct("n", "g")).alias("paper"))
