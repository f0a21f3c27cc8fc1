"""The chain of page stages over packed pages: orientation, split, deskew, content, layout, output.

Each stage is registered by name and reads the engine's options; ``process``
runs a range of them.  Only the layout needs more than a page at a time: an
aggregate of one row, which is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import options as O
from folioframe.functions import registry
from folioframe.operators import kernels as K
from folioframe.operators import scans as S

TURNS = {"left": 270, "right": 90, "upsidedown": 180, "none": 0}
MODES = {"black_and_white": "bw", "color_grayscale": "gray", "mixed": "mixed"}
COLUMNS = "part int, width int, height int, data binary"


def _packed(a: np.ndarray, part: int = 0) -> tuple:
    a = np.ascontiguousarray(a).astype(np.uint8)
    return part, a.shape[1], a.shape[0], a.tobytes()


def orientation(pages: DataFrame, o: dict) -> DataFrame:
    """Pages turned by quarters."""
    return S.rasters(pages, lambda g: S.orientation(g, TURNS[o["orientation"]]))


def split(pages: DataFrame, o: dict) -> DataFrame:
    """One or two pages of each image; a page's id is three times its image's, and one or two more for halves in reading direction."""
    two = o["layout"]

    def cut(g: np.ndarray) -> list[tuple]:
        wanted = two == "2" or (two == "0" and g.shape[1] > g.shape[0])
        kind, cutters = S.layout(g, wanted)
        if kind == "single_cut" and two in ("0", "1.5"):
            a, b = (int(np.clip(c, 0, g.shape[1])) for c in cutters)
            return [_packed(g[:, a:b] if b - a > 1 else g)]
        if not wanted or (kind != "two_pages" and two != "2"):
            return [_packed(g)]
        at = int(np.clip(cutters[0] if cutters else g.shape[1] / 2, 1, g.shape[1] - 1))
        halves = [g[:, :at], g[:, at:]]
        return [_packed(h, k) for k, h in enumerate(halves if o["layout-direction"] == "lr" else halves[::-1], 1)]

    out = S.figures(pages, cut, COLUMNS, many=True)
    return out.select((F.col("img_id") * 3 + F.col("part")).alias("img_id"), "width", "height", "data")


def deskew(pages: DataFrame, o: dict) -> DataFrame:
    """Pages levelled by their own skew where it is accepted, or by the given angle."""

    def level(g: np.ndarray) -> np.ndarray:
        angle, confidence = K.find_skew(K.without_shadows(S.black(g), int(o["dpi"]))) if o["deskew"] == "auto" else (-float(o["rotate"]), 2.0)
        if confidence < 2.0 or not angle:
            return g
        slope = -np.tan(np.radians(angle))
        return (255 - K.sheared(255 - g, slope, g.shape[1] / 2)).astype(np.uint8)

    return S.rasters(pages, level)


def content(pages: DataFrame, o: dict) -> DataFrame:
    """Pages cropped to their page box, if asked for, and their content; a page without content stays whole."""

    def crop(g: np.ndarray) -> np.ndarray:
        if o["enable-page-detection"] and not o["force-disable-page-detection"]:
            x0, y0, x1, y1 = K.page_box(S.black(g))
            g = g[y0:y1, x0:x1] if x1 - x0 > 1 and y1 - y0 > 1 else g
        box = None if o["disable-content-detection"] else K.content_box(g, int(o["dpi"]) // 2)
        return g if box is None else g[box[1] : box[3], box[0] : box[2]]

    return S.rasters(pages, crop)


def layout(pages: DataFrame, o: dict) -> DataFrame:
    """Pages with margins (millimetres), all of one size if they are to match, content placed by its alignment."""
    dot = float(o["dpi"]) / 25.4
    left, right, top, bottom = (round(float(o[f"margins-{s}"] or 0) * dot) for s in ("left", "right", "top", "bottom"))
    size = pages.where("data is not null").agg(F.max("width").alias("all_w"), F.max("height").alias("all_h"))
    shift = {"left": 0.0, "top": 0.0, "center": 0.5, "auto": 0.5, "original": 0.5, "right": 1.0, "bottom": 1.0}
    across, down = shift[o["alignment-horizontal"]], shift[o["alignment-vertical"]]
    wide = size.first() if o["match-layout"] == "true" else None

    def place(g: np.ndarray) -> np.ndarray:
        h, w = g.shape
        W, H = (wide["all_w"], wide["all_h"]) if wide is not None and wide["all_w"] else (w, h)
        out = np.full((H + top + bottom, W + left + right), 255, np.uint8)
        y, x = top + int((H - h) * down), left + int((W - w) * across)
        out[y : y + h, x : x + w] = g
        return out

    return S.rasters(pages, place)


def output(pages: DataFrame, o: dict) -> DataFrame:
    """Pages in their mode: dewarped, evened, binarised and despeckled as the options say."""
    return S.rasters(pages, lambda g: S.routed(g, MODES[o["color-mode"]], curves=o["dewarping"] == "auto", dpi=int(o["dpi"]), level=o["despeckle"]))


for _name, _stage in (("fix_orientation", orientation), ("page_split", split), ("deskew", deskew), ("select_content", content), ("page_layout", layout), ("output", output)):
    registry.register_stage(_name, _stage)


def process(pages: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Packed pages through the stages from start-filter to end-filter."""
    o, _ = O.parsed(words or [])
    for _, stage in registry.stages()[o["start-filter"] - 1 : o["end-filter"]]:
        pages = stage(pages, o)
    return pages
