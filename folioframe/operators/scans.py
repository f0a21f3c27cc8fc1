"""Whole-page operators on the packed form (img_id, width, height, data): one row a page, no exchange.

``rasters`` maps pages to pages, ``figures`` to columns; an empty or null
raster gives a row of nulls.  The kernels see one page at a time, so a task
holds a few copies of one page, however many pages there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioframe.operators import dewarp
from folioframe.operators import kernels as K
from folioframe.sources.rasters import PACKED, draw


def page_of(width: int | None, height: int | None, data: bytes | None) -> np.ndarray | None:
    """A page's pixels; None for an empty page or one whose data doesn't fit its size."""
    if not width or not height or data is None or len(data) != width * height:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width)


def _each(b: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray | None]]:
    columns = [b.column(c) for c in ("img_id", "width", "height", "data")]
    for k in range(b.num_rows):
        i, w, h, d = (c[k].as_py() for c in columns)
        yield i, page_of(w, h, d)


def rasters(pages: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f of each page, as pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):
                got = [(k, None if a is None else np.ascontiguousarray(f(a)).astype(np.uint8)) for k, a in _each(b.slice(i, 16))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([None if a is None else a.shape[1] for _, a in got], pa.int32()), pa.array([None if a is None else a.shape[0] for _, a in got], pa.int32()), pa.array([None if a is None else a.tobytes() for _, a in got], pa.binary())], ["img_id", "width", "height", "data"])

    return pages.select("img_id", "width", "height", "data").mapInArrow(run, PACKED)


def together(f: Callable[[list[np.ndarray]], list], most: int = 32, pixels: int = 1 << 21) -> Callable[[Iterator[np.ndarray | None]], Iterator]:
    """f of up to ``most`` pages at a time, or as many as have so many pixels; None for None, in order."""

    def run(pages: Iterator[np.ndarray | None]) -> Iterator:
        held: list[np.ndarray | None] = []

        def flush() -> Iterator:
            got = iter(f([a for a in held if a is not None]))
            yield from [None if a is None else next(got) for a in held]
            held.clear()

        for a in pages:
            held.append(a)
            if len(held) >= most or sum(x.size for x in held if x is not None) >= pixels:
                yield from flush()
        yield from flush()

    return run


def figures(pages: DataFrame, f: Callable[[np.ndarray], tuple | list[tuple]], columns: str, many: bool = False, before: Callable[[list[np.ndarray]], list] | None = None) -> DataFrame:
    """img_id and the columns that f gives of each page; many: a list of rows of them, none for none. before: what f takes, from several pages together, instead of a page. Pages that come from texts are drawn here and never leave the task."""
    texts = vars(pages).get("texts")
    drawn = texts is not None
    schema = StructType.fromDDL("img_id long, " + columns)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ids = [], b.column("img_id").to_pylist()
            each = draw(b) if drawn else (a for _, a in _each(b))
            for k, a in zip(ids, together(before)(each) if before else each, strict=True):
                if many:
                    rows += [(k, *r) for r in (f(a) if a is not None else [])]
                else:
                    rows.append((k, *(f(a) if a is not None else (None,) * (len(kinds) - 1))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t.type) for c, t in enumerate(kinds)], names=kinds.names)

    return (pages.select("img_id", "width", "height", "data") if texts is None else texts).mapInArrow(run, schema)


def black(g: np.ndarray) -> np.ndarray:
    """Otsu's binarisation."""
    return (g < K.otsu(K.histogram(g))).astype(np.uint8)


# --- figures of a page ------------------------------------------------------------------------------------------


def skew(g: np.ndarray, dpi: int = 150) -> tuple[float, float, bool]:
    """Angle, confidence and whether it is accepted, of the page without its shadows."""
    angle, confidence = K.find_skew(K.without_shadows(black(g), dpi))
    return round(float(angle), 6), round(float(confidence), 6), bool(confidence >= 2.0)


def orientation(g: np.ndarray, degrees: int) -> np.ndarray:
    """A page turned by quarters; any other angle is an error."""
    if degrees % 90:
        raise ValueError(f"rotation by {degrees} degrees")
    return np.rot90(g, -(degrees // 90) % 4)


def speckles(g: np.ndarray, dpi: int, level: str) -> tuple[int, int, int]:
    """Black pixels before and after despeckling, and of the speckle image, which is what was removed."""
    before = black(g)
    after = K.despeckled(before, dpi, level)
    return int(before.sum()), int(after.sum()), int((before & (1 - after)).sum())


def layout(g: np.ndarray, two_pages: bool, dpi: int = 100) -> tuple[str, list[float]]:
    """Kind of page layout and the cutters' middles, from fold lines."""
    kind, cutters = K.page_layout_of(K.fold_lines(g, dpi), g.shape[1], two_pages)
    return kind, [round((a + b) / 2, 6) for a, b in cutters]


def routed(g: np.ndarray, mode: str, method: str = "otsu", curves: bool = False, dpi: int = 300, level: str = "normal") -> np.ndarray:
    """The output stage by its parameters: ``gray`` and ``mixed`` with evened light, ``bw`` binarised, smoothed and despeckled, ``as_is`` untouched; curves: straightened first where a model is found."""
    if mode == "as_is":
        return g
    if curves:
        model = dewarp.model(g)
        if model is not None:
            g = dewarp.straightened(g, *model)
    even = K.lit(g)
    if mode == "gray":
        return even
    mask = K.content_mask(g, dpi) if mode == "mixed" else None
    bw = K.smoothed(K.binarized(even, method, mask=mask))
    bw = bw if level == "off" else K.despeckled(bw, dpi, level)
    if mode == "bw":
        return (255 * (1 - bw)).astype(np.uint8)
    if mode != "mixed":
        raise ValueError(f"no mode {mode}")
    pure = (255 * (1 - bw)).astype(np.uint8)
    return pure if mask.all() else np.where(mask > 0, pure, np.clip(even, 1, 254)).astype(np.uint8)


# Layers of a result, as bits.
LAYERS = {"foreground": 1, "background": 2, "mask": 4, "auto_mask": 8, "whole": 16}


def layer_set(mode: str, split: bool, pictures_by_zone: bool) -> int:
    """Bits of the layers that a result has: bw has a foreground alone, gray a background alone, mixed both with a mask, an automatic one unless zones make it; split adds them to the whole."""
    bits = {"bw": 1, "gray": 2, "mixed": 7}[mode]
    if mode == "mixed" and not pictures_by_zone:
        bits |= LAYERS["auto_mask"]
    return bits | LAYERS["whole"] if split else LAYERS["whole"]


def layers(g: np.ndarray) -> dict[str, np.ndarray]:
    """Foreground (pure black and white), background (all else, white where foreground is) and mask of a mixed page."""
    pure = (g == 0) | (g == 255)
    return {"foreground": np.where(pure, g, 255), "background": np.where(pure, 255, g), "mask": np.where(pure, np.uint8(0), np.uint8(255))}


def zoned(g: np.ndarray, mask: np.ndarray, zones: list[tuple[str, tuple[int, int, int, int]]], fills: list[tuple[int, tuple[int, int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Page and picture mask (1: text) after zones in their order: first erasers, then painters, then erasers that go over painters; fills last, on a binary page by whether their colour is dark."""
    m = mask.copy()
    for kind, value in (("eraser1", 1), ("painter2", 0), ("eraser3", 1)):
        for k, (x0, y0, x1, y1) in zones:
            if k == kind:
                m[y0:y1, x0:x1] = value
    out = g.copy()
    binary = bool(np.isin(np.unique(g), (0, 255)).all())
    for colour, (x0, y0, x1, y1) in fills:
        out[y0:y1, x0:x1] = (0 if colour < 128 else 255) if binary else colour
    return out, m
