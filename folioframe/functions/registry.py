"""Named stages, page orders and binarisers; what is registered is found by name wherever the engine takes one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators import kernels as K
from folioframe.operators import pages as A

Stage = Callable[[DataFrame, dict], DataFrame]
Order = Callable[[], list[Column]]
Binarizer = Callable[[np.ndarray, int, float, int], np.ndarray]

_stages: dict[str, Stage] = {}
_orders: dict[str, Order] = {}


def _put(table: dict, name: str, value: object, replace: bool) -> None:
    if name in table and not replace:
        raise ValueError(f"{name} is registered")
    table[name] = value


def register_stage(name: str, stage: Stage, replace: bool = False) -> None:
    """A stage takes packed pages and options and returns packed pages; stages run in the order in which they were registered."""
    _put(_stages, name, stage, replace)


def register_order(name: str, order: Order, replace: bool = False) -> None:
    """An order gives sort columns; ties go to image and page."""
    _put(_orders, name, order, replace)


def register_binarizer(name: str, f: Binarizer, replace: bool = False) -> None:
    """A binariser takes a gray raster, a window, a coefficient and a shift and returns 1 for black."""
    _put(K.BINARIZERS, name, f, replace)


def stages() -> list[tuple[str, Stage]]:
    return list(_stages.items())


def ordered(pages: DataFrame, name: str, by: str, key: list[str], complete: Column | None = None, reverse: bool = False) -> DataFrame:
    """key and rank of each page in a named order; pages that aren't complete come last, in either direction."""
    if name not in _orders:
        raise ValueError(f"no order {name}")
    df, sort = pages, []
    if complete is not None:
        sort.append((~complete).asc())
    for k, c in enumerate(_orders[name]()):
        df = df.withColumn(f"_sort{k}", c)
        sort.append(F.col(f"_sort{k}").desc() if reverse else F.col(f"_sort{k}").asc())
    return A.numbered(df, [*sort, *(F.col(c) for c in key)], by, key)


for _name, _order in {
    "natural": lambda: [],
    "rotation": lambda: [F.col("rotation")],
    "split_type": lambda: [F.when(F.col("layout") == 0, 100).otherwise(F.col("layout"))],
    "page_size": lambda: [F.greatest("width", "height")],
    "angle": lambda: [-F.coalesce("angle", F.lit(0))],
    "abs_angle": lambda: [-F.abs(F.coalesce("angle", F.lit(0)))],
    "content_width": lambda: [F.col("width").isNull(), F.col("width")],
    "content_height": lambda: [F.col("height").isNull(), F.col("height")],
    "alignment": lambda: [F.col("aligned"), -F.col("valign"), -F.col("halign")],
    "hard_width": lambda: [F.col("width") + F.col("left") + F.col("right")],
    "hard_height": lambda: [F.col("height") + F.col("top") + F.col("bottom")],
    "mode": lambda: [F.col(c) for c in ("mode", "auto_layer", "foreground_layer", "illumination", "threshold")],
    "dewarping": lambda: [F.col("dewarping")],
    "source_colour": lambda: [~F.col("grayscale")],
}.items():
    register_order(_name, _order)
