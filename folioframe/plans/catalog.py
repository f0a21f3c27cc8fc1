"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans import analytics_queries, layout_queries, page_queries, raster_queries, region_queries, scan_queries, shape_queries, threshold_queries

FAMILIES = (raster_queries, threshold_queries, region_queries, shape_queries, page_queries, layout_queries, analytics_queries, scan_queries)
QUERIES = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLE = {k: v for f in FAMILIES for k, v in f.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's threshold of each image and how many pixels it makes black."""
    return QUERIES["otsu_binarize"](spark, sf_dir)
