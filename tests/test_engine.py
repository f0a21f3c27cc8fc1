"""The engine's own operators: literal cases, brute force and the SQL twins on the smallest tables."""

from __future__ import annotations

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioframe.operators import pages as A
from folioframe.operators import pixels as P
from folioframe.operators import kernels as K
from folioframe.plans import catalog
from folioframe.sources import rasters as R
from folioframe.streaming import stats

SMALL = "/root/testdata/sf0.001"


def raster(spark, a: np.ndarray, name: str = "bw", img: int = 0):
    return spark.createDataFrame([(img, y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], f"img_id long, y int, x int, {name} int")


def array(df, name: str) -> np.ndarray:
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), int)
    for r in rows:
        out[r["y"], r["x"]] = r[name]
    return out


def spans(spark, profile: list[int], content: int, gap: int) -> list[tuple[int, int]]:
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(profile)], "img_id long, pos int, n long")
    return sorted((r["first"], r["last"] + 1) for r in P.content_spans(df, content, gap).collect())


def test_content_spans(spark):
    assert spans(spark, [0, 1, 0, 1, 1, 1, 0, 1, 1], 2, 1) == [(3, 6), (7, 9)]
    assert spans(spark, [0, 1, 0, 1, 1, 0, 0, 1, 1], 1, 2) == [(1, 5), (7, 9)]
    assert spans(spark, [0, 0], 1, 1) == []


def test_morphology_against_loops(spark):
    a = (np.random.default_rng(1).random((7, 9)) < 0.4).astype(int)
    pad = np.pad(a, 3)
    want = np.array([[max(pad[y + 3 - dy, x + 3 - dx] for dy in (-2, -1, 0, 1) for dx in (-1, 0, 1)) for x in range(9)] for y in range(7)])
    assert (array(P.dilate(raster(spark, a), (-1, 1), (-2, 1)), "bw") == want).all()
    want = np.array([[min(pad[y + 3 + dy, x + 3 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) for x in range(9)] for y in range(7)])
    assert (array(P.erode(raster(spark, a), (-1, 1), (-1, 1), P.WHITE), "bw") == want).all()


def test_rotation_and_upscale(spark):
    a = np.arange(6).reshape(2, 3)
    for degrees, turns in ((0, 0), (90, -1), (180, 2), (270, 1)):
        assert (array(P.rotate(raster(spark, a, "g"), degrees), "g") == np.rot90(a, turns)).all()
    with pytest.raises(ValueError):
        P.rotate(raster(spark, a, "g"), 45)
    assert (array(P.upscale(raster(spark, a, "g"), 2), "g") == a.repeat(2, 0).repeat(2, 1)).all()


def test_components_and_distances():
    r = np.random.default_rng(2)
    for diagonal in (False, True):
        a = (r.random((12, 11)) < 0.5).astype(int)
        got, seen, k = K.components(a, diagonal)[0], np.zeros_like(a), 0
        for y, x in zip(*np.nonzero(a), strict=True):
            if seen[y, x]:
                continue
            k += 1
            todo = [(y, x)]
            while todo:
                v, u = todo.pop()
                if 0 <= v < 12 and 0 <= u < 11 and a[v, u] and not seen[v, u]:
                    seen[v, u] = k
                    todo += [(v + dy, u + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if diagonal or not dy * dx]
        assert (got == seen).all()
    square = np.zeros((9, 9), int)
    square[2:7, 2:7] = 1
    assert K.distances(square)[4, 2:7].tolist() == [1, 4, 9, 4, 1]
    assert (K.distances(np.ones((2, 2), int)) == -1).all()


def test_packed_form(spark):
    a = np.random.default_rng(4).integers(0, 256, (5, 7))
    packed = R.to_packed(raster(spark, a, "g"))
    assert bytes(packed.first()["data"]) == a.astype(np.uint8).tobytes()
    assert (array(R.to_long(packed), "g") == a).all()


def test_paths_and_names(spark):
    paths = {"/a//b/./c": "/a/b/c", "a\\b\\..\\c": "a/c", "/..": None, "../x": None, "": "", "/a/..": "/"}
    rows = spark.createDataFrame([(k,) for k in paths], "p string").select("p", A.normalize_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == paths
    names = ["a_0002.png", "a_1.png", "a10_10.png", "a010_2.png", "b.png"]
    random.Random(1).shuffle(names)
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(A.natural_key(F.col("n"))).collect()]
    assert got == ["a010_2.png", "a10_10.png", "a_1.png", "a_0002.png", "b.png"]


def test_stream_equals_batch(spark):
    events = R.table(spark, SMALL, "events")
    source = stats.events_stream(spark, f"{SMALL}/event*.parquet", events.schema)
    query = stats.to_memory(stats.running(source), "running_stats")
    query.processAllAvailable()
    query.stop()
    key = lambda r: r["event_type"]
    assert sorted(spark.table("running_stats").collect(), key=key) == sorted(stats.running(events).collect(), key=key)
    windowed = stats.windowed(source)
    assert windowed.isStreaming and "window" in windowed.columns


def test_one_exchange_for_two_passes(spark):
    plan = P.dilate(R.bitmaps(R.tiles(spark, SMALL)), (-1, 1), (-1, 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    return float(f"{float(v):.9g}") if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLE[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
