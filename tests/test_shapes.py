"""Resampling, filters and shapes against direct computations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folioframe.operators import resampling as S
from folioframe.operators import shapes as H
from test_engine import array, raster


def test_scale_keeps_flat_images_and_means(spark):
    assert (array(S.scale(raster(spark, np.full((5, 7), 93), "g"), 3, 11), "g") == 93).all()
    a = np.random.default_rng(1).integers(0, 256, (6, 8))
    assert (array(S.scale(raster(spark, a, "g"), 4, 3), "g") == np.floor(a.reshape(3, 2, 4, 2).mean(axis=(1, 3)) + 0.5)).all()


def test_affine_identity_shift_and_outside(spark):
    a = np.random.default_rng(2).integers(0, 256, (5, 6))
    df = raster(spark, a, "g")
    assert (array(S.affine(df, (1, 0, 0, 0, 1, 0), 6, 5, 0, unit=1), "g") == a).all()
    moved = array(S.affine(df, (1, 0, -2, 0, 1, 0), 6, 5, 77, unit=1), "g")
    assert (moved[:, 2:] == a[:, :-2]).all() and (moved[:, :2] == 77).all()
    half = array(S.affine(df, (1, 0, -0.5, 0, 1, 0), 6, 5, 0, weak=True, unit=1), "g")
    assert (half[:, 0] == a[:, 0]).all()


def test_smoothing_keeps_polynomials():
    t = np.arange(9.0)
    assert np.allclose(S.smoothing_matrix(9, 5, 2) @ (3 * t**2 - t + 4), 3 * t**2 - t + 4)
    assert S.smoothing_matrix(2, 5, 4).shape == (2, 2)


def test_gauss_is_close_to_the_gaussian():
    m = S.gauss_matrix(41, 3.0)
    want = np.exp(-((np.arange(41) - 20) ** 2) / 18) / (3 * np.sqrt(2 * np.pi))
    assert abs(m[20] - want).max() < 1e-3 and abs(m.sum(axis=1) - 1).max() < 1e-3
    assert (S.gauss_matrix(4, 0) == np.eye(4)).all()


def test_surface_against_least_squares(spark):
    a = np.random.default_rng(3).integers(0, 256, (6, 7))
    y, x = np.indices(a.shape)
    u, v = (2 * x + 1) / 7 - 1, (2 * y + 1) / 6 - 1
    m = np.stack([(u**i * v**j).ravel() for j in range(4) for i in range(3)], -1)
    want = m @ np.linalg.lstsq(m, a.ravel(), rcond=None)[0]
    got = {(r["y"], r["x"]): r["fit"] for r in S.surface(raster(spark, a, "g"), 2, 3).collect()}
    assert np.allclose([got[k] for k in np.ndindex(a.shape)], want, atol=1e-4)


def test_dither_keeps_the_mean(spark):
    a = np.full((16, 16), 100)
    out = array(S.dither(raster(spark, a, "g"), [0, 255]), "g")
    assert set(np.unique(out)) == {0, 255} and abs(out.mean() - 100) < 10
    assert (array(S.dither(raster(spark, a, "g"), [0, 255], 0.0), "g") == 0).all()


def test_polygon_rules_differ_where_the_outline_winds_twice(spark):
    star = [(4.0, 0.0), (7.0, 9.0), (0.0, 3.0), (8.0, 3.0), (1.0, 9.0)]
    polygon = spark.createDataFrame([(0, [p[0] for p in star], [p[1] for p in star])], "img_id long, px array<double>, py array<double>")
    blank = raster(spark, np.zeros((9, 9), int))
    odd, winding = (array(S.polygon_mask(blank, polygon, w), "inside") for w in (False, True))
    assert odd[5, 4] == 0 and winding[5, 4] == 1 and (winding >= odd).all()


def test_shapes(spark):
    rows = [
        (1, [0, 4, 4, 0], [0, 0, 4, 4], "square", 1.0),
        (2, [0, 8, 8, 0], [0, 0, 4, 4], "rectangle", 1.0),
        (3, [0, 8, 0], [0, 0, 6], "polygon", 1.0),
        (4, [0, 4, 8], [0, 0, 0], "irregular", 0.0),
        (5, [0, 8, 8, 1, 0], [0, 0, 1, 1, 8], "irregular", 11.5 / 36),
        (6, [3, 6, 3, 0], [0, 3, 6, 3], "square", 1.0),
        (7, [], [], "irregular", 0.0),
    ]
    df = spark.createDataFrame([(i, list(map(float, x)), list(map(float, y))) for i, x, y, _, _ in rows], "id long, px array<double>, py array<double>")
    got = {r["id"]: r for r in H.shapes(df, 0.1).collect()}
    assert [got[r[0]]["shape"] for r in rows] == [r[3] for r in rows]
    assert np.allclose([got[r[0]]["convexity"] for r in rows], [r[4] for r in rows], atol=1e-6)
    assert [got[i]["corners"] for i in (1, 2, 3)] == [4, 4, 3]


def test_hull_against_all_points():
    r = np.random.default_rng(4)
    for _ in range(50):
        p = r.integers(0, 6, (8, 2))
        h = H.hull_points(p)
        q = np.roll(h, -1, axis=0)
        for (ax, ay), (bx, by) in zip(h, q, strict=True):
            assert ((bx - ax) * (p[:, 1] - ay) >= (by - ay) * (p[:, 0] - ax)).all()


def test_simplification_stays_within_the_tolerance():
    t = np.linspace(0, 6, 60)
    p = np.stack([t, np.sin(t)], -1)
    s = H.simplified(p, 0.05)
    assert 2 < len(s) < 30 and abs(np.interp(t, s[:, 0], s[:, 1]) - p[:, 1]).max() < 0.08


def test_homography_maps_corners_and_centre(spark):
    quads = spark.createDataFrame([(1, [0.0, 0.0, 4.0, 0.0, 3.0, 3.0, 1.0, 3.0]), (2, [0.0] * 8)], "id long, q array<double>")
    m = H.homographies(quads)
    x, y = H.mapped(F.col("m"), F.lit(1.0), F.lit(1.0))
    got = {r["id"]: (r["x"], r["y"]) for r in m.select("id", x.alias("x"), y.alias("y")).collect()}
    assert np.allclose(got[1], (3, 3)) and got[2] == (None, None)
    u, v = H.mapped(F.col("m"), F.lit(0.5), F.lit(0.5))
    centre = m.where("id = 1").select(u.alias("u"), v.alias("v")).first()
    assert np.allclose([centre["u"], centre["v"]], [2, 2])


def test_black_image_has_no_white_rectangle(spark):
    assert H.white_rectangle(raster(spark, np.ones((3, 3), int))).count() == 0
