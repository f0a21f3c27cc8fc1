"""Whole-page queries of many small pages: CPU time a page, and the fast ways against the plain ones."""

from __future__ import annotations

import time

import numpy as np
import pytest

from folioframe.operators import dewarp as D
from folioframe.operators import kernels as K
from folioframe.operators import scans as S
from folioframe.plans import scan_queries
from folioframe.sources import rasters

WORDS = "a page of some words that goes on for several lines, and is rendered as a scan; it's no longer than most: ".split()


def pages(n: int = 12) -> list[np.ndarray]:
    r = np.random.default_rng(5)
    out = []
    for k in range(n):
        w, h, data = rasters._rendered(k, " ".join(r.choice(WORDS, 450)))
        out.append(np.frombuffer(data, np.uint8).reshape(h, w))
    return out


# Milliseconds of CPU a page of about 28,000 pixels: some times what a query takes, a fraction of what it took before.
LIMITS = {
    "background": 12,
    "lit": 12,
    "output_gray": 12,
    "despeckled_normal": 12,
    "despeckled_cautious": 12,
    "despeckled_aggressive": 12,
    "output_bw": 25,
    "content_box": 14,
    "output_mixed": 30,
    "layers": 30,
    "text_lines": 25,
    "dewarp_model": 50,
    "dewarped": 50,
}


@pytest.mark.parametrize("name", LIMITS)
def test_time_a_page(name, monkeypatch):
    kept = {}
    monkeypatch.setattr(scan_queries.R, "scans", lambda spark, d: None)
    monkeypatch.setattr(scan_queries.S, "figures", lambda scans, f, columns, many=False, before=None: kept.update(f=f, before=before))
    scan_queries.QUERIES[f"page_{name}"](None, "")
    some = pages()
    kept["f"]((kept["before"] or list)(some[:1])[0])
    began = time.process_time()
    for g in (kept["before"] or list)(some):
        kept["f"](g)
    assert (time.process_time() - began) / len(some) * 1000 < LIMITS[name]


def test_lines_are_fitted_at_once_as_one_by_one():
    r = np.random.default_rng(6)
    for n, degree in ((1, 2), (3, 4), (7, 2), (60, 4), (61, 2)):
        lines = r.integers(0, 256, (40, n)).astype(np.uint8)
        on = r.random((40, n)) < r.choice([0.0, 0.2, 0.7, 0.95, 1.0], (40, 1))
        for line, s, fit in zip(lines, on, K.fitted_lines(lines, on, degree), strict=True):
            assert np.allclose(fit, K.fitted_line(line.astype(float), s, degree), atol=1e-6)


def test_surface_is_least_squares_over_the_mask():
    r = np.random.default_rng(7)
    y, x = np.mgrid[:50, :70]
    g = np.clip(200 - 0.01 * (x - 30) ** 2 - 0.4 * y + r.normal(0, 3, x.shape), 0, 255).astype(np.uint8)
    on = r.random(g.shape) < 0.6
    a = (np.vander(np.linspace(-1, 1, 50), 6, increasing=True)[y[on]][:, :, None] * np.vander(np.linspace(-1, 1, 70), 6, increasing=True)[x[on]][:, None, :]).reshape(on.sum(), -1)
    c = np.linalg.solve(a.T @ a + 1e-6 * on.sum() * np.eye(36), a.T @ g[on].astype(float))
    assert (K.surface(g, on, 5, 5)[on].astype(int) - np.floor(a @ c + 0.5).astype(int) == 0).mean() > 0.999


def test_nearest_pixels_of_wide_and_sparse_images():
    r = np.random.default_rng(12)
    for h, w, share in ((40, 700, 0.01), (200, 400, 0.0005), (60, 300, 0.3), (3, 1500, 0.002), (300, 120, 0.01), (1200, 3, 0.002)):
        on = r.random((h, w)) < share
        on[h // 2, w // 3] = True
        on[:, : w // 5] = False
        for scale in (1, 2):
            (d, at), rows = K.nearest(on, scale), np.arange(h)[:, None]
            y, x = np.divmod(at, w)
            assert on[y, x].all() and (d == (x - np.arange(w)) ** 2 + (scale * (y - rows)) ** 2).all()
            d1, at1 = K.nearest(on, scale, 100000)
            assert (d == d1).all() and (at == at1).all()


def test_chains_of_any_length_are_followed():
    on = np.arange(500)
    assert K._reached(on, on + 1, 501).all()
    assert K._reached(on[1:], on[1:] + 1, 501).tolist() == [True] + [False] * 500
    dots = np.zeros((9, 400), np.uint8)
    dots[:, :30] = 1
    dots[4, 33::4] = 1
    assert (K.despeckled(dots, 300, "cautious") == dots).all() and K.despeckled(dots[:, 31:], 300, "cautious").sum() == 0


def test_smoothing_is_hit_miss_in_all_directions():
    r = np.random.default_rng(13)
    for h, w in ((1, 1), (1, 30), (30, 1), (40, 23), (33, 64), (9, 120)):
        bw = (K.local_mean((r.random((h, w)) < 0.5).astype(np.uint8), 5)[0] > 0.5).astype(np.uint8)
        bw[r.random((h, w)) < 0.05] ^= 1
        want = bw
        for pattern in K.SMOOTHING:
            for _ in range(4):
                want = K.hit_miss(want, pattern)
                pattern = ["".join(row[k] for row in reversed(pattern)) for k in range(len(pattern[0]))]
        assert (K.smoothed(bw) == want).all()


def test_pages_without_pictures_are_told_without_their_pictures(monkeypatch):
    r = np.random.default_rng(14)
    some = pages(4)
    for g in pages(4):
        g = g.copy()
        g[20:80, 20:90] = r.integers(90, 160, (60, 70))
        some.append(g)
    some += [np.full((30, 40), 200, np.uint8), r.integers(0, 256, (25, 31)).astype(np.uint8), np.zeros((1, 1), np.uint8)]
    fast = [K.content_mask(g, dpi) for g in some for dpi in (75, 100)]
    told = [K._without_pictures(g, 100) for g in some]
    assert all(told[:4]) and not any(told[4:8])
    monkeypatch.setattr(K, "_without_pictures", lambda g, dpi: False)
    assert all((a == b).all() for a, b in zip(fast, [K.content_mask(g, dpi) for g in some for dpi in (75, 100)], strict=True))


def test_snakes_of_many_curves_move_as_alone():
    r = np.random.default_rng(15)
    blur = K.local_mean(r.integers(0, 256, (60, 90)).astype(np.uint8), 5)[0]
    curves = [np.column_stack([np.sort(r.choice(90, n, replace=False)), r.uniform(0, 59, n)]) for n in (1, 2, 40, 7, 40)]
    for c, got in zip(curves, D.snakes([blur], curves, np.zeros(5, int)), strict=True):
        assert (got == D.snake(blur, c)).all()
        h, y = 60, c[:, 1]
        for _ in range(8):  # all ways, point by point
            place = np.clip(y[:, None] + np.array([-1.0, 0.0, 1.0]), 0, h - 1)
            cost = blur[np.round(place).astype(int), c[:, 0].astype(int)[:, None]]
            bend, total, back = np.append(0.0, np.diff(y)), cost[0], []
            for i in range(1, len(y)):
                pair = total[:, None] + 2.0 * (place[i][None, :] - place[i - 1][:, None] - bend[i]) ** 2
                back.append(pair.argmin(axis=0))
                total = pair.min(axis=0) + cost[i]
            path = [int(total.argmin())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            y = place[np.arange(len(y)), path[::-1]]
        assert (got[:, 1] == y).all()


def test_residuals_are_mean_distances_from_lines():
    r = np.random.default_rng(16)
    curves = [np.column_stack([np.arange(n) * 3.0, r.uniform(30, 60, n)]) for n in (1, 2, 20, 33)]
    top, bottom = r.uniform(0, 5, 100), r.uniform(70, 90, 100)
    want = []
    for c in curves:
        x = c[:, 0].astype(int)
        v = (c[:, 1] - top[x]) / (bottom[x] - top[x]) * (bottom - top).mean()
        line = np.polyval(np.polyfit(c[:, 0], v, 1), c[:, 0]) if len(c) > 1 else v
        want.append(np.abs(v - line).mean())
    assert np.allclose(D.residuals(curves, [(top, bottom), (bottom, top)]), [np.mean(want), 1000.0])


def test_lines_of_several_pages_are_those_of_each():
    some = [*pages(5), np.full((20, 30), 230, np.uint8), np.zeros((1, 1), np.uint8), np.full((400, 300), 9, np.uint8)]
    for g, curves in zip(some, D.text_lines_of(some), strict=True):
        alone = D.text_lines(g)
        assert len(alone) == len(curves) and all((a == b).all() for a, b in zip(alone, curves, strict=True))
    run = S.together(lambda pages: [p.shape for p in pages], 3)
    assert list(run(iter([some[0], None, some[5], some[6], None]))) == [some[0].shape, None, (20, 30), (1, 1), None] and list(run(iter([]))) == []


def test_curves_of_dewarping_are_fitted_together(monkeypatch):
    r = np.random.default_rng(17)
    curves = [np.column_stack([np.sort(r.choice(w, n, replace=False)), r.uniform(0, 59, n)]) for w, n in ((120, 1), (120, 3), (120, 4), (120, 33), (90, 63), (120, 60))]
    widths = [120, 120, 120, 120, 90, 120]
    for c, w, got in zip(curves, widths, D.fitted_all(curves, widths), strict=True):
        assert np.allclose(got, D.fitted(c, w), rtol=1e-9, atol=1e-9)
    some = [*pages(4), np.full((20, 30), 230, np.uint8)]
    lines = D.text_lines_of(some)
    for g, c, got in zip(some, lines, D.models(some, lines), strict=True):
        alone = D.model(g, curves=c)
        assert (got is None) == (alone is None) and (got is None or all(np.allclose(a, b, atol=1e-9) for a, b in zip(got, alone, strict=True)))
    found = [D.model(g) is not None for g in some]
    calls = []
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a: calls.append(1))
    assert [m is not None for _, _, m in scan_queries.with_models(some)] == found and any(found) and not calls


def test_window_sums_of_gray_are_those_of_any_numbers():
    r = np.random.default_rng(18)
    for h, w, size in ((1, 1, 5), (1, 40, 31), (33, 2, 6), (70, 50, 31), (9, 9, 256), (20, 30, 1)):
        g = r.integers(0, 256, (h, w)).astype(np.uint8)
        for a, b in zip(K.local_mean(g, size), K.local_mean(g.astype(np.int64), size), strict=True):
            assert (a == b).all()
        assert (K.mean_only(g, size) == K.local_mean(g.astype(np.int64), size)[0]).all()


def test_layers_of_pages_without_pictures_stay_bytes():
    for g in (*pages(3), np.full((30, 40), 200, np.uint8)):
        got = S.layers(S.routed(g, "mixed", dpi=100))
        assert {k: v.dtype.name for k, v in got.items()} == dict.fromkeys(got, "uint8")
        mask, bw = K.content_mask(g, 100), S.routed(g, "bw", dpi=100)
        assert mask.all() and (S.routed(g, "mixed", dpi=100) == np.where(mask > 0, bw, np.clip(K.lit(g), 1, 254))).all()


@pytest.mark.parametrize("name", ["lit", "output_gray"])
def test_pages_are_drawn_where_they_are_used(name, spark):
    docs = "/root/testdata/sf0.001"
    pages = scan_queries.QUERIES[f"page_{name}"](spark, docs)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    f = {"lit": K.lit, "output_gray": lambda g: S.routed(g, "gray", dpi=100)}[name]
    stored = S.figures(rasters.scans(spark, docs).select("*"), scan_queries.total(f), scan_queries.SUM)  # by way of rows
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, stored.collect()))
