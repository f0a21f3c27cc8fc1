"""Kernels and whole-page operators against brute force and planted pages."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from folioframe.operators import dewarp as D
from folioframe.operators import kernels as K
from folioframe.operators import scans as S


def shapes(seed: int, n: int = 30):
    r = np.random.default_rng(seed)
    for _ in range(n):
        h, w = r.integers(1, 13, 2)
        yield (r.random((h, w)) < r.choice([0.2, 0.5, 0.7])).astype(np.uint8), r.integers(0, 256, (h, w)).astype(np.uint8)


def around(h: int, w: int, diagonal: bool):
    steps = [(dy, dx) for dy, dx in itertools.product((-1, 0, 1), repeat=2) if (dy or dx) and (diagonal or not dy * dx)]
    return lambda y, x: [(y + dy, x + dx) for dy, dx in steps if 0 <= y + dy < h and 0 <= x + dx < w]


@pytest.mark.parametrize("diagonal", [False, True])
def test_reconstruction_is_the_least_fixpoint(diagonal):
    for bw, mask in shapes(1):
        marker = np.maximum(mask, np.random.default_rng(2).integers(0, 256, mask.shape).astype(np.uint8))
        at, near = marker.copy(), around(*mask.shape, diagonal)
        while True:
            new = np.array([[max(mask[y, x], min([at[y, x], *(at[p] for p in near(y, x))])) for x in range(at.shape[1])] for y in range(at.shape[0])], np.uint8)
            if (new == at).all():
                break
            at = new
        assert (K.reconstructed(marker, mask, diagonal) == at).all()


def test_distances_zones_and_borders():
    for bw, _ in shapes(3):
        h, w = bw.shape
        for white, border in itertools.product((True, False), repeat=2):
            to = [(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if (0 <= y < h and 0 <= x < w and (bw[y, x] == 0) == white) or (border and not (0 <= y < h and 0 <= x < w))]
            want = [[min(((y - a) ** 2 + (x - b) ** 2 for a, b in to), default=-1) for x in range(w)] for y in range(h)]
            assert (K.distances(bw, white, border) == np.array(want)).all()
        label, _ = K.components(bw)
        on = list(zip(*np.nonzero(label), strict=True))
        zone = [[min(((y - a) ** 2 + (x - b) ** 2, b, a, label[a, b]) for a, b in on)[3] if on else 0 for x in range(w)] for y in range(h)]
        assert (K.zones(label) == np.array(zone)).all()


def test_both_ways_to_the_nearest_pixel_agree():
    r = np.random.default_rng(11)
    for _ in range(60):
        h, w = r.integers(1, 90, 2)
        on = r.random((h, w)) < r.choice([0.0, 0.001, 0.02, 0.3])
        for scale in (1, 2):
            a, b = K.nearest(on, scale, 0), K.nearest(on, scale, 1000)
            assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_eroded_points_are_plateaus_without_a_higher_neighbour():
    for bw, _ in shapes(4):
        d = K.distances(np.pad(bw, 1))[1:-1, 1:-1]
        near, want = around(*bw.shape, True), np.zeros_like(bw)
        for y, x in zip(*np.nonzero(d > 0), strict=True):
            seen, todo, top = {(y, x)}, [(y, x)], True
            while todo:
                p = todo.pop()
                for q in near(*p):
                    top &= d[q] <= d[y, x]
                    if d[q] == d[y, x] and q not in seen:
                        seen.add(q)
                        todo.append(q)
            want[y, x] = top
        assert (K.eroded_points(bw) == want).all()


def test_reduction_of_odd_sizes_and_single_lines():
    a = np.array([[1, 0, 1], [0, 0, 1], [1, 1, 1]], np.uint8)
    assert [K.reduced(a, t).tolist() for t in (1, 2)] == [[[1]], [[0]]]
    assert K.reduced(np.ones((5, 5), np.uint8), 4).shape == (2, 2)
    assert K.reduced(np.ones((1, 4), np.uint8), 4).tolist() == [[1, 1]]
    assert K.reduced(np.array([[1], [0], [1]], np.uint8), 2).tolist() == [[1]] and K.reduced(np.array([[1, 0]], np.uint8), 3).tolist() == [[0]]


def test_hit_miss_and_smoothing():
    bump = np.zeros((7, 7), np.uint8)
    bump[3:, :] = 1
    bump[2, 3] = 1
    flat = bump.copy()
    flat[2, 3] = 0
    assert (K.smoothed(bump)[1:4, 1:6] == flat[1:4, 1:6]).all()
    nick = flat.copy()
    nick[3, 3] = 0
    assert K.smoothed(nick)[3, 3] == 1
    for k in range(4):
        assert (K.smoothed(np.rot90(bump, k))[3, 3] == np.rot90(flat, k)[3, 3]).all()


def text_page(h: int = 600, w: int = 480, angle: float = 0.0, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    page = np.full((h, w), 235, np.uint8)
    for top in range(60, h - 60, 20):
        for left in range(60, w - 70, 9):
            if r.random() < 0.85:
                y, x = np.mgrid[top : top + 10, left : left + 6]
                y = y + np.floor(np.tan(np.radians(angle)) * (x + 0.5 - w / 2) + 0.5).astype(int)
                page[np.clip(y, 0, h - 1), x] = 30
    return page


@pytest.mark.parametrize("angle", [-4.5, -1.1, 0.4, 2.3, 4.5])
def test_skew_of_text(angle):
    found, confidence = K.find_skew(S.black(text_page(angle=angle)))
    assert abs(found - angle) <= 0.15 and confidence >= 2.0


def test_no_skew_in_dots():
    dots = (np.random.default_rng(5).random((800, 1000)) < 0.18).astype(np.uint8)
    assert K.find_skew(dots, coarse=0, fine=0)[1] < 2.0 and K.find_skew(np.zeros((40, 40), np.uint8))[1] == 0.0


def test_despeckling_keeps_dots_beside_letters():
    a = np.zeros((120, 160), np.uint8)
    a[40:70, 20:26] = 1  # a letter
    a[34:37, 21:24] = 1  # its dot
    a[100:102, 130:132] = 1  # a speckle
    a[10:11, 80:81] = 1
    out = K.despeckled(a, 300, "normal")
    assert out[40:70, 20:26].all() and out[34:37, 21:24].all() and out.sum() == 180 + 9
    assert K.despeckled(a[:, 100:], 300).sum() == 0 and K.despeckled(np.zeros((3, 4), np.uint8)).sum() == 0
    chain = np.zeros((60, 200), np.uint8)
    chain[10:40, 10:14] = 1
    for k in range(5):
        chain[22:28, 30 + 20 * k : 36 + 20 * k] = 1  # each hangs on the one before
    assert (K.despeckled(chain, 300, "cautious") == chain).all()
    chain[:, 68:100] = 0
    assert K.despeckled(chain, 300, "aggressive").sum() < chain.sum()


def test_white_rectangles_are_empty_and_best_first():
    for bw, _ in shapes(6):
        h, w = bw.shape
        found = K.white_rectangles(bw, 3, rounds=100_000)
        areas = [(x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in found]
        assert areas == sorted(areas, reverse=True) and all(not bw[y0:y1, x0:x1].any() for x0, y0, x1, y1 in found)
        best = max(((x1 - x0) * (y1 - y0) for x0, x1 in itertools.combinations(range(w + 1), 2) for y0, y1 in itertools.combinations(range(h + 1), 2) if not bw[y0:y1, x0:x1].any()), default=0)
        assert (areas or [0])[0] == best
        for p, q in itertools.combinations(found, 2):
            assert p[2] <= q[0] or q[2] <= p[0] or p[3] <= q[1] or q[3] <= p[1]


def test_rectangles_cover_the_mask():
    a = np.zeros((100, 120), np.uint8)
    a[10:30, 10:40], a[12:28, 45:60], a[70:90, 90:110] = 1, 1, 1
    assert K.rectangles(a) == [(10, 10, 60, 30), (90, 70, 110, 90)]
    a[50, 20:22] = 1
    assert K.rectangles(a)[0] == (10, 10, 60, 30) and K.rectangles(np.zeros((4, 4), np.uint8)) == []


def test_line_finder():
    t = np.arange(0, 100, 2.0)
    level = np.column_stack([t, np.full_like(t, 40.0)])
    steep = np.column_stack([20 + 0.2 * t, t])
    noise = np.random.default_rng(7).uniform(0, 100, (20, 2))
    lines = K.line_finder(np.vstack([level, steep, noise]), 2, 20, 2.0, 0.02)
    assert len(lines) == 2 and min(abs(a - np.pi / 2) for a, _, _ in lines) < 0.05 and all(n >= 45 for _, _, n in lines)


def test_fold_lines_and_layouts():
    page = np.full((300, 400), 220, np.uint8)
    page[:, 199:202] = 60
    lines = K.fold_lines(page)
    assert len(lines) == 1 and abs(lines[0][0] - 200) < 8 and abs(lines[0][1] - 200) < 8
    assert K.page_layout_of(lines, 400, True)[0] == "two_pages" and K.page_layout_of(lines, 400, False) == ("single_uncut", [])
    assert K.fold_lines(np.full((300, 400), 220, np.uint8)) == [] and K.page_layout_of([], 400, True)[0] == "unknown"
    assert K.page_layout_of([(10.0, 12.0), (390.0, 391.0)], 400, False)[0] == "single_cut"


def test_boxes():
    surround = np.zeros((200, 160), np.uint8)
    surround[:12], surround[:, :9], surround[-20:] = 1, 1, 1
    assert K.page_box(surround) == (9, 12, 160, 180)
    page = text_page()
    x0, y0, x1, y1 = K.content_box(page)
    y, x = np.nonzero(page < 128)
    assert abs(x0 - x.min()) <= 2 and abs(y0 - y.min()) <= 2 and abs(x1 - x.max()) <= 2 and abs(y1 - y.max()) <= 2
    assert K.content_box(np.full((100, 100), 230, np.uint8)) is None


def test_pictures_and_backgrounds():
    page = text_page(500, 400)
    page[150:300, 100:300] = np.random.default_rng(8).choice([10, 245], (150, 200))
    found = K.pictures(page)
    assert found[170:280, 120:280].mean() < 48 < found[20:40, 20:380].mean()
    mask = K.content_mask(page, 300)
    assert not mask[170:280, 120:280].any() and mask[20:40, 20:380].all()
    shade = np.clip(235 - np.arange(400)[None, :] * 0.2 + np.zeros((500, 1)), 0, 255).astype(np.uint8)
    dark = np.where(text_page(500, 400) < 128, 30, shade).astype(np.uint8)
    back = K.background(dark).astype(int)
    assert np.abs(back - shade)[20:-20, 20:-20].mean() < 6
    even = K.lit(dark)
    assert even[dark > 128].mean() > 245 and even[dark < 128].mean() < 60


def test_polarity_ladder():
    page = text_page(200, 160)
    assert K.polarity(page)[0] == "black_on_white" and K.polarity(255 - page)[0] == "white_on_black"
    assert K.needs_inversion(255 - np.where(page < 128, 0, 255).astype(np.uint8)) and not K.needs_inversion(page)
    assert K.needs_inversion(page, "inverted") and not K.needs_inversion(255 - page, "normal")
    assert K.polarity_binary(S.black(page))[0] == "black_on_white" and K.polarity_binary(1 - S.black(page))[0] == "white_on_black"
    assert K.polarity(np.zeros((0, 0), np.uint8))[0] == "unknown"


def warped_page(bend: float = 18.0) -> tuple[np.ndarray, np.ndarray]:
    flat = text_page(500, 400, seed=3)
    shift = np.round(bend * np.sin(np.linspace(0, np.pi, 400))).astype(int)
    out = np.full_like(flat, 235)
    for x, s in enumerate(shift):
        out[s:, x] = flat[: 500 - s, x]
    return flat, out


def test_dewarping_straightens_lines():
    flat, bent = warped_page()
    model = D.model(bent)
    assert model is not None and D.valid(*model) and not D.valid(model[1], model[0])
    rows = lambda g: np.diff((g < 128).sum(axis=1).astype(int)).astype(float).std()
    straight = D.straightened(bent, *model, height=500)
    assert rows(straight) > 1.8 * rows(bent) and rows(straight) > 0.6 * rows(flat)
    assert D.model(np.full((60, 60), 230, np.uint8)) is None
    u, v = np.meshgrid(np.linspace(0.05, 0.95, 7), np.linspace(0.05, 0.95, 5))
    back = D.from_page(*model, *D.to_page(*model, u.ravel(), v.ravel()))
    assert np.allclose(back[0], u.ravel(), atol=1e-6) and np.allclose(back[1], v.ravel(), atol=1e-6)
    colour = np.stack([bent] * 3, axis=-1)
    assert (D.straightened(colour, *model)[..., 1] == D.straightened(bent, *model)).all()


def test_paths_bounds_and_splines():
    cost = np.full((9, 12), 9.0)
    path = [4, 4, 5, 6, 6, 5, 4, 3, 3, 2, 2, 3]
    cost[path, range(12)] = 0
    assert D.shortest_path(cost).tolist() == path
    assert D.toward_line(cost.T, (4, 0), 11) == [(x, y) for y, x in enumerate(path)]
    bw = np.zeros((100, 200), np.uint8)
    for y in range(100):
        bw[y, 20 + y // 10 : 180] = 1
    (a, b), (c, d) = D.vertical_bounds(bw)
    assert abs(a - 20) <= 3 and abs(b - 0.1) < 0.05 and abs(c - 179) <= 1 and abs(d) < 0.02
    t = np.linspace(0, 1, 60)
    curve = np.column_stack([100 * t, 10 * np.sin(6 * t)])
    fit = D.spline(D.fitted_spline(curve, 7), 60)
    assert max(D.closest(curve, *p)[1] for p in fit) < 0.5
    assert D.bends(curve) == 1 and D.bends(curve[:20]) == 0 and D.closest(np.array([[0.0, 0], [10, 0], [10, 10]]), 12, 5) == (1, 4.0)
    through = D.spline(curve[::10], 51)
    assert np.allclose(through[::10], curve[::10])
    assert D.half_corrected([(0, 1), (2, 5), (4, 2)], True) == [(0, 2), (2, 5), (4, 2)]
    assert [y for _, y in D.moved_points([(0, 0), (1, 0), (2, 0)], 2.0)] == [2.0, 1.0, 2.0]


def test_routes_layers_and_zones():
    page = text_page(200, 160)
    assert (S.routed(page, "as_is") == page).all() and set(np.unique(S.routed(page, "bw"))) <= {0, 255}
    mixed = S.layers(S.routed(page, "mixed"))
    assert ((mixed["foreground"] == 255) | (mixed["background"] == 255)).all()
    with pytest.raises(ValueError, match="no mode"):
        S.routed(page, "other")
    with pytest.raises(ValueError, match="no method"):
        K.binarized(page, "other")
    assert S.layer_set("mixed", True, False) == 31 and S.layer_set("bw", True, True) == 17 and S.layer_set("gray", False, True) == 16
    zones = [("eraser3", (0, 0, 4, 4)), ("painter2", (0, 0, 8, 8)), ("eraser1", (0, 0, 16, 16))]
    out, mask = S.zoned(np.full((20, 20), 255, np.uint8), np.zeros((20, 20), np.uint8), zones, [(90, (1, 1, 3, 3)), (200, (5, 5, 6, 6))])
    assert mask[:4, :4].all() and not mask[4:8, 4:8].any() and mask[8:16, 8:16].all() and not mask[16:].any()
    assert (out[1:3, 1:3] == 0).all() and out[5, 5] == 255


def test_pages_without_pixels(spark):
    rows = [(1, 0, 0, b""), (2, None, None, None), (3, 2, 2, bytes(4)), (4, 3, 3, b"short")]
    pages = spark.createDataFrame(rows, "img_id long, width int, height int, data binary")
    got = {r["img_id"]: r["n"] for r in S.figures(pages, lambda g: (int(g.size),), "n int").collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}
    assert {r["img_id"]: r["width"] for r in S.rasters(pages, lambda g: g.repeat(2, 1)).collect()} == {1: None, 2: None, 3: 4, 4: None}
    assert S.figures(pages.limit(0), lambda g: (1,), "n int").isEmpty()
