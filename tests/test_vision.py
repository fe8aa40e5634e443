"""Operators on tiles and the detectors against whole-image brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerflow.operators import detectors, masks, tiles


def rows_of(images, names="value"):
    names = names.split()
    return [(k, x, y, *(int(im[y, x, c]) if im.ndim == 3 else float(im[y, x]) for c in range(len(names)))) for k, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]


def frame(spark, images, names="value"):
    kind = "int" if len(names.split()) > 1 else "double"
    return spark.createDataFrame(rows_of(images, names), "image int, x int, y int, " + ", ".join(f"{n} {kind}" for n in names.split())).repartition(3)


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.y, r.x])
        out[r.y, r.x] = r[name]
    return out


def brute_blur(a, size):
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    wide = np.pad(a.astype(float), size // 2, mode="reflect")
    return sum(k[i] * k[j] * wide[i : i + a.shape[0], j : j + a.shape[1]] for i in range(size) for j in range(size))


def brute_clean(m):
    h, w = m.shape
    wide = np.pad(m, 1, mode="edge")
    out = (sum(wide[i : i + h, j : j + w] for i in range(3) for j in range(3)) >= 5).astype(int)

    def step(a, how, fill):
        wide = np.pad(a, 1, constant_values=fill)
        return how.reduce([wide[1 : h + 1, 1 : w + 1], wide[:h, 1 : w + 1], wide[2:, 1 : w + 1], wide[1 : h + 1, :w], wide[1 : h + 1, 2:]])

    for how, fill in ((np.minimum, 1), (np.maximum, 0), (np.maximum, 0), (np.minimum, 1)):
        out = step(out, how, fill)
    return out


def brute_labels(m):
    """Pixel -> first pixel of its component, by flood fill."""
    out = {}
    for y, x in zip(*np.nonzero(m)):
        if (x, y) not in out:
            todo, first = [(x, y)], (int(y) << 32) + int(x)
            while todo:
                a, b = todo.pop()
                if (a, b) in out or not (0 <= a < m.shape[1] and 0 <= b < m.shape[0]) or not m[b, a]:
                    continue
                out[a, b] = first
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def smooth_image(seed, h, w):
    rng = np.random.default_rng(seed)
    im = rng.integers(40, 90, (h, w, 3))
    for _ in range(14):
        x, y, r = rng.integers(w), rng.integers(h), rng.integers(2, 5)
        ys, xs = np.mgrid[:h, :w]
        im[(xs - x) ** 2 + (ys - y) ** 2 <= r * r] = rng.integers(0, 256, 3)
    return im


@pytest.mark.parametrize("size", [7, 16, 100])
def test_filters_and_labels_over_tiles(spark, size):
    rng = np.random.default_rng(size)
    images = {k: (rng.random((31, 45)) < 0.45).astype(float) for k in (1, 2)}
    packed = tiles.pack(frame(spark, images), ["image"], ["value"], size)
    assert packed.count() == 2 * -(-31 // size) * -(-45 // size)
    clean = tiles.near(packed, ["image"], 1, tiles.CLEAN_REACH, tiles.cleaned, size)
    blur = tiles.near(packed, ["image"], 1, 3, tiles.gaussian(7), size)
    found = tiles.labelled(packed, ["image"], ["value"], size)
    for k, im in images.items():
        assert (back(tiles.unpack(clean, ["image"], ["m"]).where(f"image = {k}"), "m", im.shape) == brute_clean(im)).all()
        assert np.allclose(back(tiles.unpack(blur, ["image"], ["b"]).where(f"image = {k}"), "b", im.shape), brute_blur(im, 7), atol=1e-6)
        assert {(r.x, r.y): r.label for r in found.where(f"image = {k}").collect()} == brute_labels(im)


def test_an_object_over_four_tiles_is_one(spark):
    im = np.zeros((20, 20))
    im[7:11, 7:11] = 1
    im[0, :] = 1  # and a line over all tiles of a row
    found = tiles.labelled(tiles.pack(frame(spark, {1: im}), ["image"], ["value"], 4), ["image"], ["value"], 4)
    stats = {r.label: (r.area, r.x, r.y, r.w, r.h, r.cx, r.cy) for r in tiles.component_stats(found, ["image"]).collect()}
    assert stats == {(7 << 32) + 7: (16, 7, 7, 4, 4, 8.5, 8.5), 0: (20, 0, 0, 20, 1, 9.5, 0.0)}
    assert tiles.labelled(tiles.pack(frame(spark, {1: np.zeros((5, 5))}), ["image"], ["value"], 4), ["image"], ["value"], 4).count() == 0


def test_local_mean(spark):
    im = np.random.default_rng(3).integers(0, 256, (9, 14)).astype(float)
    for radius in (0, 2, 20):
        got = back(tiles.local_mean(frame(spark, {1: im}), ["image"], "value", radius), "mean", im.shape)
        want = [[im[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].mean() for x in range(14)] for y in range(9)]
        assert np.allclose(got, want)


def test_outlines():
    box = np.ones((4, 6), bool)
    ring = detectors.outline(box)
    assert len(ring) == 16 and detectors.ring_moments(ring)[0] == 15
    assert detectors.outline(np.ones((1, 1), bool)).tolist() == [[0, 0]]
    line = detectors.outline(np.ones((1, 4), bool))
    assert detectors.ring_moments(line)[0] == 0 and len(line) == 6
    plus = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
    assert detectors.ring_moments(detectors.outline(plus))[0] == 2
    rng = np.random.default_rng(1)
    for _ in range(60):  # enclosed area by Pick's theorem where the outline does not touch itself
        m = rng.random((8, 8)) < 0.6
        parts = masks.label(m, True)
        if not parts.any():
            continue
        one = parts == np.bincount(parts[parts > 0]).argmax()
        ys, xs = np.nonzero(one)
        one = one[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
        ring = [tuple(p) for p in detectors.outline(one)]
        assert set(ring) <= {(x, y) for y, x in zip(*np.nonzero(one))} and ring[0] == (int(np.flatnonzero(one[0])[0]), 0)
        steps = np.abs(np.diff(ring + ring[:1], axis=0)).max(axis=1)
        assert (steps <= 1).all()
        if len(set(ring)) == len(ring) > 2:
            outside = masks.label(np.pad(~one, 1, constant_values=True), False)
            filled = outside[1:-1, 1:-1] != outside[0, 0]
            assert detectors.ring_moments(np.array(ring))[0] == filled.sum() - len(ring) / 2 - 1


def brute_colours(im):
    b, g, r = (im[..., i].astype(int) for i in range(3))
    v, low = im.max(axis=2).astype(int), im.min(axis=2).astype(int)
    h, s = np.zeros_like(v), np.zeros_like(v)
    for i in np.ndindex(v.shape):
        d = v[i] - low[i]
        s[i] = (d * int(np.rint((255 << 12) / v[i])) + 2048) >> 12 if v[i] else 0
        raw = g[i] - b[i] if v[i] == r[i] else b[i] - r[i] + 2 * d if v[i] == g[i] else r[i] - g[i] + 4 * d
        h[i] = ((raw * int(np.rint((180 << 12) / (6.0 * d))) + 2048) >> 12) if d else 0
        h[i] += 180 * (h[i] < 0)
    return h, s, v, (b * 3735 + g * 19235 + r * 9798 + (1 << 14)) >> 15


def brute_equalised(a):
    h, w = a.shape
    ph, pw = (h, w) if h % 8 == 0 and w % 8 == 0 else (h + 8 - h % 8, w + 8 - w % 8)
    wide = np.pad(a, ((0, ph - h), (0, pw - w)), mode="reflect")
    fh, fw = ph // 8, pw // 8
    lut = np.zeros((8, 8, 256))
    for i in range(8):
        for j in range(8):
            hist = np.bincount(wide[i * fh : (i + 1) * fh, j * fw : (j + 1) * fw].ravel(), minlength=256)
            limit = max(int(2.0 * fh * fw / 256), 1)
            over = sum(max(0, c - limit) for c in hist)
            hist = [min(c, limit) + over // 256 for c in hist]
            left = over - over // 256 * 256
            k, step = 0, max(256 // left, 1) if left else 1
            while k < 256 and left > 0:
                hist[k] += 1
                k, left = k + step, left - 1
            lut[i, j] = np.clip(np.rint(np.cumsum(hist) * np.float32(255 / (fh * fw))), 0, 255)
    out = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            ty, tx = np.float32(y) * np.float32(1 / fh) - np.float32(0.5), np.float32(x) * np.float32(1 / fw) - np.float32(0.5)
            y1, x1 = int(np.floor(ty)), int(np.floor(tx))
            fy, fx = ty - y1, tx - x1
            y2, x2, y1, x1 = min(y1 + 1, 7), min(x1 + 1, 7), max(y1, 0), max(x1, 0)
            v = a[y, x]
            out[y, x] = np.rint((lut[y1, x1, v] * (1 - fx) + lut[y1, x2, v] * fx) * (1 - fy) + (lut[y2, x1, v] * (1 - fx) + lut[y2, x2, v] * fx) * fy)
    return out


def brute_candidates(mask, score, least, most, floor):
    labels = brute_labels(brute_clean(mask))
    out = []
    for first in set(labels.values()):
        px = np.array([p for p, v in labels.items() if v == first])
        x, y = px[:, 0], px[:, 1]
        w, h = np.ptp(x) + 1, np.ptp(y) + 1
        if not (least <= len(px) <= most and max(w / h, h / w) <= 4.5 and len(px) / (w * h) >= 0.16):
            continue
        one = np.zeros((h, w), bool)
        one[y - y.min(), x - x.min()] = True
        ring = detectors.outline(one)
        area, length = max(detectors.ring_moments(ring)[0], 1), max(np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum(), 1)
        compact, solid = 4 * np.pi * area / length**2, area / max(masks.hull_area(ring[:, 0], ring[:, 1]), 1)
        mixed = np.clip(0.82 * np.percentile([score[b, a] for a, b in px], 80) + 0.18 * np.clip(0.55 * compact + 0.45 * solid, 0, 1), 0, 1)
        if compact >= 0.08 and solid >= 0.22 and mixed >= floor:
            out.append((round(float(x.mean()), 5), round(float(y.mean()), 5), len(px), round(float(mixed), 5)))
    return sorted(out)


def told(df, image):
    return sorted((round(r.x, 5), round(r.y, 5), int(r.area), round(r.score, 5)) for r in df.where(f"image = {image}").collect())


def test_colour_and_contrast_detectors(spark):
    images = {1: smooth_image(1, 40, 56), 2: smooth_image(2, 40, 56)}
    df = frame(spark, images, "b g r").cache()
    h, s, v = detectors.hsv(F.col("b"), F.col("g"), F.col("r"))
    colours = df.select("image", "x", "y", h.alias("h"), s.alias("s"), v.alias("v"), detectors.gray(F.col("b"), F.col("g"), F.col("r")).alias("value")).cache()
    even = tiles.unpack(detectors.equalised(colours.select("image", "x", "y", "value"), ["image"], "value", 16), ["image"], ["value"])
    found_hsv, found_gray = detectors.detect_hsv(df, ["image"], 3, 400, 0.1, size=16), detectors.detect_gray(df, ["image"], (56, 40), 3, 400, 0.1, size=32)
    total = 0
    for k, im in images.items():
        bh, bs, bv, luma = brute_colours(im)
        for name, want in (("h", bh), ("s", bs), ("v", bv), ("value", luma)):
            assert (back(colours.where(f"image = {k}"), name, luma.shape) == want).all()
        eq = brute_equalised(luma)
        assert (back(even.where(f"image = {k}"), "value", luma.shape) == eq).all()
        st, vt = max(55.0, np.percentile(bs, 91)), max(45.0, np.percentile(bv, 38))
        hue = ((bh >= 14) & (bh <= 92)) | (bh <= 8) | (bh >= 165) | ((bh >= 95) & (bh <= 135))
        score = np.maximum(np.clip((bs - st) / max(255 - st, 1), 0, 1), np.clip((bv - vt) / max(255 - vt, 1), 0, 1) * 0.35)
        want = brute_candidates((hue & (bs >= st) & (bv >= vt)).astype(int), score, 3, 400, 0.1)
        assert told(found_hsv, k) == want
        total += len(want)
        response = np.abs(eq - np.rint(brute_blur(eq, 31)))
        rt = max(18.0, np.percentile(response, 99.3))
        score = np.clip((response - rt) / max(np.percentile(response, 99.9) - rt, 1), 0, 1)
        assert told(found_gray, k) == brute_candidates((response >= rt).astype(int), score, 3, 400, 0.5)
    assert total > 0


def test_lab():
    """Known colours in 8 bits: white, black, red, green, blue."""

    def lab(b, g, r):
        lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in (b, g, r)]
        b, g, r = lin
        x, y, z = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
        f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
        return (116 * y ** (1 / 3) - 16 if y > 0.008856 else 903.3 * y) * 2.55, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128

    assert np.allclose(lab(255, 255, 255), (255, 128, 128), atol=0.1) and np.allclose(lab(0, 0, 255), (136, 208, 195), atol=1)


def test_blobs(spark):
    im = np.full((48, 64, 3), 30)
    ys, xs = np.mgrid[:48, :64]
    for x, y, r, v in ((14, 12, 5, 230), (44, 30, 6, 250), (50, 10, 2, 240)):
        im[(xs - x) ** 2 + (ys - y) ** 2 <= r * r] = v
    df = frame(spark, {1: im}, "b g r")
    got = sorted((round(r.x), round(r.y)) for r in detectors.detect_blob(df, ["image"], 3, 400, 0.1, 4.0, size=16).collect())
    assert got == [(14, 12), (44, 30), (50, 10)]
    levels = spark.createDataFrame([(t, 10.0 + 0.1 * t, 5.0, 3.0, 1.0) for t in range(4)] + [(2, 30.0, 5.0, 3.0, 0.5)], "threshold int, mx double, my double, radius double, inertia double")
    assert [(round(r.x, 3), r.y, r.size, r.seen) for r in detectors.merge_blobs(levels, [], 2.0).collect()] == [(10.15, 5.0, 6.0, 4)]


def test_every_detector_gives_what_the_merge_takes(spark):
    from markerflow.operators import candidates

    df = frame(spark, {1: smooth_image(4, 32, 40)}, "b g r")
    found = detectors.detect(df, ["image"], ("hsv", "lab"), (40, 32), 3, 400, 0.1, 4.0, size=16)
    merged = candidates.merge_candidates(found, ["image"], 4.0).collect()
    assert merged and {m for r in found.collect() for m in [r.method]} <= {"hsv", "lab"}


def drawn(h, w, cols, rows, step, angle, cx, cy, over=6):
    ys, xs = np.mgrid[: h * over, : w * over]
    x, y = (xs + 0.5) / over - 0.5 - cx, (ys + 0.5) / over - 0.5 - cy
    c, n = np.cos(angle), np.sin(angle)
    u, v = (c * x + n * y) / step + (cols - 1) / 2, (c * y - n * x) / step + (rows - 1) / 2
    im = np.where((u >= -1) & (u <= cols) & (v >= -1) & (v <= rows), np.where((np.floor(u) + np.floor(v)) % 2 == 0, 30, 220), 128)
    return im.reshape(h, over, w, over).mean(axis=(1, 3))


@pytest.mark.parametrize("size", [16, 64])
def test_boards_are_found(spark, size):
    from markerflow.operators import corners

    places = {1: (11.0, 0.15, 55.3, 38.7), 2: (9.0, -0.7, 50.0, 40.2), 3: (12.0, 1.4, 52.0, 41.0)}
    images = {k: drawn(80, 104, 5, 4, *p) for k, p in places.items()} | {4: np.full((80, 104), 90.0), 5: drawn(80, 104, 3, 3, 10.0, 0.2, 50, 40)}
    got = {}
    for r in corners.find_boards(frame(spark, images), ["image"], 5, 4, size=size).collect():
        got.setdefault(r.image, {})[r.pos] = (r.x, r.y)
    assert set(got) == {1, 2, 3}
    for k, (step, angle, cx, cy) in places.items():
        c, n = np.cos(angle), np.sin(angle)
        want = np.array([[(cx + step * (c * u - n * v), cy + step * (n * u + c * v)) for u in np.arange(5) - 2] for v in np.arange(4) - 1.5])
        at = np.array([got[k][p] for p in range(20)])
        assert np.abs(at - corners.canonical(want).reshape(-1, 2)).max() < 0.1
