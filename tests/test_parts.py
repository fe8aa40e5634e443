"""Components as parts of tiles: labels, sums and shapes against whole images, with batches that cut tiles and components."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from markerflow.operators import detectors, masks, tiles
from markerflow.plans import vision

from .test_vision import brute_labels, frame


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield spark
    spark.conf.set(name, before)


def images():
    rng = np.random.default_rng(5)
    out = {k: np.floor(rng.random((19, 23)) * 100) for k in (1, 2, 3)}
    out[2][8:, 8:] = 0  # tiles without a piece
    corners = np.zeros((19, 23))
    corners[7, 7] = corners[8, 8] = corners[8, 15] = corners[7, 16] = 99  # tied over a tile's corner alone, either way
    return out | {4: corners}


def test_parts_of_levels_are_the_components_of_each(small_batches):
    levels, ims = [30, 60, 80], images()
    packed = tiles.pack(frame(small_batches, ims), ["image"], ["value"], 8)
    parts = detectors.threshold_parts(packed, ["image"], levels, 8).cache()
    got = {}
    for r in parts.collect():
        ys, xs = np.nonzero(tiles.mask_of(r.bits, r.w, r.h))
        assert (len(xs), xs.sum() + r.area * r.x, ys.sum() + r.area * r.y) == (r.area, r.sx, r.sy) and np.ptp(xs) + 1 == r.w and np.ptp(ys) + 1 == r.h
        assert r.x // 8 == (r.x + r.w - 1) // 8 and r.y // 8 == (r.y + r.h - 1) // 8
        for x, y in zip(xs, ys):
            assert got.setdefault((r.image, r.threshold), {}).setdefault((r.x + x, r.y + y), r.label) == r.label
    assert got == {(k, t): want for k, im in ims.items() for t in levels if (want := brute_labels(im > t))}
    assert parts.count() < sum(len(v) for v in got.values()) / 2
    stats = {(r.image, r.threshold, r.label): r.area for r in tiles.part_stats(parts, ["image", "threshold"]).collect()}
    assert stats == {(*k, label): sum(v == label for v in want.values()) for k, want in got.items() for label in set(want.values())}


def test_a_component_has_one_shape_after_a_join(small_batches):
    """Its parts come from several tasks, through a join by the keys by which they are then dealt."""
    ims = images()
    parts = detectors.pinned(detectors.threshold_parts(tiles.pack(frame(small_batches, ims), ["image"], ["value"], 8).repartition(5), ["image"], [60], 8))
    able = tiles.part_stats(parts, ["image", "threshold"]).where("area > 1").select("image", "threshold", "label")
    rows = detectors.shapes(parts.join(able, ["image", "threshold", "label"], "left_semi"), ["image", "threshold"]).collect()
    found = {(r.image, r.label): r for r in rows}
    assert len(found) == len(rows) == able.count()
    for k, im in ims.items():
        labels = brute_labels(im > 60)
        for first in {v for v in labels.values() if list(labels.values()).count(v) > 1}:
            x, y = np.array([p for p, v in labels.items() if v == first]).T
            one = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), bool)
            one[y - y.min(), x - x.min()] = True
            ring = detectors.outline(one)
            length, hull = np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum(), masks.hull_area(ring[:, 0], ring[:, 1])
            got = found[k, first]
            assert np.allclose((got.ring_area, got.perimeter, got.hull), (detectors.ring_moments(ring)[0], max(length, 1), max(hull, 1)))
            assert np.isclose(got.radius, np.median(np.hypot(ring[:, 0] + x.min() - got.mx, ring[:, 1] + y.min() - got.my)))


def test_pixels_of_parts_keep_their_other_channels(small_batches):
    im = images()[1]
    pixels = frame(small_batches, {1: im}).withColumns({"mask": (F.col("value") > 40).cast("double"), "score": F.col("value") / 4})
    found = tiles.labelled(tiles.pack(pixels, ["image"], ["mask", "score"], 8), ["image"], ["mask", "score"], 8).collect()
    assert {(r.x, r.y): r.label for r in found} == brute_labels(im > 40) and all(r.score == im[r.y, r.x] / 4 for r in found)


def test_rows_of_a_key_are_handed_on_as_soon_as_it_ends():
    taken = []

    def frames():
        for k in ([0, 0, 1], [1, 1], [], [1, 2], [3], [3, 3]):
            taken.append(k)
            yield pd.DataFrame({"k": k, "n": range(len(k))})

    got = [(rows.k.tolist(), starts.tolist(), len(taken)) for rows, starts in tiles.whole(frames(), ["k"])]
    assert got == [([0, 0], [0], 1), ([1, 1, 1, 1], [0], 4), ([2], [0], 5), ([3, 3, 3], [0], 6)]


def test_pixels_are_packed_and_cut_in_one_worker(small_batches, monkeypatch):
    """Passes of Python that are frames of their own have a worker each in every task."""
    seen = []
    monkeypatch.setattr(tiles, "pinned", lambda df: seen.append(df) or df)
    vision.m11_threshold_components(small_batches, "/root/testdata/sf0.001")
    vision.m11_components(small_batches, "/root/testdata/sf0.001")
    passes = [df._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") for df in seen]
    assert passes == [1, 2]  # the second shuffles the tiles' strips in between


def test_passes_in_one_worker_give_what_they_give_apart(small_batches):
    pixels = frame(small_batches, images())
    apart, joined = tiles.pack(pixels, ["image"], ["value"], 8), tiles.packing(pixels, ["image"], ["value"], 8)
    blur = tiles.gaussian(7)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(detectors.threshold_parts(joined, ["image"], [30, 60], 8)) == rows(detectors.threshold_parts(apart, ["image"], [30, 60], 8))
    near = tiles.near(apart, ["image"], 1, 3, blur, 8)
    assert rows(tiles.unpack(tiles.nearing(joined, ["image"], 1, 3, blur, 8), ["image"], ["v"])) == rows(tiles.unpack(near, ["image"], ["v"]))


def test_some_rows_at_a_time():
    frames = [pd.DataFrame({"n": range(a, b)}) for a, b in ((0, 2), (2, 2), (2, 3), (3, 11), (11, 12))]
    assert [some.n.tolist() for some in tiles._some(iter(frames), 3)] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    assert [some.n.tolist() for some in tiles._some(iter(frames), 5)] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]]
    assert list(tiles._some(iter(frames[1:2]), 3)) == []
