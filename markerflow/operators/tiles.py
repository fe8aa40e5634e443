"""Images as tiles, one row each, so that no task and no row holds a frame: local filters with halos, running sums, and connected components over
tiles.

A tile is (by, tx, ty, x, y, w, h, data): its place in the frame and its channels as 32-bit floats. A filter that looks `reach` pixels far gets
from each neighbour the strip that it needs; tiles meet their strips by the tile's number, nine at most. Frames are full rectangles from (0, 0);
a pixel that is not given reads as 0, a repeated one as its largest value.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .idioms import pinned
from .masks import label

SIZE = 64
_TILE = ("tx", "ty", "x", "y", "w", "h", "data")
_HELD = 128  # tiles that are worked on at once


class Pending(NamedTuple):
    """Tiles still to be made of rows, by passes of Python one after the other. Passes that follow without a shuffle between them are done in one worker a
    task; as frames of their own, each would have its worker in every task, with all that a worker imports."""

    rows: DataFrame
    passes: tuple[Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], ...] = ()
    types: str = ""

    def then(self, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], types: str) -> Pending:
        return Pending(self.rows, (*self.passes, run), types)

    def frame(self) -> DataFrame:
        passes = self.passes

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for one in passes:
                frames = one(frames)
            return frames

        return self.rows.mapInPandas(run, self.types) if passes else self.rows


def _pending(tiles: DataFrame | Pending) -> Pending:
    return tiles if isinstance(tiles, Pending) else Pending(tiles)


def _some(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Rows n at a time, whatever frames they come in."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        held.append(pdf)
        if sum(map(len, held)) >= n:
            rows = pd.concat(held, ignore_index=True)
            full = len(rows) // n * n
            yield from (rows.iloc[i : i + n] for i in range(0, full, n))
            held = [rows.iloc[full:].copy()]
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _keys(df: DataFrame, by: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{n}` {types[n]}, " for n in by)


def _array(data, channels: int, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(channels, h, w)


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a key in one task, one key after the other. They are dealt by a hash of their own: after a join by the same keys Spark would leave the
    exchange out, and, where that join then becomes a broadcast, read the rows where they lie, a key in several tasks."""
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys) if keys else rows.coalesce(1)


def whole(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that lie together by their keys, cut where a key ends, and where each key starts among them. One key is held beyond its batch."""

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        other = np.zeros(len(pdf), bool)
        other[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            other[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(other)

    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        last = starts(pdf)[-1]
        if last or held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            if held or last:
                rows = pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
                yield rows, starts(rows)
            held = []
        held.append(pdf.iloc[last:])
    if held:
        rows = pd.concat(held, ignore_index=True)
        yield rows, starts(rows)


def pack(pixels: DataFrame, by: list[str], channels: list[str], size: int = SIZE) -> DataFrame:
    """Tiles of pixels (by, x, y, channels)."""
    return packing(pixels, by, channels, size).frame()


def packing(pixels: DataFrame, by: list[str], channels: list[str], size: int = SIZE) -> Pending:
    """What pack gives, for near, parts and unpack to go on with."""
    rows = pixels.select(*by, "x", "y", F.floor(F.col("x") / size).cast("int").alias("tx"), F.floor(F.col("y") / size).cast("int").alias("ty"), *[F.col(c).cast("double").alias(c) for c in channels])
    frame = pixels.groupBy(*by).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole(frames, keys):
            first = pdf.iloc[starts]
            tx, ty = first["tx"].to_numpy(), first["ty"].to_numpy()
            w, h = np.minimum(size, first["_w"].to_numpy() - tx * size), np.minimum(size, first["_h"].to_numpy() - ty * size)
            area = (w * h).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(area)])
            tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
            at = begin[tile] + (pdf["y"].to_numpy() - ty[tile] * size).astype(np.int64) * w[tile] + pdf["x"].to_numpy() - tx[tile] * size
            data = np.full((len(channels), begin[-1]), -np.inf, np.float32)
            for i, c in enumerate(channels):
                np.maximum.at(data[i], at, pdf[c].fillna(0).to_numpy(np.float32))
            data[np.isneginf(data)] = 0
            packed = [np.ascontiguousarray(data[:, i:j]).tobytes() for i, j in itertools.pairwise(begin)]
            yield pd.DataFrame({**{n: first[n].to_numpy() for n in by}, "tx": tx, "ty": ty, "x": tx * size, "y": ty * size, "w": w, "h": h, "data": packed})

    keys = [*by, "tx", "ty"]
    joined = rows.join(frame, by) if by else rows.crossJoin(F.broadcast(frame))  # one row
    return Pending(together(joined, keys)).then(run, _keys(pixels, by) + "tx int, ty int, x int, y int, w int, h int, data binary")


def unpack(tiles: DataFrame | Pending, by: list[str], channels: list[str], positive: bool = False) -> DataFrame:
    """Pixels (by, x, y, channels) of tiles; with positive only those whose first channel is above 0, so that no others become rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _some(frames, _HELD):
            arrays = [_array(d, len(channels), h, w) for d, h, w in zip(some["data"], some["h"], some["w"])]
            kept = [a[0] > 0 if positive else np.ones(a.shape[1:], bool) for a in arrays]
            ys, xs = (np.concatenate(n) for n in zip(*(np.nonzero(k) for k in kept)))
            tile = np.repeat(np.arange(len(some)), [int(k.sum()) for k in kept])
            out = {**{n: some[n].to_numpy()[tile] for n in by}, "x": xs + some["x"].to_numpy()[tile], "y": ys + some["y"].to_numpy()[tile]}
            yield pd.DataFrame({**out, **{c: np.concatenate([a[j][k] for a, k in zip(arrays, kept)]).astype(float) for j, c in enumerate(channels)}})

    made = _pending(tiles)
    return made.then(run, _keys(made.rows, by) + "x int, y int, " + ", ".join(f"`{c}` double" for c in channels)).frame()


def each(tiles: DataFrame, by: list[str], channels: int, change: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Tiles with other channels: change gets a tile's array and its row (all its columns), and returns an array of the same height and width."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = pdf.to_dict("records")
            out = [change(_array(r["data"], channels, r["h"], r["w"]), r).astype(np.float32).tobytes() for r in rows]
            yield pdf[[*by, *_TILE[:-1]]].assign(data=out)

    return tiles.mapInPandas(run, _keys(tiles, by) + "tx int, ty int, x int, y int, w int, h int, data binary")


def near(tiles: DataFrame | Pending, by: list[str], channels: int, reach: int, change: Callable[[np.ndarray], np.ndarray], size: int = SIZE) -> DataFrame:
    """Tiles whose pixels follow from those up to reach around them: change gets a tile with what the frame has around it and returns an array of the
    same height and width. Where the array ends inside the frame it is cut off again, where the frame ends change sees the frame's border."""
    return nearing(tiles, by, channels, reach, change, size).frame()


def nearing(tiles: DataFrame | Pending, by: list[str], channels: int, reach: int, change: Callable[[np.ndarray], np.ndarray], size: int = SIZE) -> Pending:
    """What near gives, for near, parts and unpack to go on with."""
    if reach > size:
        raise ValueError(f"a filter of reach {reach} needs tiles of that size")
    made = _pending(tiles)
    keys = _keys(made.rows, by) + "tx int, ty int, x int, y int, w int, h int, data binary"

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _some(frames, _HELD):
            out = []
            for row in some.to_dict("records"):
                data = _array(row["data"], channels, row["h"], row["w"])
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        xs = slice(0, reach) if dx < 0 else slice(max(0, row["w"] - reach), row["w"]) if dx > 0 else slice(0, row["w"])
                        ys = slice(0, reach) if dy < 0 else slice(max(0, row["h"] - reach), row["h"]) if dy > 0 else slice(0, row["h"])
                        part = data[:, ys, xs]
                        if part.size and row["tx"] + dx >= 0 and row["ty"] + dy >= 0:
                            out.append((*[row[n] for n in by], row["tx"] + dx, row["ty"] + dy, row["x"] + xs.start, row["y"] + ys.start, part.shape[2], part.shape[1], part.tobytes()))
            yield pd.DataFrame(out, columns=[*by, *_TILE])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole(frames, place):
            rows = pdf.to_dict("records")
            out = [met(rows[a:b]) for a, b in itertools.pairwise([*starts, len(rows)])]
            yield pd.DataFrame([r for r in out if r], columns=[*by, *_TILE])

    def met(parts: list[dict]) -> tuple | None:
        tx, ty = parts[0]["tx"], parts[0]["ty"]
        core = next((p for p in parts if p["x"] // size == tx and p["y"] // size == ty), None)
        if core is None:  # beyond the frame
            return None
        x0, y0 = min(p["x"] for p in parts), min(p["y"] for p in parts)
        w, h = max(p["x"] + p["w"] for p in parts) - x0, max(p["y"] + p["h"] for p in parts) - y0
        all_of = np.zeros((channels, h, w), np.float32)
        for p in parts:
            all_of[:, p["y"] - y0 : p["y"] - y0 + p["h"], p["x"] - x0 : p["x"] - x0 + p["w"]] = _array(p["data"], channels, p["h"], p["w"])
        out = change(all_of)[:, core["y"] - y0 : core["y"] - y0 + core["h"], core["x"] - x0 : core["x"] - x0 + core["w"]]
        return (*[core[n] for n in by], tx, ty, core["x"], core["y"], core["w"], core["h"], np.ascontiguousarray(out, np.float32).tobytes())

    place = [*by, "tx", "ty"]
    return Pending(together(made.then(spread, keys).frame(), place)).then(meet, keys)


# --- filters on arrays (channels, height, width), with the frame's border where the array ends ------------------------------------------


def _around(a: np.ndarray, how: Callable, first, places: list[tuple[int, int]], **pad) -> np.ndarray:
    h, w = a.shape[1:]
    wide = np.pad(a, ((0, 0), (1, 1), (1, 1)), **pad)
    out = first
    for dy, dx in places:
        part = wide[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        out = part.copy() if out is None else how(out, part)
    return out


_CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
_SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def eroded(mask: np.ndarray) -> np.ndarray:
    """Least value of the pixel and its four neighbours; what lies outside the frame takes no part."""
    return _around(mask, np.minimum, None, _CROSS, constant_values=np.inf)


def dilated(mask: np.ndarray) -> np.ndarray:
    return _around(mask, np.maximum, None, _CROSS, constant_values=-np.inf)


def majority(mask: np.ndarray) -> np.ndarray:
    """Median of nine of a mask of 0 and 1; beyond the frame its border goes on."""
    return (_around(mask, np.add, None, _SQUARE, mode="edge") >= 5).astype(np.float32)


def cleaned(mask: np.ndarray) -> np.ndarray:
    """A mask after the median, an opening and a closing."""
    return eroded(dilated(dilated(eroded(majority(mask)))))


CLEAN_REACH = 5


def gaussian(size: int) -> Callable[[np.ndarray], np.ndarray]:
    """Blur with a kernel of an odd size whose deviation follows from it; the frame is mirrored at its border pixels."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()

    def blur(a: np.ndarray) -> np.ndarray:
        out = a.astype(float)
        for axis in (1, 2):
            n, r = out.shape[axis], size // 2
            wide = np.pad(out, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="reflect" if n > 1 else "edge")
            out = sum(k * np.take(wide, range(i, i + n), axis=axis) for i, k in enumerate(kernel))
        return out

    return blur


# --- running sums ---------------------------------------------------------------------------------------------------------------------


def local_mean(pixels: DataFrame, by: list[str], value: str, radius: int, name: str = "mean") -> DataFrame:
    """Adds the mean of the square of that radius around each pixel, as far as the frame goes: a summed-area table made of a running sum along
    rows and one along columns, of which a pixel needs two entries each way. A window holds one row or column of a frame. Sums are exact
    for whole numbers."""
    out = pixels.withColumns({"_sum": F.col(value).cast("double"), "_n": F.lit(1.0)})
    for line, along in (("y", "x"), ("x", "y")):
        order = Window.partitionBy(*by, line).orderBy(along)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        run = {n: F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in ("_sum", "_n")}
        out = out.withColumns({f"{n}_run": c for n, c in run.items()})
        between = {n: F.coalesce(F.lead(f"{n}_run", radius).over(order), F.last(f"{n}_run").over(whole)) - F.coalesce(F.lag(f"{n}_run", radius + 1).over(order), F.lit(0.0)) for n in ("_sum", "_n")}
        out = out.withColumns(between).drop("_sum_run", "_n_run")
    return out.withColumn(name, F.col("_sum") / F.col("_n")).drop("_sum", "_n")


# --- components -----------------------------------------------------------------------------------------------------------------------


_PART = ("x", "y", "w", "h", "area", "sx", "sy", "bits")


def parts(tiles: DataFrame | Pending, by: list[str], channels: list[str], size: int = SIZE, diagonal: bool = True, levels: list[int] | None = None) -> DataFrame:
    """(by, label, x, y, w, h, area, sx, sy, bits, the channels after the first) of the pieces into which tiles cut the components of pixels whose first
    channel is not 0: a piece's box, number of pixels and sums of their places, its pixels as bits of the box, and their other channels as 32-bit
    floats, row by row. A label is the first pixel of its component, row by row, as y * 2**32 + x. With levels, components of the pixels above each,
    the level as a last key `threshold`.

    Tiles are labelled apart, some at a time. Only pixels at their rims can tie pieces of several tiles; the rims of a frame's tiles are brought
    together, tied by union-find, and pieces without a tie keep their label. What meets in a task is one tile, or the rims of one frame.
    """
    rest = channels[1:]
    keys = [*by, "threshold"] if levels is not None else by
    made = _pending(tiles)
    typed = _keys(made.rows, by) + ("threshold int, " if levels is not None else "")
    row = np.arange(size)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _some(frames, _HELD):
            x, y, w, h = (some[n].to_numpy().astype(np.int64) for n in "xywh")
            data = np.full((len(channels), len(some), size + 1, size), -np.inf, np.float32)  # a row between tiles
            for t, d in enumerate(some["data"]):
                data[:, t, : h[t], : w[t]] = _array(d, len(channels), h[t], w[t])
            for level in [None] if levels is None else levels:
                mask = (data[0] != 0) & ~np.isneginf(data[0]) if level is None else data[0] > level
                out = pieces(mask, data[1:], x, y, w, h)
                tile = out.pop("tile")
                yield pd.DataFrame({**{n: some[n].to_numpy()[tile] for n in by}, **({} if level is None else {"threshold": np.full(len(tile), level, np.int32)}), **out})

    def pieces(mask: np.ndarray, others: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> dict:
        """Columns of a stack of tiles' pieces, and after them of the rims (piece -1): the pieces' first pixels along the tile's top, bottom, left and right."""
        numbers = label(mask.reshape(-1, size), diagonal)
        ys, xs = np.nonzero(numbers)
        piece = numbers[ys, xs] - 1
        order = np.argsort(piece, kind="stable")
        ys, xs, piece = ys[order], xs[order], piece[order]
        area = np.bincount(piece)
        start = np.cumsum(area) - area
        tile = ys[start] // (size + 1)
        ly = ys - tile[piece] * (size + 1)
        over = lambda how, v: how.reduceat(v, start) if len(start) else v[:0]
        left, top = over(np.minimum, xs), over(np.minimum, ly)
        width, height = over(np.maximum, xs) - left + 1, over(np.maximum, ly) - top + 1
        room = -(-(width * height) // 8) * 8
        begin = np.cumsum(room) - room
        flat = np.zeros(int(room.sum()), bool)
        flat[begin[piece] + (ly - top[piece]) * width[piece] + xs - left[piece]] = True
        bits = np.packbits(flat).tobytes()
        first = (ly[start] * size + xs[start]).astype(np.int32)
        known = np.append(first, np.int32(-1))[numbers.reshape(mask.shape) - 1]
        n = np.arange(len(x))
        rims = np.stack([known[:, 0], known[n, h - 1], known[:, :size, 0], known[n[:, None], row, (w - 1)[:, None]]], axis=1)
        rimmed = np.flatnonzero((rims >= 0).any(axis=(1, 2)))
        none = np.zeros(len(rimmed), np.int64)
        out = {
            "tile": [tile, rimmed], "piece": [((y[tile] + ly[start]) << 32) + x[tile] + xs[start], none - 1], "x": [x[tile] + left, x[rimmed]], "y": [y[tile] + top, y[rimmed]], "w": [width, w[rimmed]], "h": [height, h[rimmed]],
            "area": [area, none], "sx": [over(np.add, xs) + area * x[tile], none], "sy": [over(np.add, ly) + area * y[tile], none],
        }
        out = {k: np.concatenate(v) for k, v in out.items()}
        out["bits"] = [*[bits[a:b] for a, b in zip(begin // 8, (begin + room) // 8)], *[r.tobytes() for r in rims[rimmed]]]
        for c, values in zip(rest, others):
            v = values.reshape(-1, size)[ys, xs]
            out[c] = [*[v[a : a + k].tobytes() for a, k in zip(start, area)], *[b""] * len(rimmed)]
        return out

    def unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole(frames, keys):
            n = len(pdf)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            x, y = pdf["x"].to_numpy().astype(np.int64), pdf["y"].to_numpy().astype(np.int64)
            tx, ty = x // size, y // size
            rim = np.frombuffer(b"".join(pdf["bits"]), np.int32).reshape(n, 4, size).astype(np.int64)
            rim = np.where(rim >= 0, np.arange(n)[:, None, None] * size * size + rim, -1)
            wide, high = tx.max() + 3, ty.max() + 2
            place = (group * high + ty) * wide + tx + 1
            order = np.argsort(place)
            ends = []

            def tie(dx: int, dy: int, side: Callable, other: Callable) -> None:
                """Ties of each tile's side with the other side of the tile that lies there."""
                at = np.searchsorted(place[order], place + dy * wide + dx)
                at = order[np.minimum(at, n - 1)]
                there = place[at] == place + dy * wide + dx
                pair = np.stack([side(rim[there]), other(rim[at[there]])], axis=-1).reshape(-1, 2)
                ends.append(pair[(pair >= 0).all(axis=1)])

            for dx, dy, a, b in ((1, 0, 3, 2), (0, 1, 1, 0)):
                tie(dx, dy, lambda r: r[:, a], lambda r: r[:, b])
                if diagonal:
                    tie(dx, dy, lambda r: r[:, a, 1:], lambda r: r[:, b, :-1])
                    tie(dx, dy, lambda r: r[:, a, :-1], lambda r: r[:, b, 1:])
            if diagonal:
                tie(1, 1, lambda r: r[:, 1, -1], lambda r: r[:, 0, 0])
                tie(-1, 1, lambda r: r[:, 1, 0], lambda r: r[:, 0, -1])
            nodes, ends = np.unique(np.concatenate(ends), return_inverse=True)
            tile, pixel = nodes // (size * size), nodes % (size * size)
            name = ((y[tile] + pixel // size) << 32) + x[tile] + pixel % size
            order = np.lexsort([name, group[tile]])  # of a frame's nodes, the first pixel has the least number
            rank = np.empty(len(nodes), np.int64)
            rank[order] = np.arange(len(nodes))
            ends, tile, name = rank[ends].reshape(-1, 2), tile[order], name[order]
            root = np.arange(len(nodes))
            while True:
                low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
                new = root.copy()
                for k in (0, 1):
                    np.minimum.at(new, ends[:, k], low)
                    np.minimum.at(new, root[ends[:, k]], low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            yield pd.DataFrame({**{k: pdf[k].to_numpy()[tile] for k in keys}, "piece": name, "_label": name[root]})

    found = pinned(made.then(cut, typed + "piece long, x int, y int, w int, h int, area long, sx long, sy long, bits binary" + "".join(f", `{c}` binary" for c in rest)).frame())
    rims = found.where("piece < 0").select(*keys, "x", "y", "bits")
    united = together(rims, keys).mapInPandas(unite, typed + "piece long, _label long")
    return found.where("piece >= 0").join(united, [*keys, "piece"], "left").select(*keys, F.coalesce("_label", "piece").alias("label"), *_PART, *rest)


def labelled(tiles: DataFrame | Pending, by: list[str], channels: list[str], size: int = SIZE, diagonal: bool = True) -> DataFrame:
    """(by, x, y, label, the channels after the first) of the pixels whose first channel is not 0, labelled as parts labels them."""
    rest = channels[1:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), 8 * _HELD):
                some = pdf.iloc[i : i + 8 * _HELD]
                ys, xs = (np.concatenate(n) for n in zip(*(np.nonzero(mask_of(*r)) for r in zip(some["bits"], some["w"], some["h"]))))
                part = np.repeat(np.arange(len(some)), some["area"].to_numpy())
                out = {**{n: some[n].to_numpy()[part] for n in by}, "x": xs + some["x"].to_numpy()[part], "y": ys + some["y"].to_numpy()[part], "label": some["label"].to_numpy()[part]}
                yield pd.DataFrame({**out, **{c: np.frombuffer(b"".join(some[c]), np.float32).astype(float) for c in rest}})

    return parts(tiles, by, channels, size, diagonal).mapInPandas(run, _keys(_pending(tiles).rows, by) + "x int, y int, label long" + "".join(f", `{c}` double" for c in rest))


def mask_of(bits: bytes, w: int, h: int) -> np.ndarray:
    """A piece's pixels in its box."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=int(w) * int(h)).reshape(h, w)


def part_stats(parts: DataFrame, by: list[str]) -> DataFrame:
    """component_stats of the components' parts."""
    wide = lambda n, d: F.max(F.col(n) + F.col(d)) - F.min(n)
    mean = lambda n: F.sum(n) / F.sum("area")
    return parts.groupBy(*by, "label").agg(F.sum("area").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), wide("x", "w").alias("w"), wide("y", "h").alias("h"), mean("sx").alias("cx"), mean("sy").alias("cy"))


def component_stats(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, area, x, y, w, h, cx, cy) of labelled pixels: size, box and centre of each component."""
    wide = lambda n: (F.max(n) - F.min(n) + 1)
    return pixels.groupBy(*by, "label").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), wide("x").alias("w"), wide("y").alias("h"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
