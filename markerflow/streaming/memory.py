"""Stateful propagation, frame after frame per key, with bounded memory; and the streaming form of the stereo match (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.match import on_clock, usable


class MaskModel(Protocol):
    """What a model of a walk has to offer: a frame's output from its observation and what is remembered. Weights and devices are outside this library;
    prompts, their removal and resets are in sessions."""

    def step(self, frame: int, value: float, memory: list[float]) -> float: ...


class Smoothing:
    """Smoothing over the memory: the mean of the observation and what is recalled for its frame."""

    def step(self, frame: int, value: float, memory: list[float]) -> float:
        return (value + sum(memory)) / (1 + len(memory))


def closest(frames: list[int], frame: int, most: int) -> list[int]:
    """Of conditioned frames (in order of insertion) those attended to: the last before, the first from there on, then the nearest."""
    if most < 0 or len(frames) <= most:
        return list(frames)
    before, after = [f for f in frames if f < frame], [f for f in frames if f >= frame]
    chosen = [g(side) for g, side in ((max, before), (min, after)) if side]
    rest = sorted((f for f in frames if f not in chosen), key=lambda f: abs(f - frame))
    return chosen + rest[: most - len(chosen)]


class Memory:
    """Outputs of one object. A frame recalls the `conds` nearest conditioned frames and, of the others, the frame before it and every
    stride-th before that, size - 1 in all (a correction counts from where the walk meets it); a conditioned frame that was not chosen stands in for one that is missing there.

    Kept are the others that a later frame can still recall and, besides the first conditioned frame, the last `keep` of them, so the
    state of a key is bounded. A conditioned frame evicts the other kind, and a correction clears what lies within stride * size
    frames of it."""

    def __init__(self, size: int = 7, stride: int = 1, conds: int = 4, keep: int = 64, reverse: bool = False) -> None:
        self.size, self.stride, self.conds, self.keep, self.turn = size, stride, conds, max(keep, 2), -1 if reverse else 1
        self.cond: dict[int, float] = {}
        self.other: dict[int, float] = {}

    def correct(self, frame: int, value: float) -> None:
        reach = self.stride * self.size
        self.other = {f: v for f, v in self.other.items() if abs(f - frame) > reach}
        self.cond[frame] = value
        for f in list(self.cond)[1 : max(1, len(self.cond) - self.keep + 1)]:
            del self.cond[f]

    def put(self, frame: int, value: float) -> None:
        self.other[frame] = value
        oldest = frame - self.turn * self.stride * max(0, self.size - 2)  # a later frame looks no farther back
        self.other = {f: v for f, v in self.other.items() if (f - oldest) * self.turn >= 0}

    def slots(self, frame: int) -> list[int]:
        """The frames looked up, farthest first; reverse mirrors them."""
        r, t = self.stride, self.turn
        nearest = t * (((t * frame - 2) // r) * r) if t > 0 else -(-(frame + 2) // r) * r
        return [nearest - t * (k - 2) * r for k in range(self.size - 1, 1, -1)] + ([frame - t] if self.size > 1 else [])

    def recall(self, frame: int) -> list[float]:
        chosen = closest(list(self.cond), frame, self.conds)
        spare = {f: v for f, v in self.cond.items() if f not in chosen}
        found = (self.other.get(f, spare.get(f)) for f in self.slots(frame))
        return [self.cond[f] for f in chosen] + [v for v in found if v is not None]


def walk(pdf: pd.DataFrame, memory: Memory, model: MaskModel, first: int | None = None, last: int | None = None) -> pd.DataFrame:
    """Observations (frame, value, corrected) in the order of the walk, with the model's output; those outside first..last are left out.
    A correction there is still remembered, as prompts are given before the walk begins."""
    ordered = pdf.sort_values("frame", ascending=memory.turn > 0)
    inside = ordered["frame"].between(-(1 << 62) if first is None else first, (1 << 62) if last is None else last)
    for frame, value in ordered.loc[~inside & ordered["corrected"], ["frame", "value"]].itertuples(index=False):
        memory.correct(int(frame), float(value))
    ordered = ordered[inside]
    out = []
    for frame, value, corrected in ordered[["frame", "value", "corrected"]].itertuples(index=False):
        if corrected:
            memory.correct(int(frame), float(value))
            result = float(value)
        else:
            result = model.step(int(frame), float(value), memory.recall(int(frame)))
            memory.put(int(frame), result)
        out.append(result)
    return ordered.assign(output=out)


def propagate(observations: DataFrame, by: list[str], model: Callable[[], MaskModel] = Smoothing, size: int = 7, stride: int = 1, restart: int | None = None, conds: int = 4, keep: int = 64, reverse: bool = False, start: int | None = None, limit: int | None = None) -> DataFrame:
    """Batch form: one object's frames are one group, walked in order (backward with reverse).

    start is where the walk begins (the first corrected frame of the object unless given; its first frame if there is none), limit how
    many frames it goes on. With restart, output begins at that frame, and what came before it stays in the memory: those frames
    are walked and not returned."""
    schema = ", ".join(f"`{n}` {t}" for n, t in observations.dtypes) + ", output double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        given = pdf.loc[pdf["corrected"], "frame"]
        begin = start if start is not None else int(given.min()) if len(given) else int(pdf["frame"].max() if reverse else pdf["frame"].min())
        most = 1 << 40 if limit is None else limit
        first, last = (begin - most, begin) if reverse else (begin, begin + most)
        out = walk(pdf, Memory(size, stride, conds, keep, reverse), model(), first, last)
        if restart is not None:
            out = out[out["frame"] <= restart] if reverse else out[out["frame"] >= restart]
        return out

    return observations.groupBy(*by).applyInPandas(run, schema)


def restarted(output: DataFrame, again: DataFrame, restart: int) -> DataFrame:
    """Earlier output up to a frame, and what was computed anew from there on."""
    return output.where(F.col("frame") < restart).unionByName(again.where(F.col("frame") >= restart))


class _Walk(StatefulProcessor):
    """The memory of one key as state: two maps from frame to output, of which only what changed is written. With expire_ms, what was not written for that
    long is forgotten by the state store."""

    def __init__(self, key: str, model: Callable[[], MaskModel], memory: dict[str, int], expire_ms: int | None) -> None:
        self.key, self.model, self.memory, self.expire = key, model, memory, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.expire} if self.expire else {}
        self.kinds = {kind: handle.getMapState(kind, "frame int", "place int, value double", **ttl) for kind in ("cond", "other")}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        memory, held = Memory(**self.memory), {}
        for kind, state in self.kinds.items():
            held[kind] = sorted((int(v[0]), int(k[0]), float(v[1])) for k, v in state.iterator())  # conditioned frames in order of insertion
            setattr(memory, kind, {frame: value for _, frame, value in held[kind]})
        out = walk(pd.concat(list(rows)), memory, self.model())
        for kind, state in self.kinds.items():
            before = {frame: (place, value) for place, frame, value in held[kind]}
            after = {frame: (place, value) for place, (frame, value) in enumerate(getattr(memory, kind).items())}
            for frame in before.keys() - after.keys():
                state.removeKey((frame,))
            for frame, row in after.items():
                if before.get(frame) != row:
                    state.updateValue((frame,), row)
        yield pd.DataFrame({self.key: key[0], "frame": out["frame"].astype("int32"), "output": out["output"].astype(float)})

    def close(self) -> None:
        pass


def propagate_stream(observations: DataFrame, key: str, model: Callable[[], MaskModel] = Smoothing, size: int = 7, stride: int = 1, conds: int = 4, keep: int = 64, expire_ms: int | None = None) -> DataFrame:
    """Streaming form: (key, frame, output) of observations (key, frame, value, corrected) as they arrive, the memory of each key being state in the state store
    (which has to be RocksDB's), bounded by size * stride other and keep conditioned frames. Within a micro-batch frames are put in order; one that comes
    after later frames were walked is walked with what is remembered then. A query that is stopped and started again from its
    checkpoint goes on where it was."""
    bounds = {"size": size, "stride": stride, "conds": conds, "keep": keep}
    kind = dict(observations.dtypes)[key]
    processor = _Walk(key, model, bounds, expire_ms)
    return observations.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, frame int, output double", "Append", "ProcessingTime" if expire_ms else "None")


def stream_match(left: DataFrame, right: DataFrame, quality_min: float, left_drop: int, right_drop: int, late: str = "10 seconds") -> DataFrame:
    """Stream-stream match on the shared clock with a watermark (columns frame, obj_id, u, v, quality, valid, ts). A key that repeats on a
    side meets once: a stream cannot know the last of its rows before the watermark, so the first to arrive counts."""
    sides = []
    for rows, drop, s in ((left, left_drop, "L"), (right, right_drop, "R")):
        kept = on_clock(usable(rows, quality_min), drop).withWatermark("ts", late).dropDuplicatesWithinWatermark(["gframe", "obj_id"])
        sides.append(kept.select(F.col("gframe").alias(f"g{s}"), F.col("obj_id").alias(f"o{s}"), F.col("u").alias(f"u{s}"), F.col("v").alias(f"v{s}"), F.col("ts").alias(f"ts{s}")))
    near = F.expr(f"tsR BETWEEN tsL - INTERVAL {late} AND tsL + INTERVAL {late}")
    return sides[0].join(sides[1], (F.col("gL") == F.col("gR")) & (F.col("oL") == F.col("oR")) & near).select(F.col("gL").alias("gframe"), F.col("oL").alias("obj_id"), "uL", "vL", "uR", "vR")
