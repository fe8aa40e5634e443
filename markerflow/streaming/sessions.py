"""Prompt sessions: what a user has prompted so far, as an event-sourced state, from a log in a table and as a stream.

An event is (session, seq, obj_id, frame, kind, points, labels, fresh): `points` adds clicks (labels 1 in, 0 out; a box is its two corners
with labels 2 and 3, first), in place of the earlier ones on that frame if fresh, else after them; `mask` puts a mask (its name in labels is not
used) in the place of points; `clear` removes what is prompted on a frame of an object; `remove` removes an object; `reset` everything. Points
take the place of a mask. After each event the state of its object and frame is what the events up to it leave.

Defined cases: events are taken in order of seq, repeated ones (session, seq) once, as they are in the log; a box that is not fresh is
refused, as are points without labels (the event changes nothing and says so); a null object or frame stands for none; an empty log gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

EVENT = "session long, seq long, obj_id long, frame long, kind string, points array<struct<x:double,y:double>>, labels array<int>, fresh boolean"
STATE = "session long, seq long, obj_id long, frame long, kind string, accepted boolean, points array<struct<x:double,y:double>>, labels array<int>, masked boolean, prompted long, objects long"
KINDS = ("points", "mask", "clear", "remove", "reset")
#: Events after which a stream's session takes a snapshot and forgets the events before it.
SNAPSHOT = 64


class Session:
    """What is prompted: by object, then frame, (points, labels) or None for a mask."""

    def __init__(self, objects: dict[int, dict[int, tuple | None]] | None = None) -> None:
        self.objects: dict[int, dict[int, tuple | None]] = objects or {}

    def apply(self, obj_id, frame, kind, points, labels, fresh) -> bool:
        """Takes one event; whether it was accepted."""
        if kind == "reset":
            self.objects = {}
        elif kind == "remove":
            self.objects.pop(obj_id, None)
        elif kind == "clear":
            self.objects.get(obj_id, {}).pop(frame, None)
        elif kind == "mask":
            self.objects.setdefault(obj_id, {})[frame] = None
        elif kind == "points" and points is not None and labels is not None and len(points) == len(labels) and (fresh or 2 not in labels):
            at = self.objects.setdefault(obj_id, {})
            old = ((), ()) if fresh else at.get(frame) or ((), ())
            at[frame] = (old[0] + tuple(points), old[1] + tuple(labels))
        else:
            return False
        return True

    def dump(self) -> str:
        return json.dumps([[o, [[f, p] for f, p in frames.items()]] for o, frames in self.objects.items()])

    @classmethod
    def load(cls, text: str) -> Session:
        return cls({o: {f: p if p is None else (tuple(map(tuple, p[0])), tuple(p[1])) for f, p in frames} for o, frames in json.loads(text)})


def _event(row: dict) -> tuple:
    number = lambda v: None if v is None or v != v else int(v)
    points, labels = row["points"], row["labels"]
    return (number(row["obj_id"]), number(row["frame"]), row["kind"], None if points is None else [(float(p["x"]), float(p["y"])) for p in points], None if labels is None else [int(x) for x in labels], bool(row["fresh"]) if row["fresh"] is not None else False)


def _after(session: int, seq: int, event: tuple, state: Session, accepted: bool) -> tuple:
    obj, frame, kind = event[:3]
    now = state.objects.get(obj, {}).get(frame, ((), ()))
    points, labels = now or ((), ())
    return (session, seq, obj, frame, kind, accepted, [{"x": x, "y": y} for x, y in points], list(labels), now is None, sum(map(len, state.objects.values())), len(state.objects))


_COLUMNS = [f.strip().split(" ")[0] for f in "session, seq, obj_id, frame, kind, accepted, points, labels, masked, prompted, objects".split(",")]


def states(events: DataFrame) -> DataFrame:
    """STATE after each event of a log. A session is one person's work in order, so it is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Session(), []
        for row in pdf.drop_duplicates("seq").sort_values("seq").to_dict("records"):
            event = _event(row)
            accepted = state.apply(*event)
            out.append(_after(int(row["session"]), int(row["seq"]), event, state, accepted))
        return pd.DataFrame(out, columns=_COLUMNS)

    return events.groupBy("session").applyInPandas(run, STATE)


def at_frame(after: DataFrame) -> DataFrame:
    """(session, obj_id, frame, points, labels, masked): what is prompted at the end of a log, from states(). Of an object and frame the last event of its own
    counts, if no reset of the session and no removal of the object came after it."""
    last = lambda by, kinds: after.where(F.col("kind").isin(*kinds)).groupBy(*by).agg(F.max("seq").alias(f"_{kinds[0]}"))
    own = after.where(F.col("kind").isin("points", "mask", "clear")).groupBy("session", "obj_id", "frame").agg(F.max_by(F.struct("seq", "points", "labels", "masked"), "seq").alias("s"))
    rows = own.join(last(["session"], ("reset",)), "session", "left").join(last(["session", "obj_id"], ("remove",)), ["session", "obj_id"], "left")
    alive = (F.col("s.seq") > F.coalesce("_reset", F.lit(-1))) & (F.col("s.seq") > F.coalesce("_remove", F.lit(-1)))
    return rows.where(alive & (F.col("s.masked") | (F.size("s.labels") > 0))).select("session", "obj_id", "frame", "s.points", "s.labels", "s.masked")


class _Fold(StatefulProcessor):
    """A session as state: the last snapshot (its seq and what is prompted) and the events since. An event that comes late is put in its place, and the events
    after it are folded again from the snapshot; one before the snapshot comes too late and is refused."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.snapshot = handle.getValueState("snapshot", "seq long, state string")
        self.log = handle.getMapState("log", "seq long", "event string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, text = self.snapshot.get() if self.snapshot.exists() else (None, "[]")
        known = {int(k[0]): tuple(json.loads(v[0])) for k, v in self.log.iterator()}
        new = {int(r["seq"]): _event(r) for r in pd.concat(list(rows)).drop_duplicates("seq").to_dict("records")}
        late = [s for s in new if start is not None and s <= start]
        new = {s: e for s, e in new.items() if s not in known and s not in late}
        out = [_after(int(key[0]), s, (None, None, "late"), Session(), False) for s in late]
        if new:
            first, state, done = min(new), Session.load(text), 0
            every = sorted((known | new).items())
            keep_from = len(every) - len(every) % self.every
            for i, (seq, event) in enumerate(every):
                accepted = state.apply(*event)
                if seq >= first:
                    out.append(_after(int(key[0]), seq, event, state, accepted))
                if i + 1 == keep_from:
                    self.snapshot.update((seq, state.dump()))
                    done = keep_from
            for i, (seq, event) in enumerate(every):
                if i < done:
                    if seq in known:
                        self.log.removeKey((seq,))
                elif seq in new:
                    self.log.updateValue((seq,), (json.dumps(event),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, every: int = SNAPSHOT) -> DataFrame:
    """STATE rows of a stream of events. An event that comes late, but after the last snapshot, gives the rows of the events after it again, so of a
    (session, seq) the last row counts; one before the snapshot gives a row of kind `late`, not accepted. The state store has to be RocksDB's."""
    return events.groupBy("session").transformWithStateInPandas(_Fold(every), STATE, "Update", "None")
