"""One live source as a session: its pictures and sound placed on one timeline until it ends.

``Session`` is the state and the step from event to event. ``placed`` takes a table of events through it, in order of
arrival; ``placed_stream`` a stream, with the state in the state store: a value (anchor, counts, shapes), a list (sound that
waits for the first picture), a map (how many events had which status) and a timer (a source that falls silent). Both take the same steps, so
however a stream is cut into micro-batches, its rows are those of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import ship
from .live import Clock, Sound, nearest

#: Packets of sound that may wait for the first picture; of more, the oldest go.
EARLY = 400
#: Sound stays within a 25th of a second, and is placed up to ten seconds ahead.
TOLERANCE, FAR = 25, 10

#: ``kind``: picture, sound, end (a file's) or lost (the source went away). ``shape``: a picture's format and colour. ``behind``: dropped on the way here. ``received``: when it came, in ms; -1 if unknown.
EVENTS = "source string, arrival long, kind string, time long, shape string, width int, height int, rate int, channels int, samples long, behind boolean, received long"
#: A row for each event, when it is placed, and one for the end (``kind`` end). ``tally``, at the end: how many events had which status.
PLACED = "source string, arrival long, kind string, status string, slot long, repeats long, start long, at long, silence long, trim long, kept long, out_width int, out_height int, rescaled boolean, renewed boolean, tally map<string,long>"
_STATE = "start long, written long, rate int, channels int, heard long, width int, height int, shape string, over string, arrival long, received long"
_NAMES = [x.split()[0] for x in EVENTS.split(", ")][1:]
_OUT = [x.split()[0] for x in PLACED.split(", ")][1:]


@dataclass(frozen=True)
class Rules:
    """The output's frame rate; a jump of more than ``max_gap`` frames anchors anew; ``limit``: frames, at most; ``idle_ms``: silence that ends a source."""

    rate_num: int
    rate_den: int
    max_gap: int
    limit: int | None = None
    idle_ms: int | None = None


@dataclass
class Session:
    """Anchor and frames written; of sound, its first shape and samples written; the first picture's size and the last one's shape; why it is over."""

    start: int | None = None
    written: int = 0
    rate: int | None = None
    channels: int | None = None
    heard: int = 0
    width: int | None = None
    height: int | None = None
    shape: str | None = None
    over: str | None = None
    arrival: int = -1
    received: int = -1
    early: list[tuple] = field(default_factory=list)
    tally: dict[str, int] = field(default_factory=dict)

    def take(self, rules: Rules, event: dict[str, Any]) -> list[tuple]:
        """The rows that an event makes: its own, those of sound that it lets go, and the end."""
        if self.over:
            return []
        silent = rules.idle_ms and self.start is not None and event["received"] >= 0 <= self.received and event["received"] - self.received >= rules.idle_ms
        if silent:
            return self.ended("idle")
        if event["kind"] == "picture":
            out = self._picture(rules, event)
        elif event["kind"] == "sound":
            out = self._sound(rules, event)
        else:
            return self.ended({"end": "ended", "lost": "lost"}[event["kind"]] if self.start is not None else "no picture", event["arrival"])
        return out + (self.ended("length") if rules.limit is not None and self.written >= rules.limit else [])

    def ended(self, why: str, arrival: int | None = None) -> list[tuple]:
        """The last row: why, at which event, frames and samples written."""
        self.over = why
        self.tally[why] = 1
        return [self._row(self.arrival if arrival is None else arrival, "end", why, slot=self.written, start=self.start, at=self.heard, tally=dict(sorted(self.tally.items())))]

    def _row(self, arrival: int, kind: str, status: str, **values: Any) -> tuple:
        if kind != "end":
            self.tally[status] = self.tally.get(status, 0) + 1
        known = {"arrival": arrival, "kind": kind, "status": status} | values
        return tuple(known.get(c) for c in _OUT)

    def _picture(self, rules: Rules, event: dict[str, Any]) -> list[tuple]:
        self.arrival = event["arrival"]
        if event["behind"]:
            return [self._row(self.arrival, "picture", "behind", slot=self.written, repeats=0, start=self.start)]
        self.received = event["received"]
        first = self.start is None
        clock = Clock(rules.rate_num, rules.rate_den, rules.max_gap, rules.limit)
        self.start, self.written, slot, status, repeats = clock.place(self.start, self.written, event["time"])
        shown: dict[str, Any] = {}
        if status in ("write", "reanchor"):
            size = event["width"], event["height"]
            renewed = self.shape is not None and event["shape"] != self.shape
            if self.width is None:
                self.width, self.height = size
            self.shape = event["shape"]
            shown = {"out_width": self.width, "out_height": self.height, "rescaled": size != (self.width, self.height), "renewed": renewed}
        out = [self._row(self.arrival, "picture", status, slot=slot, repeats=repeats, start=self.start, **shown)]
        if first:
            for waiting in self.early:
                out += self._sound(rules, dict(zip(("arrival", "time", "rate", "channels", "samples"), waiting, strict=True)))
            self.early = []
        return out

    def _sound(self, rules: Rules, event: dict[str, Any]) -> list[tuple]:
        arrival, rate, channels = event["arrival"], event["rate"], event["channels"]
        if self.start is None:
            self.early.append((arrival, event["time"], rate, channels, event["samples"]))
            return [self._row(self.early.pop(0)[0], "sound", "too early")] if len(self.early) > EARLY else []
        if not rate or not channels:
            return [self._row(arrival, "sound", "empty")]
        if self.rate is None:
            self.rate, self.channels = rate, channels
        if (rate, channels) != (self.rate, self.channels):
            return [self._row(arrival, "sound", "reshaped")]
        cap = None if rules.limit is None else rules.limit * rate * rules.rate_den // max(rules.rate_num, 1)
        at = nearest(event["time"] - self.start, rate, 1)
        self.heard, silence, trim, kept = Sound(rate, rate // TOLERANCE, FAR * rate, cap).place(self.heard, at, event["samples"])
        return [self._row(arrival, "sound", "placed", start=self.start, at=at, silence=silence, trim=trim, kept=kept)]


def as_events(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``EVENTS`` alone and without nulls but in ``source``: what is missing is 0, empty, in time (not behind), of unknown receipt."""
    none = {"behind": F.lit(False), "received": F.lit(-1), "shape": F.lit(""), "kind": F.lit("picture")}
    columns = [F.col("source").cast("string")]
    for name, kind in (x.split() for x in EVENTS.split(", ")[1:]):
        missing = none.get(name, F.lit(0))
        columns.append((F.coalesce(F.col(name), missing) if name in rows.columns else missing).cast(kind).alias(name))
    return rows.select(columns)


def placed(events: DataFrame, rules: Rules) -> DataFrame:
    """STR-01, 03, 05, 06 on a table: the rows of ``PLACED``, sources apart, events by ``arrival``.

    A source is one walk, in bounded memory: each place depends on the last. A null source is a source. Without
    rows there are none.
    """
    ship(events.sparkSession)
    arrow = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.map_(pa.string(), pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, session = None, None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for source, *values in zip(*columns, strict=True):
                if session is None or source != last:
                    last, session = source, Session()
                out += ((source, *row) for row in session.take(rules, dict(zip(_NAMES, values, strict=True))))
            made = list(zip(*out, strict=True)) or [()] * len(arrow)
            made[-1] = [None if t is None else list(t.items()) for t in made[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, arrow, strict=True)], names=["source", *_OUT])

    return as_events(events).repartition("source").sortWithinPartitions("source", "arrival").mapInArrow(run, PLACED)


class Placing(StatefulProcessor):
    """``Session`` with its state in the store of the stream."""

    def __init__(self, rules: Rules, idle: bool):
        self.rules, self.idle = rules, idle
        self.shapes = [StructType.fromDDL(x) for x in (_STATE, "arrival long, time long, rate int, channels int, samples long", "status string", "n long")]  # here: DDL needs a session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("session", self.shapes[0])
        self.early = handle.getListState("early", self.shapes[1])
        self.tally = handle.getMapState("tally", self.shapes[2], self.shapes[3])

    def _load(self) -> Session:
        session = Session(*self.value.get()) if self.value.exists() else Session()
        if session.start is None and self.early.exists():
            session.early = [tuple(x) for x in self.early.get()]
        return session

    def _save(self, session: Session, before: bool) -> None:
        self.value.update(astuple(session)[:11])
        if before:  # sound waits for the first picture only
            if session.early:
                self.early.put(session.early)
            else:
                self.early.clear()
        for status, n in session.tally.items():
            self.tally.updateValue((status,), (n,))

    def _out(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["source", *_OUT]).astype({c.split()[0]: "object" for c in PLACED.split(", ")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        session = self._load()
        if session.over:
            for _ in rows:
                pass
            return
        session.tally = {k[0]: v[0] for k, v in self.tally.iterator()}
        before, seen, out = session.start is None, session.arrival, []
        taken = pd.concat(list(rows)).sort_values("arrival", kind="stable")[_NAMES]
        columns = [taken[c].tolist() for c in _NAMES]
        for values in zip(*columns, strict=True):
            out += session.take(self.rules, dict(zip(_NAMES, values, strict=True)))
        self._save(session, before)
        if self.idle and (session.over or session.arrival != seen):
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if not session.over:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.rules.idle_ms)
        yield from self._out(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        session = self._load()
        if not session.over:
            session.tally = {k[0]: v[0] for k, v in self.tally.iterator()}
            out = session.ended("idle")
            self._save(session, False)
            yield from self._out(key, out)

    def close(self) -> None:
        pass


def placed_stream(events: DataFrame, rules: Rules) -> DataFrame:
    """``placed`` on a stream whose batches come in order of arrival: the same rows, each as soon as it is known.

    With ``rules.idle_ms``, a source that sends no picture for so long ends by a timer too, when nothing more comes. What comes after
    the end of a source is ignored, and its state is a few numbers. Needs the RocksDB state store (``use_rocksdb``).
    """
    ship(events.sparkSession)
    idle = rules.idle_ms is not None
    return as_events(events).groupBy("source").transformWithStateInPandas(statefulProcessor=Placing(rules, idle), outputStructType=PLACED, outputMode="append", timeMode="processingTime" if idle else "none")


def use_rocksdb(spark: Any) -> None:
    """State in RocksDB, which values, lists, maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
