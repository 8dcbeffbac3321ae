"""A live source for Structured Streaming: events that arrive as files below a folder, with offsets, replay and admission.

Below ``path`` each source has a folder, in it Parquet files whose names sort by arrival; ``deliver`` writes one. An event's number in its
source is its place in this log, so an offset (how many events of each source) says once and for all which events a batch
has, and a batch that is run again has the same ones.

- A real-time source does not wait: a batch has all that came. What came while the batch before ran had room for ``waiting``
  pictures; later ones are marked ``behind``, as their places will be filled by repeats. Sound is not counted.
- A source that can wait (a file) is given ``waiting`` pictures at a time, and the sound between them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship
from . import storage

#: Pictures of a source that may wait.
WAITING = 60
_LOG = pa.schema([("kind", pa.string()), ("time", pa.int64()), ("shape", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.int64()), ("received", pa.int64())])
_EVENTS = "source string, arrival long, kind string, time long, shape string, width int, height int, rate int, channels int, samples long, received long, behind boolean"


def deliver(path: str, source: str, number: int, events: Sequence[dict]) -> None:
    """The next events of a source, as file ``number`` of its log: there whole or not at all."""
    buffer = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(list(events), schema=_LOG), buffer)
    storage.put(f"{path}/{source}/{number:012d}.parquet", buffer.getvalue())


class Log:
    """The files of all sources below a path; those seen once are not opened again to be counted."""

    def __init__(self, path: str):
        self.path = path
        self.files: dict[str, list[tuple[str, int, int]]] = {}  # of each source: name, events, pictures

    def look(self) -> None:
        """See what has arrived since."""
        for source in storage.names(self.path):
            known = self.files.setdefault(source, [])
            for name in storage.names(f"{self.path}/{source}"):
                if not known or name > known[-1][0]:
                    kinds = self.read(source, name, ["kind"]).column("kind")
                    known.append((name, len(kinds), int(pc.sum(pc.equal(kinds, "picture")).as_py() or 0)))

    def read(self, source: str, name: str, columns: list[str] | None = None) -> pa.Table:
        return pq.read_table(io.BytesIO(storage.get(f"{self.path}/{source}/{name}")), columns=columns)

    def between(self, source: str, first: int, end: int) -> Iterator[tuple[int, pa.Table]]:
        """(number of its first event, events) of each file that has some of events first to end, cut to these."""
        at = 0
        for name, n, _ in self.files.get(source, ()):
            low, high = max(first, at), min(end, at + n)
            if low < high:
                yield low, self.read(source, name).slice(low - at, high - low)
            at += n

    def after(self, source: str, first: int, pictures: int) -> int:
        """The end of the events from ``first`` on that have so many pictures at most."""
        at, left = 0, pictures
        for name, n, shown in self.files.get(source, ()):
            if at + n > first:
                if at >= first and shown <= left:
                    left -= shown
                else:
                    kinds = self.read(source, name, ["kind"]).column("kind").to_pylist()
                    for i in range(max(first - at, 0), n):
                        if kinds[i] == "picture" and left == 0:
                            return at + i
                        left -= kinds[i] == "picture"
            at += n
        return max(at, first)


class Part(InputPartition):
    """Events first to end of a source."""

    def __init__(self, source: str, first: int, end: int):
        self.source, self.first, self.end = source, first, end


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.waiting = options["path"], int(options.get("waiting", WAITING))
        self.realtime = str(options.get("realtime", "true")).lower() == "true"
        self.log = Log(self.path)
        self.at: dict[str, int] | None = None  # the end of the last batch that was planned

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        self.log.look()
        if self.realtime:
            return {s: sum(n for _, n, _ in files) for s, files in self.log.files.items()}
        at = self.at or {}
        return {s: self.log.after(s, at.get(s, 0), self.waiting) for s in self.log.files}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = dict(end)  # called for the last batch after a restart, too, before anything new is looked for
        return [Part(s, start.get(s, 0), n) for s, n in sorted(end.items()) if n > start.get(s, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        log, shown = Log(self.path), 0
        log.look()
        for number, events in log.between(partition.source, partition.first, partition.end):
            n = len(events)
            behind = []
            for kind in events.column("kind").to_pylist():
                shown += kind == "picture"
                behind.append(self.realtime and kind == "picture" and shown > self.waiting)
            columns = [pa.array([partition.source] * n, pa.string()), pa.array(range(number, number + n), pa.int64()), *(events.column(c).combine_chunks() for c in _LOG.names), pa.array(behind)]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "arrival", *_LOG.names, "behind"])


class LiveFolder(DataSource):
    """Options: ``path``; ``realtime`` (true: drop what finds no room; false: wait); ``waiting`` (pictures that have room)."""

    @classmethod
    def name(cls) -> str:
        return "live_folder"

    def schema(self) -> str:
        return _EVENTS

    def streamReader(self, schema: StructType) -> LiveReader:
        return LiveReader(dict(self.options))


def live_events(spark: SparkSession, path: str, realtime: bool = True, waiting: int = WAITING) -> DataFrame:
    """SRC-29, STR-02: the events of all sources below ``path`` as a stream, one partition for each source that has new ones."""
    ship(spark)
    spark.dataSource.register(LiveFolder)
    return spark.readStream.format("live_folder").option("path", path).option("realtime", str(realtime).lower()).option("waiting", waiting).load()
