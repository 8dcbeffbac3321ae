"""A streaming sink for media playlists: each batch adds its tail, in two phases.

Tasks stage the new lines of each rendition where nothing looks. The commit of a batch moves them to the rendition's tails and then writes the batch's entry
in the log, which alone makes them part of a playlist; a batch that is committed again changes nothing, and what an aborted one
staged is removed. What a batch does depends on its own segments only, however old the stream is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.segments import playlist_head
from ..session import ship
from ..sources import storage


@dataclass
class Staged(WriterCommitMessage):
    """Of each rendition of a task: its first segment's number and where its lines are."""

    tails: list[tuple[str, int, str]]


class TailWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Any]) -> Staged:
        lines: dict[str, list[tuple[int, str]]] = {}
        for row in iterator:
            lines.setdefault(row["rendition"], []).append((row["sequence"], f"#EXTINF:{row['seconds']:.6f},\n{row['uri']}\n"))
        out = []
        for rendition, found in lines.items():
            found.sort()
            staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
            storage.put(staged, "".join(x for _, x in found).encode())
            out.append((rendition, found[0][0], staged))
        return Staged(out)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        staged = sorted(x for m in messages if m for x in m.tails)
        entry = f"{self.path}/log/{batchId:012d}.json"
        if storage.get(entry) is not None:  # this batch is in the playlists already
            return self.abort(messages, batchId)
        rows = []
        for n, (rendition, first, at) in enumerate(staged):
            tail = f"tails/{batchId:012d}-{n:06d}"
            storage.move(at, f"{self.path}/{tail}")
            rows.append({"rendition": rendition, "batch": batchId, "first": first, "tail": tail})
        storage.put(entry, "\n".join(map(json.dumps, rows)).encode())

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        for message in messages:
            for *_, staged in message.tails if message else ():
                storage.drop(staged)


class Playlists(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_playlists"

    def streamWriter(self, schema: StructType, overwrite: bool) -> TailWriter:
        return TailWriter(self.options["path"])


def publish_hls(segments: DataFrame, path: str, checkpoint: str, rendition: str, sequence: str, seconds: str, uri: str, **trigger: Any) -> Any:
    """STR-07, SNK-10: the segments of a stream, as they come, in the growing playlists below ``path``. ``trigger``: by default, all there is now.

    Each batch's segments of a rendition meet in one task, which sorts them; those of a later batch are later ones.
    """
    ship(segments.sparkSession)
    segments.sparkSession.dataSource.register(Playlists)
    rows = segments.select(F.col(rendition).cast("string").alias("rendition"), F.col(sequence).cast("long").alias("sequence"), F.col(seconds).cast("double").alias("seconds"), F.col(uri).cast("string").alias("uri")).repartition("rendition")
    return rows.writeStream.format("media_playlists").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def finish_hls(path: str) -> None:
    """STR-07: from now on the playlists below ``path`` are finished ones, with an end."""
    storage.put(f"{path}/finished", b"")


def playlists(spark: SparkSession, path: str, target: int, init: str | None = "init.mp4") -> DataFrame:
    """SNK-10: (rendition, playlist) of all batches that are in the log, each rendition's tails in order: event playlists, or finished ones after ``finish_hls``."""
    live = storage.get(f"{path}/finished") is None
    log = spark.read.schema("rendition string, batch long, first long, tail string").json(f"{path}/log")
    tails = spark.read.format("binaryFile").load(f"{path}/tails").select(F.regexp_extract("path", "tails/[0-9-]+$", 0).alias("tail"), F.decode("content", "UTF-8").alias("lines"))
    found = log.join(tails, "tail")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "first", "lines"))), lambda x: x["lines"]), "")
    return found.groupBy("rendition").agg(F.concat(playlist_head(F.lit(str(target)), live, init), body, F.lit("" if live else "#EXT-X-ENDLIST\n")).alias("playlist"))
