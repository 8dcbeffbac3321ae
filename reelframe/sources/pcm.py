"""Uncompressed sound in blocks: WAV files of any size are read by byte ranges, and windows are cut from the blocks they span."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from .storage import store

#: Frames (a sample for each channel) of a block.
BLOCK = 16_384
#: Blocks that one task reads.
BLOCKS = 256
_BLOCKS = "path string, channels int, rate int, block long, first long, samples array<float>"
# Format codes of a WAV file, plain numbers, floats, and a longer form with the code in its own first bytes.
NUMBERS, FLOATS, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Sound:
    """What a file's head says: where its samples lie and what they are."""

    code: int
    channels: int
    rate: int
    bits: int
    at: int
    size: int

    @property
    def frame(self) -> int:
        """Bytes of a frame."""
        return self.channels * self.bits // 8


def head(file: pa.NativeFile, length: int) -> Sound | None:
    """SRC-20: the chunks of a WAV file up to its samples, whatever comes before; None if it is none or none that is read here.

    Samples that the file cuts short, or of unknown size (as a stream writes it), end with the file.
    """
    file.seek(0)
    if length < 12 or (start := file.read(12))[:4] != b"RIFF" or start[8:] != b"WAVE":
        return None
    at, told = 12, None
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(size, 40))
            if len(body) < 16:
                return None
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            told = (struct.unpack("<H", body[24:26])[0] if code == EXTENSIBLE and len(body) >= 26 else code), channels, rate, bits
        elif name == b"data":
            if not told or not told[1] or (told[0], told[3]) not in ((NUMBERS, 8), (NUMBERS, 16), (NUMBERS, 24), (NUMBERS, 32), (FLOATS, 32), (FLOATS, 64)):
                return None
            return Sound(*told, at + 8, min(size, length - at - 8))
        at += 8 + size + size % 2
    return None


def decoded(raw: bytes, code: int, bits: int) -> np.ndarray:
    """AUD-05: samples as numbers from -1 to 1, in single precision; a part of a sample at the end goes."""
    raw = raw[: len(raw) // (bits // 8) * (bits // 8)]
    if code == FLOATS:
        return np.frombuffer(raw, f"<f{bits // 8}").astype(np.float32)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    if bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.view("<i4").reshape(-1) >> 8).astype(np.float32) / np.float32(1 << 23)
    return np.frombuffer(raw, f"<i{bits // 8}").astype(np.float32) / np.float32(1 << (bits - 1))


class Range(InputPartition):
    """Blocks first to end of a file."""

    def __init__(self, path: str, sound: Sound, first: int, end: int):
        self.path, self.sound, self.first, self.end = path, sound, first, end


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.many = options["path"], int(options.get("block", BLOCK)), int(options.get("blocks", BLOCKS))

    def partitions(self) -> Sequence[Range]:
        system, at = store(self.path)
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for x in sorted(files, key=lambda x: x.path):
            if x.type == fs.FileType.File and x.extension.lower() in ("wav", "wave"):
                with system.open_input_file(x.path) as file:
                    sound = head(file, x.size)
                blocks = -(-(sound.size // sound.frame) // self.block) if sound else 0
                out += [Range(x.path, sound, n, min(n + self.many, blocks)) for n in range(0, blocks, self.many)]
        return out or [Range("", None, 0, 0)]  # type: ignore[arg-type]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.end:
            return
        system, sound = store(self.path)[0], partition.sound
        size = self.block * sound.frame
        with system.open_input_file(partition.path) as file:
            for n in range(partition.first, partition.end):
                file.seek(sound.at + n * size)
                samples = decoded(file.read(min(size, sound.size // sound.frame * sound.frame - n * size)), sound.code, sound.bits)
                columns = [pa.array([partition.path]), pa.array([sound.channels], pa.int32()), pa.array([sound.rate], pa.int32()), pa.array([n]), pa.array([n * self.block]), pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "channels", "rate", "block", "first", "samples"])


class PcmBlocks(DataSource):
    """Options: ``path`` (a file, or a folder with WAV files at any depth); ``block`` (frames of a block); ``blocks`` (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "pcm_blocks"

    def schema(self) -> str:
        return _BLOCKS

    def reader(self, schema: object) -> RangeReader:
        return RangeReader(dict(self.options))


def pcm_blocks(spark: SparkSession, path: str, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """AUD-05, SRC-20: (path, channels, rate, block, first, samples): the interleaved samples of WAV files, ``block`` frames a row, from frame ``first`` on.

    A task reads ``blocks`` blocks, one at a time, so a file of any size is read in bounded memory by many tasks. 8, 16, 24 and 32
    bits and floats of 32 and 64 bits; other files have no rows.
    """
    ship(spark)
    spark.dataSource.register(PcmBlocks)
    return spark.read.format("pcm_blocks").option("path", path).option("block", block).option("blocks", blocks).load()


def windows(blocks: DataFrame, cuts: DataFrame, block: int = BLOCK, channels: str | Column = "channels") -> DataFrame:
    """AUD-08: (<columns of cuts>, block, samples): the frames [start, end) of each cut (path, start, end, ...), a row for each block it spans, the first and last trimmed.

    A cut meets its blocks by number, so the join is an equi-join; what lies outside the file, or ends before it starts, has no rows.
    ``joined`` puts short windows together.
    """
    spans = cuts.where(F.col("end") > F.greatest(F.col("start"), F.lit(0))).withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("start"), F.lit(0)) / block), F.floor((F.col("end") - 1) / block))))
    n = F.col(channels) if isinstance(channels, str) else channels
    both = spans.join(blocks.select("path", "block", n.alias("_n"), F.col("samples").alias("_s")), ["path", "block"])
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("end") - F.col("block") * block, F.floor(F.size("_s") / F.col("_n")))
    cut = F.slice("_s", (low * F.col("_n") + 1).cast("int"), F.greatest((high - low) * F.col("_n"), F.lit(0)).cast("int"))
    return both.withColumn("samples", cut).where("size(samples) > 0").select(*cuts.columns, "block", "samples")


def joined(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(<by>, samples): the parts of each window as one array; for windows that fit a row."""
    found = F.array_sort(F.collect_list(F.struct("block", "samples")))
    return parts.groupBy(*by).agg(F.flatten(F.transform(found, lambda x: x["samples"])).alias("samples"))
