"""Readers that give media relations: containers by their first bytes, cues, playlists and job manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.picture import container_kind
from ..functions.text import strip_markup


def assets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-01: (path, length, container) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", container_kind(F.col("content")).alias("container"))


def _milliseconds(stamp: Column) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(stamp, r"(?:(\d+):)?(\d+):(\d+)[.,](\d{3})", i), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)


def cues(spark: SparkSession, path: str) -> DataFrame:
    """SRC: (path, start, duration, text), in milliseconds, of WebVTT and SubRip files; text without markup."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    blocks = files.select("path", F.explode(F.split("value", r"\n[ \t]*\n+")).alias("block"))
    stamp = r"((?:\d+:)?\d+:\d+[.,]\d{3})\s+-->\s+((?:\d+:)?\d+:\d+[.,]\d{3})[^\n]*\n?([\s\S]*)"
    parts = blocks.where(F.col("block").rlike(stamp)).select("path", *(F.regexp_extract("block", stamp, i).alias(f"_{i}") for i in (1, 2, 3)))
    start = _milliseconds(F.col("_1"))
    return parts.select("path", start.alias("start"), (_milliseconds(F.col("_2")) - start).alias("duration"), strip_markup("_3", "webvtt").alias("text"))


def playlist(spark: SparkSession, path: str) -> DataFrame:
    """SRC: (path, sequence, seconds, uri) of HLS media playlists."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    first = F.coalesce(F.nullif(F.regexp_extract("value", r"#EXT-X-MEDIA-SEQUENCE:(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    found = F.regexp_extract_all("value", F.lit(r"#EXTINF:[0-9.]+,[^\n]*\n(?:#[^\n]*\n)*[^#\n][^\n]*"), F.lit(0))
    rows = files.select("path", first.alias("_first"), F.posexplode(found).alias("_n", "_x"))
    return rows.select("path", (F.col("_first") + F.col("_n")).alias("sequence"), F.regexp_extract("_x", r"#EXTINF:([0-9.]+)", 1).cast("double").alias("seconds"), F.regexp_extract("_x", r"([^\n]*)$", 1).alias("uri"))


def manifest(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """SRC, JON-07: the jobs of a batch manifest (JSON with ``defaults`` and ``jobs``), each with the defaults for what it leaves open."""
    whole = spark.read.option("multiLine", "true").json(path)
    job = dict(whole.selectExpr("explode(jobs) as j").select("j.*").dtypes)
    base = dict(whole.select("defaults.*").dtypes) if "defaults" in whole.columns else {}
    one = whole.select(F.posexplode("jobs").alias("job", "j"), *([F.col("defaults").alias("d")] if base else []))
    pick = lambda f: F.coalesce(*([F.col(f"j.{f}")] if f in job else []), *([F.col(f"d.{f}")] if f in base else []), F.lit(None))
    return one.select("job", *(pick(f).alias(f) for f in fields))


def write_playlists(playlists: DataFrame, path: str, rendition: str) -> None:
    """SNK: the playlist texts, a folder for each rendition."""
    playlists.select(rendition, F.col("playlist").alias("value")).write.partitionBy(rendition).mode("overwrite").text(path)
