"""Language identification by compression: the language whose zstandard dictionary spells a text shortest.

A raw-content dictionary for each language is cut from a bounded sample of labelled texts. Every
whole text is compressed with each; the smallest size names the language. Where the margin to the
next is narrow, the prediction is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import tidy

#: Sampled texts of each language, at most, and bytes of its dictionary.
ROWS, DICTIONARY = 200, 96 << 10
LEVEL = 9
#: Below this score a prediction is marked as rejected.
NARROW = 0.6
UNKNOWN = "und"


def plain(text: str) -> bytes:
    """Lower-case words of letters, a space before each: case, digits, punctuation and markup say little about a language."""
    return (" " + " ".join(_BREAK.split(text.lower())).strip()).encode("utf-8", "replace")


_BREAK = re.compile(r"[\W\d_]+")


def held_out(key: str = "doc_id") -> F.Column:
    """The documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def dictionaries(labelled: DataFrame, rows: int = ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary for each ``lang`` of ``labelled`` (doc_id, text, lang), from ``rows`` texts of it whose ids hash lowest.

    Each text gives an equal share of the bytes, from its first ``size`` characters at most. Languages are
    counted over all rows; the sample is thinned by those counts before it is ranked, so no language's
    rows meet in one task. The most frequent language comes first. The driver holds the counts and the
    dictionaries: one number and ``size`` bytes for each language.
    """
    known = labelled.where("lang is not null and text is not null and length(text) > 0").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    shares = known.sparkSession.createDataFrame([(lang, int((1 << 30) * min(1.0, 2 * rows / n))) for lang, n in counts.items()], "lang string, share long")
    thin = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", F.left("text", F.lit(size)).alias("text"), place.alias("place"))
    table = thin.toArrow().sort_by([("lang", "ascending"), ("place", "ascending"), ("text", "ascending")])
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist(), strict=True):
        if len(texts.setdefault(lang, [])) < rows:
            texts[lang].append(plain(text))
    out = {}
    for lang, found in sorted(texts.items(), key=lambda x: (-counts[x[0]], x[0])):
        share = max(64, size // len(found))
        whole = b"".join(x[:share] for x in found)
        spare = b"".join(x[share:] for x in found)
        out[lang] = (spare[: max(0, size - len(whole))] + whole)[-size:]
    return out


class Sizes:
    """Compressors with a dictionary for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.languages = list(dictionaries)

        def make(lang: str, level: int) -> zstandard.ZstdCompressor:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False)

        self.fast = [make(x, LEVEL) for x in self.languages]
        self.best: list | None = None
        self._make = make

    def of(self, text: bytes) -> np.ndarray:
        """The compressed size with each dictionary; sizes that differ by a byte at most are told apart by a slower level."""
        sizes = np.array([len(c.compress(text)) for c in self.fast], dtype=float)
        if len(sizes) > 1 and np.sum(sizes <= sizes.min() + 1) > 1:
            if self.best is None:
                self.best = [self._make(x, 19) for x in self.languages]
            sizes = (sizes + np.array([len(c.compress(text)) for c in self.best])) / 2
        return sizes

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is the winner's share when a byte less weighs more, the shorter the text."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.of(plain(text))
        weight = np.exp(-(sizes - sizes.min()) / (1 + 0.004 * sizes.min()))
        return self.languages[int(sizes.argmin())], float(weight.max() / weight.sum())


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected (the margin is narrow, or ``und``), in place of columns of such names.

    Null texts and texts without a letter are ``und`` with score 0. Of languages with equal sizes the
    most frequent one is taken. Nothing but the text is read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(dictionaries)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = rest.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(shared.value)
        for batch in batches:
            found = [sizes.predict(x.as_py()) for x in batch.column(at)]
            score = np.array([x[1] for x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array(score), pa.array(score < NARROW)], names=[*rest, "lang_pred", "score", "rejected"])

    return docs.select(rest).mapInArrow(run, docs.select(rest).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))
