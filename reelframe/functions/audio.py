"""Column functions on interleaved samples: an array of numbers, and its channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .timebase import _c

# Speakers of the usual layouts, and those that each codec has from the narrowest on.
LAYOUTS = {
    "mono": ("FC",), "stereo": ("FL", "FR"), "2.1": ("FL", "FR", "LFE"), "3.0": ("FL", "FR", "FC"), "3.0(back)": ("FL", "FR", "BC"), "3.1": ("FL", "FR", "FC", "LFE"),
    "4.0": ("FL", "FR", "FC", "BC"), "quad": ("FL", "FR", "BL", "BR"), "quad(side)": ("FL", "FR", "SL", "SR"), "4.1": ("FL", "FR", "FC", "LFE", "BC"),
    "5.0": ("FL", "FR", "FC", "BL", "BR"), "5.0(side)": ("FL", "FR", "FC", "SL", "SR"), "5.1": ("FL", "FR", "FC", "LFE", "BL", "BR"), "5.1(side)": ("FL", "FR", "FC", "LFE", "SL", "SR"),
    "6.1": ("FL", "FR", "FC", "LFE", "BC", "SL", "SR"), "7.1": ("FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR"),
}
CARRIED = {
    "opus": ("mono", "stereo", "3.0", "quad", "5.0", "5.1", "6.1", "7.1"),
    "vorbis": ("mono", "stereo", "3.0", "quad", "5.0", "5.1", "6.1", "7.1"),
    "aac": ("mono", "stereo", "3.0", "4.0", "5.0", "5.1", "7.1"),
    "ac3": ("mono", "stereo", "2.1", "3.0", "3.0(back)", "3.1", "4.0", "quad(side)", "4.1", "5.0(side)", "5.1(side)"),
    "eac3": ("mono", "stereo", "2.1", "3.0", "3.0(back)", "3.1", "4.0", "quad(side)", "4.1", "5.0(side)", "5.1(side)", "7.1"),
    "dts": ("mono", "stereo", "2.1", "3.0", "3.0(back)", "3.1", "4.0", "quad(side)", "4.1", "5.0(side)", "5.1(side)"),
}
#: What a codec downmixes to where it carries no layout with a place for every speaker.
DOWNMIX = {"ac3": "5.1(side)", "eac3": "5.1(side)", "dts": "5.1(side)"}
MINUS_3_DB = 0.5**0.5
# Where a speaker goes that the output lacks, by preference: the first group that the output has whole takes it at that gain (0: see ``routes``).
PREFERRED: dict[str, tuple[tuple[tuple[str, ...], float], ...]] = {
    "FC": ((("FL", "FR"), MINUS_3_DB),), "FL": ((("FC",), MINUS_3_DB),), "FR": ((("FC",), MINUS_3_DB),), "LFE": (),
    "BL": ((("SL",), 0), (("BC",), MINUS_3_DB), (("FL",), MINUS_3_DB)), "BR": ((("SR",), 0), (("BC",), MINUS_3_DB), (("FR",), MINUS_3_DB)),
    "SL": ((("BL",), 0), (("BC",), MINUS_3_DB), (("FL",), MINUS_3_DB)), "SR": ((("BR",), 0), (("BC",), MINUS_3_DB), (("FR",), MINUS_3_DB)),
    "BC": ((("BL", "BR"), MINUS_3_DB), (("SL", "SR"), MINUS_3_DB), (("FL", "FR"), 0.5)),
}


def routes(source: Sequence[str], target: Sequence[str]) -> list[tuple[str, str, float]]:
    """(speaker, where it goes, gain) of every speaker of ``source``: to itself, or to the first preferred group that ``target`` has.

    A back and a side speaker are one and the same unless ``source`` has both: only then the one folds into the other at -3 dB.
    """
    out = []
    for name in source:
        groups = [((name,), 1.0), *PREFERRED[name]]
        group, gain = next(((g, v) for g, v in groups if set(g) <= set(target)), ((), 0.0))
        out += [(name, to, gain or (MINUS_3_DB if to in source else 1.0)) for to in group]
    return out


def remix_matrix(source: Sequence[str], target: Sequence[str]) -> list[list[float]]:
    """AUD-01: a row for each output speaker, a gain for each input speaker: ``routes``, or for mono the stereo downmix, each side at -3 dB.

    All gains are divided by the largest sum of a row where that is above 1, so that nothing clips.
    """
    if tuple(target) == ("FC",) and tuple(source) != ("FC",):
        sides = routes(source, ("FL", "FR"))
        gains = [[MINUS_3_DB * sum((g for name, _, g in sides if name == x), 0.0) for x in source]]
    else:
        gains = [[sum((g for name, to, g in routes(source, target) if (name, to) == (x, y)), 0.0) for x in source] for y in target]
    widest = max((sum(r) for r in gains), default=0.0)
    return [[g / widest for g in r] for r in gains] if widest > 1 + 1e-6 else gains


def spellings(source: Sequence[str]) -> list[frozenset[str]]:
    """The sets of speakers that say the same as ``source``: a lone surround pair is back or side, a back centre is itself or half of a pair."""
    out = [frozenset(source)]
    for pair, other in ((("BL", "BR"), ("SL", "SR")), (("SL", "SR"), ("BL", "BR"))):
        if set(pair) <= set(source) and not set(other) & set(source):
            out += [s - set(pair) | set(other) for s in out]
    if "BC" in source:
        out += [s - {"BC"} | set(pair) for s in out for pair in (("BL", "BR"), ("SL", "SR"))]
    return out


def carried_layout(codec: str, source: str) -> str | None:
    """AUD-02: the layout that a codec carries ``source`` in: the first it has, as wide at least, that covers one of its spellings; None if there is none.

    MP3 is mono or stereo, and HE-AAC v2 always stereo.
    """
    if codec in ("mp3", "he_aac_v2"):
        return "mono" if codec == "mp3" and source == "mono" else "stereo"
    wanted = spellings(LAYOUTS[source])
    for name in CARRIED[codec]:
        if len(LAYOUTS[name]) >= len(LAYOUTS[source]) and any(s <= set(LAYOUTS[name]) for s in wanted):
            return name
    return DOWNMIX.get(codec)


def carried(codec, layout) -> Column:
    """AUD-02: ``carried_layout`` of columns; null for unknown names."""
    known = {f"{c}/{name}": carried_layout(c, name) for c in (*CARRIED, "mp3", "he_aac_v2") for name in LAYOUTS}
    table = F.create_map(*(F.lit(x) for k, v in known.items() if v for x in (k, v)))
    return F.try_element_at(table, F.concat(_c(codec), F.lit("/"), _c(layout)))


def remixed(samples, source: Sequence[str], target: Sequence[str]) -> Column:
    """AUD-01: interleaved ``samples`` of one layout as those of another."""
    n, matrix = len(source), remix_matrix(source, target)
    frames = F.sequence(F.lit(0), (F.size(_c(samples)) / n).cast("int") - 1)
    out = lambda i: F.array(*(sum((v * F.element_at(_c(samples), i * n + j + 1) for j, v in enumerate(row) if v), F.lit(0.0)) for row in matrix))
    return F.when(F.size(_c(samples)) >= n, F.flatten(F.transform(frames, out))).otherwise(F.array().cast("array<double>"))


def remixes(spark: SparkSession, layouts: Sequence[str] = tuple(LAYOUTS)) -> DataFrame:
    """AUD-01: (source, target, gains: an array for each output speaker) of every pair of layouts: a few hundred rows, whatever is joined to them."""
    rows = [(a, b, remix_matrix(LAYOUTS[a], LAYOUTS[b])) for a in layouts for b in layouts]
    return spark.createDataFrame(rows, "source string, target string, gains array<array<double>>")


def remixed_by(samples, gains) -> Column:
    """AUD-01: one frame of ``samples`` through the ``gains`` of ``remixes``."""
    return F.transform(_c(gains), lambda row: F.aggregate(F.zip_with(row, _c(samples), lambda g, v: g * v), F.lit(0.0), lambda a, x: a + x))


def channel_map(samples, source: Sequence[str], pairs: Sequence[tuple[str, str]], target: Sequence[str]) -> Column:
    """ARR-01, AUD-04: each output speaker takes the source speaker that a pair names; silence where none does."""
    n, take = len(source), {out: source.index(into) for into, out in pairs}
    frames = F.sequence(F.lit(0), (F.size(_c(samples)) / n).cast("int") - 1)
    pick = lambda i: F.array(*(F.element_at(_c(samples), i * n + take[t] + 1).cast("double") if t in take else F.lit(0.0) for t in target))
    return F.when(F.size(_c(samples)) >= n, F.flatten(F.transform(frames, pick))).otherwise(F.array().cast("array<double>"))


def window(samples, channels: int, first, last) -> Column:
    """AUD-08: the frames [first, last) of interleaved samples."""
    return F.slice(_c(samples), (_c(first) * channels + 1).cast("int"), F.greatest((_c(last) - _c(first)) * channels, F.lit(0)).cast("int"))


def decision(codec, accepted: Sequence[str], channels, most: int, wanted: str) -> Column:
    """AUD-07: ``pass`` an accepted codec within the channels, ``drop`` where nothing is wanted, else ``transcode``."""
    return F.when(F.lit(wanted == "none"), "drop").when(_c(codec).isin(*accepted) & (_c(channels) <= most), "pass").otherwise("transcode")
