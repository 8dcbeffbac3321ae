"""Column functions on colour descriptions, sample aspects and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timebase import _c

# Transfer codes of the standard and what they mean; bytes of a frame as halves of a byte for each pixel.
TRANSFERS = {1: "bt709", 4: "bt470bg", 6: "bt709", 8: "linear", 14: "bt709", 15: "bt709", 16: "pq", 18: "hlg"}
HALF_BYTES = {"yuv420p": 3, "nv12": 3, "yuv422p": 4, "yuv444p": 6, "rgb24": 6, "rgba": 8, "yuv420p10": 6, "yuv422p10": 8, "yuv444p10": 12, "gray8": 2}


def transfer(code) -> Column:
    """The transfer curve of a code, ``unspecified`` for others."""
    out = F.lit("unspecified")
    for k, v in TRANSFERS.items():
        out = F.when(_c(code) == k, v).otherwise(out)
    return out


def frame_bytes(format_, width, height) -> Column:
    """Bytes of a frame; null for an unknown format. Chroma of odd sizes is rounded up for 4:2:0 and 4:2:2."""
    w, h = _c(width).cast("long"), _c(height).cast("long")
    cw, ch = F.floor((w + 1) / 2), F.floor((h + 1) / 2)
    out = F.lit(None).cast("long")
    for name, halves in HALF_BYTES.items():
        deep = 2 if name.endswith("10") else 1
        size = (w * h + 2 * cw * ch) * deep if "420" in name or name == "nv12" else (w * h + 2 * cw * h) * deep if "422" in name else w * h * halves / 2
        out = F.when(_c(format_) == name, size.cast("long")).otherwise(out)
    return out


def resolved(container, bitstream, height) -> Column:
    """CLR-09: what the container says, else the bitstream, else BT.601 for pictures below 720 lines and BT.709 for others."""
    return F.coalesce(_c(container), _c(bitstream), F.when(_c(height) < 720, "bt601").otherwise("bt709"))


def gcd(a, b) -> Column:
    """The greatest common divisor, by Euclid's steps: 92 are enough for 64 bits."""
    start = F.struct(F.abs(_c(a).cast("long")).alias("a"), F.abs(_c(b).cast("long")).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))), lambda s: s["a"])


def sample_aspect(container_num, container_den, stream_num, stream_den) -> Column:
    """SRC-36: struct(num, den) in lowest terms: the container's where both are positive, else the bitstream's, else 1:1."""
    own, other = (_c(container_num) > 0) & (_c(container_den) > 0), (_c(stream_num) > 0) & (_c(stream_den) > 0)
    pick = lambda x, y: F.when(own, _c(x)).when(other, _c(y)).otherwise(1).cast("long")
    num, den = pick(container_num, stream_num), pick(container_den, stream_den)
    return F.struct(F.floor(num / gcd(num, den)).alias("num"), F.floor(den / gcd(num, den)).alias("den"))


def to_source(x, y, scale, left, top) -> Column:
    """ARR-02: struct(x, y) in the source of a point in a letterboxed picture."""
    return F.struct(((_c(x) - _c(left)) / _c(scale)).alias("x"), ((_c(y) - _c(top)) / _c(scale)).alias("y"))


def decoded_text(content) -> Column:
    """TXT-08: text of bytes: UTF-16 by its mark, else UTF-8; null where the bytes are no UTF-8."""
    b = _c(content)
    mark = F.hex(F.substring(b, 1, 2))
    body = F.substring(b, 3, 2**31 - 1)
    return F.when(mark == "FEFF", F.decode(body, "UTF-16BE")).when(mark == "FFFE", F.decode(body, "UTF-16LE")).otherwise(F.try_validate_utf8(b.cast("string")))
