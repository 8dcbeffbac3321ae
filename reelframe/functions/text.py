"""Column functions on cue text, language tags, metadata text and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .timebase import _c

# Fixed values: (ISO 639-2/T, 639-2/B, 639-1, name).
LANGUAGES = (
    ("ara", "", "ar", "Arabic"),
    ("bul", "", "bg", "Bulgarian"),
    ("cat", "", "ca", "Catalan"),
    ("ces", "cze", "cs", "Czech"),
    ("cym", "wel", "cy", "Welsh"),
    ("dan", "", "da", "Danish"),
    ("deu", "ger", "de", "German"),
    ("ell", "gre", "el", "Greek"),
    ("eng", "", "en", "English"),
    ("est", "", "et", "Estonian"),
    ("eus", "baq", "eu", "Basque"),
    ("fas", "per", "fa", "Persian"),
    ("fin", "", "fi", "Finnish"),
    ("fra", "fre", "fr", "French"),
    ("gle", "", "ga", "Irish"),
    ("glg", "", "gl", "Galician"),
    ("heb", "", "he", "Hebrew"),
    ("hin", "", "hi", "Hindi"),
    ("hrv", "", "hr", "Croatian"),
    ("hun", "", "hu", "Hungarian"),
    ("ind", "", "id", "Indonesian"),
    ("isl", "ice", "is", "Icelandic"),
    ("ita", "", "it", "Italian"),
    ("jpn", "", "ja", "Japanese"),
    ("kat", "geo", "ka", "Georgian"),
    ("kor", "", "ko", "Korean"),
    ("lav", "", "lv", "Latvian"),
    ("lit", "", "lt", "Lithuanian"),
    ("mkd", "mac", "mk", "Macedonian"),
    ("msa", "may", "ms", "Malay"),
    ("nld", "dut", "nl", "Dutch"),
    ("nor", "", "no", "Norwegian"),
    ("nob", "", "nb", "Norwegian Bokmål"),
    ("nno", "", "nn", "Norwegian Nynorsk"),
    ("pol", "", "pl", "Polish"),
    ("por", "", "pt", "Portuguese"),
    ("ron", "rum", "ro", "Romanian"),
    ("rus", "", "ru", "Russian"),
    ("slk", "slo", "sk", "Slovak"),
    ("slv", "", "sl", "Slovenian"),
    ("spa", "", "es", "Spanish"),
    ("srp", "", "sr", "Serbian"),
    ("swe", "", "sv", "Swedish"),
    ("tam", "", "ta", "Tamil"),
    ("tha", "", "th", "Thai"),
    ("tur", "", "tr", "Turkish"),
    ("ukr", "", "uk", "Ukrainian"),
    ("vie", "", "vi", "Vietnamese"),
    ("zho", "chi", "zh", "Chinese"),
)


def language_table(spark: SparkSession) -> DataFrame:
    """(code, tag, name): a row for each spelling of each language."""
    rows = [(code, one, name) for t, b, one, name in LANGUAGES for code in {t, b, one} if code]
    return spark.createDataFrame(rows, "code string, tag string, name string")


def normalised_language(df: DataFrame, column: str, tag: str = "tag", name: str = "name") -> DataFrame:
    """PRJ-07: ``df`` with the BCP-47 tag and English name of a code: unknown codes pass in lower case, empty ones are ``und``.

    The table has a fixed size, below 200 rows, and is broadcast.
    """
    table = language_table(df.sparkSession).select(F.col("code").alias("_code"), F.col("tag").alias("_tag"), F.col("name").alias("_name"))
    code = F.lower(F.trim(F.coalesce(_c(column), F.lit(""))))
    out = df.withColumn("_key", code).join(F.broadcast(table), F.col("_key") == F.col("_code"), "left")
    known = F.coalesce("_tag", F.when(F.col("_key") == "", "und").otherwise(F.col("_key")))
    return out.withColumn(tag, known).withColumn(name, F.coalesce("_name", "_key")).drop("_key", "_code", "_tag", "_name")


def strip_markup(text, kind: str = "html") -> Column:
    """TXT-01: plain cue text. ``ass``: the ninth comma field on (after ``Dialogue:`` the tenth), without ``{...}``, ``\\N`` as a line
    break; others without ``<...>``; ``webvtt`` decodes entities as well. Trimmed."""
    t = _c(text)
    if kind == "ass":
        fields = F.when(t.startswith("Dialogue:"), F.regexp_extract(t, r"^(?:[^,]*,){9}([\s\S]*)$", 1)).otherwise(F.regexp_extract(t, r"^(?:[^,]*,){8}([\s\S]*)$", 1))
        return F.trim(F.regexp_replace(F.regexp_replace(fields, r"\{[^}]*\}", ""), r"\\[Nn]", "\n"))
    plain = F.regexp_replace(t, r"<[^>]*>", "")
    if kind == "webvtt":
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
            plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.btrim(plain, F.lit(" \t\r\n"))


def escape_cue(text) -> Column:
    """TXT-02: entities for ``& < >``, no white space at line ends, no blank lines."""
    t = _c(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    lines = F.transform(F.split(t, "\n"), lambda x: F.rtrim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def iso6709(latitude, longitude, altitude=None) -> Column:
    """TXT-07: signed degrees, four decimals, and the altitude in metres where there is one."""
    part = lambda x, width: F.concat(F.when(x < 0, "-").otherwise("+"), F.lpad(F.format_string("%.4f", F.abs(x)), width, "0"))
    out = F.concat(part(_c(latitude), 7), part(_c(longitude), 8))
    if altitude is not None:
        out = F.concat(out, F.coalesce(F.concat(F.when(_c(altitude) < 0, "-").otherwise("+"), F.format_string("%.3f", F.abs(_c(altitude)))), F.lit("")))
    return F.concat(out, F.lit("/"))


def parse_iso6709(text) -> Column:
    """TXT-07: struct(latitude, longitude, altitude) of a string in decimal degrees; null where it is none."""
    pattern = r"^([+-][0-9]{1,2}(?:\.[0-9]+)?)([+-][0-9]{1,3}(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)?/?$"
    part = lambda i: F.nullif(F.regexp_extract(_c(text), pattern, i), F.lit("")).try_cast("double")
    found = F.struct(part(1).alias("latitude"), part(2).alias("longitude"), part(3).alias("altitude"))
    return F.when(part(1).between(-90, 90) & part(2).between(-180, 180), found)


def quicktime_seconds(value) -> Column:
    """TXT-06: seconds since 1904 as Unix seconds."""
    return _c(value) - 2_082_844_800


def normalised_date(text) -> Column:
    """TXT-05: RFC 3339 where the text is a full date or date and time, else the text as written."""
    t = F.trim(_c(text))
    form = r"^(\d{4})[-:/](\d{2})[-:/](\d{2})(?:[T ](\d{2}:\d{2}:\d{2})(?:\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
    part = lambda i: F.regexp_extract(t, form, i)
    day = F.concat_ws("-", part(1), part(2), part(3))
    zone = F.when(part(5) == "", "Z").when(F.length(part(5)) == 5, F.concat(F.substring(part(5), 1, 3), F.lit(":"), F.substring(part(5), 4, 2))).otherwise(part(5))
    return F.when(F.expr("try_to_timestamp(regexp_replace(substring(trim({0}), 1, 10), '[:/]', '-'), 'yyyy-MM-dd')".format(text)).isNull() if isinstance(text, str) else F.lit(False), t).when(t.rlike(form) & (part(4) != ""), F.concat(day, F.lit("T"), part(4), zone)).when(t.rlike(form), day).otherwise(t)


def file_stem(path) -> Column:
    """TXT-15: the name of a file without its folder and extension, other characters than letters, digits, ``-``, ``_`` and ``.`` as ``_``."""
    name = F.regexp_replace(F.regexp_extract(_c(path), r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    return F.when(clean == "", "untitled").otherwise(clean)


def hash_hex(value) -> Column:
    """TXT-14: 16 lower-case digits."""
    return F.lpad(F.lower(F.hex(_c(value).cast("long"))), 16, "0")


def hex_hash(text) -> Column:
    """TXT-14: the 64-bit value of up to 16 hex digits, with or without ``0x``; null for others."""
    digits = F.regexp_extract(F.lower(F.trim(_c(text))), r"^(?:0x)?([0-9a-f]{1,16})$", 1)
    full = F.lpad(digits, 16, "0")
    half = lambda i: F.conv(F.substring(full, i, 8), 16, 10).cast("long")
    high = F.when(half(1) >= 2**31, half(1) - 2**32).otherwise(half(1))
    return F.when(digits != "", high * F.lit(2**32) + half(9))


def digests(content) -> Column:
    """AGG-18: struct(sha256, sha1, md5) in lower-case hex."""
    b = _c(content).cast("binary")
    return F.struct(F.sha2(b, 256).alias("sha256"), F.sha1(b).alias("sha1"), F.md5(b).alias("md5"))


def rung_text(text) -> Column:
    """TXT-13: struct(width, height, bitrate, flags) of ``WxH@RATE:flag,flag``; null where it is none."""
    form = r"^([0-9]+)x([0-9]+)(?:@([0-9.]+[kKmM]?))?(?::([a-z0-9_,=-]+))?$"
    part = lambda i: F.regexp_extract(F.trim(_c(text)), form, i)
    from .timebase import bits_per_second

    flags = F.when(part(4) == "", F.array().cast("array<string>")).otherwise(F.split(part(4), ","))
    return F.when(F.trim(_c(text)).rlike(form), F.struct(part(1).try_cast("int").alias("width"), part(2).try_cast("int").alias("height"), bits_per_second(part(3)).alias("bitrate"), flags.alias("flags")))


def key_values(line, allowed: Sequence[str]) -> Column:
    """TXT-12: struct(pairs, unknown) of ``key=value`` parts between blanks; unknown lists keys that are not allowed."""
    pairs = F.str_to_map(F.trim(_c(line)), F.lit(r"\s+"), F.lit("="))
    return F.struct(F.map_filter(pairs, lambda k, v: k.isin(*allowed)).alias("pairs"), F.array_sort(F.filter(F.map_keys(pairs), lambda k: ~k.isin(*allowed) & (k != ""))).alias("unknown"))


# The names that encoders leave in files, as the prefixes they start with.
ENCODERS = ("Lavc", "Lavf", "LAME", "libfaac", "FAAC", "Nero", "FhG", "iTunes", "GPAC", "libvorbis")


def encoder_idents(content) -> Column:
    """TXT-16: the distinct encoder names in bytes or text, by prefix and then place, each with the version of 16 digits and dots at most that follows it."""
    text = F.decode(_c(content).cast("binary"), "ISO-8859-1")
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(rf"{name}[0-9.]{{0,16}}"), F.lit(0)) for name in ENCODERS)))
