"""Identifying metadata: synonyms, what to keep of it, and what an output still carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories in order; names of tags and the field they mean.
CATEGORIES = ("location", "capture_time", "device", "descriptive")
SYNONYMS = {
    "location": "location recording_location location_iso6709 iso6709 gps xyz",
    "make": "make manufacturer",
    "model": "model camera_model",
    "software": "software encoder encoding_tool encoded_with creator_tool writing_app muxing_app firmware android_version version source host_computer",
    "lens": "lens lens_model lens_make",
    "serial": "serial serial_number body_serial_number camera_serial_number lens_serial_number identifier device_identifier unique_id",
    "owner": "owner owner_name camera_owner_name",
    "capture_time": "date creation_time creationdate creation_date date_recorded date_released date_encoded date_tagged date_time_original datetime year recorded_date date_time time",
}
#: Names that describe, and are fields by themselves.
DESCRIPTIVE = (
    "title name displayname display_name artist author album album_artist albumartist performer composer copyright comment comments description keywords genre "
    "information director producer publisher license organization contact subject summary synopsis disclaimer warning collection_name encoded_by lyrics grouping "
    "tracknumber track discnumber rating credits artist_url url isrc label"
).split()
_FIELDS = {name: field for field, names in SYNONYMS.items() for name in names.split()} | {name: name for name in DESCRIPTIVE}


def kept_location(latitude: Column, longitude: Column, altitude: Column, name: Column, keep: str) -> Column:
    """MET-01: struct of what stays: nothing, two decimals without altitude and name (``approximate``), or all (``keep``)."""
    if keep == "keep":
        return F.struct(latitude.alias("latitude"), longitude.alias("longitude"), altitude.alias("altitude"), name.alias("name"))
    none = lambda kind: F.lit(None).cast(kind)
    if keep == "approximate":
        return F.struct(F.round(latitude, 2).alias("latitude"), F.round(longitude, 2).alias("longitude"), none("double").alias("altitude"), none("string").alias("name"))
    return F.lit(None).cast("struct<latitude:double,longitude:double,altitude:double,name:string>")


def kept_time(text: Column, keep: str) -> Column:
    """MET-02: nothing, the date alone (``date``), or the text as it is (``keep``)."""
    return text if keep == "keep" else F.substring(text, 1, 10) if keep == "date" else F.lit(None).cast("string")


def kept_device(device: Column, keep: str) -> Column:
    """MET-03: a map of the device's fields: none, all but serial number and owner (``keep``), or all (``all``)."""
    if keep == "strip":
        return F.lit(None).cast("map<string,string>")
    return device if keep == "all" else F.map_filter(device, lambda k, v: ~k.isin("serial", "owner"))


def violations(present: Column, allowed: Column) -> Column:
    """MET-05, SET-06: the categories that an output carries beyond those allowed, sorted."""
    return F.array_sort(F.array_except(present, allowed))


def field_of(tag: Column) -> Column:
    """MET-06: the field that a tag's name means: lower case, blanks and dashes as ``_``; ``unclassified`` if unknown."""
    name = F.regexp_replace(F.lower(tag), "[ -]", "_")
    table = F.create_map(*(F.lit(x) for pair in _FIELDS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), F.lit("unclassified"))


def first_values(tags: DataFrame, asset: str, tag: str, value: str, order: str) -> DataFrame:
    """MET-06: (asset, field, value): the first value of each field that is not blank, without the blanks and NULs around it."""
    text = F.trim(F.regexp_replace(F.trim(F.col(value)), "\\x00+$", ""))
    return tags.withColumn("field", field_of(F.col(tag))).withColumn(value, text).where(F.col(value) != "").groupBy(asset, "field").agg(F.min_by(value, order).alias(value))


def category_sets(tags: DataFrame, asset: str, category: str) -> DataFrame:
    """AGG-13: the set of categories of each asset, sorted."""
    return tags.groupBy(asset).agg(F.array_sort(F.collect_set(category)).alias("categories"))


def stage_sets(a: Column, b: Column) -> Column:
    """SET-05: struct of the union and intersection of two sets, sorted, and whether the first holds the second."""
    return F.struct(F.array_sort(F.array_union(a, b)).alias("united"), F.array_sort(F.array_intersect(a, b)).alias("common"), (F.size(F.array_except(b, a)) == 0).alias("holds"))
