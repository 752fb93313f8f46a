"""Frame names: camera and capture time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Camera letter, then YYYY_MM_DD_HH_MM_SS_micros.
NAME = r"^([A-Za-z])_(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})_(\d{2})_(\d{6})(?!\d)"


def camera(name: Column) -> Column:
    """First letter of the name, in upper case; null for null, '' for the empty name."""
    return F.upper(F.substring(name, 1, 1))


def capture_time(name: Column) -> Column:
    """Timestamp in the name; null if there is none or it is no valid time."""
    digits = F.concat_ws(" ", F.concat_ws("-", *[F.regexp_extract(name, NAME, i) for i in (2, 3, 4)]), F.concat_ws(":", *[F.regexp_extract(name, NAME, i) for i in (5, 6, 7)]))
    text = F.concat(digits, F.lit("."), F.regexp_extract(name, NAME, 8))
    return F.when(name.rlike(NAME), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


def recording(dataset: Column) -> Column:
    """'' names the shipped recording, as does null; closing slashes make no other recording."""
    return F.regexp_replace(F.trim(F.coalesce(dataset, F.lit(""))), r"[\\/]+$", "")
