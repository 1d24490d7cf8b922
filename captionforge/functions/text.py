"""Column functions: paths, stripping, times and cue blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, all kinds that a text program strips, control separators included.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: The last extension of a path's last part; a leading dot begins no extension.
EXT = r"(?<=[^/.][^/]{0,255})\.[^./]*$"


def strip_text(text: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), STRIP, "")


def output_path(path: Column, ext: str = ".srt") -> Column:
    """The path with its last extension replaced; appended if there is none."""
    return F.concat(F.regexp_replace(path, EXT, ""), F.lit(ext))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, EXT, 0))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def srt_timestamp(seconds: Column) -> Column:
    """Seconds as HH:MM:SS,mmm: null and negative are zero, milliseconds round half to even, hours have no limit."""
    v = F.when(seconds.isNull() | (seconds < 0), 0.0).otherwise(seconds)
    whole = F.floor(v)
    ms = (whole * 1000 + F.rint((v - whole) * 1000).cast("long")).cast("long")
    parts = [F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000]
    return F.format_string("%02d:%02d:%02d,%03d", *(p.cast("long") for p in parts))


def render_cue(number: Column, start: Column, end: Column, text: Column) -> Column:
    """Number, times and text, one line each."""
    return F.concat(number.cast("string"), F.lit("\n"), srt_timestamp(start), F.lit(" --> "), srt_timestamp(end), F.lit("\n"), text, F.lit("\n"))
