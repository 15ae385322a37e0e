"""String, time and number expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"  # the sign of a negative marker is U+2212, not a hyphen


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def channel_token(path: Column, dashes: bool = False) -> Column:
    """A channel's name from its file: what follows the last underscore; in merges a dash counts as one."""
    name = F.translate(stem(path), "-", "_") if dashes else stem(path)
    return F.element_at(F.split(name, "_"), -1)


def is_nuclear(name: Column) -> Column:
    return F.lower(name).rlike("dapi|hoechst|nuclear")


def name_or(label: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), default)


def pretty_time(iso: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """An ISO time in a pattern; what is no time keeps its first 16 characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), pattern), F.substring(iso, 1, 16))


def fenced_edits(text: Column) -> Column:
    """array<struct<path, body>> of fenced blocks that name a file."""
    pattern = F.lit("(?s)```(?:python)?:([^\\n]+)\\n(.*?)```")
    paths, bodies = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.arrays_zip(paths.alias("path"), bodies.alias("body"))


def without_edits(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?s)```(?:python)?:[^\\n]+\\n.*?```", ""))


def clipped(text: Column, size: int, tail: str = "") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(tail))).otherwise(text)


def has_any(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def model_name(name: Column) -> Column:
    return F.regexp_replace(name, "^models/", "")


#: Widths of a scale bar that read well, in micrometres.
BAR_WIDTHS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)


def scale_bar(zoom: Column, ds: Column, pixel_um: Column) -> Column:
    """struct<bar_px, label>: the first width whose bar is 60 to 250 pixels, else 100 pixels of what that is."""
    z = F.greatest(zoom / F.greatest(ds, F.lit(1.0)), F.lit(0.001))
    per_um = z / F.nullif(pixel_um, F.lit(0.0))
    fit = F.get(F.filter(F.array(*map(F.lit, BAR_WIDTHS)), lambda w: (w * per_um >= 60) & (w * per_um <= 250)), 0)
    um = F.coalesce(fit.cast("bigint"), (100 / F.greatest(per_um, F.lit(0.001))).cast("bigint"))
    label = F.when(um >= 1000, F.concat(F.floor(um / 1000).cast("string"), F.lit(" mm"))).otherwise(F.concat(um.cast("string"), F.lit(" µm")))
    px = F.when(fit.isNotNull(), (fit * per_um).cast("int")).otherwise(F.lit(100))
    plain = F.concat((100 / z).cast("bigint").cast("string"), F.lit(" px"))
    return F.when(pixel_um > 0, F.struct(px.alias("bar_px"), label.alias("label"))).otherwise(F.struct(F.lit(100).alias("bar_px"), plain.alias("label")))
