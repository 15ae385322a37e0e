"""Display arithmetic on columns: window and level, look-up tables, blending, colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """c held between low and high; NaN and null stay as they are (greatest and least would pass over them)."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def window_level(v: Column, cmin: Column, cmax: Column, brightness: Column, gamma: Column | None = None) -> Column:
    """Intensity to [0, 1]; an empty window is one unit wide; gamma, if other than 1, comes before brightness."""
    v, cmin, cmax = v.cast("double"), cmin.cast("double"), cmax.cast("double")
    top = F.when(cmax <= cmin, cmin + 1).otherwise(cmax)
    n = clip((v - cmin) / (top - cmin), 0.0, 1.0)
    if gamma is not None:
        n = F.when(gamma != 1.0, F.pow(n, 1 / gamma)).otherwise(n)
    return clip(n * brightness, 0.0, 1.0)


def lut_byte(level: Column, cmin: float, cmax: float, brightness: float, gamma: float, part: int) -> Column:
    """Entry of an 8-bit look-up table for an integer level; the window is at least one unit wide, gamma counts from 0.01 off 1."""
    n = clip((level.cast("double") - cmin) / max(1.0, cmax - cmin), 0.0, 1.0)
    if abs(gamma - 1) > 0.01:
        n = F.pow(n, F.lit(1.0 / gamma))
    return clip(clip(n * brightness, 0.0, 1.0) * float(part), 0.0, 255.0).cast("int")


def lut_index(v: Column, size: int) -> Column:
    return clip(v.cast("double"), 0.0, float(size - 1)).cast("int")


def byte_of(c: Column) -> Column:
    """An 8-bit sample: held to [0, 255] and truncated."""
    return clip(c.cast("double"), 0.0, 255.0).cast("int")


def colourised(n: Column, part: Column | int) -> Column:
    return byte_of(n * (F.lit(part) if isinstance(part, int) else part))


def screen_u8(layers: Column) -> Column:
    """Screen blend of 8-bit layers in order, each step truncated."""
    return F.aggregate(layers, F.lit(0).cast("bigint"), lambda a, b: a + b - F.floor(a * b / 255)).cast("int")


def screen_float(layers: Column) -> Column:
    """Screen blend of layers in [0, 1]; the order does not matter."""
    return 1 - F.aggregate(layers, F.lit(1.0), lambda a, b: a * (1 - b))


GOLDEN = 0.618033988749895
SATURATION, VALUE = 0.85, 0.95


def hsv_channel(hue: Column, part: str, s: float = SATURATION, v: float = VALUE) -> Column:
    """One of r, g, b of a hue in [0, 1), as an 8-bit sample."""
    sixth = F.floor(hue * 6)
    f = hue * 6 - sixth
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * f), v * (1 - s * (1 - f))
    by = {"r": (F.lit(v), q, p, p, t, F.lit(v)), "g": (t, F.lit(v), F.lit(v), q, p, p), "b": (p, p, t, F.lit(v), F.lit(v), q)}[part]
    out = by[5]
    for k in range(4, -1, -1):
        out = F.when(sixth % 6 == k, by[k]).otherwise(out)
    return F.floor(out * 255).cast("int")


def cell_hue(cell_id: Column) -> Column:
    x = cell_id.cast("double") * GOLDEN
    return x - F.floor(x)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.format_string("#%02x%02x%02x", r, g, b))


def hex_part(colour: Column, place: int) -> Column:
    """Sample 0, 1 or 2 of #rrggbb."""
    return F.conv(F.substring(colour, 2 + 2 * place, 2), 16, 10).cast("int")


def lerp_hex(a: Column, b: Column, t: Column) -> Column:
    parts = [(hex_part(a, k) + (hex_part(b, k) - hex_part(a, k)) * t).cast("int") for k in range(3)]
    return hex_colour(*parts)


def ramp(preset: str, v: Column) -> Sequence[Column]:
    """(r, g, b) in [0, 1] of a preset at v in [0, 1]."""
    up = lambda k, off: clip(v * k - off, 0.0, 1.0)
    # Slopes and offsets of the presets.
    return {
        "Grays": (v, v, v),
        "Fire": (up(3, 0), up(3, 1), up(3, 2)),
        "Ice": (up(3, 2), up(3, 1), up(3, 0)),
        "GreenFire": (up(2, 1), up(2, 0), up(3, 2)),
    }[preset]
