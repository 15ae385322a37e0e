"""OME metadata and resolution tags as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_size_um(xml: Column, pixels_per_unit: Column, unit: Column) -> Column:
    """Micrometres a pixel: PhysicalSizeX of the OME header, else the TIFF resolution per cm (3) or inch (2), else 0."""
    size = F.xpath_double(xml, F.lit("//*[local-name()='Pixels']/@PhysicalSizeX"))
    ppu = F.nullif(pixels_per_unit, F.lit(0.0))
    by_tag = F.when(unit == 3, 10000 / ppu).when(unit == 2, 25400 / ppu)
    return F.coalesce(F.when(~F.isnan(size) & (size > 0), size), by_tag, F.lit(0.0))


def channel_names(xml: Column) -> Column:
    """Names of the channels in order; one without a name is Ch and its place; no such header: empty."""
    count = F.coalesce(F.xpath_int(xml, F.lit("count(//*[local-name()='Channel'])")), F.lit(0))
    names = F.xpath(xml, F.lit("//*[local-name()='Channel']/@Name"))
    # a channel without a name gives xpath no row, so names go by place only if all have one
    whole = F.size(names) == count
    marks = F.regexp_extract_all(xml, F.lit("(?s)<(?:\\w+:)?Channel\\b([^>]*)>"), F.lit(1))
    each = F.transform(marks, lambda m, i: F.coalesce(F.nullif(F.regexp_extract(m, r"\bName=\"([^\"]*)\"", 1), F.lit("")), F.concat(F.lit("Ch"), i.cast("string"))))
    return F.when(count == 0, F.array().cast("array<string>")).when(whole, names).otherwise(each)
