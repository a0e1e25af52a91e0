"""Colours of levels: palettes as small tables made from rules, and lookups that stay inside an expression."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, functions as F

#: Fixed values of the light-level palette: end of a band in percent, hue in degrees, saturation, brightness.
LIGHT_BANDS = (
    (10, 0, 0, 0.0),
    (20, 0, 0, 0.1),
    (30, 0, 0, 0.2),
    (40, 0, 0, 0.3),
    (50, 0, 0, 0.4),
    (60, 0, 1, 0.5),
    (70, 30, 1, 0.6),
    (80, 60, 1, 0.7),
    (90, 120, 1, 0.8),
    (95, 240, 1, 0.9),
    (99, 0, 0, 244 / 255),
    (100, 0, 0, 1.0),
)


def rgb(hue: float, saturation: float, brightness: float) -> int:
    """0xRRGGBB, each part truncated."""
    r, g, b = (int(x * 255) for x in colorsys.hsv_to_rgb(hue / 360, saturation, brightness))
    return r << 16 | g << 8 | b


def grayscale(size: int = 256) -> list[int]:
    return [(255 * k // (size - 1)) * 0x10101 for k in range(size)]


def light_levels() -> list[int]:
    """A hundred colours, one for each percent."""
    starts = (0, *[b[0] for b in LIGHT_BANDS])
    return [rgb(h, s, v) for start, (end, h, s, v) in zip(starts, LIGHT_BANDS, strict=False) for _ in range(start, end)]


def indexed(palette: list[int], index: Column) -> Column:
    """The colour of an index, which is held inside the palette."""
    at = F.greatest(F.lit(0), F.least(F.lit(len(palette) - 1), index))
    return F.get(F.array(*[F.lit(c) for c in palette]), at)


def at_or_above(bounds: list[float], colours: list[int], value: Column) -> Column:
    """The colour of the first bound that is not below the value; the last one beyond all bounds."""
    out = F.lit(colours[-1])
    for b, c in zip(reversed(bounds), reversed(colours), strict=True):
        out = F.when(value <= b, c).otherwise(out)
    return out
