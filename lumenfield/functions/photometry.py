"""Light on a surface as column expressions: discs over horizons, slopes, temperature, classes, quantised levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from lumenfield.functions.geometry import BINS

#: Disc half-width in degrees, half-disc columns, albedo, emissivity, solar constant, Stefan-Boltzmann, floor in K.
HALF, COLUMNS = 0.27, 16
ALBEDO, EMISSIVITY, SOLAR, SIGMA, COLDEST = 0.15, 0.975, 1336.0, 5.670367e-8, 40.0


def half_disc() -> list[float]:
    return [HALF * math.sqrt(64 - (7.5 - i) ** 2) / 8 for i in range(COLUMNS)]


def disc_fraction(horizon: Column, azimuth: Column, elevation: Column) -> Column:
    """The share of a disc above an array of 1440 elevations, all in degrees.

    Sixteen columns cross the disc; the horizon is interpolated under each. The first bin is the start
    truncated towards zero, so a start below 0 is extrapolated.
    """
    start = (azimuth - HALF - 0.125) * 4
    first = F.when(start < 0, F.ceil(start)).otherwise(F.floor(start)).cast("int")
    base = (first + BINS) % BINS
    total = F.lit(0.0)
    for k, c in enumerate(half_disc()):  # written out, so that all of it is compiled and what columns share is computed once
        g = start - first + k * (HALF / 2)
        o = F.greatest(F.lit(0), F.floor(g).cast("int"))
        a, b = F.get(horizon, (base + o) % BINS), F.get(horizon, (base + o + 1) % BINS)
        total = total + F.greatest(F.lit(0.0), F.least(F.lit(2 * c), elevation + c - (a + (g - o) * (b - a))))
    return total / (2 * sum(half_disc()))


def segment_fraction(horizon_deg: Column, elevation: Column, radius: float = 0.25) -> Column:
    """The share of a disc above a flat horizon, by circular segment."""
    d = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (horizon_deg - elevation) / radius))
    return (F.acos(d) - d * F.sqrt(1 - d * d)) / math.pi


def over_horizon(horizon: Column, azimuth_rad: Column, elevation_deg: Column) -> Column:
    """Degrees over the horizon, interpolated between its bins."""
    k = azimuth_rad * ((BINS - 1) / (2 * math.pi))
    i = F.floor(k).cast("int")
    a, b = F.get(horizon, i), F.get(horizon, (i + 1) % BINS)
    return elevation_deg - (a + (k - i) * (b - a))


def above(horizon: Column, azimuth_rad: Column, elevation_deg: Column) -> Column:
    return elevation_deg > F.get(horizon, F.floor(0.5 + azimuth_rad * ((BINS - 1) / (2 * math.pi))).cast("int"))


def slopes_to_degrees(slopes: Column) -> Column:
    return F.transform(slopes, lambda s: F.degrees(F.atan(s)))


def temperature(cosine: Column, fraction: Column) -> Column:
    """Kelvin in equilibrium with the light."""
    return F.greatest(F.lit(COLDEST), F.pow(SOLAR * (1 - ALBEDO) * F.greatest(F.lit(0.0), cosine) * fraction / (EMISSIVITY * SIGMA), F.lit(0.25)))


def zone(depth: Column) -> Column:
    return F.when(depth < 0, 0).when(depth < 0.5, 1).when(depth < 1, 2).otherwise(3)


def depth_class(depth: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), depth) * 4).cast("int")


def byte_level(x: Column, scale: float = 255.0) -> Column:
    """Truncated to 0..255 as an unsigned byte wraps."""
    return F.pmod((x * scale).cast("int"), F.lit(256))


def slope_code(slope: Column) -> Column:
    """Slopes clamped to 2 either way, as integers for order-free maxima."""
    return (F.greatest(F.lit(-2.0), F.least(F.lit(2.0), slope)) / 4 * 1e6).cast("int")


def code_slope(code: Column) -> Column:
    return code * 4 / 1e6


def rgb565(v: Column) -> tuple[Column, Column, Column]:
    part = lambda shift, bits: F.shiftright(v, shift).bitwiseAND(F.lit((1 << bits) - 1)) * 255 / ((1 << bits) - 1)
    return tuple(F.floor(x).cast("int") for x in (part(11, 5), part(5, 6), part(0, 5)))


def rgb555(v: Column) -> tuple[Column, Column, Column]:
    part = lambda shift: F.shiftright(v, shift).bitwiseAND(F.lit(31)) * 255 / 31
    return tuple(F.floor(part(shift)).cast("int") for shift in (10, 5, 0))


def argb1555(v: Column) -> tuple[Column, Column, Column, Column]:
    """rgb555 after the top bit's 0 or 255."""
    return ((F.shiftright(v, 15).bitwiseAND(F.lit(1)) * 255).cast("int"), *rgb555(v))


def nibbles(v: Column) -> tuple[Column, Column]:
    """A byte's high and low four bits."""
    return F.shiftright(v, 4).bitwiseAND(F.lit(15)).cast("int"), v.bitwiseAND(F.lit(15)).cast("int")


def hsv_rgb(hue: Column, saturation: Column, value: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue in 0..1 of a hue in degrees, saturation and value in 0..1."""
    part = lambda n: F.pmod(F.lit(float(n)) + hue / 60, F.lit(6.0))
    return tuple(value - value * saturation * F.greatest(F.lit(0.0), F.least(part(n), 4 - part(n), F.lit(1.0))) for n in (5, 3, 1))
