"""Polar grid geometry as column expressions: pixels, tiles, latitude and longitude, body-fixed points, local angles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Fixed values of the data format: grid size, centre offset, km a pixel, body radius in km, tile size, horizon bins.
GRID, CENTRE, SCALE, RADIUS, TILE, BINS = 30400, 15199.5, 0.02, 1737.4, 128, 1440


@dataclass(frozen=True)
class Pole:
    """A hemisphere is a value that callers pass, never a global."""

    south: bool = True

    @property
    def lat(self) -> float:
        return -math.pi / 2 if self.south else math.pi / 2

    @property
    def sign(self) -> float:
        return 1.0 if self.south else -1.0


def plane_xy(line: Column, sample: Column) -> tuple[Column, Column]:
    """Kilometres in the projection's plane."""
    return (sample - CENTRE) * SCALE, (F.lit(CENTRE) - line) * SCALE


def lat_lon(line: Column, sample: Column, pole: Pole = Pole()) -> tuple[Column, Column]:
    """Radians, by inverse polar stereographic projection on a sphere."""
    x, y = plane_xy(line, sample)
    p = F.sqrt(x * x + y * y)
    c = 2 * F.atan2(p, F.lit(2 * RADIUS))
    lat = F.asin(F.cos(c) * math.sin(pole.lat) + F.when(y == 0, 0.0).otherwise(y * F.sin(c) * math.cos(pole.lat) / F.when(p == 0, 1.0).otherwise(p)))
    return lat, F.atan2(x, y * pole.sign)


def pixel_of(lat: Column, lon: Column, pole: Pole = Pole()) -> tuple[Column, Column]:
    """(line, sample) as doubles, exactly."""
    half = math.pi / 4 + (lat / 2 if pole.south else -lat / 2)
    p = 2 * RADIUS * F.tan(half)
    x, y = p * F.sin(lon), p * F.cos(lon) * pole.sign
    return CENTRE - y / SCALE, x / SCALE + CENTRE


def body_point(lat: Column, lon: Column, height_m: Column) -> tuple[Column, Column, Column]:
    """Kilometres in the body-fixed frame."""
    r = height_m / 1000 + RADIUS
    return r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)


def point_lat_lon(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.atan2(z, F.sqrt(x * x + y * y)), F.atan2(y, x)


def local_frame(x: Column, y: Column, z: Column, at: tuple[Column, Column, Column], lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A body-fixed point in the frame of a surface point: moved there, then turned by its longitude and colatitude."""
    dx, dy, dz = x - at[0], y - at[1], z - at[2]
    ex = dx * F.cos(lon) + dy * F.sin(lon)
    ey = dy * F.cos(lon) - dx * F.sin(lon)
    return ex * F.sin(lat) - dz * F.cos(lat), ey, ex * F.cos(lat) + dz * F.sin(lat)


def az_el(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Azimuth from 0 to two pi, and elevation, in radians."""
    return F.atan2(y, x) + math.pi, F.atan2(z, F.sqrt(x * x + y * y))


def horizon_bin(azimuth: Column) -> Column:
    return F.floor(0.5 + azimuth * ((BINS - 1) / (2 * math.pi))).cast("int")


def tile_of(line: Column, sample: Column) -> tuple[Column, Column]:
    """(id_x, id_y)."""
    return F.floor(sample / TILE).cast("int"), F.floor(line / TILE).cast("int")


def covering(left: int, top: int, width: int, height: int, whole: bool = False) -> tuple[range, range]:
    """Tile ids that a rectangle covers; the last, partial ones only if ``whole``."""
    more = TILE - 1 if whole else 0
    return range(left // TILE, (left + width + more) // TILE), range(top // TILE, (top + height + more) // TILE)


def degrees_minutes(text: Column, negative: str, limit: int) -> Column:
    """Signed degrees from a text such as 12°34'56.7"N; null where it is none or beyond the limit."""
    pattern = r"^\s*(\d+)[°d ]\s*(\d+)['m ]\s*(\d+(?:\.\d+)?)[\"s ]?\s*([NSEWnsew])\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    value = part(1) + part(2) / 60 + part(3) / 3600
    signed = F.when(F.upper(F.regexp_extract(text, pattern, 4)) == negative, -value).otherwise(value)
    return F.when(F.abs(signed) <= limit, signed)


def pixel_index(lat: Column, lon: Column, pole: Pole = Pole()) -> tuple[Column, Column]:
    """(line, sample) as integers, with the offsets and truncation that product files use."""
    line, sample = pixel_of(lat, lon, pole)
    return (F.lit(GRID) + (1 - F.lit(2 * CENTRE) + line).cast("int")).cast("int"), (sample + 1.5).cast("int")


def image_to_grid(row: Column, column: Column, origin: tuple[float, float], cell: float) -> tuple[Column, Column]:
    """(line, sample) of an image's pixel in the same projection; origin and cell of the image in metres."""
    return CENTRE - (origin[1] - row * cell) / (1000 * SCALE), CENTRE + (origin[0] + column * cell) / (1000 * SCALE)


def to_map(screen: Column, offset: float, scale: float) -> Column:
    return (screen - offset) * scale


def to_screen(place: Column, offset: float, scale: float) -> Column:
    return place / scale + offset


def ephemeris_seconds(time: Column, offset: int = 5, whole: bool = False) -> Column:
    """Seconds from noon of 2000-01-01 with a fixed offset, of whole seconds if asked; the offsets in use are 5, 3, and 3 with whole seconds."""
    us = F.unix_micros(time.cast("timestamp")) - F.unix_micros(F.lit("2000-01-01 12:00:00").cast("timestamp"))
    return F.floor(us / 1_000_000) + float(offset) if whole else us / 1_000_000 + offset
