"""Vectors of three columns: products, affine transforms, surface normals, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vector) -> Vector:
    """Of length 1; null where the length is 0."""
    n = F.sqrt(dot(a, a))
    return tuple(F.when(n > 0, x / n) for x in a)


def affine(a: Vector, rows: list[list[float]]) -> Vector:
    """A row vector with 1 as its fourth part times a matrix of four rows and three columns."""
    return tuple(a[0] * rows[0][k] + a[1] * rows[1][k] + a[2] * rows[2][k] + rows[3][k] for k in range(3))


def surface_normal(h: Column, h_line: Column, h_sample: Column, cell: float = 20.0) -> Vector:
    """Of the plane through a pixel and two neighbours: the next line's and the previous sample's; metres."""
    return unit((-cell * (h_line - h), -cell * (h_sample - h), F.lit(cell * cell)))


def contribution(fraction: Column, light: Vector, normal: Vector) -> Column:
    """The seen share of a disc times the cosine of its light, 0 from below."""
    return fraction * F.greatest(F.lit(0.0), dot(unit(light), normal))


def with_unit(df: DataFrame, name: str, a: Vector) -> DataFrame:
    """df with the unit vector of a as the columns name_x, name_y, name_z; steps of their own, so that lengths are computed once."""
    raw = [f"{name}_{k}" for k in "xyz"]
    df = df.withColumns(dict(zip(raw, a, strict=True)))
    df = df.withColumn(f"{name}_d", F.sqrt(dot(part(name), part(name))))
    return df.withColumns({n: F.when(F.col(f"{name}_d") > 0, F.col(n) / F.col(f"{name}_d")) for n in raw}).drop(f"{name}_d")


def part(name: str) -> Vector:
    return F.col(f"{name}_x"), F.col(f"{name}_y"), F.col(f"{name}_z")


def solar_frame(df: DataFrame, moon: Vector, sun: Vector, ecliptic: Vector) -> DataFrame:
    """df with the axes x1, x2, x3 (each _x, _y, _z) of the frame that turns with the sun.

    Positions are as seen from one body; ``ecliptic`` is the ecliptic's normal. The first axis is from the sun
    to the moon, the second is square to it and the normal, the third to both.
    """
    df = with_unit(df, "x1", tuple(m - s for m, s in zip(moon, sun, strict=True)))
    df = with_unit(df, "x2", cross(part("x1"), ecliptic))
    return with_unit(df, "x3", cross(part("x1"), part("x2")))


def site_az_el(a: Vector) -> tuple[Column, Column]:
    """Azimuth turning the other way round, and elevation, in a site's own frame; radians."""
    return -F.atan2(a[1], a[0]), F.atan2(a[2], F.sqrt(a[0] * a[0] + a[1] * a[1]))
