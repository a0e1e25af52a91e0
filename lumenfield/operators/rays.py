"""Rays over an elevation grid: horizons of the ground near a target, and how high a target must stand to see past it.

A ray goes from a target in steps of pixels; at each step the ground is interpolated between four cells. Targets are dealt out by
tile, and each cell goes to the tiles that its rays can reach, so a task has a tile and a margin around it, of a size that
parameters bound, and computes on arrays. Nothing is joined by ray or step.

Rows of a null or NaN line, sample or h are left out; of cells that repeat (line, sample) the highest counts, and repeated
targets come back one by one. A step whose four cells are not all there is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenfield.functions import geometry as geo
from lumenfield.functions.geometry import Pole
from lumenfield.session import ship

#: Rays times targets that a task computes at once.
AT_ONCE = 1 << 18


def body_points(line: np.ndarray, sample: np.ndarray, h: np.ndarray, pole: Pole) -> tuple[np.ndarray, ...]:
    """x, y, z in the body-fixed frame in kilometres, latitude, longitude."""
    x, y = (sample - geo.CENTRE) * geo.SCALE, (geo.CENTRE - line) * geo.SCALE
    p = np.sqrt(x * x + y * y)
    c = 2 * np.arctan2(p, 2 * geo.RADIUS)
    lat = np.arcsin(np.cos(c) * math.sin(pole.lat) + np.where(y == 0, 0.0, y * np.sin(c) * math.cos(pole.lat) / np.where(p == 0, 1.0, p)))
    lon = np.arctan2(x, y * pole.sign)
    r = h / 1000 + geo.RADIUS
    return r * np.cos(lat) * np.cos(lon), r * np.cos(lat) * np.sin(lon), r * np.sin(lat), lat, lon


class Ground:
    """Arrays over a rectangle of cells, NaN where there is none."""

    def __init__(self, line: np.ndarray, sample: np.ndarray, *values: np.ndarray) -> None:
        self.top, self.left = int(line.min()), int(sample.min())
        shape = int(line.max()) - self.top + 2, int(sample.max()) - self.left + 2
        self.arrays = []
        for v in values:
            a = np.full(shape, np.nan)
            a[line - self.top, sample - self.left] = v
            self.arrays.append(a)
        self.shape = shape

    def at(self, line: np.ndarray, sample: np.ndarray) -> list[np.ndarray]:
        """Values interpolated along lines, then along samples."""
        y, x = np.floor(line), np.floor(sample)
        fy, fx = line - y, sample - x
        i, j = (y - self.top).astype(np.int64), (x - self.left).astype(np.int64)
        out = (i < 0) | (j < 0) | (i >= self.shape[0] - 1) | (j >= self.shape[1] - 1)
        i, j = np.where(out, self.shape[0] - 1, i), np.where(out, self.shape[1] - 1, j)
        below, right = np.minimum(i + 1, self.shape[0] - 1), np.minimum(j + 1, self.shape[1] - 1)
        values = []
        for a in self.arrays:
            first = a[i, j] + fy * (a[below, j] - a[i, j])
            second = a[i, right] + fy * (a[below, right] - a[i, right])
            values.append(first + fx * (second - first))
        return values


def _by_tile(targets: DataFrame, cells: DataFrame, tile: int, margin: int, kernel: Callable, schema: str) -> DataFrame:
    """kernel(targets, cells) for each tile of targets and the cells in it and around it."""
    ship(targets.sparkSession)
    ok = "line is not null and sample is not null and h is not null and not isnan(h)"
    cells = cells.where(ok).groupBy("line", "sample").agg(F.max("h").cast("double").alias("h"))
    mine_as = {"line": "t_line", "sample": "t_sample", "h": "t_h"}  # names of their own, as both may come from one table
    t = targets.where("line is not null and sample is not null").select(*[F.col(x).alias(y) for x, y in mine_as.items()], F.floor(F.col("line") / tile).alias("t_y"), F.floor(F.col("sample") / tile).alias("t_x"))
    wanted = t.select(F.col("t_y").alias("ty"), F.col("t_x").alias("tx")).distinct()
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile)))
    around = cells.withColumn("ty", near("line")).withColumn("tx", near("sample")).join(wanted, ["ty", "tx"], "left_semi")

    def run(mine: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        if mine.empty or ground.empty:
            return pd.DataFrame({x: pd.Series([], dtype=object) for x in names})
        return kernel(mine.rename(columns={y: x for x, y in mine_as.items()}), ground)

    return t.groupBy("t_y", "t_x").cogroup(around.groupBy("ty", "tx")).applyInPandas(run, schema)


def near_horizons(targets: DataFrame, cells: DataFrame, far: float, step: float, rays: int = 2880, bins: int = geo.BINS, observer_m: float = 0.0, tile: int = geo.TILE, pole: Pole = Pole()) -> DataFrame:
    """line, sample, bins array<int>, slopes array<double>: by azimuth bin the largest slope to the ground along rays.

    Both need line, sample, h in metres. A ray is followed from 1 pixel to ``far`` pixels by ``step``; its bin is that of its first
    point's azimuth in the target's frame, and a ray without a first point is none. Slopes are of the frame's z, less the
    observer's height, to the distance in its plane. A bin that no ray has is not listed. A target needs a height of its own.
    """
    distance = 1 + step * np.arange(int(math.floor((far - 1) / step + 1e-9)) + 1)
    angle = 2 * math.pi * np.arange(rays) / rays
    sin, cos = np.sin(angle), np.cos(angle)

    def kernel(mine: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        line, sample = ground["line"].to_numpy(np.int64), ground["sample"].to_numpy(np.int64)
        area = Ground(line, sample, *body_points(line.astype(float), sample.astype(float), ground["h"].to_numpy(float), pole)[:3])
        out = {"line": [], "sample": [], "bins": [], "slopes": []}
        mine = mine[mine["h"].notna()]
        for k in range(0, len(mine), max(1, AT_ONCE // rays)):
            some = mine.iloc[k : k + max(1, AT_ONCE // rays)]
            tl, ts = some["line"].to_numpy(float)[:, None], some["sample"].to_numpy(float)[:, None]
            x0, y0, z0, lat, lon = body_points(tl, ts, some["h"].to_numpy(float)[:, None], pole)
            best, where = np.full((len(some), rays), -np.inf), np.full((len(some), rays), -1)
            for n, d in enumerate(distance):
                dx, dy, dz = (a - b for a, b in zip(area.at(tl + sin * d, ts + cos * d), (x0, y0, z0), strict=True))
                east = dx * np.cos(lon) + dy * np.sin(lon)
                y = dy * np.cos(lon) - dx * np.sin(lon)
                x, z = east * np.sin(lat) - dz * np.cos(lat), east * np.cos(lat) + dz * np.sin(lat)
                if n == 0:
                    seen = ~np.isnan(x)
                    where[seen] = np.floor(0.5 + (np.arctan2(y[seen], x[seen]) + math.pi) * ((bins - 1) / (2 * math.pi))).astype(int)
                with np.errstate(invalid="ignore"):
                    best = np.fmax(best, (z - observer_m / 1000) / np.sqrt(x * x + y * y))
            highest = np.full((len(some), bins), -np.inf)
            row = np.broadcast_to(np.arange(len(some))[:, None], where.shape)
            ok = where >= 0
            np.maximum.at(highest, (row[ok], where[ok]), best[ok])
            for i in range(len(some)):
                has = np.flatnonzero(highest[i] > -np.inf)
                for name, v in zip(out, (int(tl[i, 0]), int(ts[i, 0]), has.tolist(), highest[i, has].tolist()), strict=True):
                    out[name].append(v)
        return pd.DataFrame(out, dtype=object)

    return _by_tile(targets.select("line", "sample", "h"), cells.select("line", "sample", "h"), tile, math.ceil(far) + 1, kernel, "line int, sample int, bins array<int>, slopes array<double>")


def rise_heights(targets: DataFrame, cells: DataFrame, slopes: list[float], ranges: list[float], tile: int = geo.TILE, pole: Pole = Pole()) -> DataFrame:
    """line, sample, rise: metres that a target must rise so that along each ray light of the ray's slope passes over the ground.

    Both need line, sample, h in metres. ``slopes`` has a slope for each of as many equally spaced rays, ``ranges`` are distances in
    pixels. The ground's height is interpolated; distances are those in the plane of the body's axes x and y. Without any step rise is null.
    """
    angle = 2 * math.pi * np.arange(len(slopes)) / max(1, len(slopes))
    up = -1.0 if pole.south else 1.0

    def kernel(mine: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        area = Ground(ground["line"].to_numpy(np.int64), ground["sample"].to_numpy(np.int64), ground["h"].to_numpy(float))
        mine = mine[mine["h"].notna()]
        tl, ts = mine["line"].to_numpy(float), mine["sample"].to_numpy(float)
        x0, y0, z0, _, _ = body_points(tl, ts, mine["h"].to_numpy(float), pole)
        rise = np.full(len(mine), np.nan)
        for a, slope in zip(angle, slopes, strict=True):
            for d in ranges:
                line, sample = tl + math.sin(a) * d, ts + math.cos(a) * d
                x, y, z, _, _ = body_points(line, sample, area.at(line, sample)[0], pole)
                away = np.sqrt((x - x0) ** 2 + (y - y0) ** 2)
                rise = np.fmax(rise, 1000 * (up * z - slope * away - up * z0))
        return pd.DataFrame({"line": tl.astype(int), "sample": ts.astype(int), "rise": rise})

    far = math.ceil(max(ranges, default=0)) + 1
    out = _by_tile(targets.select("line", "sample", "h"), cells.select("line", "sample", "h"), tile, far, kernel, "line int, sample int, rise double")
    return out.withColumn("rise", F.nanvl("rise", F.lit(None).cast("double")))
