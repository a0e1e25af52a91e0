"""Light curves: pixels by time steps, and what is summed up from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenfield.functions import geometry, photometry


def time_grid(spark, start: str, stop: str, step: str) -> DataFrame:
    """i, t from start to stop, both included."""
    seq = F.expr(f"sequence(timestamp '{start}', timestamp '{stop}', interval {step})")
    return spark.range(1).select(F.posexplode(seq).alias("i", "t"))


def dense(samples: DataFrame, steps: int, fill: float = 0.0) -> DataFrame:
    """pid, i, v for all steps of each pid: the few samples of a pid become one array, with no join and no lookup by step.

    Of samples that repeat (pid, i) the largest v counts; those of a null i, or outside 0 to steps - 1, are left out,
    but their pid still comes back. A null v is ``fill``.
    """
    here = F.when(F.col("i").between(0, steps - 1), F.struct("i", F.coalesce("v", F.lit(fill)).alias("v")))
    have = samples.groupBy("pid").agg(F.sort_array(F.collect_list(here)).alias("s"))
    have = have.withColumn("s", F.filter("s", lambda x, k: F.coalesce(F.get("s", k + 1)["i"] != x["i"], F.lit(True))))
    gap = lambda n: F.array_repeat(F.lit(fill), n.cast("int"))
    first = gap(F.coalesce(F.get("s", F.lit(0))["i"], F.lit(steps)))
    rest = F.transform("s", lambda x, k: F.concat(F.array(x["v"]), gap(F.coalesce(F.get("s", k + 1)["i"], F.lit(steps)) - x["i"] - 1)))
    return have.select("pid", F.posexplode(F.flatten(F.concat(F.array(first), rest))).alias("i", "v"))


def summary(curve: DataFrame, threshold: float, step_hours: float) -> DataFrame:
    """The average-light byte (terms and mean truncated), the byte of steps at the threshold, the sum, and hours with light."""
    return curve.groupBy("pid").agg(
        F.floor(F.sum((F.col("v") * 255).cast("int")) / F.count("*")).cast("int").alias("average_sun"),
        F.floor(255 * F.count_if(F.col("v") >= threshold) / F.count("*")).cast("int").alias("visibility"),
        F.sum("v").alias("total"),
        (F.count_if(F.col("v") > 0) * step_hours).alias("hours_in_sun"),
    )


def wide(curve: DataFrame, pids: list[int]) -> DataFrame:
    """A row for each step, a column for each of a few pids."""
    return curve.where(F.col("pid").isin(pids)).groupBy("i").pivot("pid", pids).agg(F.first("v"))


def _met(pixels: DataFrame, vectors: DataFrame, names: tuple[str, ...], steps: int, most: int) -> DataFrame:
    each = pixels.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    told = vectors.select("i", *names)
    return each.join(F.broadcast(told) if steps <= most else told, "i")


def light(horizons: DataFrame, vectors: DataFrame, steps: int, most: int = 1 << 20) -> DataFrame:
    """pid, i, v: the share of the disc that each pixel sees at each step.

    ``horizons`` needs pid and horizon (1440 elevations in degrees), ``vectors`` i (0 to steps - 1), az and el in degrees. A
    pixel's own row is exploded into steps, which meet the vectors by step; those are broadcast up to
    ``most`` steps and shuffled beyond. Horizons are read in place, so they aren't multiplied in an exchange.
    """
    met = _met(horizons.select("pid", "horizon"), vectors, ("az", "el"), steps, most)
    return met.select("pid", "i", photometry.disc_fraction(F.col("horizon"), F.col("az"), F.col("el")).alias("v"))


def events(runs: DataFrame) -> DataFrame:
    """pid, lit, start, stop of the runs that end in a change; the last run of a series doesn't."""
    return runs.where("stop < n").select("pid", "lit", "start", "stop")


def stations(seen: DataFrame, mask: float) -> DataFrame:
    """For each t the station with the highest el of those whose mask value reaches ``mask``; if there is none, the first by name.

    ``seen`` needs t, station, mask, el; ties go to the first name. ``suitable`` tells whether one reached it.
    """
    ok = F.col("mask") >= mask
    rank = F.struct((~ok).alias("bad"), F.when(ok, -F.col("el")).alias("low"), F.col("station").alias("station"))
    return seen.groupBy("t").agg(F.min_by(F.struct("station", "el", ok.alias("suitable")), rank).alias("best")).select("t", "best.*")


def body_angles(lat: Column, lon: Column, height_m: Column, body: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Azimuth from 0 to 360 and elevation, in degrees, of a body-fixed point in kilometres, seen from a surface point."""
    az, el = geometry.az_el(*geometry.local_frame(*body, geometry.body_point(lat, lon, height_m), lat, lon))
    return F.degrees(az), F.degrees(el)


def seen(pixels: DataFrame, vectors: DataFrame, steps: int, most: int = 1 << 20) -> DataFrame:
    """pid, i, az, el, over, v: where a body stands for each pixel at each step, in degrees, how far over its horizon, and the share of its disc.

    ``pixels`` needs pid, lat and lon in radians, h in metres and horizon (1440 elevations in degrees), ``vectors`` i (0 to
    steps - 1) and x, y, z in body-fixed kilometres, of the sun or a station; they meet as in light(). A null
    in a pixel or a vector makes what depends on it null; a repeated pid or i gives repeated rows.
    """
    met = _met(pixels.select("pid", "lat", "lon", "h", "horizon"), vectors, ("x", "y", "z"), steps, most)
    az, el = body_angles(F.col("lat"), F.col("lon"), F.col("h"), (F.col("x"), F.col("y"), F.col("z")))
    met = met.select("pid", "i", "horizon", az.alias("az"), el.alias("el"))
    over = photometry.over_horizon(F.col("horizon"), F.radians("az"), F.col("el"))
    return met.select("pid", "i", "az", "el", over.alias("over"), photometry.disc_fraction(F.col("horizon"), F.col("az"), F.col("el")).alias("v"))


def shadows(seen: DataFrame) -> DataFrame:
    """seen() with ``sun``, the byte of a snapshot in sunlight, and ``station``, the class of one of a station: whole degrees over the horizon, rounded up, 0 below it."""
    station = F.when(F.col("over") <= 0, 0).otherwise(F.ceil("over")).cast("int")
    return seen.withColumns({"sun": photometry.byte_level(F.col("v")), "station": station})
