"""Horizons: the largest slope by azimuth bin, near and far, as joins on tiles and partial maxima."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenfield.functions import geometry as geo


def ring(ids: DataFrame, radius: int, columns: int, rows: int) -> DataFrame:
    """x, y and the neighbours nx, ny at this Chebyshev distance inside the grid of tiles."""
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if max(abs(a), abs(b)) == radius]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    out = ids.select("x", "y", each.alias("o")).select("x", "y", (F.col("x") + F.col("o.a")).alias("nx"), (F.col("y") + F.col("o.b")).alias("ny"))
    return out.where(F.col("nx").between(0, columns - 1) & F.col("ny").between(0, rows - 1))


def horizon(targets: DataFrame, casters: DataFrame, tile: int, reach: int, bins: int = 1440, cell: float = 1.0) -> DataFrame:
    """tline, tsample, bin, slope: the largest slope from each target to casters within ``reach`` tiles.

    Both need line, sample, h. A target is sent to the tiles around it and meets casters by tile: an
    equi-join, and maxima are merged on the map side, so what is shuffled after it is a row for each bin.
    """
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    t = targets.select(F.col("line").alias("tline"), F.col("sample").alias("tsample"), F.col("h").alias("th"), near.alias("a")).withColumn("b", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    t = t.select("tline", "tsample", "th", (F.floor(F.col("tsample") / tile) + F.col("a")).alias("tx"), (F.floor(F.col("tline") / tile) + F.col("b")).alias("ty"))
    # Few targets can mean many pairs, so their partitions are set here rather than merged by size.
    t = t.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tx", "ty")
    c = casters.select("line", "sample", "h", F.floor(F.col("sample") / tile).alias("tx"), F.floor(F.col("line") / tile).alias("ty"))
    both = t.join(c, ["tx", "ty"])
    dx, dy = (F.col("sample") - F.col("tsample")) * cell, (F.col("tline") - F.col("line")) * cell
    far = F.sqrt(dx * dx + dy * dy)
    both = both.select("tline", "tsample", dx.alias("dx"), dy.alias("dy"), far.alias("d"), (F.col("h") - F.col("th")).alias("rise")).where("d > 0")
    bin_ = F.floor(0.5 + (F.atan2("dy", "dx") + math.pi) * ((bins - 1) / (2 * math.pi))).cast("int")
    return both.groupBy("tline", "tsample", bin_.alias("bin")).agg(F.max(F.col("rise") / F.col("d")).alias("slope"))


def local_horizon(targets: DataFrame, casters: DataFrame, tile: int, reach: int, bins: int = geo.BINS, observer_m: float = 0.0, pole: geo.Pole = geo.Pole()) -> DataFrame:
    """tline, tsample, bin, slope: like horizon(), in each target's own frame on the curved body.

    Both need line, sample, h in metres. A caster's point is taken into the target's frame; its bin is that of its azimuth there, and its
    slope that of its height over the observer to its distance in the frame's plane. Body points are made once for each row, before
    targets are sent to the tiles around them. Rows of a null line, sample or h meet nothing.
    """

    def placed(d: DataFrame, key: str) -> DataFrame:
        lat, lon = geo.lat_lon(F.col("line"), F.col("sample"), pole)
        d = d.select(F.col("line").alias(f"{key}line"), F.col("sample").alias(f"{key}sample"), "h", lat.alias(f"{key}lat"), lon.alias(f"{key}lon")).where("h is not null")
        point = geo.body_point(F.col(f"{key}lat"), F.col(f"{key}lon"), F.col("h"))
        return d.select("*", *[p.alias(f"{key}{n}") for p, n in zip(point, "xyz", strict=True)]).drop("h")

    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    t = placed(targets, "t").withColumn("a", near).withColumn("b", near)
    t = t.withColumns({"tilex": F.floor(F.col("tsample") / tile) + F.col("a"), "tiley": F.floor(F.col("tline") / tile) + F.col("b")}).drop("a", "b")
    t = t.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tilex", "tiley")
    c = placed(casters, "c").withColumns({"tilex": F.floor(F.col("csample") / tile), "tiley": F.floor(F.col("cline") / tile)})
    both = t.join(c.select("cline", "csample", "cx", "cy", "cz", "tilex", "tiley"), ["tilex", "tiley"]).where("tline <> cline or tsample <> csample")
    x, y, z = geo.local_frame(F.col("cx"), F.col("cy"), F.col("cz"), (F.col("tx"), F.col("ty"), F.col("tz")), F.col("tlat"), F.col("tlon"))
    both = both.select("tline", "tsample", x.alias("x"), y.alias("y"), z.alias("z"))
    azimuth, _ = geo.az_el(F.col("x"), F.col("y"), F.col("z"))
    bin_ = F.floor(0.5 + azimuth * ((bins - 1) / (2 * math.pi))).cast("int")
    slope = (F.col("z") - observer_m / 1000) / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return both.groupBy("tline", "tsample", bin_.alias("bin")).agg(F.max(slope).alias("slope"))


#: Fixed value: seconds that one node of the far field takes.
NODE_SECONDS = 0.1625


def work(targets: DataFrame, **how) -> DataFrame:
    """nodes, seconds: the far-field nodes of a queue of target tiles, and the time that they are reckoned to take."""
    return far_nodes(targets, **how).agg(F.count("*").alias("nodes")).select("nodes", (F.col("nodes") * NODE_SECONDS).alias("seconds"))


def merged(a: Column, b: Column) -> Column:
    """The larger of two horizon arrays, element by element: the merge of partial horizons, in any order."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def far_nodes(targets: DataFrame, root: int = 256, limit: float = 90.0, resolution: float = 2 * math.pi / 1440, tile: int = 128) -> DataFrame:
    """Quadtree of caster tiles for each target tile x, y: nodes coarse enough for their distance, as nx, ny, step.

    Nodes beyond ``limit`` tiles go; a node that overlaps its target or is too coarse for its distance is cut
    in four, down to a step of 1. A level is one narrow projection, so there are no shuffles at all.
    """
    level = targets.select("x", "y", F.lit(0).alias("nx"), F.lit(0).alias("ny"))
    out, step = None, root
    while step >= 1:
        gap = lambda n, t: F.greatest(F.lit(0), F.col(n) - (F.col(t) + 1), F.col(t) - (F.col(n) + step))
        d = level.withColumn("d", F.sqrt(F.pow(gap("nx", "x"), 2) + F.pow(gap("ny", "y"), 2))).where(F.col("d") <= limit)
        over = (F.col("nx") < F.col("x") + 1) & (F.col("x") < F.col("nx") + step) & (F.col("ny") < F.col("y") + 1) & (F.col("y") < F.col("ny") + step)
        fine = (F.lit(step <= 1) | (F.lit(float(step)) < F.col("d") * tile * resolution)) & ~over
        done = d.where(fine).select("x", "y", "nx", "ny", F.lit(step).alias("step"))
        out = done if out is None else out.unionAll(done)
        if step == 1:
            break
        step //= 2
        level = d.where(~fine).select("x", "y", "nx", "ny", F.explode(F.array(*[F.struct(F.lit(a * step).alias("a"), F.lit(b * step).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o"))
        level = level.select("x", "y", (F.col("nx") + F.col("o.a")).alias("nx"), (F.col("ny") + F.col("o.b")).alias("ny"))
    return out


def adjacent(ids: DataFrame, dx: int, dy: int, columns: int, rows: int) -> DataFrame:
    """x, y and the tile nx, ny at an offset, where the grid of tiles has it."""
    out = ids.select("x", "y", (F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny"))
    return out.where(F.col("nx").between(0, columns - 1) & F.col("ny").between(0, rows - 1))


def rising(pairs: DataFrame, near: int = 6, bins: int = 1440) -> DataFrame:
    """The pairs whose caster may cast a shadow: one of its vectors rises over the target's horizon, or it is near.

    Pairs need x, y, nx, ny, horizon (an array by azimuth bin) and vectors, an array of az (radians, 0 to two
    pi) and slope in the unit of the horizon. All is one filter on a pair's own row.
    """
    close = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny")) <= near * near
    over = F.exists("vectors", lambda v: v["slope"] > F.get("horizon", F.floor(0.5 + v["az"] * ((bins - 1) / (2 * math.pi))).cast("int")))
    return pairs.where(close | over)


def spans(bins: DataFrame, value: str = "v") -> DataFrame:
    """pid, first, last: unbroken spans of azimuth bins that have a value, for drawing; gaps are where none is."""
    seen = bins.where(F.col(value).isNotNull()).select("pid", "bin")
    w = W.partitionBy("pid").orderBy("bin")
    return seen.withColumn("part", F.col("bin") - F.row_number().over(w)).groupBy("pid", "part").agg(F.min("bin").alias("first"), F.max("bin").alias("last")).drop("part")
