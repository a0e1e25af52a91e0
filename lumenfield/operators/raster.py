"""Rasters as rows (line, sample, value): stencils, neighbourhoods, masks, histograms, mosaics, bit planes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def stencil(grid: DataFrame, height: int, width: int, value: str = "h") -> DataFrame:
    """line, sample and a..i: the 3 x 3 values around each pixel, row by row; beyond an edge the edge repeats.

    Each pixel sends its value to where it is needed, so one aggregation by place replaces eight self-joins.
    """
    to = lambda at, size: F.array_distinct(F.filter(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: at + d), lambda x: (x >= 0) & (x < size)))
    sent = grid.select("line", "sample", value, F.explode(to(F.col("line"), height)).alias("to_line")).withColumn("to_sample", F.explode(to(F.col("sample"), width)))
    place = lambda dy, dx: (F.col("line") == F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("to_line") + dy))) & (F.col("sample") == F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("to_sample") + dx)))
    names = iter("abcdefghi")
    aggs = [F.max(F.when(place(dy, dx), F.col(value))).alias(next(names)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return sent.groupBy("to_line", "to_sample").agg(*aggs).where("e is not null").withColumnsRenamed({"to_line": "line", "to_sample": "sample"})


def horn(grid: DataFrame, height: int, width: int, cell: float) -> DataFrame:
    """line, sample, dzdx, dzdy by Horn's weights."""
    s = stencil(grid, height, width)
    return s.select("line", "sample", F.expr(f"((c + 2 * f + i) - (a + 2 * d + g)) / {8 * cell}").alias("dzdx"), F.expr(f"((g + 2 * h + i) - (a + 2 * b + c)) / {8 * cell}").alias("dzdy"))


def hillshade(slopes: DataFrame, azimuth: float, elevation: float) -> DataFrame:
    """shade, 0 to 255: the cosine between the light and the surface."""
    ze, az = F.radians(F.lit(90.0 - elevation)), F.radians(F.lit(azimuth))
    slope = F.atan(F.sqrt(F.col("dzdx") ** 2 + F.col("dzdy") ** 2))
    aspect = F.atan2(F.col("dzdy"), -F.col("dzdx"))
    shade = F.cos(ze) * F.cos(slope) + F.sin(ze) * F.sin(slope) * F.cos(az - aspect)
    return slopes.withColumn("shade", 255 * F.greatest(F.lit(0.0), shade))


def disc_max(grid: DataFrame, radius: int, value: str = "h") -> DataFrame:
    """The largest value within radius pixels of each pixel that has one."""
    offsets = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if x * x + y * y <= radius * radius]
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in offsets]))
    sent = grid.select("line", "sample", value, each.alias("o")).select((F.col("line") + F.col("o.y")).alias("line"), (F.col("sample") + F.col("o.x")).alias("sample"), value, ((F.col("o.y") == 0) & (F.col("o.x") == 0)).alias("own"))
    return sent.groupBy("line", "sample").agg(F.max(value).alias("disc_max"), F.max("own").alias("own")).where("own").drop("own")


def histogram(raster: DataFrame, value: str = "v", size: int = 256) -> DataFrame:
    """Counts of all values 0..size-1, zero where none."""
    counts = raster.groupBy(F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    return raster.sparkSession.range(size).select(F.col("id").cast("int").alias("v")).join(F.broadcast(counts.where(F.col("v").between(0, size - 1))), "v", "left").na.fill(0, ["n"])


def area_bins(raster: DataFrame, bins: int = 10, pixel_area: float = 400.0, value: str = "v") -> DataFrame:
    """Surface in bins of percent of 255, bounds truncated; the top bin stops below 255."""
    low = [int(100 * k / bins * 255 / 100) for k in range(bins + 1)]
    aggs = [(F.count_if((F.col(value) >= a) & (F.col(value) < b)) * pixel_area).alias(f"b{k}") for k, (a, b) in enumerate(zip(low, low[1:], strict=False))]
    wide = raster.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(100 // bins * k).alias("low"), F.lit(100 // bins * (k + 1)).alias("high"), F.col(f"b{k}").alias("area")) for k in range(bins)])).alias("x")).select("x.*")


def mosaic(parts: list[DataFrame]) -> DataFrame:
    """Rows of equal place from several rasters: the last raster that has one wins."""
    tagged = [p.select("line", "sample", "v", F.lit(k).alias("k")) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionAll, tagged).groupBy("line", "sample").agg(F.max_by("v", "k").alias("v"))


def merged(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """Two rasters of equal extent put together by a column function."""
    return a.withColumnRenamed("v", "v1").join(b.withColumnRenamed("v", "v2"), ["line", "sample"]).select("line", "sample", f(F.col("v1"), F.col("v2")).alias("v"))


def clipped(raster: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """A window, moved to its own corner; the range reaches the scan."""
    inside = F.col("line").between(top, top + height - 1) & F.col("sample").between(left, left + width - 1)
    return raster.where(inside).withColumns({"line": F.col("line") - top, "sample": F.col("sample") - left})


def packed_bits(bits: DataFrame) -> DataFrame:
    """line, byte, bits: eight samples in a byte, the first in the lowest bit."""
    at = F.floor(F.col("sample") / 8).cast("int")
    return bits.groupBy("line", at.alias("byte")).agg(F.sum(F.when(F.col("bit"), F.expr("shiftleft(1, cast(sample % 8 as int))")).otherwise(0)).cast("int").alias("bits"))


def unpacked_bits(packed: DataFrame) -> DataFrame:
    return packed.select("line", "bits", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("line", (F.col("byte") * 8 + F.col("k")).alias("sample"), (F.expr("shiftright(bits, k) & 1") == 1).alias("bit"))


def lowest_mast(levels: DataFrame, threshold: float, none: int = 255) -> DataFrame:
    """The least height whose level reaches the threshold."""
    return levels.groupBy("line", "sample").agg(F.coalesce(F.min(F.when(F.col("v") >= threshold, F.col("height"))), F.lit(none)).alias("mast"))


def top(raster: DataFrame, k: int, value: str = "v") -> DataFrame:
    return raster.orderBy(F.desc(value), "line", "sample").limit(k)


def tile_bounds(raster: DataFrame, tile: Column, value: str = "h") -> DataFrame:
    """For each tile its extent, lowest and highest value, and the pixel of the highest one."""
    return raster.groupBy(tile.alias("tile")).agg(F.min("line").alias("top"), F.max("line").alias("bottom"), F.min("sample").alias("left"), F.max("sample").alias("right"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(F.struct("line", "sample"), F.struct(F.col(value), -F.col("line"), -F.col("sample"))).alias("at")).select("tile", "top", "bottom", "left", "right", "low", "high", "at.line", "at.sample")


def scaled(raster: DataFrame, factor: float) -> DataFrame:
    return raster.withColumn("v", F.col("v") * factor)


def neighbours(grid: DataFrame, value: str = "h") -> DataFrame:
    """line, sample, value, and those of the next line and the previous sample, where both are there; one aggregation."""
    sent = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).alias("n")) for n, (a, b) in enumerate(((0, 0), (-1, 0), (0, 1)))]))
    told = grid.select("line", "sample", value, sent.alias("o")).select((F.col("line") + F.col("o.a")).alias("line"), (F.col("sample") + F.col("o.b")).alias("sample"), value, "o.n")
    names = (value, f"{value}_line", f"{value}_sample")
    return told.groupBy("line", "sample").agg(*[F.max(F.when(F.col("n") == k, F.col(value))).alias(name) for k, name in enumerate(names)]).where(" and ".join(f"{n} is not null" for n in names))
