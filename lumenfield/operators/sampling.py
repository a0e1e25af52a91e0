"""Heights between pixels, and the points that stand for a tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bilinear(points: DataFrame, grid: DataFrame) -> DataFrame:
    """pid, h at fractional py (line), px (sample), where all four pixels around are in the grid.

    A point is sent to its four pixels with its weights there: one equi-join and one sum, whatever the grid's size.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    y, x = F.col("py").cast("int"), F.col("px").cast("int")
    fy, fx = F.col("py") - y, F.col("px") - x
    sent = points.select("pid", "py", "px", corner.alias("c")).select(
        "pid",
        (y + F.col("c.a")).alias("line"),
        (x + F.col("c.b")).alias("sample"),
        (F.when(F.col("c.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("c.b") == 1, fx).otherwise(1 - fx)).alias("weight"),
    )
    met = sent.join(grid.select("line", "sample", "h"), ["line", "sample"])
    return met.groupBy("pid").agg(F.sum(F.col("h") * F.col("weight")).alias("h"), F.count("h").alias("n")).where("n = 4").select("pid", "h")


def test_points(points: DataFrame, tile: int, rise: float = 0.2) -> DataFrame:
    """tx, ty, k, line, sample, r: a tile's highest pixel (k = 0) and its four corners, at its largest radius and ``rise`` more.

    Points need line, sample, r. A tie for the highest goes to the first in row order.
    """
    tx, ty = F.floor(F.col("sample") / tile).cast("int"), F.floor(F.col("line") / tile).cast("int")
    top = points.groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.max("r").alias("r"), F.max_by(F.struct("line", "sample"), F.struct(F.col("r"), -F.col("line"), -F.col("sample"))).alias("at"))
    place = lambda k, line, sample: F.struct(F.lit(k).alias("k"), line.cast("long").alias("line"), sample.cast("long").alias("sample"))
    left, high, more = F.col("tx") * tile, F.col("ty") * tile, tile - 1
    each = F.array(place(0, F.col("at.line"), F.col("at.sample")), *[place(k, high + b, left + a) for k, (a, b) in enumerate(((0, 0), (more, 0), (more, more), (0, more)), 1)])
    return top.select("tx", "ty", (F.col("r") + rise).alias("r"), F.explode(each).alias("p")).select("tx", "ty", "p.k", "p.line", "p.sample", "r")
