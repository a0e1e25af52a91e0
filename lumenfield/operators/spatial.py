"""Nearest samples and chunks by cells of the plane, with no nested-loop join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenfield.session import checkpointed


def nearest(points: DataFrame, samples: DataFrame, cell: float) -> DataFrame:
    """pid, sid, d2: the exact nearest sample of each point, of least sid where distances tie.

    Points need pid, px, py; samples sid, sx, sy. Points look into the 3 x 3 cells around their own; a best
    one within a cell's width can't be beaten from beyond. The few others look again with cells twice as wide,
    until none is left; a round's rows are checkpointed. Points and samples of a null, NaN or infinite coordinate are left out;
    without samples no point has one.
    """
    real = lambda *names: " and ".join(f"{n} is not null and not isnan({n}) and abs({n}) < double('infinity')" for n in names)
    left, out, size = points.select("pid", "px", "py").where("pid is not null").where(real("px", "py")), None, cell
    samples = checkpointed(samples.select("sid", "sx", "sy").where("sid is not null").where(real("sx", "sy")))
    if samples.isEmpty():
        return left.select("pid", F.lit(None).cast("long").alias("sid"), F.lit(0.0).alias("d2")).where("false")
    while True:
        at = lambda c, size=size: F.floor(F.col(c) / size).cast("long")
        around = left.select("*", F.explode(F.expr("sequence(-1, 1)")).alias("a")).withColumn("b", F.explode(F.expr("sequence(-1, 1)")))
        around = around.withColumns({"cx": at("px") + F.col("a"), "cy": at("py") + F.col("b")})
        both = around.join(samples.select("sid", "sx", "sy", at("sx").alias("cx"), at("sy").alias("cy")), ["cx", "cy"])
        d2 = (F.col("px") - F.col("sx")) ** 2 + (F.col("py") - F.col("sy")) ** 2
        best = both.groupBy("pid").agg(F.min(F.struct(d2.alias("d2"), "sid")).alias("best")).select("pid", "best.sid", "best.d2")
        done = checkpointed(best.where(F.col("d2") <= size * size))
        out = done if out is None else out.unionAll(done)
        left = checkpointed(left.join(done, "pid", "left_anti"))
        if left.isEmpty():
            return out
        size *= 2


def in_chunks(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """pid, bid of points in boxes (x1, y1, x2, y2, ends included): boxes are sent to the cells they touch."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    b = boxes.select("*", F.explode(F.sequence(at("x1"), at("x2"))).alias("cx")).withColumn("cy", F.explode(F.sequence(at("y1"), at("y2"))))
    both = points.withColumns({"cx": at("px"), "cy": at("py")}).join(b, ["cx", "cy"])
    return both.where(F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2"))).select("pid", "bid")


def rectangles(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """aid, bid and the shared part x1, y1, x2, y2 of boxes with common area.

    Both need an id (aid, bid), x1, y1, x2, y2. Boxes are sent to the cells they touch; a pair is told by the
    one cell that has its shared part's lower corner, so it comes once without a distinct.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    cells = lambda d: d.withColumn("cx", F.explode(F.sequence(at(F.col("x1")), at(F.col("x2"))))).withColumn("cy", F.explode(F.sequence(at(F.col("y1")), at(F.col("y2")))))
    names = ("x1", "y1", "x2", "y2")
    right = cells(b.select("bid", *names)).withColumnsRenamed({n: f"b{n}" for n in names})
    met = cells(a.select("aid", *names)).join(right, ["cx", "cy"])
    part = met.select("aid", "bid", "cx", "cy", *[f(n, f"b{n}").alias(n) for n, f in zip(names, (F.greatest, F.greatest, F.least, F.least), strict=True)])
    return part.where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")) & (at(F.col("x1")) == F.col("cx")) & (at(F.col("y1")) == F.col("cy"))).drop("cx", "cy")
