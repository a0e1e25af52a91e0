"""Terrain meshes: vertices, faces and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def vertices(grid: DataFrame, step: int = 1) -> DataFrame:
    """line, sample, h of the pixels on every step-th row and column."""
    return grid.where((F.col("line") % step == 0) & (F.col("sample") % step == 0))


def faces(points: DataFrame, step: int = 1) -> DataFrame:
    """Two triangles for each square whose four corners exist, corners as line, sample pairs, turning alike.

    Each point tells the four squares that it is a corner of, so one aggregation finds the complete ones.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, step) for b in (0, step)]))
    squares = points.withColumn("c", corner).select((F.col("line") - F.col("c.a")).alias("line"), (F.col("sample") - F.col("c.b")).alias("sample"))
    full = squares.groupBy("line", "sample").count().where("count = 4")
    p = lambda a, b: F.struct((F.col("line") + a).alias("line"), (F.col("sample") + b).alias("sample"))
    return full.select("line", "sample", F.explode(F.array(F.array(p(0, 0), p(step, 0), p(step, step)), F.array(p(0, 0), p(step, step), p(0, step)))).alias("face"))


def counts(points: DataFrame, step: int = 1) -> DataFrame:
    """vertices, faces: one row."""
    n = faces(points, step).agg(F.count("*").alias("faces"))
    return points.agg(F.count("*").alias("vertices")).select("vertices", F.lit(1).alias("k")).join(F.broadcast(n.select("faces", F.lit(1).alias("k"))), "k").drop("k")  # two rows


def ply(points: DataFrame, triangles: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Lines of an ASCII PLY file in order of ``k``: vertex numbers come from sorted places, not from a driver."""
    n, m = points.count(), triangles.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", "property double x", "property double y", "property double z", f"element face {m}", "property list uchar int vertex_indices", "end_header"]
    spark = points.sparkSession
    first = spark.createDataFrame([(i - len(head), v) for i, v in enumerate(head)], "k long, value string")
    ids = points.select("line", "sample", F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")).orderBy("line", "sample").rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF(["line", "sample", "x", "y", "z", "k"])
    rows = ids.select("k", F.concat_ws(" ", "x", "y", "z").alias("value"))
    corners = triangles.withColumn("f", F.monotonically_increasing_id()).select("f", F.posexplode("face").alias("j", "c")).select("f", "j", "c.line", "c.sample")
    told = corners.join(ids.select("line", "sample", F.col("k").alias("v")), ["line", "sample"]).groupBy("f").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"].cast("string"))).alias("t"))
    return first.unionAll(rows).unionAll(told.select((F.lit(n) + F.col("f")).alias("k"), F.concat(F.lit("3 "), "t").alias("value")))
