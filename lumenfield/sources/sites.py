"""The table of landing sites, their extents and the tiles they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenfield.functions.geometry import TILE, Pole, pixel_index

#: Site, south, name, latitude and longitude of the centre in degrees.
CENTRES = (
    (1, True, "Mazarico 1", -89.45, 222.69),
    (4, True, "Mazarico 4", -89.78, 204.27),
    (7, True, "Mazarico 7", -88.81, 123.64),
    (11, True, "Mazarico 11", -88.67, 291.90),
    (101, True, "North Cabeus", -83.6933, -35.8187),
    (102, True, "Nobile 1", -85.4446, 32.1105),
    (103, True, "Malapert 1", -85.9750, 2.0827),
    (104, True, "Malapert 2", -85.9698, -3.1406),
    (105, True, "Shoemaker 1", -87.1180, 57.1368),
    (106, True, "de Gerlache South", -89.2588, -92.9704),
    (107, True, "Shirley1", -89.2804, -7.3766),
    (108, True, "Shirley2", -89.3781, -11.0677),
    (201, True, "Spudis Point", -89.44075, 223.13621),
    (202, True, "Shoemaker 2", -88.7990, 78.2717),
)
#: Site, south, name, left, top, right, bottom in tiles, the last two not included.
TILES = (
    (109, True, "Nobile 2", 149, 66, 158, 74),
    (110, True, "Haworth 1", 100, 68, 108, 76),
    (111, True, "Haworth 2", 100, 80, 107, 87),
    (203, True, "Nobile 3", 149, 69, 157, 77),
    (1001, False, "Peary_South", 122, 150, 128, 154),
    (1002, False, "Hermite A East", 103, 135, 107, 139),
)
#: Pixels from a centre to its box's sides: 10 km.
SPAN = 500


def sites(spark: SparkSession, south: bool | None = None) -> DataFrame:
    """site, south, name, x1, y1, x2, y2 in pixels; of one hemisphere, or all."""
    c = spark.createDataFrame(CENTRES, "site int, south boolean, name string, lat double, lon double")
    (line, sample), (nline, nsample) = (pixel_index(F.radians("lat"), F.radians("lon"), Pole(p)) for p in (True, False))
    line, sample = F.when(F.col("south"), line).otherwise(nline), F.when(F.col("south"), sample).otherwise(nsample)
    by_centre = c.select("site", "south", "name", (sample - SPAN).alias("x1"), (line - SPAN).alias("y1"), (sample + SPAN).alias("x2"), (line + SPAN).alias("y2"))
    t = spark.createDataFrame(TILES, "site int, south boolean, name string, x1 int, y1 int, x2 int, y2 int")
    both = by_centre.unionByName(t.withColumns({n: F.col(n) * TILE for n in ("x1", "y1", "x2", "y2")}))
    return both if south is None else both.where(F.col("south") == south)


def site_tiles(places: DataFrame) -> DataFrame:
    """id_x, id_y, south of each tile that some site covers, once; n_sites that do."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE).cast("int"), F.floor((F.col(b) - 1) / TILE).cast("int")))
    each = places.select("south", "y1", "y2", span("x1", "x2").alias("id_x")).withColumn("id_y", span("y1", "y2"))
    return each.groupBy("south", "id_x", "id_y").agg(F.count("*").alias("n_sites"))
