"""Queries of conversions between frames, angles, images and screens, and of files made from rasters and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions import geometry as geo, photometry as ph, vectors as vec
from lumenfield.plans.queries import query
from lumenfield.plans.stand_ins import GRID, grid, table
from lumenfield.sources import codecs

_P = "p as (select p_partkey as id, p_size + 1.0::double as x, p_partkey % 13 + 0.5::double as y, p_partkey % 7 - 3.0::double as z from part)"


def _vectors(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), (F.col("p_size") + 1).cast("double").alias("x"), (k % 13 + 0.5).cast("double").alias("y"), (k % 7 - 3).cast("double").alias("z"))


def _xyz():
    return F.col("x"), F.col("y"), F.col("z")


@query(f"with {_P} select id, round(atan2(z, sqrt(x * x + y * y)), 9) + 0e0 as lat, round(atan2(y, x), 9) + 0e0 as lon from p")
def point_latitudes(spark, sf):
    lat, lon = geo.point_lat_lon(*_xyz())
    return _vectors(spark, sf).select("id", (F.round(lat, 9) + 0.0).alias("lat"), (F.round(lon, 9) + 0.0).alias("lon"))


@query(f"with {_P} select id, round(-atan2(y, x), 9) + 0e0 as az, round(atan2(z, sqrt(x * x + y * y)), 9) + 0e0 as el from p")
def site_angles(spark, sf):
    az, el = vec.site_az_el(_xyz())
    return _vectors(spark, sf).select("id", (F.round(az, 9) + 0.0).alias("az"), (F.round(el, 9) + 0.0).alias("el"))


_TURN = [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.5], [0.25, 0.0, 2.0], [10.0, -20.0, 30.0]]


@query(f"with {_P} select id, -y + 0.25e0 * z + 10 as x, x - 20 as y, 0.5e0 * y + 2 * z + 30 as z from p")
def affine_points(spark, sf):
    out = vec.affine(_xyz(), _TURN)
    return _vectors(spark, sf).select("id", *[(v + 0.0).alias(n) for n, v in zip("xyz", out, strict=True)])


@query("select c_custkey as id, 15199.5e0 - (40000e0 - (c_custkey % 500) * 5e0) / 20e0 as line, 15199.5e0 + (-30000e0 + (c_custkey % 700) * 5e0) / 20e0 as sample from customer")
def image_pixels(spark, sf):
    k = F.col("c_custkey")
    line, sample = geo.image_to_grid(k % 500, k % 700, (-30000.0, 40000.0), 5.0)
    return table(spark, sf, "customer").select(k.alias("id"), F.round(line, 6).alias("line"), F.round(sample, 6).alias("sample"))


@query("select c_custkey as id, (c_custkey % 640 - 320e0) * 0.25e0 as place, cast(c_custkey % 640 as double) as screen from customer")
def map_and_screen(spark, sf):
    place = geo.to_map((F.col("c_custkey") % 640).cast("double"), 320.0, 0.25)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), place.alias("place")).select("id", "place", geo.to_screen(F.col("place"), 320.0, 0.25).alias("screen"))


@query("select p_partkey as id, list_transform(range(8), lambda k: round(degrees(atan((p_partkey % 11 + k) / 8e0 - 0.5e0)), 6) + 0e0) as horizon from part")
def horizon_degrees(spark, sf):
    slopes = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.col("p_partkey") % 11 + k) / F.lit(8.0) - 0.5)
    out = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ph.slopes_to_degrees(slopes).alias("horizon"))
    return out.withColumn("horizon", F.transform("horizon", lambda d: F.round(d, 6) + 0.0))


_TILE = 16


@query(f"""with {GRID}, g as (select line, sample, cast(floor(h * 1000) as bigint) * 1000000 as ticks from grid),
t as (select line // {_TILE} as l, sample // {_TILE} as s, min(line) as l0, max(line) as l1, min(sample) as s0, max(sample) as s1 from g group by 1, 2),
cells as (select unnest(range(l0, l1 + 1)) as line, s0, s1 from t), all_cells as (select line, unnest(range(s0, s1 + 1)) as sample from cells)
select cast(a.line as int) as line, cast(a.sample as int) as sample, coalesce(ticks, 0) as ticks from all_cells a left join g on g.line = a.line and g.sample = a.sample""")
def tick_round_trip(spark, sf):
    cells = grid(spark, sf).select("line", "sample", (F.floor(F.col("h") * 1000) * 1_000_000).alias("ticks"))
    return codecs.decoded(codecs.tick_files(cells, _TILE), "ticks").select("line", "sample", "ticks")


_LEVELS = [1.0, 0.5, 0.25]


@query(f"""with {GRID}, t as (select distinct line // {_TILE} as l, sample // {_TILE} as s from grid), b(band, threshold) as (values {", ".join(f"({k}, {x}::double)" for k, x in enumerate(_LEVELS))}),
r as (select cast(range as int) as row from range({_TILE})), q as (select cast(range as int) as col from range({_TILE}))
select cast(t.l * {_TILE} as int) as line, cast(t.s * {_TILE} as int) as sample, threshold, row, col, coalesce(floor(h) * (band + 1), 0e0) as hours
from t cross join b cross join r cross join q left join grid on grid.line = t.l * {_TILE} + row and grid.sample = t.s * {_TILE} + col""")
def band_round_trip(spark, sf):
    bands = F.explode(F.sequence(F.lit(0), F.lit(len(_LEVELS) - 1))).alias("band")
    cells = grid(spark, sf).select("line", "sample", "h", bands).select("line", "sample", "band", (F.floor("h") * (F.col("band") + 1)).cast("double").alias("hours"))
    out = codecs.decoded(codecs.band_files(cells, _LEVELS, _TILE), "bands")
    return out.select("line", "sample", F.col("threshold").cast("double").alias("threshold"), "row", "col", F.col("hours").cast("double").alias("hours"))


@query("""with u as (select p_partkey as id, (p_partkey * 7919) % 65536 as v, cast(p_partkey % 360 as double) as hue, (p_partkey % 5) / 4e0 as s, (p_partkey % 9) / 8e0 as val from part),
k as (select *, fmod(5e0 + hue / 60, 6e0) as kr, fmod(3e0 + hue / 60, 6e0) as kg, fmod(1e0 + hue / 60, 6e0) as kb from u)
select id, cast((v >> 15) & 1 as int) * 255 as a, cast(floor(((v >> 10) & 31) * 255 / 31e0) as int) as r, cast(floor(((v >> 5) & 31) * 255 / 31e0) as int) as g, cast(floor((v & 31) * 255 / 31e0) as int) as b,
cast((v >> 4) & 15 as int) as high, cast(v & 15 as int) as low,
round(val - val * s * greatest(0, least(kr, 4 - kr, 1)), 9) + 0e0 as hr, round(val - val * s * greatest(0, least(kg, 4 - kg, 1)), 9) + 0e0 as hg, round(val - val * s * greatest(0, least(kb, 4 - kb, 1)), 9) + 0e0 as hb from k""")
def packed_colours(spark, sf):
    k = F.col("p_partkey")
    v = (k * 7919 % 65536).cast("int")
    packed = zip(("a", "r", "g", "b", "high", "low"), (*ph.argb1555(v), *ph.nibbles(v)), strict=True)
    hsv = zip(("hr", "hg", "hb"), ph.hsv_rgb((k % 360).cast("double"), k % 5 / 4.0, k % 9 / 8.0), strict=True)
    return table(spark, sf, "part").select(k.alias("id"), *[x.alias(n) for n, x in packed], *[(F.round(x, 9) + 0.0).alias(n) for n, x in hsv])


@query("""with t as (select event_id as id, (epoch_us(cast(ts as timestamp)) - epoch_us(timestamp '2000-01-01 12:00:00')) / 1e6 as s from events)
select id, s + 5 as et5, s + 3 as et3, floor(s) + 3 as et_whole from t""")
def ephemeris_variants(spark, sf):
    t = F.col("ts")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), geo.ephemeris_seconds(t).alias("et5"), geo.ephemeris_seconds(t, 3).alias("et3"), geo.ephemeris_seconds(t, 3, True).alias("et_whole"))
