"""The engine's queries on the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lumenfield.functions import geometry as geo
from lumenfield.functions import photometry as ph
from lumenfield.operators import curves, horizon, mesh, raster, runs, spatial
from lumenfield.plans.stand_ins import CURVE, GRID, LEVELS, LIT, RUNS, SIDE, curve, grid, levels, lit, table
from lumenfield.sources import text
from lumenfield.streaming import tracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Runs and sequences


@query(f"with {CURVE()}, {RUNS()} select pid, coalesce(max(case when not lit and stop < n then len end), max(n)) as longest_night_1, coalesce(max(case when not lit and stop < n then len end), 0) as longest_night_2, coalesce(max(case when lit and stop < n then len end), -1) as full_sun_steps from r group by pid")
def longest_night(spark, sf):
    return runs.longest(lit(curve(spark, sf)))


@query(f"with {CURVE()}, {RUNS()} select pid, n, lit, start, stop, len from r")
def light_runs(spark, sf):
    return runs.runs(lit(curve(spark, sf))).select("pid", "n", "lit", "start", "stop", "len")


@query(f"""with {CURVE()}, {RUNS()}, p as (select g.*, row_number() over (partition by g.pid, g.isl order by g.i) as k from r_g g),
z as (select *, sum(case when lit and k >= 12 then 1 else 0 end) over (partition by pid order by i) as part from p),
s as (select pid, part, count(*) filter (not lit) as dark from z group by 1, 2)
select pid, max(dark) as haven_steps from s group by pid""")
def safe_haven_steps(spark, sf):
    return runs.havens(lit(curve(spark, sf)))


@query(f"with {CURVE()}, w as (select pid, i, v, lag(v) over (partition by pid order by i) as a, lead(v) over (partition by pid order by i) as b from curve) select pid, i, v from w where a > v and v < b")
def local_minima(spark, sf):
    return runs.minima(curve(spark, sf))


_BOX = (3, 6, 9, 12)


@query(f"with {CURVE()}, w as (select pid, " + ", ".join(f"sum(v) over (partition by pid order by i rows between {k - 1} preceding and current row) / {k} as w{k}" for k in _BOX) + " from curve) select pid, " + ", ".join(f"round(max(w{k}), 4) as w{k}" for k in _BOX) + " from w group by pid")
def box_filter_maxima(spark, sf):
    return runs.box_maxima(curve(spark, sf)).select("pid", *[F.round(f"w{k}", 4).alias(f"w{k}") for k in _BOX])


@query(f"""with {CURVE()}, {RUNS()}, d as (select *, case when start - lag(stop) over (partition by pid order by start) > 3 then 1 else 0 end as o from r where not lit),
q as (select *, sum(o) over (partition by pid order by start) as part from d) select pid, min(start) as start, max(stop) as stop from q group by pid, part""")
def dark_intervals(spark, sf):
    return runs.dark_intervals(lit(curve(spark, sf)), 3)


@query(f"with {CURVE()} select pid, i, max(case when lit then i end) over (partition by pid order by i) as before, min(case when lit then i end) over (partition by pid order by i rows between current row and unbounded following) as after from curve")
def nearest_lit_steps(spark, sf):
    return runs.nearest_lit(lit(curve(spark, sf)))


@query(f"with {CURVE()}, {RUNS()} select pid, min(start) as start from r where lit and len > 0 group by pid")
def first_long_light(spark, sf):
    return runs.first_long_run(lit(curve(spark, sf)), 0)


_OTHER = "click"


@query(f"""with {CURVE('x')}, {CURVE('y', _OTHER)}, {RUNS('x', 'a')}, {RUNS('y', 'b')}
select a.pid, a.start, a.stop, b.start as start2, b.stop as stop2, least(a.stop, b.stop) - greatest(a.start, b.start) as overlap from a join b on a.pid = b.pid and a.start < b.stop and b.start < a.stop where not a.lit and not b.lit""")
def dark_and_silent(spark, sf):
    dark = lambda c: runs.runs(lit(c)).where("not lit")
    return runs.overlaps(dark(curve(spark, sf)), dark(curve(spark, sf, _OTHER)))


@query(f"with {CURVE('x')}, {CURVE('y', _OTHER)} select x.pid, count(*) filter (x.v >= 300 and y.v >= 100) as bits, max(case when x.v >= 300 and y.v >= 100 then x.i end) as last from x join y using (pid, i) group by x.pid")
def full_sun_bits(spark, sf):
    both = curve(spark, sf).withColumnRenamed("v", "sun").join(curve(spark, sf, _OTHER).withColumnRenamed("v", "earth"), ["pid", "i"])
    on = (F.col("sun") >= 300) & (F.col("earth") >= 100)
    return both.groupBy("pid").agg(F.count_if(on).alias("bits"), F.max(F.when(on, F.col("i"))).alias("last"))


# Curves


@query(f"with {CURVE()} select pid, cast(floor(sum(cast(floor(v / 500 * 255) as bigint)) / count(*)) as int) as average_sun, cast(floor(255 * count(*) filter (v / 500 >= 0.5) / count(*)) as int) as visibility, round(sum(v / 500), 4) as total, count(*) filter (v > 0) * 2.0::double as hours_in_sun from curve group by pid")
def average_light(spark, sf):
    c = curve(spark, sf).withColumn("v", F.col("v") / 500)
    return curves.summary(c, 0.5, 2.0).withColumn("total", F.round("total", 4))


@query(f"with {CURVE()} select i, max(case when pid = 1 then v end) as p1, max(case when pid = 2 then v end) as p2, max(case when pid = 3 then v end) as p3 from curve where pid in (1, 2, 3) group by i")
def light_curve_comparison(spark, sf):
    return curves.wide(curve(spark, sf), [1, 2, 3]).select("i", *[F.col(str(k)).alias(f"p{k}") for k in (1, 2, 3)])


@query("select cast(i as int) as i, timestamp '2020-01-01' + i * interval 6 hour as t from range(0, 6797) r(i)")
def metonic_time_grid(spark, sf):
    return curves.time_grid(spark, "2020-01-01 00:00:00", "2024-08-26 00:00:00", "6 hours").select("i", F.col("t").cast("timestamp_ntz").alias("t"))


_DISC = ", ".join(f"({k}, {v!r}::double)" for k, v in enumerate(ph.half_disc()))
_HL = "hl as (select p.pid, cast(b.range as int) as bin, cast((p.pid * 7 + b.range * 13) % 97 as double) / 97 * 2 as deg from (select distinct user_id % 8 as pid from events) p cross join range(1440) b)"
_Q = "q as (select event_id as qid, user_id % 8 as pid, cast((event_id * 37) % 3600 as double) / 10 as az, cast((event_id * 11) % 400 as double) / 100 - 1 as el from events)"


def _rays(spark, sf):
    bins = F.sequence(F.lit(0), F.lit(1439))
    h = F.transform(bins, lambda b: F.pmod(F.col("pid") * 7 + b * 13, F.lit(97)).cast("double") / 97 * 2)
    ev = table(spark, sf, "events").select(F.col("event_id").alias("qid"), (F.col("user_id") % 8).alias("pid"), (((F.col("event_id") * 37) % 3600).cast("double") / 10).alias("az"), (((F.col("event_id") * 11) % 400).cast("double") / 100 - 1).alias("el"))
    return ev.join(F.broadcast(ev.select("pid").distinct().withColumn("h", h)), "pid")  # eight horizons


@query(f"""with {_HL}, {_Q}, disc(k, c) as (values {_DISC}),
a as (select *, (az - 0.395e0) * 4e0 as b from q), b1 as (select *, cast(tb as int) as i, b - tb as f0 from (select *, case when b < 0 then ceil(b) else floor(b) end as tb from a)),
c1 as (select b1.*, d.c, f0 + d.k * 0.135e0 as g from b1 cross join disc d), e as (select *, cast(greatest(0, floor(g)) as int) as o from c1),
f as (select qid, pid, el, c, g - o as fr, ((i + 1440) % 1440 + o) % 1440 as l, ((i + 1440) % 1440 + o + 1) % 1440 as r from e),
w as (select f.qid, f.c, greatest(0, least(2e0 * f.c, f.el + f.c - (hl.deg + f.fr * (hr.deg - hl.deg)))) as p from f join hl on hl.pid = f.pid and hl.bin = f.l join hl hr on hr.pid = f.pid and hr.bin = f.r)
select qid, round(sum(p) / (2e0 * sum(c)), 5) as sun from w group by qid""")
def sun_fraction(spark, sf):
    return _rays(spark, sf).select("qid", F.round(ph.disc_fraction(F.col("h"), F.col("az"), F.col("el")), 5).alias("sun"))


@query(f"""with {_HL}, {_Q}, k as (select *, az / 360 * 1439 as k from q), j as (select *, cast(floor(k) as int) as i from k)
select qid, round(el - (a.deg + (k - i) * (b.deg - a.deg)), 5) as over_deg, el > c.deg as visible from j
join hl a on a.pid = j.pid and a.bin = i join hl b on b.pid = j.pid and b.bin = (i + 1) % 1440 join hl c on c.pid = j.pid and c.bin = cast(floor(0.5 + az / 360 * 1439) as int)""")
def elevation_over_horizon(spark, sf):
    az = F.radians("az")
    return _rays(spark, sf).select("qid", F.round(ph.over_horizon(F.col("h"), az, F.col("el")), 5).alias("over_deg"), ph.above(F.col("h"), az, F.col("el")).alias("visible"))


@query("""with x as (select p_partkey as id, p_size / 50.0::double as cosine, (p_partkey % 11) / 10.0::double as frac, p_retailprice / 500 - 1 as depth from part),
s as (select *, greatest(-1, least(1, (0.1 - cosine + 0.5) / 0.25)) as d from x)
select id, round(greatest(40, power(1336 * 0.85 * greatest(0, cosine) * frac / (0.975 * 5.670367e-8), 0.25)), 4) as kelvin, case when depth < 0 then 0 when depth < 0.5 then 1 when depth < 1 then 2 else 3 end as zone,
cast(floor(greatest(0, depth) * 4) as int) as class, cast(((cast(trunc(frac * 255) as int)) % 256) as int) as level, cast(trunc(greatest(-2, least(2, depth)) / 4 * 1e6) as int) as code, round((acos(d) - d * sqrt(1 - d * d)) / pi(), 5) as segment from s""")
def surface_photometry(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("cosine"), ((F.col("p_partkey") % 11) / 10).alias("frac"), (F.col("p_retailprice") / 500 - 1).alias("depth"))
    c, f, d = F.col("cosine"), F.col("frac"), F.col("depth")
    return x.select("id", F.round(ph.temperature(c, f), 4).alias("kelvin"), ph.zone(d).alias("zone"), ph.depth_class(d).alias("class"), ph.byte_level(f).alias("level"), ph.slope_code(d).alias("code"), F.round(ph.segment_fraction(F.lit(0.1) + 0.5, c), 5).alias("segment"))


# Geometry

_PX = "p as (select line * 400 + 7 as l, sample * 400 + 3 as s, h from grid), xy as (select *, (s - 15199.5) * 0.02 as x, (15199.5 - l) * 0.02 as y from p), pc as (select *, sqrt(x * x + y * y) as r, 2 * atan2(sqrt(x * x + y * y), 2 * 1737.4) as c from xy), ll as (select *, asin(-cos(c)) as lat, atan2(x, y) as lon from pc)"


def _pixels(spark, sf):
    g = grid(spark, sf).select((F.col("line") * 400 + 7).alias("l"), (F.col("sample") * 400 + 3).alias("s"), "h")
    lat, lon = geo.lat_lon(F.col("l"), F.col("s"))
    return g.withColumns({"lat": lat, "lon": lon})


@query(f"with {GRID}, {_PX} select l, s, round(degrees(lat), 4) as lat, round(degrees(lon), 4) as lon, round((1737.4 + h / 1000) * cos(lat) * cos(lon), 4) as x, round((1737.4 + h / 1000) * cos(lat) * sin(lon), 4) as y, round((1737.4 + h / 1000) * sin(lat), 4) as z from ll")
def pixel_to_body_point(spark, sf):
    p = _pixels(spark, sf)
    x, y, z = geo.body_point(F.col("lat"), F.col("lon"), F.col("h"))
    return p.select("l", "s", F.round(F.degrees("lat"), 4).alias("lat"), F.round(F.degrees("lon"), 4).alias("lon"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query(f"with {GRID} select line * 400 + 7 as l, sample * 400 + 3 as s, cast(line * 400 + 7 as double) as l2, cast(sample * 400 + 3 as double) as s2 from grid")
def pixel_round_trip(spark, sf):
    line, sample = geo.pixel_of(F.col("lat"), F.col("lon"))
    return _pixels(spark, sf).select("l", "s", F.round(line, 3).alias("l2"), F.round(sample, 3).alias("s2"))


@query(f"""with {GRID}, {_PX}, b as (select *, (1737.4 + h / 1000) as r1 from ll), v as (select *, -1737.4 as vz from b),
d as (select l, s, lat, lon, 1e5 - r1 * cos(lat) * cos(lon) as dx, 2e5 - r1 * cos(lat) * sin(lon) as dy, 3e3 - r1 * sin(lat) as dz from v),
f as (select l, s, (dx * cos(lon) + dy * sin(lon)) * sin(lat) - dz * cos(lat) as fx, dy * cos(lon) - dx * sin(lon) as fy, (dx * cos(lon) + dy * sin(lon)) * cos(lat) + dz * sin(lat) as fz from d)
select l, s, round(degrees(atan2(fy, fx) + pi()), 3) as az, round(degrees(atan2(fz, sqrt(fx * fx + fy * fy))), 3) as el, cast(floor(0.5 + (atan2(fy, fx) + pi()) * (1439 / (2 * pi()))) as int) as bin from f""")
def local_azimuth_elevation(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    at = geo.body_point(lat, lon, F.col("h"))
    az, el = geo.az_el(*geo.local_frame(F.lit(1e5), F.lit(2e5), F.lit(3e3), at, lat, lon))
    return _pixels(spark, sf).select("l", "s", F.round(F.degrees(az), 3).alias("az"), F.round(F.degrees(el), 3).alias("el"), geo.horizon_bin(az).alias("bin"))


@query(f"with {GRID} select (line * 400 + 7) // 128 as ty, (sample * 400 + 3) // 128 as tx, count(*) as n, min(h) as low, max(h) as high from grid group by 1, 2")
def tiles_of_pixels(spark, sf):
    tx, ty = geo.tile_of(F.col("l"), F.col("s"))
    return _pixels(spark, sf).groupBy(ty.alias("ty"), tx.alias("tx")).agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))


@query("""with t as (select c_custkey as id, c_custkey % 90 as d, c_custkey % 60 as m, (c_custkey % 600) / 10.0::double as s, c_custkey % 2 = 0 as north from customer)
select id, case when c then null else round((d + m / 60.0::double + s / 3600) * case when north then 1 else -1 end, 6) end as lat from (select *, d + m / 60.0::double + s / 3600 > 90 as c from t)""")
def degrees_minutes_seconds(spark, sf):
    k = F.col("c_custkey")
    told = F.format_string("%d°%d'%s\"%s", k % 90, k % 60, ((k % 600) / 10).cast("string"), F.when(k % 2 == 0, "N").otherwise("S"))
    return table(spark, sf, "customer").select(k.alias("id"), F.round(geo.degrees_minutes(told, "S", 90), 6).alias("lat"))


@query("select p_partkey as id, cast(floor(((v >> 11) & 31) * 255 / 31) as int) as r, cast(floor(((v >> 5) & 63) * 255 / 63) as int) as g, cast(floor((v & 31) * 255 / 31) as int) as b from (select p_partkey, cast((p_partkey * 7919) % 65536 as int) as v from part)")
def rgb_unpack(spark, sf):
    r, g, b = ph.rgb565(F.col("v"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919) % 65536).cast("int").alias("v")).select("id", r.alias("r"), g.alias("g"), b.alias("b"))


@query("select o_orderkey as id, (epoch_us(cast(o_orderdate as timestamp)) - epoch_us(timestamp '2000-01-01 12:00:00')) / 1e6 + 5 as et from orders")
def ephemeris_time(spark, sf):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp")) - F.unix_micros(F.lit("2000-01-01 12:00:00").cast("timestamp"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (us / 1e6 + 5).alias("et"))


# Rasters


@query(f"with {LEVELS} select cast(r.range as int) as v, count(l.v) as n from range(256) r left join levels l on l.v = r.range group by 1")
def byte_histogram(spark, sf):
    return raster.histogram(levels(spark, sf))


@query(f"with {LEVELS}, b as (select k, cast(trunc(10 * k * 255 / 100.0) as int) as lo, cast(trunc(10 * (k + 1) * 255 / 100.0) as int) as hi from range(10) t(k)) select cast(10 * k as int) as low, cast(10 * (k + 1) as int) as high, count(v) * 400.0::double as area from b left join levels on v >= lo and v < hi group by k")
def surface_area_bins(spark, sf):
    return raster.area_bins(levels(spark, sf))


_ROWS = f"""s as (select t.line, t.sample, {', '.join(f'max(case when g.line = greatest(0, least({SIDE - 1}, t.line + ({dy}))) and g.sample = greatest(0, least({SIDE - 1}, t.sample + ({dx}))) then g.h end) as {n}' for n, (dy, dx) in zip('abcdefghi', [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)], strict=True))}
from grid t join grid g on abs(g.line - t.line) <= 1 and abs(g.sample - t.sample) <= 1 group by 1, 2),
z as (select line, sample, ((c + 2 * f + i) - (a + 2 * d + g)) / 160 as dzdx, ((g + 2 * h + i) - (a + 2 * b + c)) / 160 as dzdy from s)"""


@query(f"with {GRID}, {_ROWS} select line, sample, round(dzdx, 10) as dzdx, round(dzdy, 10) as dzdy, round(255 * greatest(0, cos(radians(45)) * cos(atan(sqrt(dzdx ** 2 + dzdy ** 2))) + sin(radians(45)) * sin(atan(sqrt(dzdx ** 2 + dzdy ** 2))) * cos(radians(135) - atan2(dzdy, -dzdx))), 3) as shade from z where dzdx is not null and dzdy is not null")
def hillshade(spark, sf):
    s = raster.hillshade(raster.horn(grid(spark, sf), SIDE, SIDE, 20.0).where("dzdx is not null and dzdy is not null"), 135.0, 45.0)
    return s.select("line", "sample", F.round("dzdx", 10).alias("dzdx"), F.round("dzdy", 10).alias("dzdy"), F.round("shade", 3).alias("shade"))


@query(f"with {GRID} select t.line, t.sample, max(g.h) as disc_max from grid t join grid g on (g.line - t.line) * (g.line - t.line) + (g.sample - t.sample) * (g.sample - t.sample) <= 4 and abs(g.line - t.line) <= 2 group by 1, 2")
def disc_neighbourhood(spark, sf):
    return raster.disc_max(grid(spark, sf), 2)


@query(f"with {GRID} select t.line, t.sample from grid t join grid g on (g.line - t.line) * (g.line - t.line) + (g.sample - t.sample) * (g.sample - t.sample) <= 4 and abs(g.line - t.line) <= 2 group by 1, 2 having max(g.h) <= 40")
def landing_discs(spark, sf):
    return raster.disc_max(grid(spark, sf), 2).where("disc_max <= 40").select("line", "sample")


@query(f"with {LEVELS}, a as (select line, sample, v from levels where line between 8 and 39 and sample between 8 and 39), b as (select line, sample, 255 - v as v from levels where line between 24 and 55 and sample between 24 and 55) select coalesce(a.line, b.line) as line, coalesce(a.sample, b.sample) as sample, coalesce(b.v, a.v) as v from a full join b on a.line = b.line and a.sample = b.sample")
def mosaic(spark, sf):
    v = levels(spark, sf)
    back = lambda r, k: r.withColumns({"line": F.col("line") + k, "sample": F.col("sample") + k})
    return raster.mosaic([back(raster.clipped(v, 8, 8, 32, 32), 8), back(raster.clipped(v, 24, 24, 32, 32), 24).withColumn("v", 255 - F.col("v"))])


@query(f"with {LEVELS} select a.line, a.sample, cast(least(255, a.v + b.v) as int) as v from levels a join levels b on a.line = b.sample and a.sample = b.line")
def raster_merge(spark, sf):
    v = levels(spark, sf)
    turned = v.select(F.col("sample").alias("line"), F.col("line").alias("sample"), "v")
    return raster.merged(v, turned, lambda a, b: F.least(F.lit(255), a + b).cast("int"))


@query(f"with {LEVELS} select line, sample, round(case when v = 0 then 0.5 * v else 0.8 * v + 0.4 * h end, 4) as v from levels join grid using (line, sample)")
def raster_mask(spark, sf):
    both = levels(spark, sf).join(grid(spark, sf), ["line", "sample"])
    return both.select("line", "sample", F.round(F.when(F.col("v") == 0, 0.5 * F.col("v")).otherwise(0.8 * F.col("v") + 0.4 * F.col("h")), 4).alias("v"))


@query(f"with {LEVELS} select line, sample // 8 as byte, cast(sum(case when v >= 128 then 1 << (sample % 8) else 0 end) as int) as bits from levels group by 1, 2")
def bit_planes(spark, sf):
    return raster.packed_bits(levels(spark, sf).select("line", "sample", (F.col("v") >= 128).alias("bit")))


@query(f"with {LEVELS} select line, sample, v >= 128 as bit from levels where v >= 128")
def bit_plane_round_trip(spark, sf):
    return raster.unpacked_bits(raster.packed_bits(levels(spark, sf).select("line", "sample", (F.col("v") >= 128).alias("bit")))).where("bit")


@query(f"with {LEVELS} select line, sample, coalesce(min(k) filter (v * (k + 1) >= 600), 255) as mast from levels cross join (select cast(unnest([0, 1, 2, 3, 4, 6, 8, 10]) as int) as k) group by 1, 2")
def mast_height(spark, sf):
    v = levels(spark, sf).withColumn("height", F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3, 4, 6, 8, 10)])))
    return raster.lowest_mast(v.withColumn("v", F.col("v") * (F.col("height") + 1)), 600)


@query(f"with {LEVELS} select line, sample, v from levels order by v desc, line, sample limit 100")
def best_pixels(spark, sf):
    return raster.top(levels(spark, sf), 100)


@query(f"with {GRID}, t as (select *, (line // 16) * 4 + sample // 16 as tile from grid), a as (select *, row_number() over (partition by tile order by h desc, line, sample) as k from t) select tile, min(line) as top, max(line) as bottom, min(sample) as left, max(sample) as right, min(h) as low, max(h) as high, max(line) filter (k = 1) as line, max(sample) filter (k = 1) as sample from a group by tile".replace(" as left", ' as "left"').replace(" as right", ' as "right"'))
def tile_summary(spark, sf):
    return raster.tile_bounds(grid(spark, sf), (F.floor(F.col("line") / 16) * 4 + F.floor(F.col("sample") / 16)).cast("int"))


@query(f"with {LEVELS}, p(lo, hi, colour) as (values (0, 63, 'black'), (64, 127, 'blue'), (128, 191, 'green'), (192, 255, 'white')) select colour, count(*) as n from levels join p on v between lo and hi group by 1")
def colour_map(spark, sf):
    names = F.array(*[F.lit(x) for x in ("black", "blue", "green", "white")])
    return levels(spark, sf).groupBy(F.get(names, F.floor(F.col("v") / 64).cast("int")).alias("colour")).agg(F.count("*").alias("n"))


@query(f"with {LEVELS} select line, sample, cast(v = 0 as int) * 255 as v from levels where v = 0 or (line + sample) % 7 = 0")
def dark_mask(spark, sf):
    return levels(spark, sf).where("v = 0 or (line + sample) % 7 = 0").select("line", "sample", F.when(F.col("v") == 0, 255).otherwise(0).alias("v"))


# Aggregates, joins


@query("select p_brand as brand, round(avg(p_size), 6) as mean, round(stddev_samp(p_size), 6) as deviation, min(p_retailprice) as low, max(p_retailprice) as high from part group by 1")
def depth_statistics(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.round(F.avg("p_size"), 6).alias("mean"), F.round(F.stddev_samp("p_size"), 6).alias("deviation"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("select class, p_partkey as id from (select p_size // 5 as class, p_partkey, row_number() over (partition by p_size // 5 order by p_partkey) as k from part) where k <= 10")
def first_ten_of_class(spark, sf):
    p = table(spark, sf, "part").select(F.floor(F.col("p_size") / 5).cast("int").alias("class"), F.col("p_partkey").alias("id"))
    return p.withColumn("k", F.row_number().over(W.partitionBy("class").orderBy("id"))).where("k <= 10").drop("k")


@query("select user_id % 72 as bin, min(value) as low, max(value) as high, arg_max(event_id, value * 1000000 + event_id / 1e9) as at from events group by 1")
def slope_extremes(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 72).alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("event_id", F.struct("value", "event_id")).alias("at"))


_PTS = "p as (select c_custkey as pid, cast((c_custkey * 7919) % 1009 as double) as px, cast((c_custkey * 104729) % 1013 as double) as py from customer), s as (select s_suppkey as sid, cast((s_suppkey * 6101) % 997 as double) as sx, cast((s_suppkey * 3571) % 991 as double) as sy from supplier)"


def _points(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = table(spark, sf, "customer").select(k.alias("pid"), (k * 7919 % 1009).cast("double").alias("px"), (k * 104729 % 1013).cast("double").alias("py"))
    return p, table(spark, sf, "supplier").select(s.alias("sid"), (s * 6101 % 997).cast("double").alias("sx"), (s * 3571 % 991).cast("double").alias("sy"))


@query(f"with {_PTS}, d as (select pid, sid, (px - sx) ** 2 + (py - sy) ** 2 as d2 from p cross join s), k as (select *, row_number() over (partition by pid order by d2, sid) as k from d) select pid, sid, d2 from k where k = 1")
def nearest_sample(spark, sf):
    return spatial.nearest(*_points(spark, sf), cell=50.0)


@query(f"with {_PTS}, b as (select sid as bid, sx as x1, sy as y1, sx + 40 as x2, sy + 25 as y2 from s) select pid, bid from p join b on px between x1 and x2 and py between y1 and y2")
def points_in_chunks(spark, sf):
    p, s = _points(spark, sf)
    return spatial.in_chunks(p, s.select(F.col("sid").alias("bid"), F.col("sx").alias("x1"), F.col("sy").alias("y1"), (F.col("sx") + 40).alias("x2"), (F.col("sy") + 25).alias("y2")), 50.0)


@query(f"with {_PTS} select pid, sid from p join s on (px - sx) ** 2 + (py - sy) ** 2 < 900")
def samples_within_radius(spark, sf):
    p, s = _points(spark, sf)
    box = s.select(F.col("sid").alias("bid"), (F.col("sx") - 30).alias("x1"), (F.col("sy") - 30).alias("y1"), (F.col("sx") + 30).alias("x2"), (F.col("sy") + 30).alias("y2"))
    near = spatial.in_chunks(p, box, 50.0).join(p, "pid").join(s, F.col("bid") == F.col("sid"))
    return near.where((F.col("px") - F.col("sx")) ** 2 + (F.col("py") - F.col("sy")) ** 2 < 900).select("pid", "sid")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber >= 4) and exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)")
def remaining_jobs(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return text.remaining(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"]).join(known, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select o_orderkey as id, format('sun_{:05d}_{:05d}_{:03d}_', o_orderkey % 30400, o_custkey % 30400, o_orderkey % 100) || strftime(o_orderdate, '%Y%m%d') || '_' || strftime(o_orderdate + interval 30 day, '%Y%m%d') || '_06.bin' as name from orders")
def product_names(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf, "orders").select(k.alias("id"), text.product_name("sun", k % 30400, F.col("o_custkey") % 30400, k % 100, t, t + F.expr("interval 30 days"), F.lit(6)).alias("name"))


# Horizons and meshes


@query(f"""with {GRID}, t as (select line as tline, sample as tsample, h as th from grid),
p as (select tline, tsample, cast(g.sample - tsample as double) as dx, cast(tline - g.line as double) as dy, g.h - th as rise from t join grid g on abs(g.sample // 8 - tsample // 8) <= 2 and abs(g.line // 8 - tline // 8) <= 2)
select tline, tsample, cast(floor(0.5 + (atan2(dy, dx) + pi()) * (179 / (2 * pi()))) as int) as bin, round(max(rise / sqrt(dx * dx + dy * dy)), 6) as slope from p where dx <> 0 or dy <> 0 group by 1, 2, 3""")
def horizon_slopes(spark, sf):
    g = grid(spark, sf)
    out = horizon.horizon(g, g, 8, 2, bins=180)
    return out.withColumn("slope", F.round("slope", 6))


@query("with a as (select user_id % 5 as pid, event_id % 72 as bin, max(value) as v from events group by 1, 2) select pid, bin, v from a")
def horizon_merge(spark, sf):
    ev = table(spark, sf, "events").select((F.col("user_id") % 5).alias("pid"), (F.col("event_id") % 72).cast("int").alias("bin"), "value", (F.col("event_id") % 2).alias("half"))
    arrays = lambda k: ev.where(F.col("half") == k).groupBy("pid", "bin").agg(F.max("value").alias("v")).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m")).select("pid", F.transform(F.sequence(F.lit(0), F.lit(71)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(-1e9))).alias("h"))
    both = arrays(0).join(arrays(1).withColumnRenamed("h", "h2"), "pid", "full").select("pid", horizon.merged(F.coalesce("h", "h2"), F.coalesce("h2", "h")).alias("h"))
    return both.select("pid", F.posexplode("h").alias("bin", "v")).where("v > -1e9").select("pid", F.col("bin").cast("long").alias("bin"), "v")


@query("with i as (select cast(s_suppkey % 20 as int) as x, cast(s_suppkey // 20 % 20 as int) as y from supplier group by 1, 2), o as (select cast(a.range - 3 as int) as a, cast(b.range - 3 as int) as b from range(7) a cross join range(7) b) select x, y, x + a as nx, y + b as ny from i cross join o where greatest(abs(a), abs(b)) = 3 and x + a between 0 and 19 and y + b between 0 and 19")
def neighbour_rings(spark, sf):
    ids = table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).cast("int").alias("x"), F.floor(F.col("s_suppkey") / 20 % 20).cast("int").alias("y")).distinct()
    return horizon.ring(ids, 3, 20, 20)


def _quadtree(step: int) -> str:
    gap = lambda n, t: f"greatest(0, {n} - ({t} + 1), {t} - ({n} + step))"
    return f"""with recursive t as (select cast(s_suppkey % 16 as int) as x, cast(s_suppkey // 16 % 16 as int) as y from supplier group by 1, 2),
n(x, y, nx, ny, step, d, fine) as (
select x, y, 0, 0, {step}, 0.0::double, false from t
union all
select *, (step <= 1 or step < d * 128 * (2 * pi() / 1440)) and not (nx < x + 1 and x < nx + step and ny < y + 1 and y < ny + step) as fine from (
select x, y, nx, ny, step, sqrt(cast({gap('nx', 'x')} ** 2 + {gap('ny', 'y')} ** 2 as double)) as d from (
select x, y, nx + o.a * (step // 2) as nx, ny + o.b * (step // 2) as ny, step // 2 as step from n cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b) where not fine and step > 1)) where d <= 90)
select x, y, nx, ny, step from n where fine"""


@query(_quadtree(32))
def far_field_nodes(spark, sf):
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select((k % 16).cast("int").alias("x"), F.floor(k / 16 % 16).cast("int").alias("y")).distinct()
    return horizon.far_nodes(t, root=32)


@query(_quadtree(256).replace("select x, y, nx, ny, step from n where fine", "select count(*) as nodes, count(*) * 0.1625::double as seconds from n where fine"))
def far_field_work(spark, sf):
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select((k % 16).cast("int").alias("x"), F.floor(k / 16 % 16).cast("int").alias("y")).distinct()
    return horizon.work(t)


@query(f"with {GRID}, c as (select a.line, a.sample from grid a join grid b on b.line = a.line + 4 and b.sample = a.sample join grid c on c.line = a.line and c.sample = a.sample + 4 join grid d on d.line = a.line + 4 and d.sample = a.sample + 4 where a.line % 4 = 0 and a.sample % 4 = 0) select line, sample, 2 as faces from c")
def mesh_faces(spark, sf):
    return mesh.faces(mesh.vertices(grid(spark, sf), 4), 4).groupBy("line", "sample").agg(F.count("*").cast("int").alias("faces"))


# Streams


@query("select time_bucket(interval 2 hour, cast(ts as timestamp)) as start, event_type, count(*) as n, max(value) as top from events group by 1, 2")
def stream_windows(spark, sf):
    return tracker.drained(tracker.windowed(tracker.event_stream(spark, sf))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""with e as (select *, value < {LIT} as dark, row_number() over (partition by user_id order by ts, event_id) as k from events), g as (select *, sum(case when dark then 0 else 1 end) over (partition by user_id order by k) as part from e),
r as (select user_id, part, count(*) filter (dark) as n, max(k) as k from g group by 1, 2) select user_id, arg_max(n, k) as dark, max(n) as longest from r group by 1""")
def stream_dark_runs(spark, sf):
    return tracker.drained(tracker.dark_counts(tracker.event_stream(spark, sf), LIT), "update")
