"""More of the engine's queries: light over horizons, heights, normals, frames, sites, meshes, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions import geometry as geo
from lumenfield.functions import palettes, vectors as vec
from lumenfield.operators import curves, horizon, mesh, raster, rays, runs, sampling, spatial
from lumenfield.plans.queries import _DISC, _PTS, _points, query
from lumenfield.plans.stand_ins import CURVE, GRID, LEVELS, RUNS, SIDE, curve, grid, levels, lit, table
from lumenfield.sources import sites

_Q7 = "k as (select c_custkey as pid, ((c_custkey * 7919) % 434) / 7.0::double as py, ((c_custkey * 104729) % 434) / 7.0::double as px from customer), p as (select *, cast(floor(py) as int) as l, cast(floor(px) as int) as s from k)"


@query(f"""with {GRID}, {_Q7} select pid, round(a.h * (1 - (py - l)) * (1 - (px - s)) + b.h * (1 - (py - l)) * (px - s) + c.h * (py - l) * (1 - (px - s)) + d.h * (py - l) * (px - s), 6) as h
from p join grid a on a.line = l and a.sample = s join grid b on b.line = l and b.sample = s + 1 join grid c on c.line = l + 1 and c.sample = s join grid d on d.line = l + 1 and d.sample = s + 1""")
def bilinear_heights(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("pid"), (k * 7919 % 434 / F.lit(7.0)).alias("py"), (k * 104729 % 434 / F.lit(7.0)).alias("px"))
    return sampling.bilinear(p, grid(spark, sf)).withColumn("h", F.round("h", 6))


@query(f"""with {GRID}, n as (select a.line, a.sample, -20 * (b.h - a.h) as x, -20 * (c.h - a.h) as y, 400.0::double as z from grid a join grid b on b.line = a.line + 1 and b.sample = a.sample join grid c on c.line = a.line and c.sample = a.sample - 1),
u as (select *, sqrt(x * x + y * y + z * z) as d from n) select line, sample, round(x / d, 9) as nx, round(y / d, 9) as ny, round(z / d, 9) as nz, round(0.75 * greatest(0, (3 * x - 4 * y + 5 * z) / d / sqrt(50)), 9) as light from u""")
def surface_light(spark, sf):
    g = raster.neighbours(grid(spark, sf))
    n = vec.surface_normal(F.col("h"), F.col("h_line"), F.col("h_sample"))
    g = g.select("line", "sample", *[x.alias(name) for x, name in zip(n, ("nx", "ny", "nz"), strict=True)])
    sun = vec.contribution(F.lit(0.75), (F.lit(3.0), F.lit(-4.0), F.lit(5.0)), (F.col("nx"), F.col("ny"), F.col("nz")))
    return g.select("line", "sample", *[F.round(x, 9).alias(x) for x in ("nx", "ny", "nz")], F.round(sun, 9).alias("light"))


#: Pixels some 110 km from the pole with heights in metres, and their body points: line, sample, h, x, y, z, lat, lon.
_POLE = f"""{GRID}, cells as (select line + 10000 as line, sample + 13001 as sample, h * 20 as h from grid),
plane as (select *, (sample - 15199.5e0) * 0.02e0 as px, (15199.5e0 - line) * 0.02e0 as py from cells),
away as (select *, 2e0 * atan2(sqrt(px * px + py * py), 3474.8e0) as c, sqrt(px * px + py * py) as p from plane),
turned as (select line, sample, h, asin(cos(c) * sin(-pi() / 2) + py * sin(c) * cos(-pi() / 2) / p) as lat, atan2(px, py) as lon, h / 1000 + 1737.4e0 as r from away),
pts as (select line, sample, h, lat, lon, r * cos(lat) * cos(lon) as x, r * cos(lat) * sin(lon) as y, r * sin(lat) as z from turned)"""


def _pole(spark, sf):
    return grid(spark, sf).select((F.col("line") + 10000).alias("line"), (F.col("sample") + 13001).alias("sample"), (F.col("h") * 20).alias("h"))


def _mixed(name: str, to: str) -> str:
    """SQL of a value between four cells."""
    first, second = f"(a.{name} + (cl - yl) * (b.{name} - a.{name}))", f"(c.{name} + (cl - yl) * (d.{name} - c.{name}))"
    return f"{first} + (cs - xs) * ({second} - {first}) as {to}"


_CORNERS = "join {0} a on a.line = yl and a.sample = xs join {0} b on b.line = yl + 1 and b.sample = xs join {0} c on c.line = yl and c.sample = xs + 1 join {0} d on d.line = yl + 1 and d.sample = xs + 1"
_RAYS, _FAR, _OBSERVER = 47, 6.0, 2.0


@query(f"""with {_POLE}, ray as (select cast(range as int) as k, 2e0 * pi() * range / {_RAYS} as a from range({_RAYS})), stp as (select 1e0 + range * 0.5e0 as dist from range({int((_FAR - 1) / 0.5) + 1})),
seen as (select t.line as tl, t.sample as ts, t.x as tx, t.y as ty, t.z as tz, t.lat as tlat, t.lon as tlon, ray.k, dist, t.line + sin(ray.a) * dist as cl, t.sample + cos(ray.a) * dist as cs from pts t cross join ray cross join stp),
spot as (select *, cast(floor(cl) as int) as yl, cast(floor(cs) as int) as xs from seen),
hit as (select tl, ts, tx, ty, tz, tlat, tlon, k, dist, {_mixed("x", "gx")}, {_mixed("y", "gy")}, {_mixed("z", "gz")} from spot {_CORNERS.format("pts")}),
moved as (select *, (gx - tx) * cos(tlon) + (gy - ty) * sin(tlon) as e, (gy - ty) * cos(tlon) - (gx - tx) * sin(tlon) as ly, gz - tz as dz from hit),
loc as (select tl, ts, k, dist, e * sin(tlat) - dz * cos(tlat) as lx, ly, e * cos(tlat) + dz * sin(tlat) as lz from moved),
dirs as (select tl, ts, k, cast(floor(0.5e0 + (atan2(ly, lx) + pi()) * (1439 / (2e0 * pi()))) as int) as bin from loc where dist = 1)
select tl as line, ts as sample, bin, round(max((lz - {_OBSERVER} / 1000) / sqrt(lx * lx + ly * ly)), 6) + 0e0 as slope from loc join dirs using (tl, ts, k) group by 1, 2, 3""")
def near_horizon_rays(spark, sf):
    g = _pole(spark, sf)
    out = rays.near_horizons(g, g, far=_FAR, step=0.5, rays=_RAYS, observer_m=_OBSERVER)
    each = out.select("line", "sample", F.explode(F.arrays_zip("bins", "slopes")).alias("x"))
    return each.select("line", "sample", F.col("x.bins").alias("bin"), F.round("x.slopes", 6).alias("slope"))


_RISE, _RANGES = 24, (1.0, 2.0, 4.0, 8.0)


@query(f"""with {_POLE}, ray as (select range as k, 2e0 * pi() * range / {_RISE} as a, -0.02e0 + 0.002e0 * range as slope from range({_RISE})), rng(dist) as (values {", ".join(f"({x}::double)" for x in _RANGES)}),
seen as (select t.line as tl, t.sample as ts, t.x as tx, t.y as ty, t.z as tz, slope, t.line + sin(ray.a) * dist as cl, t.sample + cos(ray.a) * dist as cs from pts t cross join ray cross join rng),
spot as (select *, cast(floor(cl) as int) as yl, cast(floor(cs) as int) as xs from seen),
hit as (select tl, ts, tx, ty, tz, slope, (cs - 15199.5e0) * 0.02e0 as px, (15199.5e0 - cl) * 0.02e0 as py, {_mixed("h", "h")} from spot {_CORNERS.format("pts")}),
dist as (select *, sqrt(px * px + py * py) as p from hit), ang as (select *, 2e0 * atan2(p, 3474.8e0) as c, h / 1000 + 1737.4e0 as r from dist),
sph as (select *, asin(cos(c) * sin(-pi() / 2) + case when py = 0 then 0 else py * sin(c) * cos(-pi() / 2) / p end) as lat, atan2(px, py) as lon from ang),
far as (select tl, ts, slope, tz, r * sin(lat) as z, sqrt(pow(r * cos(lat) * cos(lon) - tx, 2) + pow(r * cos(lat) * sin(lon) - ty, 2)) as d from sph)
select p.line, p.sample, round(max(1000 * (-far.z - slope * d + tz)), 3) + 0e0 as rise from pts p left join far on tl = p.line and ts = p.sample group by 1, 2""")
def rise_height(spark, sf):
    g = _pole(spark, sf)
    return rays.rise_heights(g, g, [-0.02 + 0.002 * k for k in range(_RISE)], list(_RANGES)).withColumn("rise", F.round("rise", 3))


@query(f"""with {_POLE}, met as (select t.line as tline, t.sample as tsample, t.lat, t.lon, c.x - t.x as dx, c.y - t.y as dy, c.z - t.z as dz from pts t join pts c on abs(c.line // 8 - t.line // 8) <= 1 and abs(c.sample // 8 - t.sample // 8) <= 1 and (c.line <> t.line or c.sample <> t.sample)),
turn as (select *, dx * cos(lon) + dy * sin(lon) as e, dy * cos(lon) - dx * sin(lon) as ly from met),
loc as (select tline, tsample, e * sin(lat) - dz * cos(lat) as lx, ly, e * cos(lat) + dz * sin(lat) as lz from turn)
select tline, tsample, cast(floor(0.5e0 + (atan2(ly, lx) + pi()) * (359 / (2e0 * pi()))) as int) as bin, round(max((lz - {_OBSERVER} / 1000) / sqrt(lx * lx + ly * ly)), 3) + 0e0 as slope from loc group by 1, 2, 3""")
def local_frame_horizons(spark, sf):
    g = _pole(spark, sf)
    return horizon.local_horizon(g, g, tile=8, reach=1, bins=360, observer_m=_OBSERVER).withColumn("slope", F.round("slope", 3))


_NIGHTS = (100.0, 250.0, 400.0)


@query(f"""with {CURVE()}, b(band, t) as (values {", ".join(f"({k}, {t}::double)" for k, t in enumerate(_NIGHTS))}), s as (select pid, band, i, v >= t as lit from curve cross join b),
e as (select *, case when lag(lit) over w is distinct from lit then 1 else 0 end as chg, count(*) over (partition by pid, band) as n from s window w as (partition by pid, band order by i)),
g as (select *, sum(chg) over (partition by pid, band order by i) as isl from e), r as (select pid, band, isl, n, lit, max(i) + 1 as stop, count(*) as len from g group by all)
select pid, band, coalesce(max(case when not lit and stop < n then len end), max(n)) as longest_night from r group by 1, 2""")
def longest_night_bands(spark, sf):
    return runs.longest_nights(curve(spark, sf), list(_NIGHTS))


_STEPS = 96


@query(f"""with pids as (select distinct user_id as pid from events), hl as (select p.pid, cast(b.range as int) as bin, cast((p.pid * 7 + b.range * 13) % 97 as double) / 97 * 2 as deg from pids p cross join range(1440) b),
q as (select pid, cast(range as int) as i, cast(range * 37 % 3600 as double) / 10 as az, cast(range * 11 % 400 as double) / 100 - 1 as el from pids cross join range({_STEPS})), disc(k, c) as (values {_DISC}),
a as (select *, (az - 0.395e0) * 4e0 as b from q), b1 as (select *, cast(tb as int) as j, b - tb as f0 from (select *, case when b < 0 then ceil(b) else floor(b) end as tb from a)),
c1 as (select b1.*, d.c, f0 + d.k * 0.135e0 as g from b1 cross join disc d), e as (select *, cast(greatest(0, floor(g)) as int) as o from c1),
f as (select pid, i, el, c, g - o as fr, ((j + 1440) % 1440 + o) % 1440 as l, ((j + 1440) % 1440 + o + 1) % 1440 as r from e),
w as (select f.pid, f.i, sum(greatest(0, least(2e0 * f.c, f.el + f.c - (hl.deg + f.fr * (hr.deg - hl.deg))))) / (2e0 * sum(f.c)) as v from f join hl on hl.pid = f.pid and hl.bin = f.l join hl hr on hr.pid = f.pid and hr.bin = f.r group by 1, 2)
select pid, round(avg(v), 6) as mean, count(*) filter (v > 0.5) as steps_lit from w group by 1""")
def light_over_horizons(spark, sf):
    bins = F.sequence(F.lit(0), F.lit(geo.BINS - 1))
    pixels = table(spark, sf, "events").select(F.col("user_id").alias("pid")).distinct().withColumn("horizon", F.transform(bins, lambda b: F.pmod(F.col("pid") * 7 + b * 13, F.lit(97)).cast("double") / 97 * 2))
    sun = spark.range(_STEPS).select(F.col("id").cast("int").alias("i"), ((F.col("id") * 37 % 3600).cast("double") / 10).alias("az"), ((F.col("id") * 11 % 400).cast("double") / 100 - 1).alias("el"))
    return curves.light(pixels, sun, _STEPS).groupBy("pid").agg(F.round(F.avg("v"), 6).alias("mean"), F.count_if(F.col("v") > 0.5).alias("steps_lit"))


@query(f"with {CURVE()}, {RUNS()} select pid, lit, start, stop from r where stop < n")
def light_events(spark, sf):
    return curves.events(runs.runs(lit(curve(spark, sf))))


_IDS = "i as (select cast(s_suppkey % 20 as int) as x, cast(s_suppkey // 20 % 20 as int) as y from supplier group by 1, 2)"


def _ids(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select((k % 20).cast("int").alias("x"), F.floor(k / 20 % 20).cast("int").alias("y")).distinct()


@query(f"with {_IDS} select x, y, x + 1 as nx, y - 2 as ny from i where x + 1 <= 19 and y - 2 >= 0")
def adjacent_tiles(spark, sf):
    return horizon.adjacent(_ids(spark, sf), 1, -2, 20, 20)


def _pairs(spark, sf):
    """Tiles, those within nine tiles of them, two vectors to each, and a horizon of steps."""
    ids = _ids(spark, sf)
    rings = [horizon.ring(ids, r, 20, 20) for r in (5, 9)]
    p = rings[0].unionAll(rings[1])
    az, _ = geo.az_el((F.col("nx") - F.col("x")).cast("double"), (F.col("ny") - F.col("y")).cast("double"), F.lit(0.0))
    slope = F.pmod(F.col("nx") * 13 + F.col("ny") * 7, F.lit(11)).cast("double")
    p = p.withColumn("vectors", F.array(F.struct(az.alias("az"), slope.alias("slope")), F.struct(az.alias("az"), (slope - 1).alias("slope"))))
    return p.withColumn("horizon", F.transform(F.sequence(F.lit(0), F.lit(geo.BINS - 1)), lambda b: F.pmod(b.cast("int") * 7 + F.col("x"), F.lit(10)).cast("double")))


_RISING = f"""{_IDS}, o as (select cast(a.range - 9 as int) as a, cast(b.range - 9 as int) as b from range(19) a cross join range(19) b), t as (select x, y, x + a as nx, y + b as ny from i cross join o where greatest(abs(a), abs(b)) in (5, 9) and x + a between 0 and 19 and y + b between 0 and 19),
v as (select *, cast(floor(0.5 + (atan2(ny - y, nx - x) + pi()) * (1439 / (2 * pi()))) as int) as bin from t),
k as (select x, y, nx, ny from v where (x - nx) ** 2 + (y - ny) ** 2 <= 36 or (nx * 13 + ny * 7) % 11 > (bin * 7 + x) % 10)"""


@query(f"with {_RISING} select * from k")
def rising_casters(spark, sf):
    return horizon.rising(_pairs(spark, sf)).select("x", "y", "nx", "ny")


@query(f"with {_RISING} select * from k where (nx + ny) % 3 <> 0")
def missing_casters(spark, sf):
    p = horizon.rising(_pairs(spark, sf)).select("x", "y", "nx", "ny")
    return p.join(p.where((F.col("nx") + F.col("ny")) % 3 == 0), ["x", "y", "nx", "ny"], "left_anti")


@query("with b as (select distinct user_id as pid, cast(floor(epoch(ts) / 7200) % 360 as int) as bin from events), p as (select *, bin - row_number() over (partition by pid order by bin) as part from b) select pid, min(bin) as first, max(bin) as last from p group by pid, part")
def horizon_spans(spark, sf):
    b = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 7200 % 360).cast("int")
    return horizon.spans(table(spark, sf, "events").groupBy(F.col("user_id").alias("pid"), b.alias("bin")).agg(F.max("value").alias("v")))


@query(f"with {GRID}, t as (select sample // 16 as tx, line // 16 as ty, line, sample, h, row_number() over (partition by line // 16, sample // 16 order by h desc, line, sample) as n from grid), h as (select * from t where n = 1), c(k, a, b) as (values (1, 0, 0), (2, 15, 0), (3, 15, 15), (4, 0, 15)) select tx, ty, 0 as k, cast(line as bigint) as line, cast(sample as bigint) as sample, h + 0.2 as r from h union all select tx, ty, k, cast(ty * 16 + b as bigint), cast(tx * 16 + a as bigint), h + 0.2 from h cross join c")
def tile_test_points(spark, sf):
    return sampling.test_points(grid(spark, sf).withColumnRenamed("h", "r"), 16)


_SITES = ", ".join(f"({s}, {str(p).lower()}, {a!r}::double, {o!r}::double)" for s, p, _, a, o in sites.CENTRES)
_BOXES = ", ".join(f"({s}, {str(p).lower()}, {a * 128}, {b * 128}, {c * 128}, {d * 128})" for s, p, _, a, b, c, d in sites.TILES)
_EXTENTS = f"""c(site, south, lat, lon) as (values {_SITES}), xy as (select *, 2 * 1737.4 * tan(pi() / 4 + radians(lat) / 2) as p from c),
e as (select site, south, cast(trunc(p * sin(radians(lon)) / 0.02 + 15201) as int) as sample, 30400 + cast(trunc(1 - 15199.5 - p * cos(radians(lon)) / 0.02) as int) as line from xy),
b(site, south, x1, y1, x2, y2) as (select site, south, sample - 500, line - 500, sample + 500, line + 500 from e union all select * from (values {_BOXES}))"""


@query(f"with {_EXTENTS} select * from b where south")
def southern_sites(spark, sf):
    return sites.sites(spark, south=True).drop("name")


@query(f"with {_EXTENTS}, x as (select *, unnest(range(x1 // 128, (x2 - 1) // 128 + 1)) as id_x from b), t as (select *, unnest(range(y1 // 128, (y2 - 1) // 128 + 1)) as id_y from x) select south, cast(id_x as int) as id_x, cast(id_y as int) as id_y, count(*) as n_sites from t group by 1, 2, 3")
def site_tiles(spark, sf):
    return sites.site_tiles(sites.sites(spark))


@query(f"with {_PTS}, d as (select pid, min((px - sx) ** 2 + (py - sy) ** 2) as d2 from p cross join s group by 1) select pid, case when d2 <= 100 then 1 when d2 <= 900 then 4 when d2 <= 2500 then 16 else 64 end as zoom from d")
def mesh_zoom(spark, sf):
    d = spatial.nearest(*_points(spark, sf), cell=50.0)
    return d.select("pid", palettes.at_or_above([100, 900, 2500], [1, 4, 16], F.col("d2")).alias("near"), "d2").select("pid", F.when(F.col("d2") > 2500, 64).otherwise(F.col("near")).alias("zoom"))


@query(f"with {GRID}, f as (select a.line from grid a join grid b on b.line = a.line + 1 and b.sample = a.sample join grid c on c.line = a.line and c.sample = a.sample + 1 join grid d on d.line = a.line + 1 and d.sample = a.sample + 1) select (select count(*) from grid) as vertices, 2 * (select count(*) from f) as faces")
def mesh_counts(spark, sf):
    return mesh.counts(grid(spark, sf))


@query("select event_type, cast(min(floor(epoch(ts))) as bigint) as start, cast(max(floor(floor(epoch(ts)) + value)) as bigint) as stop from events group by 1")
def coverage_windows(spark, sf):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.min(t).alias("start"), F.max(F.floor(t + F.col("value"))).alias("stop"))


_PALETTE = ", ".join(f"({k}, {c})" for k, c in enumerate(palettes.light_levels()))


@query(f"with {LEVELS}, p(k, c) as (values {_PALETTE}) select line, sample, v * 0.5::double as half, c as colour from levels join p on k = least(99, v * 100 // 255)")
def light_level_colours(spark, sf):
    v = levels(spark, sf).withColumn("colour", palettes.indexed(palettes.light_levels(), F.floor(F.col("v") * 100 / 255).cast("int")))
    return raster.scaled(v, 0.5).select("line", "sample", F.col("v").alias("half"), "colour")


@query("""with a as (select c_custkey as aid, (c_custkey * 7919) % 1009 as x1, (c_custkey * 104729) % 1013 as y1, c_custkey % 60 as w, c_custkey % 45 as h from customer), b as (select s_suppkey as bid, (s_suppkey * 6101) % 997 as u1, (s_suppkey * 3571) % 991 as v1 from supplier)
select aid, bid, greatest(x1, u1) as x1, greatest(y1, v1) as y1, least(x1 + w, u1 + 40) as x2, least(y1 + h, v1 + 70) as y2 from a join b on greatest(x1, u1) < least(x1 + w, u1 + 40) and greatest(y1, v1) < least(y1 + h, v1 + 70)""")
def rectangle_intersections(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, sf, "customer").select(k.alias("aid"), (k * 7919 % 1009).alias("x1"), (k * 104729 % 1013).alias("y1"), "c_custkey").select("aid", "x1", "y1", (F.col("x1") + k % 60).alias("x2"), (F.col("y1") + k % 45).alias("y2"))
    b = table(spark, sf, "supplier").select(s.alias("bid"), (s * 6101 % 997).alias("x1"), (s * 3571 % 991).alias("y1")).select("*", (F.col("x1") + 40).alias("x2"), (F.col("y1") + 70).alias("y2"))
    return spatial.rectangles(a, b, 64.0)


@query("""with s as (select user_id as t, event_type as station, max(value) as mask, min(value) as el from events group by 1, 2),
k as (select *, row_number() over (partition by t order by case when mask >= 400 then 0 else 1 end, case when mask >= 400 then -el end, station) as n from s) select t, station, el, mask >= 400 as suitable from k where n = 1""")
def station_choice(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("t"), F.col("event_type").alias("station")).agg(F.max("value").alias("mask"), F.min("value").alias("el"))
    return curves.stations(s, 400.0)


@query("""with p as (select p_partkey as id, p_size + 1.0::double as mx, p_partkey % 13 + 0.5::double as my, p_partkey % 7 - 3.0::double as mz, p_partkey % 17 * 20.0::double + 300 as sx, p_partkey % 5 * 10.0::double as sy, p_partkey % 3 * 5.0::double as sz from part),
a as (select id, (mx - sx) / d as x, (my - sy) / d as y, (mz - sz) / d as z from (select *, sqrt((mx - sx) ** 2 + (my - sy) ** 2 + (mz - sz) ** 2) as d from p)),
b as (select id, x, y, z, sqrt(x * x + y * y) as d from a) select id, round(x, 8) as x1, round(y / d, 8) as x2, round(-z * -(x / d) , 8) as x3 from b""")
def solar_frames(spark, sf):
    k = F.col("p_partkey")
    moon = ((F.col("p_size") + 1).cast("double"), k % 13 + 0.5, (k % 7 - 3).cast("double"))
    sun = ((k % 17 * 20 + 300).cast("double"), (k % 5 * 10).cast("double"), (k % 3 * 5).cast("double"))
    out = vec.solar_frame(table(spark, sf, "part").select(k.alias("id"), "p_partkey", "p_size"), moon, sun, (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return out.select("id", *[F.round(f"{x}_x", 8).alias(x) for x in ("x1", "x2", "x3")])
