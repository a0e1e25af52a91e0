"""Queries of havens by minimum and interval, of bodies over horizons, and of files that are written and read again."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from lumenfield.functions import geometry as geo
from lumenfield.operators import curves, havens, runs
from lumenfield.plans.queries import _OTHER, query
from lumenfield.plans.stand_ins import CURVE, GRID, RUNS, SIDE, curve, grid, lit, table
from lumenfield.session import shared_dir
from lumenfield.sources import codecs, dem

_LINK = 100.0


def _series(spark, sf):
    """Light of all events, and a link from those of one type."""
    link = curve(spark, sf, _OTHER).select("pid", "i", (F.col("v") >= _LINK).alias("comm"))
    return lit(curve(spark, sf)).join(link, ["pid", "i"], "left").select("pid", "i", "lit", "comm")


def _lows(spark, sf):
    """Steps where the whole levels of all pixels together are least."""
    total = curve(spark, sf).groupBy("i").agg(F.sum(F.floor("v")).alias("v")).withColumn("pid", F.lit(0))
    return runs.minima(total).select("i")


_SERIES = f"""{CURVE("sun")}, {CURVE("link", _OTHER)},
both_ as (select sun.pid, sun.i, sun.lit, coalesce(link.v >= {_LINK}, false) as comm from sun left join link using (pid, i))"""
_HAVENS = f"""{_SERIES}, total as (select i, sum(floor(v)) as v from sun group by 1), near as (select i, v, lag(v) over (order by i) as a, lead(v) over (order by i) as b from total), low as (select i from near where a > v and v < b),
size as (select pid, max(i) as e from both_ group by 1),
link0 as (select s.pid, l.i, e, coalesce((select max(x.i) from both_ x where x.pid = s.pid and x.comm and x.i <= l.i), 0) as c0, coalesce((select min(x.i) from both_ x where x.pid = s.pid and x.comm and x.i >= l.i), e) as c1 from size s cross join low l),
spell as (select pid, i as low, coalesce((select max(x.i) from both_ x where x.pid = k.pid and x.lit and x.i <= k.c0), 0) as f, coalesce((select min(x.i) from both_ x where x.pid = k.pid and x.lit and x.i >= k.c1), e) as l from link0 k),
part as (select s.pid, s.low, b.i, b.lit from spell s join both_ b on b.pid = s.pid and b.i between s.f and s.l),
edge as (select *, case when lag(lit) over w is distinct from lit then 1 else 0 end as chg from part window w as (partition by pid, low order by i)),
isle as (select *, sum(chg) over (partition by pid, low order by i) as isl from edge), nth as (select *, row_number() over (partition by pid, low, isl order by i) as k from isle),
spent as (select *, sum(case when lit and k >= 12 then 1 else 0 end) over (partition by pid, low order by i) as z from nth), dark as (select pid, low, z, count(*) filter (not lit) as d from spent group by all),
haven as (select pid, low as i, cast(max(d) as int) as haven_steps, max(d) * 2e0 as haven_hours from dark group by 1, 2)"""


@query(f"with {_HAVENS} select * from haven")
def haven_by_minimum(spark, sf):
    return havens.by_minimum(_series(spark, sf), _lows(spark, sf))


@query(f"with {_HAVENS} select pid, max(haven_steps) as haven_steps, max(haven_hours) as haven_hours from haven group by 1")
def haven_combined(spark, sf):
    return havens.combined(havens.by_minimum(_series(spark, sf), _lows(spark, sf)))


_INSIDE = (30, 330)


def _cut(kind: str, name: str) -> str:
    """SQL of intervals where a boolean is false, put together over 12 steps."""
    return f"""{name}_c as (select pid, i, {kind} as lit from both_), {RUNS(f"{name}_c", f"{name}_r")}, {name}_o as (select *, coalesce(start - lag(stop) over (partition by pid order by start) > 12, true) as o from {name}_r where not lit),
{name}_p as (select *, sum(o::int) over (partition by pid order by start) as part from {name}_o), {name} as (select pid, min(start) as start, least(max(stop), max(n) - 1) as stop from {name}_p group by pid, part having min(start) <= {_INSIDE[1]} and least(max(stop), max(n) - 1) >= {_INSIDE[0]})"""


@query(f"""with {_SERIES}, {_cut("comm", "spell")}, {_cut("lit", "dark")}, met as (select s.pid, s.start, coalesce(max(d.stop - d.start), 1000) as d from spell s left join dark d on d.pid = s.pid and d.start <= s.stop and s.start <= d.stop group by 1, 2)
select p.pid, cast(coalesce(min(d), 1000) as int) as haven_steps from (select distinct pid from both_) p left join met on met.pid = p.pid group by 1""")
def haven_by_interval(spark, sf):
    return havens.by_interval(_series(spark, sf), *_INSIDE)


@query(f"""select cast(a.range as int) as line, cast(b.range as int) as sample, coalesce(floor(h), 0) * 0.5e0 as h from range({SIDE}) a cross join range({SIDE}) b
left join (with {GRID} select * from grid) g on g.line = a.range and g.sample = b.range where a.range between 5 and 40 and b.range between 4 and 49""")
def dem_scan(spark, sf):
    """A raster of SIDE squared cells is written by the driver and scanned by rows of tiles, in part."""
    values = np.zeros((SIDE, SIDE), "<i2")
    for r in grid(spark, sf).select("line", "sample", F.floor("h").cast("int").alias("h")).toLocalIterator():
        values[r["line"], r["sample"]] = r["h"]
    path = f"{shared_dir(spark)}/dem-{uuid.uuid4().hex}.img"
    system, place = dem.opened(path)
    with system.open_output_stream(place) as out:
        out.write(values.tobytes())
    return dem.scan(spark, path, lines=(5, 60), samples=(4, 50), size=(SIDE, SIDE), rows=16).where("line <= 40")


_BITS = 3


@query(f"""with {GRID}, t as (select distinct line // 16 as l, sample // 16 as s from grid), b as (select cast(range as int) as level from range({_BITS})), r as (select cast(range as int) as row from range(16)), q as (select cast(range as int) as col from range(16))
select level, row, col, count(*) as tiles, count(*) filter (coalesce(cast(floor(h) as int) % (level + 2) = 0, false)) as bits from t cross join b cross join r cross join q left join grid on grid.line = t.l * 16 + row and grid.sample = t.s * 16 + col group by all""")
def bit_round_trip(spark, sf):
    """Bit cubes made from cells, written into the shared folder, read again; how often each bit is set."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(_BITS - 1))).alias("level")
    cells = grid(spark, sf).select("line", "sample", "h", levels).withColumn("bit", F.floor("h").cast("int") % (F.col("level") + 2) == 0)
    folder = f"{shared_dir(spark)}/bits-{uuid.uuid4().hex}"
    codecs.write(codecs.bit_files(cells, _BITS, 16), folder)
    return codecs.read(spark, folder, "bits").groupBy("level", "row", "col").agg(F.count("*").alias("tiles"), F.count_if("bit").alias("bits"))


@query(f"with {GRID} select sample as x, line as y, floor(h) as depth, (line % 4) * 0.5e0 as stdev, h as nx, -h as ny, 1e0 as nz, (sample % 5) * 0.25e0 as first_light, cast(3 + sample % 5 as int) as lights from grid")
def cache_round_trip(spark, sf):
    light = F.transform(F.sequence(F.lit(0), F.col("sample") % 5 + 2), lambda k: ((F.col("sample") % 5) * 0.25 + k).cast("float"))
    records = grid(spark, sf).select(F.col("sample").alias("x"), F.col("line").alias("y"), F.floor("h").cast("float").alias("depth"), ((F.col("line") % 4) * 0.5).cast("float").alias("stdev"), F.col("h").alias("nx"), (-F.col("h")).alias("ny"), F.lit(1.0).alias("nz"), light.alias("lighting"))
    out = codecs.decoded(codecs.cache_files(records, 16), "cache")
    return out.select("x", "y", F.col("depth").cast("double").alias("depth"), F.col("stdev").cast("double").alias("stdev"), "nx", "ny", "nz", F.get("lighting", F.lit(0)).cast("double").alias("first_light"), F.size("lighting").alias("lights"))


_SEEN = 24
_HOR = "((pid * 7 + ({0}) * 13) % 97) / 97e0 * 2e0"


@query(f"""with p as (select s_suppkey as pid, (s_suppkey % 50 + 1) * 0.001e0 - pi() / 2 as lat, (s_suppkey % 31) * 0.2e0 - 3e0 as lon, (s_suppkey % 7) * 100e0 as h from supplier),
v as (select cast(range as int) as i, 300000e0 * cos(range * 0.3e0) as x, 300000e0 * sin(range * 0.3e0) as y, 4000e0 - range * 500e0 as z from range({_SEEN})),
d as (select pid, i, lat, lon, x - (h / 1000 + 1737.4e0) * cos(lat) * cos(lon) as dx, y - (h / 1000 + 1737.4e0) * cos(lat) * sin(lon) as dy, z - (h / 1000 + 1737.4e0) * sin(lat) as dz from p cross join v),
f as (select pid, i, (dx * cos(lon) + dy * sin(lon)) * sin(lat) - dz * cos(lat) as fx, dy * cos(lon) - dx * sin(lon) as fy, (dx * cos(lon) + dy * sin(lon)) * cos(lat) + dz * sin(lat) as fz from d),
a as (select pid, i, atan2(fy, fx) + pi() as az, degrees(atan2(fz, sqrt(fx * fx + fy * fy))) as el from f), b as (select *, az * 1439 / (2 * pi()) as k, cast(floor(az * 1439 / (2 * pi())) as int) as n from a),
o as (select *, el - ({_HOR.format("n")} + (k - n) * ({_HOR.format("(n + 1) % 1440")} - {_HOR.format("n")})) as ov from b)
select pid, i, round(degrees(az), 6) as az, round(el, 6) + 0e0 as el, round(ov, 6) + 0e0 as over, cast(case when ov <= 0 then 0 else ceil(ov) end as int) as station from o""")
def bodies_over_horizons(spark, sf):
    k = F.col("s_suppkey")
    bins = F.sequence(F.lit(0), F.lit(geo.BINS - 1))
    place = table(spark, sf, "supplier").select(k.alias("pid"), ((k % 50 + 1) * 0.001 - np.pi / 2).alias("lat"), ((k % 31) * 0.2 - 3.0).alias("lon"), ((k % 7) * 100.0).alias("h"))
    pixels = place.withColumn("horizon", F.transform(bins, lambda b: F.pmod(F.col("pid") * 7 + b * 13, F.lit(97)).cast("double") / 97 * 2))
    i = F.col("id")
    body = spark.range(_SEEN).select(i.cast("int").alias("i"), (300000.0 * F.cos(i * 0.3)).alias("x"), (300000.0 * F.sin(i * 0.3)).alias("y"), (4000.0 - i * 500.0).alias("z"))
    out = curves.shadows(curves.seen(pixels, body, _SEEN))
    return out.select("pid", "i", F.round("az", 6).alias("az"), *[(F.round(x, 6) + 0.0).alias(x) for x in ("el", "over")], "station")
