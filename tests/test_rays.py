"""Rays over flat ground and walls, heights that see past them, series and neighbours with awkward rows."""

import math

import pytest
from pyspark.sql import functions as F

from lumenfield.functions import geometry as geo
from lumenfield.operators import curves, horizon, rays, runs, spatial


def ground(spark, side, h):
    return spark.createDataFrame([(10_000 + i, 12_000 + j, float(h(i, j))) for i in range(side) for j in range(side)], "line int, sample int, h double")


def test_flat_ground_is_below_zero_all_around(spark):
    g = ground(spark, 24, lambda i, j: 0)
    out = rays.near_horizons(g.where("line = 10012 and sample = 12012"), g, far=8.0, step=0.5, rays=360, observer_m=2.0).collect()
    assert len(out) == 1 and len(out[0]["bins"]) > 300
    assert all(-0.06 < s < 0 for s in out[0]["slopes"]) and max(out[0]["slopes"]) - min(out[0]["slopes"]) < 1e-3


def test_a_wall_is_where_the_horizon_peaks(spark):
    """The wall stands at greater samples; joins by ray and by pair of pixels see it alike, and tiles do not matter."""
    g = ground(spark, 24, lambda i, j: 500 if j == 18 else 0)
    t = g.where("line = 10012 and sample = 12012")
    near = {n: rays.near_horizons(t, g, far=9.0, step=0.25, rays=720, tile=n).first() for n in (8, 128)}
    assert near[8] == near[128]
    peak = max(zip(near[8]["slopes"], near[8]["bins"], strict=True))
    assert peak[0] == pytest.approx(500 / (6 * 20), rel=0.1)
    pairs = horizon.local_horizon(t, g, tile=8, reach=2, bins=geo.BINS).orderBy(F.desc("slope")).first()
    assert abs(pairs["bin"] - peak[1]) <= 2 and pairs["slope"] == pytest.approx(peak[0], rel=0.02)


def test_rise_over_a_wall(spark):
    g = ground(spark, 24, lambda i, j: 500 if j == 18 else 0)
    t = g.where("line = 10012 and sample = 12012")
    rise = lambda slopes: rays.rise_heights(t, g, slopes, [2.0, 6.0]).first()["rise"]
    # Ray 0 goes along samples; the others stay below. The plane of x and y is tilted by the target's latitude.
    tilt = math.radians(4)
    assert rise([0.0] * 4) == pytest.approx(500, abs=6 * 20 * tilt)
    assert rise([1.0, 9.0, 9.0, 9.0]) < rise([0.0, 9.0, 9.0, 9.0])
    assert rays.rise_heights(t, g, [0.0], []).first()["rise"] is None


def test_rays_with_awkward_rows(spark):
    g = ground(spark, 6, lambda i, j: i)
    odd = spark.createDataFrame([(None, 1, 1.0), (10_002, 12_002, None), (10_001, 12_001, float("nan")), (10_003, 12_003, -50.0)], "line int, sample int, h double")
    want = sorted(map(str, rays.near_horizons(g, g, far=2.0, step=1.0, rays=8).collect()))
    assert sorted(map(str, rays.near_horizons(g, g.unionAll(odd), far=2.0, step=1.0, rays=8).collect())) == want
    none = g.where("false")
    assert rays.near_horizons(none, g, 2.0, 1.0, 8).count() == rays.near_horizons(g, none, 2.0, 1.0, 8).count() == rays.rise_heights(none, none, [0.0], [1.0]).count() == 0
    assert horizon.local_horizon(none, g, 8, 1).count() == 0


def test_work_counts_nodes(spark):
    t = spark.createDataFrame([(3, 4)], "x int, y int")
    assert horizon.work(t).first()["seconds"] == pytest.approx(horizon.far_nodes(t).count() * 0.1625)
    assert horizon.far_nodes(t, limit=20.0).count() < horizon.far_nodes(t).count()  # the limit acts


def test_dense_with_repeats_nulls_and_strays(spark):
    rows = [(1, 2, 5.0), (1, 2, 7.0), (1, None, 9.0), (1, 0, None), (1, 9, 4.0), (1, -1, 4.0), (2, None, 1.0), (None, 1, 3.0)]
    out = curves.dense(spark.createDataFrame(rows, "pid long, i int, v double"), 4).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["i"]):
        got.setdefault(r["pid"], []).append(r["v"])
    assert got == {1: [0.0, 0.0, 7.0, 0.0], 2: [0.0] * 4, None: [0.0, 3.0, 0.0, 0.0]}


def test_nights_by_band(spark):
    v = [5, 1, 1, 3, 3, 1, 5]
    out = runs.longest_nights(spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "pid long, i int, v double"), [0.0, 2.0, 4.0])
    assert {r["band"]: r["longest_night"] for r in out.collect()} == {0: 7, 1: 2, 2: 5}


def test_nearest_with_places_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    p = spark.createDataFrame([(1, nan, 0.0), (2, 0.0, None), (3, 1.0, 1.0), (4, inf, 0.0)], "pid long, px double, py double")
    s = spark.createDataFrame([(7, nan, nan), (8, 40.0, 40.0), (9, None, 1.0)], "sid long, sx double, sy double")
    assert [(r["pid"], r["sid"]) for r in spatial.nearest(p, s, 1.0).collect()] == [(3, 8)]
    assert spatial.nearest(p, s.where("sid = 7"), 1.0).count() == 0
