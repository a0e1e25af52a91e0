"""Havens against plain loops, elevation scans by range, files that are written and read back."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import curves, havens
from lumenfield.sources import codecs, dem


def spell_loop(lit, comm, low):
    """The spell around one step, and the most dark steps that gather in it, step by step."""
    n = len(lit)
    back = lambda x, k: next((i for i in range(k, -1, -1) if x[i]), 0)
    on = lambda x, k: next((i for i in range(k, n) if x[i]), n - 1)
    most = dark = light = 0
    for i in range(back(lit, back(comm, low)), on(lit, on(comm, low)) + 1):
        light = light + 1 if lit[i] else 0
        dark = 0 if light >= 4 else dark + (not lit[i])
        most = max(most, dark)
    return most


def cut_loop(x, gap):
    out, n = [], len(x)
    for i in range(n):
        if not x[i] and (i == 0 or x[i - 1]):
            stop = next((k for k in range(i, n) if x[k]), n - 1)
            if out and i - out[-1][1] <= gap:
                out[-1][1] = stop
            else:
                out.append([i, stop])
    return out


def interval_loop(lit, comm, first, last, gap):
    dark, spell = ([v for v in cut_loop(x, gap) if v[0] <= last and v[1] >= first] for x in (lit, comm))
    met = [[b - a for a, b in dark if a <= t and s <= b] for s, t in spell]
    return min((max(x) if x else 1000 for x in met), default=1000)


@pytest.fixture(scope="module")
def booleans():
    r = random.Random(4)
    out = {0: ([True] * 30, [True] * 30), 1: ([False] * 30, [False] * 30), 2: ([True], [False]), 3: ([False] * 40, [True] * 40)}
    for pid in range(4, 40):
        n, p, q = r.randint(2, 90), r.choice((0.1, 0.5, 0.9)), r.choice((0.1, 0.5, 0.9))
        out[pid] = [r.random() < p for _ in range(n)], [r.random() < q for _ in range(n)]
    return out


@pytest.fixture(scope="module")
def series(spark, booleans):
    rows = [(pid, i, a, b) for pid, (lit, comm) in booleans.items() for i, (a, b) in enumerate(zip(lit, comm, strict=True))]
    nulls = [(p, i, a or None, b or None) for p, i, a, b in rows]  # null counts as false
    random.Random(1).shuffle(nulls)
    return spark.createDataFrame(nulls, "pid int, i int, lit boolean, comm boolean").repartition(3)


def test_havens_by_minimum(spark, series, booleans):
    lows = [0, 1, 7, 20, 29, 60, 500]
    out = havens.by_minimum(series, spark.createDataFrame([(x,) for x in [*lows, 7, None]], "i int"), recharge=4, step_hours=0.5)
    want = {(pid, k): spell_loop(lit, comm, k) for pid, (lit, comm) in booleans.items() for k in lows if k < len(lit)}
    assert {(r["pid"], r["i"]): r["haven_steps"] for r in out.collect()} == want and out.count() == len(want)
    most = {r["pid"]: (r["haven_steps"], r["haven_hours"]) for r in havens.combined(out).collect()}
    assert most == {pid: (m := max(v for (p, _), v in want.items() if p == pid), m / 2) for pid in booleans}
    assert havens.by_minimum(series, spark.createDataFrame([], "i int")).count() == 0
    assert havens.by_minimum(series.limit(0), spark.createDataFrame([(1,)], "i int")).count() == 0


@pytest.mark.parametrize(("first", "last", "gap"), [(0, 100, 2), (10, 25, 0), (60, 70, 12)])
def test_havens_by_interval(series, booleans, first, last, gap):
    got = {r["pid"]: r["haven_steps"] for r in havens.by_interval(series, first, last, gap).collect()}
    assert got == {pid: interval_loop(lit, comm, first, last, gap) for pid, (lit, comm) in booleans.items()}


def test_elevation_scan(spark, tmp_path):
    h = np.random.default_rng(2).integers(-20000, 20000, (70, 50))
    h.astype("<i2").tofile(tmp_path / "a.img")
    h.astype("<f4").tofile(tmp_path / "b.img")
    told = lambda df: sorted((r["line"], r["sample"], r["h"]) for r in df.collect())
    want = lambda scale, a, b, s, t: [(i, j, h[i, j] * scale) for i in range(a, b) for j in range(s, t)]
    a = dem.scan(spark, str(tmp_path / "a.img"), size=(70, 50), rows=16)
    assert told(a) == want(0.5, 0, 70, 0, 50) and a.rdd.getNumPartitions() == 5
    b = dem.scan(spark, f"file://{tmp_path}/b.img", "float32", "south", (20, 35), (7, 9), (70, 50), 16)
    assert told(b) == want(0.001, 20, 35, 7, 9) and b.rdd.getNumPartitions() == 2 and b.first()["pole"] == "south"
    assert told(dem.scan(spark, str(tmp_path / "a.img"), size=(70, 50), raw=True, lines=(69, 70))) == want(1, 69, 70, 0, 50)
    assert dem.scan(spark, str(tmp_path / "a.img"), size=(70, 50), lines=(9, 9)).count() == 0
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        p = dem.scan(spark, str(tmp_path / "a.img"), size=(70, 50), rows=16)
        some = p.where("line = 40 and sample >= 3 and sample < 8 and h > -30000")
        assert told(some) == want(0.5, 40, 41, 3, 8) and some.rdd.getNumPartitions() == 1
        assert told(p.where("line > 60 and line <= 65 and sample in (1, 2) and not sample = 1")) == want(0.5, 61, 66, 2, 3)
        assert p.where("line > 9 and line < 5").count() == 0 and p.where("line > 200").count() == 0 and p.where("line > -5 and sample < -1").count() == 0
    finally:
        spark.conf.unset(key)
    for wrong, message in (({"size": (70, 51)}, "length"), ({"size": (70, 50), "lines": (0, 71)}, "bounds"), ({"size": (70, 50), "kind": "int8"}, "kind")):
        with pytest.raises(Exception, match=message):
            dem.scan(spark, str(tmp_path / "a.img"), **wrong).count()


def test_files_written_and_read(spark, tmp_path):
    cells = spark.range(0, 500).select((F.col("id") % 20).cast("int").alias("line"), (F.col("id") % 23 + 30).cast("int").alias("sample"), (F.col("id") % 2).cast("int").alias("level"), (F.col("id") % 3 == 0).alias("bit"))
    folder = str(tmp_path / "bits")
    assert codecs.write(codecs.bit_files(cells, 2, 16), folder) == 6
    assert codecs.write(codecs.bit_files(cells, 2, 16), folder) == 6  # again: replaced, nothing else is left there
    assert len(list((tmp_path / "bits").iterdir())) == 6
    out = codecs.read(spark, folder, "bits")
    assert out.count() == 6 * 2 * 256
    set_ = cells.where("bit").select("line", "sample", "level").distinct().count()
    assert out.where("bit").count() == set_
    with pytest.raises(ValueError, match="multiple"):
        codecs.bit_files(cells, 2, 12)
    records = [(5, 3, 1.5, 0.25, 1.0, 2.0, 3.0, [0.5, 0.25]), (5, 3, 1.5, 0.25, 1.0, 2.0, 3.0, [0.5, 0.25]), (40, 3, 2.5, 0.0, 0.0, 0.0, 1.0, []), (1, None, 2.5, 0.0, 0.0, 0.0, 1.0, [])]
    cache = spark.createDataFrame(records, "x int, y int, depth float, stdev float, nx double, ny double, nz double, lighting array<float>")
    assert codecs.write(codecs.cache_files(cache, 32), f"file://{tmp_path}/cache") == 2
    back = codecs.read(spark, str(tmp_path / "cache"), "cache").drop("path")
    assert sorted(map(tuple, back.collect())) == sorted(records[:3])
    assert codecs.write(codecs.cache_files(cache.limit(0)), folder) == 0


def test_bodies_and_shadows(spark):
    """On flat horizons a body's disc is whole well over them and none well below, and light() agrees at the same angles."""
    flat = F.array_repeat(F.lit(0.0), 1440)
    pixels = spark.createDataFrame([(1, -1.5, 0.3, 100.0), (2, -1.55, -2.0, 0.0), (3, None, 0.0, 0.0)], "pid int, lat double, lon double, h double").withColumn("horizon", flat)
    vectors = spark.createDataFrame([(0, 1e6, 2e5, -4e5), (1, 1e6, 2e5, 4e5), (2, -1e6, 0.0, -9e4)], "i int, x double, y double, z double")
    out = curves.shadows(curves.seen(pixels, vectors, 3))
    rows = {(r["pid"], r["i"]): r for r in out.collect()}
    assert len(rows) == 9 and all(rows[3, k]["el"] is None for k in range(3))
    for (pid, k), r in rows.items():
        if pid < 3:
            assert r["over"] == pytest.approx(r["el"]) and r["station"] == max(0, int(np.ceil(r["el"]))) and 0 <= r["az"] <= 360
            assert r["sun"] == (255 if r["el"] > 1 else 0) or abs(r["el"]) <= 1
    assert rows[1, 0]["sun"] == 255 and rows[1, 1]["sun"] == 0
    for pid in (1, 2):
        at = spark.createDataFrame([(k, rows[pid, k]["az"], rows[pid, k]["el"]) for k in range(3)], "i int, az double, el double")
        assert {r["i"]: r["v"] for r in curves.light(pixels.where(f"pid = {pid}"), at, 3).collect()} == {k: rows[pid, k]["v"] for k in range(3)}
    assert curves.seen(pixels.limit(0), vectors, 3).count() == 0
