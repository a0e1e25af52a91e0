"""Every query beside its SQL at the smallest scale, run functions against plain loops, codecs as round trips."""

import glob
import math
import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__
from lumenfield.functions import geometry as geo
from lumenfield.functions import palettes, photometry as ph, vectors as vec
from lumenfield.operators import curves, horizon, mesh, raster, runs, sampling, spatial
from lumenfield.plans import products, queries as core  # noqa: F401 - products adds its queries
from lumenfield.sources import codecs, text
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def key(r):
    return tuple((x is None, 0 if x is None else int(x) if isinstance(x, bool) else x) for x in r)


@pytest.mark.parametrize("name", list(core.ORACLES))
def test_query_and_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=key)
    names = ", ".join(f'"{x}"' for x in cols)
    assert got == sorted(duck.sql(f"select {names} from ({core.ORACLES[name]})").fetchall(), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def loops(lit):
    """Dark runs that end inside the series, and lit ones."""
    n, i, dark, light = len(lit), 0, [], []
    while i < n:
        j = i
        while j < n and lit[j] == lit[i]:
            j += 1
        if j < n:
            (light if lit[i] else dark).append(j - i)
        i = j
    return max(dark, default=n), max(dark, default=0), max(light, default=-1)


def shadow(lit, recharge=12):
    best = dark = row = 0
    for x in lit:
        if x:
            row += 1
            if row >= recharge:
                best, dark = max(best, dark), 0
        else:
            row, dark = 0, dark + 1
    return max(best, dark)


def test_runs_against_loops(spark):
    r = random.Random(1)
    series = {}
    for pid in range(120):
        out = []
        while len(out) < r.choice([1, 5, 60]):
            out += [r.random() < 0.5] * r.randrange(1, 20)
        series[pid] = out
    df = spark.createDataFrame([(p, i, x) for p, v in series.items() for i, x in enumerate(v)], "pid long, i int, lit boolean")
    assert {r[0]: tuple(r[1:]) for r in runs.longest(df).collect()} == {p: loops(v) for p, v in series.items()}
    assert {r[0]: r[1] for r in runs.havens(df).collect()} == {p: shadow(v) for p, v in series.items()}


def test_flat_and_wall_horizons(spark):
    flat = spark.createDataFrame([(i, j, 0.0) for i in range(16) for j in range(16)], "line int, sample int, h double")
    one = flat.where("line = 8 and sample = 8")
    assert horizon.horizon(one, flat, 8, 2).agg(F.max(F.abs("slope"))).first()[0] == 0
    wall = flat.withColumn("h", F.when(F.col("sample") == 12, 10.0).otherwise(0.0))
    got = horizon.horizon(one, wall, 8, 2, bins=360).orderBy(F.desc("slope")).first()
    assert got["slope"] == 2.5 and got["bin"] == math.floor(0.5 + math.pi * 359 / (2 * math.pi))


def test_disc_fractions(spark):
    h = F.array_repeat(F.lit(0.0), 1440)
    df = spark.createDataFrame([(90.0, 0.0), (90.0, 2.0), (90.0, -2.0), (0.1, 0.0), (359.9, 0.0)], "az double, el double")
    got = [round(r[0], 9) for r in df.select(ph.disc_fraction(h, F.col("az"), F.col("el"))).collect()]
    assert got == [0.5, 1.0, 0.0, 0.5, 0.5]


def test_geometry(spark):
    df = spark.createDataFrame([(15199, 15199), (0, 0), (30399, 100), (20000, 15000)], "l int, s int")
    for pole in (geo.Pole(True), geo.Pole(False)):
        lat, lon = geo.lat_lon(F.col("l"), F.col("s"), pole)
        line, sample = geo.pixel_of(F.col("lat"), F.col("lon"), pole)
        for r in df.withColumns({"lat": lat, "lon": lon}).select("l", "s", "lat", line.alias("l2"), sample.alias("s2")).collect():
            assert abs(r["l"] - r["l2"]) < 1e-4 and abs(r["s"] - r["s2"]) < 1e-4 and (r["lat"] < 0) == pole.south
    assert geo.covering(0, 0, 300, 256) == (range(0, 2), range(0, 2)) and geo.covering(0, 0, 300, 256, True)[0] == range(0, 3)
    x = spark.range(1).select(ph.code_slope(ph.slope_code(F.lit(0.5))).alias("a"), F.transform(ph.slopes_to_degrees(F.array(F.lit(1.0))), lambda d: F.round(d, 6)).alias("b")).first()
    assert abs(x["a"] - 0.5) < 1e-5 and x["b"] == [45.0]


def test_nearest_with_ties(spark):
    r = random.Random(3)
    p = [(i, r.randrange(50), r.randrange(50)) for i in range(200)] + [(999, 5000, 5000)]
    s = [(i, r.randrange(50), r.randrange(50)) for i in range(40)]
    got = {x["pid"]: x["sid"] for x in spatial.nearest(spark.createDataFrame([(i, float(a), float(b)) for i, a, b in p], "pid long, px double, py double"), spark.createDataFrame([(i, float(a), float(b)) for i, a, b in s], "sid long, sx double, sy double"), 4.0).collect()}
    assert got == {i: min(((a - c) ** 2 + (b - d) ** 2, k) for k, c, d in s)[1] for i, a, b in p}


def test_codecs(spark, tmp_path):
    h = np.arange(2 * 3 * 1440, dtype=np.float32).reshape(2, 3, 1440)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / codecs.tile_name(128, 256, 2)).write_bytes(codecs.encode_tile(128, 256, 1, 2, h))
    rows = codecs.read(spark, str(tmp_path / "t"), "tile").collect()
    assert len(rows) == 6 and codecs.tile_key(rows[0]["path"]) == (128, 256, 2)
    assert all(r["horizon"] == h[r["row"], r["col"]].tolist() for r in rows)
    with pytest.raises(ValueError):
        list(codecs.decode_tile(codecs.encode_tile(1, 1, 1, 0, h)[:-4]))
    bands = np.arange(3 * 4 * 5, dtype=np.float32).reshape(3, 4, 5)
    assert [x[-1] for x in codecs.decode_bands(codecs.encode_bands(0, 0, [1, 0.5, 0.1], bands))] == bands.ravel().tolist()
    assert len(codecs.encode_bands(0, 0, [1, 0.5, 0.1], np.zeros((3, 128, 128)))) == 20 + 12 + 3 * 128 * 128 * 4
    cube = np.random.default_rng(1).random((2, 3, 16)) < 0.5
    assert [x[-1] for x in codecs.decode_bits(codecs.encode_bits(cube))] == cube.ravel().tolist()
    with pytest.raises(ValueError):
        codecs.encode_bits(np.zeros((1, 1, 7), bool))
    ticks = np.arange(6, dtype=np.int64).reshape(2, 3) * 10**12
    assert list(codecs.decode_ticks(codecs.encode_ticks(5, 7, ticks)))[-1] == (8, 7, 5 * 10**12)
    cache = [(1, 2, 0.5, 0.25, 1.0, 0.0, 0.0, [1.0, 2.0]), (3, 4, 1.5, 0.0, 0.0, 1.0, 0.0, [])]
    assert list(codecs.decode_cache(codecs.encode_cache(cache) + b"\0" * 60)) == cache
    assert list(codecs.decode_dem(np.array([2, -4], "<i2").tobytes(), 1, 2)) == [(0, 0, 1.0), (0, 1, -2.0)]


def test_files_of_rows(spark):
    cells = spark.createDataFrame([(1, 2, 5), (1, 2, 7), (3, 4, 9), (None, 1, 3), (20, 1, None), (17, 30, 1)], "line int, sample int, ticks long")
    files = codecs.tick_files(cells, 16)
    assert sorted(r["path"] for r in files.collect()) == ["ticks_00000_00000.bin", "ticks_00016_00016.bin"]
    got = {(r["line"], r["sample"]): r["ticks"] for r in codecs.decoded(files, "ticks").collect()}
    assert got == {(line, sample): 0 for line in (1, 2, 3) for sample in (2, 3, 4)} | {(1, 2): 7, (3, 4): 9, (17, 30): 1}
    bands = spark.createDataFrame([(1, 2, 0, 5.0), (1, 2, 1, 6.0), (1, 2, 2, 8.0)], "line int, sample int, band int, hours double")
    rows = codecs.decoded(codecs.band_files(bands, [1.0, 0.5], 4), "bands").collect()
    assert len(rows) == 32 and {(r["threshold"], r["row"], r["col"], r["hours"]) for r in rows if r["hours"]} == {(1.0, 1, 2, 5.0), (0.5, 1, 2, 6.0)}
    horizon = [k / 4 for k in range(codecs.BINS)]
    tile = spark.createDataFrame([(130, 257, horizon)], "line int, sample int, horizon array<double>")
    rows = codecs.decoded(codecs.horizon_files(tile, 2, observer=3), "tile").collect()
    assert len(rows) == 4 and [(r["line"], r["sample"], r["observer"], r["horizon"]) for r in rows if any(r["horizon"])] == [(130, 256, 3, horizon)]
    none = cells.where("false")
    assert codecs.tick_files(none).count() == 0 and codecs.horizon_files(tile.where("false")).count() == 0
    with pytest.raises(ValueError):
        list(codecs.decode_ticks(codecs.encode_ticks(0, 0, np.zeros((2, 2)))[:-8]))


def test_text_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"Line": 128, "Sample": 0}]')
    assert text.queue(spark, str(tmp_path / "q.json")).first()["Line"] == 128
    assert text.queue(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "k.txt").write_text("a.bsp\n\n # x\n#y\nb.tpc\n")
    assert sorted(r[0] for r in text.kernels(spark, str(tmp_path / "k.txt")).collect()) == ["a.bsp", "b.tpc"]
    (tmp_path / "c.json").write_text('{"host_dem": "1", "dem": "2"}')
    assert [text.setting(k, h, str(tmp_path / "c.json"), "d") for k, h in (("dem", "host"), ("dem", "x"), ("none", "x"))] == ["1", "2", "d"]
    (tmp_path / "t.tsv").write_text("\t".join(str(float(k)) for k in range(15)) + "\n")
    assert text.triangles(spark, str(tmp_path / "t.tsv")).first()["cx"] == 3.0
    (tmp_path / "d.csv").write_text("lat,lon,depth\n-89.5,10,2.5\n")
    assert text.depths(spark, str(tmp_path / "d.csv")).first()["depth"] == 2.5
    (tmp_path / "p.tsv").write_text("# c\n0\t1\t2\t1.5\t1\t2\t3\t-40\t-88\n")
    assert text.depth_product(spark, str(tmp_path / "p.tsv")).first()["lon"] == 40.0


def test_mesh_ply(spark):
    g = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3)], "line int, sample int, h double")
    lines = [r["value"] for r in mesh.ply(g, mesh.faces(g), "line", "sample", "h").orderBy("k").collect()]
    assert lines[2] == "element vertex 9" and lines[6] == "element face 8" and len(lines) == 9 + 9 + 8
    assert all(0 <= int(x) < 9 for v in lines[-8:] for x in v.split()[1:])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "line int, sample int, v int, h double")
    assert raster.histogram(none).agg(F.sum("n")).first()[0] == 0
    assert raster.mosaic([none, none]).count() == 0 and raster.disc_max(none, 2).count() == 0
    assert curves.summary(spark.createDataFrame([], "pid long, i int, v double"), 1.0, 2.0).count() == 0


def test_vectors_and_frames(spark):
    v = (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    moved = vec.affine(v, [[0, 1, 0], [-1, 0, 0], [0, 0, 1], [10, 20, 30]])
    zero = vec.unit((F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    az, el = vec.site_az_el((F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    r = spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate((*moved, *vec.cross(v, v), *zero, az, el))]).first()
    assert tuple(r)[:6] == (8.0, 21.0, 33.0, 0.0, 0.0, 0.0) and tuple(r)[6:9] == (None,) * 3
    assert r[9] == pytest.approx(-math.pi / 2) and r[10] == pytest.approx(math.pi / 4)


def test_palettes():
    p = palettes.light_levels()
    assert len(p) == 100 and p[0] == p[9] == 0 and p[99] == 0xFFFFFF and p[95] == 0xF4F4F4 and p[80] >> 8 & 255 and not p[80] & 0xFF00FF
    assert palettes.grayscale()[::85] == [0, 0x555555, 0xAAAAAA, 0xFFFFFF]


def test_image_places(spark):
    line, sample = geo.image_to_grid(F.lit(10), F.lit(4), (-2000.0, 2000.0), 20.0)
    x = geo.to_screen(geo.to_map(F.lit(7.0), 2, 0.5), 2, 0.5)
    assert tuple(spark.range(1).select(line, sample, x).first()) == pytest.approx((15199.5 - 90, 15199.5 - 96, 7.0))


def test_empty_grids(spark):
    g = spark.createDataFrame([], "line int, sample int, h double")
    assert sampling.bilinear(spark.createDataFrame([(1, 0.5, 0.5)], "pid long, py double, px double"), g).count() == 0
    assert sampling.test_points(g.withColumnRenamed("h", "r"), 8).count() == raster.neighbours(g).count() == 0
    assert tuple(mesh.counts(g).first()) == (0, 0)
