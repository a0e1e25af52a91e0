"""Binary tiles and rasters as rows: read with Spark's binaryFile source, made from rows as a table of files (path, content), one row for each tile.

All numbers are little-endian. Readers yield rows in bounded batches; a file with a wrong length, header
or marker raises ValueError, but the lighting cache ends at the first wrong marker.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenfield.session import ship
from lumenfield.sources.dem import opened

BINS = 1440
MARKER = 0xAAAAAAAA
_NAME = re.compile(r"horizon_(\d{5})_(\d{5})_(\d{3})\.bin$")


def tile_key(path: str) -> tuple[int, int, int] | None:
    """(line, sample, observer height) from a tile's name, None if it is no tile."""
    m = _NAME.search(path)
    return tuple(map(int, m.groups())) if m else None


def tile_name(line: int, sample: int, observer: int) -> str:
    return f"horizon_{line:05d}_{sample:05d}_{observer:03d}.bin"


def decode_tile(data: bytes, legacy: bool = False) -> Iterator[tuple]:
    """(line, sample, step, observer, row, col, horizon) for each pixel; the legacy form has no observer field."""
    n = 5 if legacy else 6
    head = struct.unpack_from(f"<{n}i?", data)
    line, sample, width, height, step = head[:5]
    if not head[-1]:
        return
    at = 4 * n + 1
    if len(data) != at + 4 * width * height * BINS:
        raise ValueError("a tile's length doesn't agree with its header")
    values = np.frombuffer(data, "<f4", width * height * BINS, at).reshape(height, width, BINS)
    for r in range(height):
        for k in range(width):
            yield line, sample, step, 0 if legacy else head[5], r, k, values[r, k].tolist()


def encode_tile(line: int, sample: int, step: int, observer: int, horizons: np.ndarray) -> bytes:
    height, width, _ = horizons.shape
    return struct.pack("<6i?", line, sample, width, height, step, observer, True) + horizons.astype("<f4").tobytes()


def decode_bands(data: bytes) -> Iterator[tuple]:
    """(line, sample, threshold, row, col, hours)."""
    line, sample, height, width, n = struct.unpack_from("<5i", data)
    if len(data) != 20 + 4 * n + 4 * n * height * width:
        raise ValueError("a band file's length doesn't agree with its header")
    levels = np.frombuffer(data, "<f4", n, 20)
    values = np.frombuffer(data, "<f4", n * height * width, 20 + 4 * n).reshape(n, height, width)
    for k, r, q in np.ndindex(values.shape):
        yield line, sample, float(levels[k]), r, q, float(values[k, r, q])


def encode_bands(line: int, sample: int, levels: list[float], values: np.ndarray) -> bytes:
    n, height, width = values.shape
    return struct.pack("<5i", line, sample, height, width, n) + np.array(levels, "<f4").tobytes() + values.astype("<f4").tobytes()


def decode_bits(data: bytes) -> Iterator[tuple]:
    """(level, row, col, bit), the first column of a byte in its lowest bit."""
    levels, height, width = struct.unpack_from("<3i", data)
    if len(data) != 12 + levels * height * width // 8:
        raise ValueError("a bit cube's length doesn't agree with its header")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=12), bitorder="little").reshape(levels, height, width)
    for k, r, q in np.ndindex(bits.shape):
        yield k, r, q, bool(bits[k, r, q])


def encode_bits(cube: np.ndarray) -> bytes:
    if cube.shape[2] % 8:
        raise ValueError("the width must be a multiple of 8")
    return struct.pack("<3i", *cube.shape) + np.packbits(cube, axis=None, bitorder="little").tobytes()


def decode_ticks(data: bytes) -> Iterator[tuple]:
    """(line, sample, ticks) of a window."""
    left, top, width, height = struct.unpack_from("<4i", data)
    if len(data) != 16 + 8 * width * height:
        raise ValueError("a tick raster's length doesn't agree with its header")
    values = np.frombuffer(data, "<i8", width * height, 16).reshape(height, width)
    for r, q in np.ndindex(values.shape):
        yield top + r, left + q, int(values[r, q])


def encode_ticks(left: int, top: int, values: np.ndarray) -> bytes:
    return struct.pack("<4i", left, top, values.shape[1], values.shape[0]) + values.astype("<i8").tobytes()


def decode_cache(data: bytes) -> Iterator[tuple]:
    """(x, y, depth, stdev, nx, ny, nz, lighting) up to the first wrong marker."""
    at = 0
    while at + 48 <= len(data) and struct.unpack_from("<I", data, at)[0] == MARKER:
        x, y, depth, stdev, nx, ny, nz, n = struct.unpack_from("<2i2f3di", data, at + 4)
        yield x, y, depth, stdev, nx, ny, nz, np.frombuffer(data, "<f4", n, at + 48).tolist()
        at += 48 + 4 * n


def encode_cache(rows: list[tuple]) -> bytes:
    return b"".join(struct.pack("<I2i2f3di", MARKER, *r[:7], len(r[7])) + np.array(r[7], "<f4").tobytes() for r in rows)


def decode_dem(data: bytes, lines: int, samples: int, kind: str = "<i2") -> Iterator[tuple]:
    """(line, sample, h): half metres of an int16 raster, or thousandths of a float one."""
    values = np.frombuffer(data, kind)
    if values.size != lines * samples:
        raise ValueError("a raster's length doesn't agree with its size")
    scale = 0.5 if kind == "<i2" else 0.001
    for k, v in enumerate(values.tolist()):
        yield k // samples, k % samples, v * scale


FORMATS = {
    "tile": (decode_tile, "line int, sample int, step int, observer int, row int, col int, horizon array<float>"),
    "bands": (decode_bands, "line int, sample int, threshold float, row int, col int, hours float"),
    "bits": (decode_bits, "level int, row int, col int, bit boolean"),
    "ticks": (decode_ticks, "line int, sample int, ticks long"),
    "cache": (decode_cache, "x int, y int, depth float, stdev float, nx double, ny double, nz double, lighting array<float>"),
    "dem": (decode_dem, "line int, sample int, h double"),
}


def decoded(files: DataFrame, form: str, batch: int = 2000, **options) -> DataFrame:
    """Rows of files (path, content) in one of FORMATS, with the file's path; a file is one task's work."""
    ship(files.sparkSession)
    decode, schema = FORMATS[form]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                some = []
                for row in decode(bytes(data), **options):
                    some.append(row)
                    if len(some) == batch:
                        yield pd.DataFrame(some, columns=names).assign(path=file)
                        some = []
                if some:
                    yield pd.DataFrame(some, columns=names).assign(path=file)

    return files.select("path", "content").mapInPandas(rows, f"{schema}, path string")


def read(spark: SparkSession, path: str, form: str, batch: int = 2000, **options) -> DataFrame:
    """decoded() of all files under path."""
    return decoded(spark.read.format("binaryFile").load(path), form, batch, **options)


def _tiled(cells: DataFrame, value: str, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each cell once, the greatest value of those that repeat, with its tile's first line and sample (__l, __s)."""
    cells = cells.where(" and ".join(f"{x} is not null" for x in ("line", "sample", *keys, value)))
    cells = cells.groupBy(F.col("line").cast("int").alias("line"), F.col("sample").cast("int").alias("sample"), *keys).agg(F.max(value).alias("v"))
    origin = lambda x: (F.floor(F.col(x) / size) * size).cast("int")
    return cells.withColumns({"__l": origin("line"), "__s": origin("sample")})


def tick_files(cells: DataFrame, size: int = 128) -> DataFrame:
    """path, content: a tick raster for each tile of ``size`` that has any of the cells (line, sample, ticks).

    A raster spans its tile's cells; cells missing in it are 0. Of repeated cells the greatest counts, and cells with a null none.
    """
    ship(cells.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = int(frame["line"].min()), int(frame["sample"].min())
        out = np.zeros((int(frame["line"].max()) - top + 1, int(frame["sample"].max()) - left + 1), np.int64)
        out[frame["line"].to_numpy() - top, frame["sample"].to_numpy() - left] = frame["v"].to_numpy()
        return pd.DataFrame({"path": [f"ticks_{frame['__l'].iloc[0]:05d}_{frame['__s'].iloc[0]:05d}.bin"], "content": [encode_ticks(left, top, out)]})

    return _tiled(cells, "ticks", size).groupBy("__l", "__s").applyInPandas(one, "path string, content binary")


def band_files(cells: DataFrame, levels: list[float], size: int = 128) -> DataFrame:
    """path, content: a band file for each tile of ``size`` that has any of the cells (line, sample, band, hours).

    ``band`` is a place in levels, and others are left out. Missing, repeated and null cells as in tick_files().
    """
    ship(cells.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = int(frame["__l"].iloc[0]), int(frame["__s"].iloc[0])
        out = np.zeros((len(levels), size, size), np.float32)
        out[frame["band"].to_numpy(), frame["line"].to_numpy() - top, frame["sample"].to_numpy() - left] = frame["v"].to_numpy()
        return pd.DataFrame({"path": [f"bands_{top:05d}_{left:05d}.bin"], "content": [encode_bands(top, left, levels, out)]})

    return _tiled(cells.where(F.col("band").between(0, len(levels) - 1)), "hours", size, ("band",)).groupBy("__l", "__s").applyInPandas(one, "path string, content binary")


def horizon_files(pixels: DataFrame, size: int = 128, step: int = 1, observer: int = 0) -> DataFrame:
    """path, content: a horizon tile for each tile of ``size`` that has any of the pixels (line, sample, horizon of BINS values).

    Pixels missing in a tile have horizons of 0. Of repeated pixels the greatest horizon counts, and pixels with a null none.
    """
    ship(pixels.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = int(frame["__l"].iloc[0]), int(frame["__s"].iloc[0])
        out = np.zeros((size, size, BINS), np.float32)
        out[frame["line"].to_numpy() - top, frame["sample"].to_numpy() - left] = np.stack(frame["v"].to_list())
        return pd.DataFrame({"path": [tile_name(top, left, observer)], "content": [encode_tile(top, left, step, observer, out)]})

    return _tiled(pixels, "horizon", size).groupBy("__l", "__s").applyInPandas(one, "path string, content binary")


def bit_files(cells: DataFrame, levels: int, size: int = 128) -> DataFrame:
    """path, content: a bit cube for each tile of ``size``, a multiple of 8, that has any of the cells (line, sample, level, bit).

    ``level`` is from 0 to levels - 1, and others are left out. Missing, repeated and null cells as in tick_files().
    """
    if size % 8:
        raise ValueError("the width must be a multiple of 8")
    ship(cells.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = int(frame["__l"].iloc[0]), int(frame["__s"].iloc[0])
        out = np.zeros((levels, size, size), bool)
        out[frame["level"].to_numpy(), frame["line"].to_numpy() - top, frame["sample"].to_numpy() - left] = frame["v"].to_numpy()
        return pd.DataFrame({"path": [f"bits_{top:05d}_{left:05d}.bin"], "content": [encode_bits(out)]})

    return _tiled(cells.where(F.col("level").between(0, levels - 1)), "bit", size, ("level",)).groupBy("__l", "__s").applyInPandas(one, "path string, content binary")


_RECORD = ("x", "y", "depth", "stdev", "nx", "ny", "nz", "lighting")


def cache_files(records: DataFrame, size: int = 128) -> DataFrame:
    """path, content: a lighting cache for each tile of ``size`` with records (x, y, depth, stdev, nx, ny, nz, lighting), by y and x.

    Repeated records all stay; those with a null in any of these columns are left out.
    """
    ship(records.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x", "depth"], kind="stable")
        rows = list(frame[list(_RECORD)].itertuples(index=False, name=None))
        return pd.DataFrame({"path": [f"cache_{frame['__l'].iloc[0]:05d}_{frame['__s'].iloc[0]:05d}.bin"], "content": [encode_cache(rows)]})

    origin = lambda x: (F.floor(F.col(x) / size) * size).cast("int")
    known = records.where(" and ".join(f"{x} is not null" for x in _RECORD)).select(*_RECORD).withColumns({"__l": origin("y"), "__s": origin("x")})
    return known.groupBy("__l", "__s").applyInPandas(one, "path string, content binary")


def write(files: DataFrame, folder: str) -> int:
    """Write files (path, content) into a folder that all machines reach, each by the task that has it; returns their number.

    A file is written under a name of its task's own and then renamed, so a task that runs twice does no harm, and what
    exists under the name is replaced. With text.remaining() before it, only what is missing is made.
    """
    ship(files.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        system.create_dir(top, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                own = f"{top}/.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(content.as_buffer())
                system.move(own, f"{top}/{name.as_py()}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(one, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
