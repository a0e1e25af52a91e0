"""Headerless elevation rasters as a data source of many partitions, one for each row of tiles.

``scan`` is the way in. A partition reads only its lines, and of them only the samples that are asked for; ranges come as options,
and comparisons of line and sample with constants narrow them where spark.sql.python.filterPushdown.enabled is set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from lumenfield.functions.geometry import GRID, TILE
from lumenfield.session import ship

#: Fixed values of the formats: numbers as they are stored, and metres in one of them.
KINDS = {"int16": ("<i2", 0.5), "float32": ("<f4", 0.001)}
SCHEMA = "line int, sample int, h double"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path on any file system that pyarrow knows; one without a scheme is local, or on a folder that all machines mount."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Lines(ds.InputPartition):
    """Lines from first up to stop, which isn't included."""

    first: int
    stop: int


class DemReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        if (kind := options.get("kind", "int16")) not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        self.dtype, self.scale = KINDS[kind]
        number = lambda name, default: int(options.get(name, default))
        self.size = {"line": number("lines", GRID), "sample": number("samples", GRID)}
        self.rows, self.raw, self.pole = number("rows", TILE), options.get("raw", "false").lower() == "true", options.get("pole")
        self.range = {x: [number(f"{x}_from", 0), number(f"{x}_to", n)] for x, n in self.size.items()}
        for name, (a, b) in self.range.items():
            if not 0 <= a <= b <= self.size[name]:
                raise ValueError(f"{name}s from {a} to {b} are out of bounds")

    def partitions(self) -> list[Lines]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        if info.size != self.size["line"] * self.size["sample"] * np.dtype(self.dtype).itemsize:
            raise ValueError("a raster's length doesn't agree with its size")
        (a, b), (s, t) = self.range["line"], self.range["sample"]
        if a >= b or s >= t:
            return [Lines(0, 0)]
        return [Lines(max(k, a), min(k + self.rows, b)) for k in range(a // self.rows * self.rows, b, self.rows)]

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        system, path = opened(self.path)
        (s, t), width = self.range["sample"], np.dtype(self.dtype).itemsize
        if part.first >= part.stop:
            return
        with system.open_input_file(path) as file:
            samples = pa.array(np.arange(s, t, dtype=np.int32))
            for line in range(part.first, part.stop):
                values = np.frombuffer(file.read_at((t - s) * width, (line * self.size["sample"] + s) * width), self.dtype)
                h = values.astype(np.float64) * (1.0 if self.raw else self.scale)
                columns = [pa.array(np.full(t - s, line, np.int32)), samples, pa.array(h)]
                names = ["line", "sample", "h"]
                if self.pole:
                    columns, names = [*columns, pa.array([self.pole] * (t - s))], [*names, "pole"]
                yield pa.RecordBatch.from_arrays(columns, names=names)


class NarrowedDemReader(DemReader):
    """A reader that takes comparisons with constants; Spark refuses it where they aren't pushed to Python sources."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if not self._narrowed(f):
                yield f

    def _narrowed(self, f: ds.Filter) -> bool:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name not in self.range:
            return False
        if isinstance(f, ds.IsNotNull):
            return True
        if not isinstance(getattr(f, "value", None), int):
            return False
        bounds = {
            ds.EqualTo: lambda v: (v, v + 1),
            ds.GreaterThan: lambda v: (v + 1, None),
            ds.GreaterThanOrEqual: lambda v: (v, None),
            ds.LessThan: lambda v: (None, v),
            ds.LessThanOrEqual: lambda v: (None, v + 1),
        }.get(type(f))
        if bounds is None:
            return False
        a, b = bounds(f.value)
        mine = self.range[name]
        mine[0] = mine[0] if a is None else max(mine[0], a)
        mine[1] = mine[1] if b is None else min(mine[1], b)
        return True


class DemSource(ds.DataSource):
    """Options: path, kind (int16 in half metres, float32 in thousandths), lines and samples of the raster, rows of a partition,
    raw (numbers as stored), pole (a column of that value), push (comparisons narrow
    the ranges), line_from, line_to, sample_from, sample_to."""

    @classmethod
    def name(cls) -> str:
        return "dem"

    def schema(self) -> str:
        return f"{SCHEMA}, pole string" if self.options.get("pole") else SCHEMA

    def reader(self, schema) -> DemReader:
        return (NarrowedDemReader if self.options.get("push") == "true" else DemReader)(dict(self.options))


def scan(spark: SparkSession, path: str, kind: str = "int16", pole: str | None = None, lines: tuple[int, int] | None = None, samples: tuple[int, int] | None = None, size: tuple[int, int] = (GRID, GRID), rows: int = TILE, raw: bool = False) -> DataFrame:
    """line, sample, h in metres above the reference radius (and pole, where one is named).

    ``lines`` and ``samples`` are ranges whose ends aren't included; out of bounds, as a file of a wrong length, they raise ValueError.
    """
    ship(spark)
    spark.dataSource.register(DemSource)
    reader = spark.read.format("dem").options(path=path, kind=kind, lines=size[0], samples=size[1], rows=rows, raw=raw, push=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower())
    for name, ends in (("line", lines), ("sample", samples)):
        if ends:
            reader = reader.options(**{f"{name}_from": ends[0], f"{name}_to": ends[1]})
    return (reader.option("pole", pole) if pole else reader).load()
