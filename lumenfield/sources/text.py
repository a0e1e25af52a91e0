"""Text inputs and outputs: sample tables, job queues, kernel lists, configuration, names, skipping of what exists."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRIANGLE = ", ".join(f"{c}{k} double" for k in (1, 2, 3) for c in "xyz") + ", lon double, lat double, elevation double, num double, modern double, paleo double"


def triangles(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated triangles without a header, with their centre."""
    t = spark.read.csv(path, sep="\t", schema=TRIANGLE)
    return t.withColumns({"cx": F.expr("(x1 + x2 + x3) / 3"), "cy": F.expr("(y1 + y2 + y3) / 3")})


def depths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="lat double, lon double, depth double")


def depth_product(spark: SparkSession, path: str) -> DataFrame:
    """Fields 3 to 8 of a tab-separated file with comments: depth, x, y, z, negative longitude, latitude."""
    t = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select(F.split("value", "\t").alias("f"))
    field = lambda k: F.get("f", F.lit(k)).try_cast("double")
    return t.select(field(3).alias("depth"), field(4).alias("x"), field(5).alias("y"), field(6).alias("z"), (-field(7)).alias("lon"), field(8).alias("lat"))


def kernels(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a list; blank lines and those that begin with a space or # are skipped."""
    return spark.read.text(path).where(~F.col("value").rlike("^( |#|$)")).select(F.trim("value").alias("path"))


QUEUE = "Line int, Sample int, Width int, Height int, Step int, ObserverHeightInMeters int"


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a JSON list; none if there is no file."""
    try:
        return spark.read.json(path, schema=QUEUE, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], QUEUE)


def setting(key: str, host: str, path: str, default: str | None = None, environment: str = "LUMENFIELD_") -> str | None:
    """host_key, then key of a JSON file, then the environment, then the default."""
    known = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    return next((v for v in (known.get(f"{host}_{key}"), known.get(key), os.environ.get(environment + key), default) if v is not None), None)


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without an output yet, which makes a sink idempotent."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def product_name(kind: str, line: Column, sample: Column, observer: Column, start: Column, stop: Column, step_hours: Column) -> Column:
    return F.format_string(f"{kind}_%05d_%05d_%03d_%s_%s_%02d.bin", line.cast("int"), sample.cast("int"), observer.cast("int"), F.date_format(start, "yyyyMMdd"), F.date_format(stop, "yyyyMMdd"), step_hours.cast("int"))
