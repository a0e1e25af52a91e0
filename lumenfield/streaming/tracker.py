"""Structured Streaming over event tables: windowed levels, and dark runs as custom state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfield.session import ship


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; ts becomes a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, size: str = "2 hours", late: str = "1 hour") -> DataFrame:
    agg = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "top")


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """What a query over all that is there yields, as a table."""
    name = f"t{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def dark_counts(stream: DataFrame, threshold: float) -> DataFrame:
    """user_id, dark, longest: events below the threshold in a row, now and at most, kept as state for each user."""
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dark, longest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            dark = dark + 1 if v < threshold else 0
            longest = max(longest, dark)
        state.update((dark, longest))
        yield pd.DataFrame({"user_id": [key[0]], "dark": [dark], "longest": [longest]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, dark long, longest long", "dark long, longest long", "update", GroupStateTimeout.NoTimeout)
