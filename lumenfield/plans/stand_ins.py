"""Domain tables derived from the driver's tables, in Spark and as SQL text for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenfield.operators import curves

STEPS, SIDE, LIT = 360, 64, 250.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An elevation grid, SIDE squared at most: line, sample, h."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("line"), (F.col("l_partkey") % SIDE).cast("int").alias("sample")).agg((F.sum(F.col("l_quantity").cast("long")) / F.count("*")).alias("h"))


GRID = f"grid as (select cast(l_orderkey % {SIDE} as int) as line, cast(l_partkey % {SIDE} as int) as sample, cast(sum(cast(l_quantity as bigint)) as double) / count(*) as h from lineitem group by 1, 2)"


def curve(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Levels of each user (as a pixel) by two-hour steps: pid, i, v, dense."""
    ev = table(spark, sf_dir, "events")
    if kind:
        ev = ev.where(F.col("event_type") == kind)
    step = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 7200).cast("int")
    levels = ev.groupBy(F.col("user_id").alias("pid"), step.alias("i")).agg(F.max("value").alias("v"))
    return curves.dense(levels, STEPS)


def CURVE(name: str = "curve", kind: str | None = None) -> str:
    where = f"where event_type = '{kind}'" if kind else ""
    return f"""{name}_l as (select user_id as pid, cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 7200) as int) as i, max(value) as v from events {where} group by 1, 2),
{name} as (select p.pid, t.i, coalesce(l.v, 0) as v, coalesce(l.v, 0) >= {LIT} as lit from (select distinct pid from {name}_l) p cross join (select cast(range as int) as i from range({STEPS})) t left join {name}_l l on l.pid = p.pid and l.i = t.i)"""


def lit(c: DataFrame) -> DataFrame:
    return c.withColumn("lit", F.col("v") >= LIT)


#: Runs of a curve named c: pid, n, lit, start, stop, len.
def RUNS(c: str = "curve", name: str = "r") -> str:
    return f"""{name}_e as (select *, case when lag(lit) over w is distinct from lit then 1 else 0 end as chg, count(*) over (partition by pid) as n from {c} window w as (partition by pid order by i)),
{name}_g as (select *, sum(chg) over (partition by pid order by i) as isl from {name}_e),
{name} as (select pid, isl, n, lit, min(i) as start, max(i) + 1 as stop, count(*) as len from {name}_g group by pid, isl, n, lit)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte raster: line, sample, v."""
    return grid(spark, sf_dir).select("line", "sample", F.pmod((F.col("h") * 7).cast("int") + F.col("line") * 3, F.lit(256)).cast("int").alias("v"))


LEVELS = GRID + ", levels as (select line, sample, cast(((cast(floor(h * 7) as int) + line * 3) % 256) as int) as v from grid)"
