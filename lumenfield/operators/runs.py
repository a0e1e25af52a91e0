"""Runs in time series: ``series`` has pid, i (dense from 0) and lit. One shuffle by pid serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def runs(series: DataFrame) -> DataFrame:
    """pid, n, lit, start, stop (not included), len of each maximal run."""
    w = W.partitionBy("pid").orderBy("i")
    change = (F.lag("lit").over(w).eqNullSafe(F.col("lit"))).cast("int")
    e = series.select("pid", "i", "lit", (1 - change).alias("change"), F.count("*").over(W.partitionBy("pid")).alias("n"))
    e = e.withColumn("island", F.sum("change").over(w))
    return e.groupBy("pid", "island", "n", "lit").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).withColumn("len", F.col("stop") - F.col("start")).drop("island")


def longest(series: DataFrame) -> DataFrame:
    """Longest dark run that ends before the series does (none: the whole span, or 0), and longest lit one (none: -1)."""
    ended = F.col("stop") < F.col("n")
    dark, lit = F.max(F.when(~F.col("lit") & ended, F.col("len"))), F.max(F.when(F.col("lit") & ended, F.col("len")))
    return runs(series).groupBy("pid").agg(F.coalesce(dark, F.max("n")).alias("longest_night_1"), F.coalesce(dark, F.lit(0)).alias("longest_night_2"), F.coalesce(lit, F.lit(-1)).alias("full_sun_steps"))


def longest_nights(curve: DataFrame, thresholds: list[float], value: str = "v") -> DataFrame:
    """pid, band, longest_night: longest() of each threshold, whose place in the list is its band, in one pass over the curve."""
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.lit(float(t)).alias("t")) for k, t in enumerate(thresholds)]))
    series = curve.select("pid", "i", value, bands.alias("b")).select(F.struct("pid", "b.band").alias("pid"), "i", (F.col(value) >= F.col("b.t")).alias("lit"))
    return longest(series).select("pid.pid", "pid.band", F.col("longest_night_1").alias("longest_night"))


def shadow_with_recharge(lit: Column, recharge: int = 12) -> Column:
    """Most dark steps that gather in an array of booleans, where so many lit ones in a row reset them."""
    state = lambda cs, sh, mx: F.struct(cs.cast("int").alias("cs"), sh.cast("int").alias("sh"), mx.cast("int").alias("mx"))
    zero = F.lit(0)

    def step(t: Column, x: Column) -> Column:
        full = x & (t["cs"] + 1 >= recharge)
        return state(F.when(x, t["cs"] + 1).otherwise(zero), F.when(full, zero).when(x, t["sh"]).otherwise(t["sh"] + 1), F.greatest(t["mx"], t["sh"]))

    return F.aggregate(lit, state(zero, zero, zero), step, lambda t: F.greatest(t["mx"], t["sh"]))


def series_arrays(series: DataFrame, value: str = "lit") -> DataFrame:
    """A row for each pid with its values in order."""
    return series.groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value))), lambda x: x[value]).alias(value))


def havens(series: DataFrame, recharge: int = 12) -> DataFrame:
    return series_arrays(series).select("pid", shadow_with_recharge(F.col("lit"), recharge).alias("haven_steps"))


def minima(curve: DataFrame, value: str = "v") -> DataFrame:
    """Places strictly below both neighbours."""
    w = W.partitionBy("pid").orderBy("i")
    return curve.withColumns({"a": F.lag(value).over(w), "b": F.lead(value).over(w)}).where(f"a > {value} and {value} < b").drop("a", "b")


def box_maxima(curve: DataFrame, widths: tuple[int, ...] = (3, 6, 9, 12), value: str = "v") -> DataFrame:
    """For each width the largest trailing sum over the width, divided by the width from the first value on."""
    w = W.partitionBy("pid").orderBy("i")
    sums = {f"w{k}": F.sum(value).over(w.rowsBetween(1 - k, 0)) / k for k in widths}
    return curve.select("pid", *[x.alias(n) for n, x in sums.items()]).groupBy("pid").agg(*[F.max(n).alias(n) for n in sums])


def dark_intervals(series: DataFrame, gap: int = 12) -> DataFrame:
    """Dark runs, put together where no more than ``gap`` lit steps are between them."""
    w = W.partitionBy("pid").orderBy("start")
    d = runs(series).where("not lit").withColumn("open", (F.col("start") - F.lag("stop").over(w) > gap).cast("int"))
    d = d.withColumn("part", F.sum(F.coalesce("open", F.lit(1))).over(w))
    return d.groupBy("pid", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def nearest_lit(series: DataFrame) -> DataFrame:
    """The last lit step up to each step and the first one from it."""
    w = W.partitionBy("pid").orderBy("i")
    at = F.when(F.col("lit"), F.col("i"))
    return series.select("pid", "i", F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("before"), F.first(at, True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("after"))


def first_long_run(series: DataFrame, longer: int) -> DataFrame:
    return runs(series).where(F.col("lit") & (F.col("len") > longer)).groupBy("pid").agg(F.min("start").alias("start"))


def overlaps(a: DataFrame, b: DataFrame, width: int = 32) -> DataFrame:
    """Pairs of intervals of one pid that overlap: an equi-join on the pid and blocks of time that both touch."""
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))).alias("block")
    x = a.select("pid", "start", "stop", blocks("start", "stop"))
    y = b.select("pid", F.col("start").alias("start2"), F.col("stop").alias("stop2")).select("*", blocks("start2", "stop2"))
    both = x.join(y, ["pid", "block"]).where("start < stop2 and start2 < stop")
    # A pair that shares several blocks counts in the first of them.
    return both.where(F.col("block") == F.floor(F.greatest("start", "start2") / width)).select("pid", "start", "stop", "start2", "stop2", (F.least("stop", "stop2") - F.greatest("start", "start2")).alias("overlap"))
