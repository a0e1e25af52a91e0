"""Safe havens: how long a pixel is dark around each time when the station stands lowest.

``series`` has pid, i (dense from 0, each once), lit and comm (the station is seen); nulls count as false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lumenfield.operators import runs


def spells(series: DataFrame) -> DataFrame:
    """series with ``first`` and ``last`` of each step: from its last link back to the last light before that, and from its next link on to the next light.

    The step itself counts both ways; without a link or light on a side it is the series' end there.
    """
    w = W.partitionBy("pid").orderBy("i")
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    s = series.withColumns({"lit": F.coalesce("lit", F.lit(False)), "comm": F.coalesce("comm", F.lit(False)), "end": F.count("*").over(W.partitionBy("pid")).cast("int") - 1})
    light = F.when(F.col("lit"), F.col("i"))
    s = s.withColumns({"dusk": F.coalesce(F.last(light, True).over(before), F.lit(0)), "dawn": F.coalesce(F.first(light, True).over(after), F.col("end"))})
    first = F.last(F.when(F.col("comm"), F.col("dusk")), True).over(before)
    last = F.first(F.when(F.col("comm"), F.col("dawn")), True).over(after)
    return s.withColumns({"first": F.coalesce(first, F.lit(0)), "last": F.coalesce(last, F.col("end"))}).drop("dusk", "dawn", "end")


def by_minimum(series: DataFrame, lows: DataFrame, recharge: int = 12, step_hours: float = 2.0) -> DataFrame:
    """pid, i, haven_steps, haven_hours for each pixel and each step in ``lows`` (i; repeats and nulls don't matter).

    The most dark steps that gather within the spell around the step, where ``recharge`` lit ones in a row reset them. All
    windows and the gathering of a pixel's row share one exchange by pid; lows meet the steps before it.
    """
    flagged = series.join(lows.where("i is not null").select("i", F.lit(True).alias("low")).distinct(), "i", "left")
    lowest = F.when(F.col("low"), F.struct("i", "first", "last"))
    each = spells(flagged).groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "lit"))), lambda x: x["lit"]).alias("lit"), F.collect_list(lowest).alias("lows"))
    each = each.select("pid", "lit", F.explode("lows").alias("at"))
    part = F.slice("lit", F.col("at.first") + 1, F.col("at.last") - F.col("at.first") + 1)
    out = each.select("pid", F.col("at.i").alias("i"), runs.shadow_with_recharge(part, recharge).alias("haven_steps"))
    return out.withColumn("haven_hours", F.col("haven_steps") * step_hours)


def combined(havens: DataFrame) -> DataFrame:
    """pid, haven_steps, haven_hours: the worst of a pixel's minima."""
    return havens.groupBy("pid").agg(F.max("haven_steps").alias("haven_steps"), F.max("haven_hours").alias("haven_hours"))


def by_interval(series: DataFrame, first: int, last: int, gap: int = 12, none: int = 1000) -> DataFrame:
    """pid, haven_steps: of the spells without a link, the one whose longest dark interval is shortest; the older measure.

    Spells and dark intervals are put together over ``gap`` steps; those that end before ``first`` or begin after ``last`` are
    left out; one at the series' end stops at its last step; touching counts as meeting. A spell that meets no dark
    interval counts ``none``, and so does a pixel without any.
    """
    ends = series.groupBy("pid").agg(F.count("*").alias("n"))

    def intervals(value: str) -> DataFrame:
        s = series.select("pid", "i", F.coalesce(value, F.lit(False)).alias("lit"))
        cut = runs.dark_intervals(s, gap).join(ends, "pid").withColumn("stop", F.least("stop", F.col("n") - 1))
        return cut.where((F.col("start") <= last) & (F.col("stop") >= first)).select("pid", "start", "stop")

    spell, dark = intervals("comm"), intervals("lit")
    wider = lambda x: x.withColumn("stop", F.col("stop") + 1)  # noqa: E731 - so that those that touch overlap
    met = runs.overlaps(wider(spell), wider(dark)).groupBy("pid", "start").agg(F.max(F.col("stop2") - 1 - F.col("start2")).alias("dark"))
    least = spell.join(met, ["pid", "start"], "left").groupBy("pid").agg(F.min(F.coalesce("dark", F.lit(none))).alias("haven_steps"))
    return ends.select("pid").join(least, "pid", "left").select("pid", F.coalesce("haven_steps", F.lit(none)).cast("int").alias("haven_steps"))
