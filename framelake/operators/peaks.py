"""Peaks of a signal by distance, prominence and width, a row a peak."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.operators import series


def _runs(frames: DataFrame, x: str) -> DataFrame:
    """(episode, first, final, h, top, edge): runs of equal values in order; top if both neighbours are lower."""
    turns = F.coalesce((F.col(x) != F.lag(x).over(series.ep())).cast("long"), F.lit(0))
    marked = frames.select("episode", "frame", F.col(x).cast("double").alias("h"), F.sum(turns).over(series.so_far()).alias("run"))
    runs = marked.groupBy("episode", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("final"), F.first("h").alias("h"))
    order = Window.partitionBy("episode").orderBy("first")
    before, after = F.lag("h").over(order), F.lead("h").over(order)
    return runs.select("episode", "first", "final", "h", F.coalesce((before < F.col("h")) & (after < F.col("h")), F.lit(False)).alias("top"), (before.isNull() | after.isNull()).alias("edge"))


def apart(peaks: DataFrame, distance: int) -> DataFrame:
    """The peaks (episode, frame, h) that stay if of two nearer than ``distance`` frames the lower goes (of equal ones the earlier), highest first.

    Only peaks of one chain, each nearer than ``distance`` to the next, can decide on one another, so chains are decided side by side.
    """
    order = Window.partitionBy("episode").orderBy("frame")
    breaks = F.coalesce((F.col("frame") - F.lag("frame").over(order) >= distance).cast("long"), F.lit(0))
    chained = peaks.withColumn("chain", F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chained.groupBy("episode", "chain").agg(F.sort_array(F.collect_list(F.struct("h", "frame")), asc=False).alias("peaks"))
    kept = F.aggregate("peaks", F.array().cast("array<struct<h:double,frame:bigint>>"), lambda kept, p: F.when(F.exists(kept, lambda k: F.abs(k["frame"] - p["frame"]) < distance), kept).otherwise(F.concat(kept, F.array(p))))
    return chains.select("episode", F.inline(kept)).select("episode", "frame", "h")


def _bases(elements: str, low: str) -> Column:
    """For each element (h, ``low``) the least value back to the nearest higher element; ``low`` is the least since the element before.

    The stack holds the elements that nothing after them has topped yet, with the least value back to the one below.
    """
    none = F.struct(F.array().cast("array<struct<h:double,low:double>>").alias("stack"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        under = F.filter(state["stack"], lambda s: s["h"] <= e["h"])
        base = F.least(e[low], F.array_min(F.transform(under, lambda s: s["low"])))
        over = F.filter(state["stack"], lambda s: s["h"] > e["h"])
        return F.struct(F.concat(over, F.array(F.struct(e["h"].alias("h"), base.alias("low")))).alias("stack"), F.concat(state["out"], F.array(base)).alias("out"))

    return F.aggregate(elements, none, step, lambda state: state["out"])


def prominences(frames: DataFrame, x: str) -> DataFrame:
    """(episode, frame, h, prominence) of every local maximum of ``x``, of a flat one its middle frame.

    The prominence is the height over the higher of the two least values on the way to the nearest higher value, or the end, on either side.
    Only maxima and ends can be such nearest higher ones, so an episode's maxima with the lows between them are enough.
    """
    runs = _runs(frames, x)
    order = Window.partitionBy("episode").orderBy("first")
    parts = runs.withColumn("part", F.sum((F.col("top") | F.col("edge")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("top") | F.col("edge")).cast("long"))
    least = parts.groupBy("episode", "part").agg(F.min("h").alias("low"), F.max_by(F.struct("first", "final", "h", "top"), "first").alias("e"))
    after = F.coalesce(F.lead("low").over(Window.partitionBy("episode").orderBy("part")), F.col("e.h"))
    told = least.select("episode", F.struct(F.col("e.first").alias("first"), F.col("e.final").alias("final"), F.col("e.h").alias("h"), F.col("e.top").alias("top"), "low", after.alias("after")).alias("e"))
    whole = told.groupBy("episode").agg(F.array_sort(F.collect_list("e")).alias("all"))  # an episode's maxima
    whole = whole.select("episode", F.arrays_zip("all", _bases("all", "low").alias("left"), F.reverse(_bases_reversed()).alias("right")).alias("z")).select("episode", F.inline("z"))
    return whole.where("all.top").select("episode", F.expr("(all.first + all.final) div 2").alias("frame"), F.col("all.h").alias("h"), (F.col("all.h") - F.greatest("left", "right")).alias("prominence"))


def _bases_reversed() -> Column:
    return _bases(F.reverse("all"), "after")


def peaks(frames: DataFrame, x: str, distance: int = 1, width: float = 0.0, prominence: float = 0.0) -> DataFrame:
    """(episode, frame, h, prominence, width) of the local maxima of ``x`` over frames numbered without gaps.

    First peaks nearer than ``distance`` frames to a higher one go, then those of less ``prominence``, then those narrower than ``width`` at half
    their prominence, between crossings found by linear interpolation. Widths are measured as far as ``width`` asks: on a side that doesn't cross
    within the frames that can matter, these frames count. Constant and empty episodes have no peaks; null values aren't allowed.
    """
    told = prominences(frames, x).where(F.col("prominence") >= prominence)
    if distance > 1:
        all_tops = _runs(frames, x).where("top").select("episode", F.expr("(first + final) div 2").alias("frame"), "h")
        told = told.join(apart(all_tops, distance).select("episode", "frame"), ["episode", "frame"])
    reach = max(1, math.ceil(width)) + 1
    near = frames.select("episode", "frame", F.reverse(F.collect_list(F.col(x).cast("double")).over(series.ep().rowsBetween(-reach, 0))).alias("left"), F.collect_list(F.col(x).cast("double")).over(series.ep().rowsBetween(0, reach)).alias("right"))
    seen = told.join(near, ["episode", "frame"]).withColumn("level", F.col("h") - F.col("prominence") / 2)

    def side(values: str) -> Column:
        crossing = lambda o: F.when((F.get(values, o) <= F.col("level")) & (F.get(values, o - 1) > F.col("level")), o - (F.col("level") - F.get(values, o)) / (F.get(values, o - 1) - F.get(values, o)))
        return F.coalesce(F.array_min(F.transform(F.sequence(F.lit(1), F.size(values) - 1), crossing)), (F.size(values) - 1).cast("double"))

    return seen.withColumn("width", side("left") + side("right")).where(F.col("width") >= width).select("episode", "frame", "h", "prominence", "width")
