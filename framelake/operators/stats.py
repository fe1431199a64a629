"""Statistics of vectors and durations, per episode and pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_stats(frames: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """(keys, pos, min, max, mean, std, count) of each component; std is the population's."""
    long = frames.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy(*keys, "pos").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def pooled(stats: DataFrame) -> DataFrame:
    """Statistics of all frames from those of episodes: the mean is weighted, the variance taken about the pooled mean in a second pass."""
    means = stats.groupBy("pos").agg((F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("pooled_mean"))
    spread = F.col("std") * F.col("std") + (F.col("mean") - F.col("pooled_mean")) * (F.col("mean") - F.col("pooled_mean"))
    return stats.join(means, "pos").groupBy("pos").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.first("pooled_mean").alias("mean"), F.sqrt(F.sum(F.col("count") * spread) / F.sum("count")).alias("std"), F.sum("count").alias("count"))


def duration_groups(durations: DataFrame, last: int = 50) -> DataFrame:
    """Summary of (episode, source_s, output_s) over all episodes, the ``last`` ones, and those before; the groups overlap."""
    least = durations.orderBy(F.desc("episode")).limit(last).agg(F.min("episode")).first()[0]
    grouped = durations.withColumn("grp", F.explode(F.array(F.lit("all"), F.when(F.col("episode") >= F.lit(least), f"last{last}").otherwise(f"before_last{last}"))))
    cut = (1 - F.col("output_s") / F.col("source_s")) * 100
    return grouped.groupBy("grp").agg(
        F.count("*").alias("n"), F.avg("output_s").alias("mean_s"), F.median("output_s").alias("median_s"), F.stddev_pop("output_s").alias("std_s"), F.min("output_s").alias("min_s"), F.max("output_s").alias("max_s"),
        ((1 - F.sum("output_s") / F.sum("source_s")) * 100).alias("reduction_percent"), F.min(cut).alias("least_reduction_percent"), F.every(F.col("output_s") < F.col("source_s")).alias("all_shorter"),
    )


def dataset_summary(episodes: DataFrame, fps: float) -> DataFrame:
    """One row of totals over (episode, source_frames, active_frames, output_frames, warnings, truncated, inherited_jumps): frames, seconds, the share left out, and counts of episodes with warnings or cut short."""
    total = {n: F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("source_frames", "active_frames", "output_frames")}
    sums = episodes.agg(F.count("*").alias("total_episodes"), *total.values(), F.count_if(F.coalesce(F.col("warnings") > 0, F.lit(False))).alias("ambiguous_episodes"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated_episodes"), F.coalesce(F.sum("inherited_jumps"), F.lit(0)).alias("inherited_jumps"))
    return sums.withColumns({"frame_reduction_fraction": F.try_divide(F.col("source_frames") - F.col("output_frames"), F.col("source_frames")), "discarded_frames": F.col("source_frames") - F.col("active_frames"), **{f"{n}_duration_s": F.col(f"{n}_frames") / fps for n in ("source", "active", "output")}})


def camera_eye(frames: DataFrame) -> DataFrame:
    """(episode, x, y, z) of a camera that sees the right arm on the right: from the mean offset of the arms (lx, ly, lz, rx, ry, rz by frame).

    Where the arms' mean offset is level with nothing, the frame where they are widest apart serves (the first of several), else a fixed corner.
    """
    d = [F.col(f"r{n}") - F.col(f"l{n}") for n in "xy"]
    wide = F.hypot(*d)
    told = frames.groupBy("episode").agg(F.avg(d[0]).alias("x"), F.avg(d[1]).alias("y"), F.max(F.struct(wide.alias("w"), (-F.col("frame")).alias("f"), d[0].alias("x"), d[1].alias("y"))).alias("widest"))
    least = F.greatest(F.lit(1e-9), F.col("widest.w") * 1e-6)
    thin = (F.hypot("x", "y") <= least) & (F.col("widest.w") > least)
    told = told.select("episode", least.alias("least"), *(F.when(thin, F.col(f"widest.{n}")).otherwise(F.col(n)).alias(n) for n in "xy")).withColumn("level", F.hypot("x", "y"))
    known = F.coalesce(F.col("level") > F.col("least"), F.lit(False))
    return told.select("episode", F.when(known, 1.8 * F.col("y") / F.col("level")).otherwise(1.25).alias("x"), F.when(known, -1.8 * F.col("x") / F.col("level")).otherwise(1.25).alias("y"), F.lit(0.9).alias("z"))
