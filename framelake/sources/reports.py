"""Durations of datasets, and the files in which they are reported."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import series, stats
from framelake.plans import checks
from framelake.sources import publish


def episode_lengths(spark: SparkSession, root: str) -> DataFrame:
    """(episode_index, length) as declared: from meta/episodes.jsonl if there is one, else from the tables under meta/episodes. Only these columns are read."""
    if publish.exists(spark, f"{root}/meta/episodes.jsonl"):
        return spark.read.schema("episode_index long, length long").json(f"{root}/meta/episodes.jsonl", mode="FAILFAST")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes").select(F.col("episode_index").cast("long").alias("episode_index"), F.col("length").cast("long").alias("length"))


def compared(before: DataFrame, after: DataFrame, fps: float) -> DataFrame:
    """(episode, source_frames, output_frames, source_s, output_s, reduction_percent) of (episode, length) on both sides, which must list the same episodes."""
    both = before.select("episode", F.col("length").alias("source_frames")).join(after.select("episode", F.col("length").alias("output_frames")), "episode", "full_outer")
    checks.require_valid(both.where("source_frames is null or output_frames is null"), "episodes of one side only")
    cut = F.try_divide(F.col("source_frames") - F.col("output_frames"), F.col("source_frames")) * 100
    return both.withColumns({"source_s": F.col("source_frames") / fps, "output_s": F.col("output_frames") / fps, "reduction_percent": cut})


def write_durations(durations: DataFrame, root: str, last: int = 50) -> dict:
    """Writes the rows of :func:`compared` as CSV and their summaries by group as JSON lines; returns the summaries. The last group is there only if there are more than ``last`` episodes."""
    durations.repartitionByRange("episode").sortWithinPartitions("episode").write.mode("error").option("header", "true").csv(f"{root}/episode_durations")
    summary = stats.duration_groups(durations, last)
    summary.coalesce(1).write.mode("error").json(f"{root}/duration_summary")
    return {r["grp"]: r.asDict() for r in summary.collect()}  # three rows


def summary_json(summary: dict) -> str:
    """A summary as JSON; undefined numbers are refused."""
    return json.dumps(summary, allow_nan=False, indent=2, sort_keys=True)


def tick_step(n: int, most: int = 30) -> int:
    """The smallest of 1, 2, 5, 10, 20, 50, ... by which n labels become ``most`` at most."""
    step, k = 1, 0
    while -(-n // step) > most:
        k += 1
        step = (1, 2, 5)[k % 3] * 10 ** (k // 3)
    return step


def frame_ranges(selection: DataFrame) -> DataFrame:
    """(episode, filter): the selected frames of each episode as one expression of ranges, between(n,a,b) joined by +, for an external video tool."""
    ranges = series.runs(selection.select("episode", "frame").distinct(), F.lit(True))
    text = F.format_string("between(n,%d,%d)", "start_frame", F.col("end_frame") - 1)
    ordered = ranges.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("start_frame", text.alias("text")))).alias("all"))  # of one episode's ranges
    return ordered.select("episode", F.array_join(F.col("all.text"), "+").alias("filter"))
