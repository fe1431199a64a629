"""Validators: each returns one row for each breach, so an empty result is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def timeline(frames: DataFrame, fps: float, tolerance: float = 1e-5) -> DataFrame:
    """Frames whose number is not their rank from 0, or whose timestamp (seconds) is off i / fps by more than the tolerance; null in either is a breach."""
    rank = F.row_number().over(Window.partitionBy("episode").orderBy("frame")) - 1
    ranked = frames.withColumn("rank", rank.cast("long"))
    near = F.abs(F.col("timestamp") - F.col("frame") / fps) <= tolerance
    reason = F.when(~F.col("rank").eqNullSafe(F.col("frame")), "frame").when(~F.coalesce(near & ~F.isnan("timestamp"), F.lit(False)), "timestamp")
    return ranked.withColumn("reason", reason).where("reason is not null").select("episode", "frame", "reason")


def unsound(vector: str | Column) -> Column:
    """Whether a vector is null or holds a null, NaN or infinite component."""
    return F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def vectors(frames: DataFrame, vector: str, width: int) -> DataFrame:
    """Episodes with unsound vectors or vectors of another width, and how many."""
    return frames.groupBy("episode").agg(F.count_if(unsound(vector)).alias("unsound"), F.count_if(F.coalesce(F.size(vector) != width, F.lit(True))).alias("wrong_width")).where("unsound > 0 or wrong_width > 0")


def episode_lengths(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Episodes whose declared length is not their number of rows, or that only one side has."""
    counted = frames.groupBy("episode").agg(F.count("*").alias("n_rows"))
    joined = episodes.select("episode", "length").join(counted, "episode", "full_outer")
    return joined.where(~F.col("length").eqNullSafe(F.col("n_rows"))).select("episode", "length", "n_rows")


def orphans(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Keys that the dimension lacks, with how many rows use them."""
    return rows.join(dimension.select(F.col(dimension_key).alias(key)), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def source_map(entries: DataFrame) -> DataFrame:
    """Episodes of (episode, output_frame, source_frame) with whether output frames are dense from 0 and source frames strictly increase; null in either is neither."""
    order = Window.partitionBy("episode").orderBy("output_frame")
    rising = (F.col("source_frame") > F.lag("source_frame").over(order)) | (F.row_number().over(order) == 1)
    marked = entries.withColumn("dense", F.col("output_frame").eqNullSafe(F.row_number().over(order) - 1)).withColumn("rising", F.coalesce(rising & F.col("source_frame").isNotNull(), F.lit(False)))
    return marked.groupBy("episode").agg(F.count("*").alias("n"), F.every(F.col("dense") & F.col("rising")).alias("valid"))


def totals(declared: DataFrame, frames: DataFrame, tasks: DataFrame, key: str = "episode") -> DataFrame:
    """(name, declared, found) of totals (total_episodes, total_frames, total_tasks in one row) that the rows don't bear out."""
    names = ("total_episodes", "total_frames", "total_tasks")

    def long(row: DataFrame, name: str, *of: str) -> DataFrame:
        return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias(name)) for n in of))))

    found = long(frames.agg(F.count_distinct(key).alias(names[0]), F.count("*").alias(names[1])), "found", *names[:2]).union(long(tasks.agg(F.count("*").alias(names[2])), "found", names[2]))
    return long(declared, "declared", *names).join(found, "name").where(~F.col("declared").eqNullSafe(F.col("found"))).select("name", "declared", "found")


def limits(frames: DataFrame, least: int = 1, most: int = 100_000) -> DataFrame:
    """(episode, n) of episodes with fewer rows than ``least`` or more than ``most``."""
    return frames.groupBy("episode").agg(F.count("*").alias("n")).where((F.col("n") < least) | (F.col("n") > most))


def selection(frames: DataFrame, chosen: DataFrame, protected: DataFrame) -> DataFrame:
    """(episode, frame, reason) of a selection (episode, frame): frames that the source lacks, chosen twice, or protected and left out. Frames after an episode's last chosen one may go."""
    source, own = frames.select("episode", "frame").distinct(), chosen.select("episode", "frame")
    unknown = own.join(source, ["episode", "frame"], "left_anti").withColumn("reason", F.lit("unknown"))
    twice = own.groupBy("episode", "frame").count().where("count > 1").select("episode", "frame", F.lit("twice").alias("reason"))
    last = own.groupBy("episode").agg(F.max("frame").alias("last"))
    lost = protected.select("episode", "frame").distinct().join(last, "episode", "left").where(F.col("frame") <= F.coalesce("last", F.col("frame"))).drop("last")
    return unknown.unionByName(twice).unionByName(lost.join(own, ["episode", "frame"], "left_anti").withColumn("reason", F.lit("protected")))


def require_valid(breaches: DataFrame, what: str) -> None:
    """Raises on the driver if there is a breach, with the first ten."""
    if first := breaches.limit(10).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in first]}")
