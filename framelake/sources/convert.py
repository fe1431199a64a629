"""Multi-file layouts: reading their metadata, cutting episodes out, re-layout into one directory an episode, and metadata of the result."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.operators import series, stats
from framelake.plans import checks
from framelake.sources import publish


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    """(task_index, task) of meta/tasks.parquet, where the task may be stored as an unnamed index."""
    rows = spark.read.parquet(f"{root}/meta/tasks.parquet")
    text = "task" if "task" in rows.columns else "__index_level_0__"
    return rows.select(F.col("task_index").cast("long").alias("task_index"), F.col(text).alias("task"))


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all meta/episodes files: episode_index, length, dataset_from_index, dataset_to_index, tasks, and video and statistics columns as they are."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")


def episode_breaches(episodes: DataFrame) -> DataFrame:
    """(episode_index, reason) where numbers aren't dense from 0, a length isn't positive, or bounds don't follow each other."""
    seen = series.numbered(episodes.select("episode_index", "length", "dataset_from_index", "dataset_to_index"), "episode_index", "place", "length", "begin")
    fits = (F.col("dataset_from_index") == F.col("begin")) & (F.col("dataset_to_index") == F.col("begin") + F.col("length"))
    reason = F.when(F.col("episode_index") != F.col("place"), "number").when(F.coalesce(F.col("length"), F.lit(0)) <= 0, "length").when(~F.coalesce(fits, F.lit(False)), "bounds")
    return seen.select("episode_index", reason.alias("reason")).where("reason is not null")


def chosen(episodes: DataFrame, wanted: list[int] | None) -> DataFrame:
    """Named episodes (all if none are named) with new_index, dense from 0; raises for unknown ones."""
    if wanted is not None:
        asked = episodes.sparkSession.createDataFrame([(e,) for e in wanted], "episode_index long")
        checks.require_valid(asked.join(episodes, "episode_index", "left_anti"), "unknown episodes")
        episodes = episodes.join(F.broadcast(asked.distinct()), "episode_index", "left_semi")  # as many rows as the caller listed
    return series.numbered(episodes, "episode_index", "new_index")


def relaid(frames: DataFrame, episodes: DataFrame, fps: float) -> DataFrame:
    """Rows of chosen episodes with new episode_index, frame_index, index and timestamp; other columns untouched, types kept.

    Episodes are met by their number, so that a row needs no join on its index; :func:`gaps` tells rows that the bounds don't agree with.
    """
    own = series.numbered(episodes, "new_index", "_place", "length", "_begin").select("episode_index", F.col("new_index").alias("_new"), "_begin")
    types = {f.name: f.dataType for f in frames.schema}
    new = {"episode_index": F.col("_new"), "index": F.col("_begin") + F.col("frame_index"), "timestamp": F.col("frame_index") / fps}
    joined = frames.join(own, "episode_index").withColumns({c: x.cast(types[c]) for c, x in new.items() if c in types})
    return joined.select(frames.columns)


def gaps(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_index, reason) of episodes whose rows aren't exactly the declared bounds on index, in step with frame_index."""
    seen = frames.groupBy("episode_index").agg(F.count("*").alias("n"), F.count_distinct("index").alias("different"), F.min("index").alias("low"), F.max("index").alias("high"), F.every(F.col("index") - F.col("frame_index") >= 0).alias("sound"), F.min(F.col("index") - F.col("frame_index")).alias("least"), F.max(F.col("index") - F.col("frame_index")).alias("most"))
    told = episodes.select("episode_index", "length", "dataset_from_index").join(seen, "episode_index", "left")
    good = (F.col("n") == F.col("length")) & (F.col("different") == F.col("length")) & (F.col("low") == F.col("dataset_from_index")) & (F.col("high") == F.col("dataset_from_index") + F.col("length") - 1) & (F.col("least") == F.col("low")) & (F.col("most") == F.col("low"))
    return told.where(~F.coalesce(good, F.lit(False))).select("episode_index", F.lit("rows").alias("reason"))


def feature_stats(frames: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, min, max, mean, std arrays by component, count array) of numeric columns; a scalar is a vector of one. One pass over the rows."""
    kinds = dict(frames.dtypes)
    vectors = [F.col(c) if kinds[c].startswith("array") else F.array(c) for c in features]
    long = frames.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), v.cast("array<double>").alias("v")) for c, v in zip(features, vectors, strict=True)))).alias("f")).select(*keys, "f.feature", "f.v")
    told = stats.vector_stats(long, "v", [*keys, "feature"])
    ordered = told.groupBy(*keys, "feature").agg(F.array_sort(F.collect_list(F.struct("pos", "min", "max", "mean", "std", "count"))).alias("all"))  # a vector's width at most
    return ordered.select(*keys, "feature", *(F.col(f"all.{n}").alias(n) for n in ("min", "max", "mean", "std")), F.array(F.col("all")[0]["count"]).alias("count"))


def visual_stats(episodes: DataFrame, key: str) -> DataFrame:
    """(episode_index, min, max, mean, std, count) of a video feature as declared in columns stats/<key>/..."""
    names = ("min", "max", "mean", "std", "count")
    return episodes.select("episode_index", *(F.col(f"`stats/{key}/{n}`").alias(n) for n in names))


def visual_breaches(told: DataFrame, channels: int = 3) -> DataFrame:
    """Episodes whose visual statistics aren't ``channels`` x 1 x 1, or hold a negative or undefined number as std."""
    shape = F.lit(True)
    for n in ("min", "max", "mean", "std"):
        shape = shape & (F.size(n) == channels) & F.forall(n, lambda x: (F.size(x) == 1) & (F.size(x[0]) == 1))
    sound = F.forall("std", lambda x: (x[0][0] >= 0) & ~F.isnan(x[0][0]))
    return told.where(~F.coalesce(shape & sound, F.lit(False))).select("episode_index", F.lit("visual statistics").alias("reason"))


#: Seconds of a video that meet in one task when packets are dealt to slices.
SLICE_BIN = 16.0


def slice_breaches(packets: DataFrame, slices: DataFrame, fps: float, rates: DataFrame | None = None, tolerance: float = 1e-5) -> DataFrame:
    """(video, episode_index, reason) of episodes that can't be cut from a video without decoding.

    Packets are (video, packet, pts, dts, key), numbered without gaps; slices (video, episode_index, from_timestamp, to_timestamp, length); rates (video, rate), if given.
    The whole video's times must rise, and the slice's time times fps must be its length. It takes the packets from its first timestamp on, one at
    each frame's own time; the first must be a key frame, each shown when it is decoded, and the video's rate the dataset's. Anything null is a
    breach. Slices of one episode that differ are told one by one.

    Packets and slices meet by bins of time, so a packet is compared with the slices near it and no video's packets meet in one task; a packet's
    predecessor is found by its number.
    """
    no, one = F.lit(False), ["video", "episode_index", "from_timestamp", "to_timestamp", "length"]
    slices = slices.select(*one).distinct()
    before = packets.select("video", (F.col("packet") + 1).alias("packet"), F.col("pts").alias("before"), F.lit(True).alias("later"))
    rises = F.coalesce(F.col("later").isNull() & F.col("pts").isNotNull() | (F.col("pts") > F.col("before")), no)
    rising = packets.join(before, ["video", "packet"], "left").groupBy("video").agg(F.every(rises).alias("rises"))
    first = F.col("from_timestamp")
    bounds = slices.withColumns({"low_": first - tolerance, "high_": first + (F.col("length") - 0.5) / fps})
    rows = series.bin_join(packets.select("video", "pts", "dts", "key"), bounds, ["video"], "pts", "low_", "high_", SLICE_BIN).where("pts < high_")
    place = F.row_number().over(Window.partitionBy(*one).orderBy("pts")) - 1
    rows = rows.withColumn("placed", F.abs(F.col("pts") - first - place / fps) <= tolerance).withColumn("ordered", F.abs(F.coalesce("dts", "pts") - F.col("pts")) < tolerance)
    every = lambda c: F.every(F.coalesce(c, no)).alias(c)
    met = rows.groupBy(*one).agg(F.count("pts").alias("n"), every("placed"), every("ordered"), F.min_by("key", "pts").alias("key"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in one]
    seen = slices.alias("s").join(met.alias("m"), same[0] & same[1] & same[2] & same[3] & same[4], "left").select("s.*", F.coalesce("n", F.lit(0)).alias("n"), "placed", "ordered", "key").join(rising, "video", "left")
    spans = (F.abs((F.col("to_timestamp") - first) * fps - F.col("length")) < 1e-4) & (first >= 0)
    reason = F.when(~F.col("n").eqNullSafe(F.col("length")), "packets").when(~F.coalesce(spans, no), "duration").when(~F.coalesce("rises", no), "times").when(~F.coalesce("ordered", no), "order").when(~F.coalesce("placed", no), "alignment").when(~F.coalesce("key", no), "key frame")
    if rates is not None:
        seen = seen.join(rates.select("video", (F.abs(F.col("rate") - fps) < 1e-6).alias("rated")), "video", "left")
        reason = reason.when(~F.coalesce("rated", no), "frame rate")
    return seen.select("video", "episode_index", reason.alias("reason")).where("reason is not null")


def rekeyed(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows keyed by source_episode under the episodes' new numbers; rows of other episodes go."""
    own = episodes.select(F.col("source_episode"), F.col("episode_index"))
    return rows.drop("episode_index").join(own, "source_episode")


def trusted_map(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Map rows (source_episode, sha256, source_frame) whose source has the same digest and that many frames (source_episode, sha256, n_frames)."""
    return entries.join(sources, ["source_episode", "sha256"]).where((F.col("source_frame") >= 0) & (F.col("source_frame") < F.col("n_frames"))).select(entries.columns)


def same_rows(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys for which two tables differ in any of ``columns`` (all common ones), or that only one has; null equals null."""
    columns = columns or [c for c in a.columns if c in b.columns and c not in keys]

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(name))

    both = digest(a, "a").join(digest(b, "b"), keys, "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def differing_schemas(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths of files or folders whose columns aren't the first one's; footers are read by tasks (:func:`publish.footers`), and a broken file is an error that names it."""
    told = publish.footers(spark, paths)
    if broken := told.where("error is not null").orderBy("file").select("file", "error").head():
        raise ValueError(f"{broken['file']}: {broken['error']}")
    kinds = told.groupBy("path").agg(F.array_sort(F.collect_set("schema")).alias("kinds"))
    first = kinds.where(F.col("path") == paths[0]).select(F.col("kinds").alias("first"))
    other = kinds.join(first, F.col("kinds") != F.col("first")).select("path").toLocalIterator()  # a name a differing path
    differing = {r["path"] for r in other}
    return [p for p in paths if p in differing]


def file_groups(episodes: DataFrame) -> DataFrame:
    """(file, n, episodes): episodes grouped by the data file that holds them, so that each file is read once; the sorted numbers of one file's episodes."""
    file = F.format_string("data/chunk-%03d/file-%03d.parquet", F.col("`data/chunk_index`"), F.col("`data/file_index`"))
    return episodes.groupBy(file.alias("file")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("episode_index")).alias("episodes"))


def info_of(frames: DataFrame, tasks: DataFrame, info: dict, chunks_size: int = 1000) -> dict:
    """A dataset's info with totals, splits and paths of ``frames``; three numbers come to the driver."""
    n, episodes = frames.agg(F.count("*"), F.count_distinct("episode_index")).first()
    videos = sum(f.get("dtype") == "video" for f in info.get("features", {}).values())
    return {**info, "codebase_version": "v2.1", "total_episodes": episodes, "total_frames": n, "total_tasks": tasks.count(), "total_videos": episodes * videos, "total_chunks": -(-episodes // chunks_size), "chunks_size": chunks_size, "splits": {"train": f"0:{episodes}"}, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"}


def write_metadata(root: str, info: dict, episodes: DataFrame, tasks: DataFrame, episode_stats: DataFrame) -> None:
    """meta/info.json, and meta/episodes.jsonl, tasks.jsonl and episodes_stats.jsonl in order, written by Spark to any file system; existing ones are errors.

    The format wants each as one file, so one task writes it, sorted: a row an episode, never a row a frame.
    """
    spark = episodes.sparkSession
    text = spark.createDataFrame([(json.dumps(info, allow_nan=False, sort_keys=True),)], "value string")
    publish.single_file(text.coalesce(1).write.text, f"{root}/meta/info.json", spark)
    for name, rows, key in (("episodes", episodes, "episode_index"), ("tasks", tasks, "task_index"), ("episodes_stats", episode_stats, "episode_index")):
        publish.single_file(rows.coalesce(1).sortWithinPartitions(key).write.json, f"{root}/meta/{name}.jsonl", spark)


def inferred_fps(frames: DataFrame) -> DataFrame:
    """(episode_index, fps): steps over the time they take, made whole if within 1e-4; null for episodes of one frame."""
    took: Column = F.max_by("timestamp", "frame_index") - F.min_by("timestamp", "frame_index")
    raw = frames.groupBy("episode_index").agg(F.try_divide(F.count("*") - 1, took.cast("double")).alias("fps"))
    return raw.withColumn("fps", F.when(F.abs(F.col("fps") - F.rint("fps")) < 1e-4, F.rint("fps")).otherwise(F.col("fps")))


def with_task_set(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """(episode_index, tasks): the sorted texts of the tasks that each episode's frames name."""
    used = frames.select("episode_index", "task_index").distinct().join(tasks, "task_index")
    return used.groupBy("episode_index").agg(F.array_sort(F.collect_set("task")).alias("tasks"))


def task_set_breaches(episodes: DataFrame, frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Episodes whose declared tasks aren't those of their frames."""
    found = with_task_set(frames, tasks).withColumnRenamed("tasks", "found")
    joined = episodes.select("episode_index", F.array_sort(F.array_distinct("tasks")).alias("tasks")).join(found, "episode_index", "left")
    return joined.where(~F.col("tasks").eqNullSafe(F.col("found"))).select("episode_index", F.lit("tasks").alias("reason"))
