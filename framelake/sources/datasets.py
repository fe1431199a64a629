"""Episode datasets on any file system that Spark reads: metadata, frames, tasks, source maps, and writing a selection back."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import pose
from framelake.operators import series
from framelake.sources import publish

EPISODE_FILE = r"episode_(\d+)\.parquet$"


@dataclass(frozen=True)
class Profile:
    """How a vector column gives left and right positions: ordinals, signs and offsets of three numbers for each arm, and a tool offset."""

    vector: str
    indices: tuple[int, ...]
    direction: tuple[int, ...] = (1,) * 6
    offset: tuple[float, ...] = (0.0,) * 6
    tool: tuple[float, ...] = (0.0,) * 6
    quaternions: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if not all(len(x) == 6 for x in (self.indices, self.direction, self.offset, self.tool)):
            raise ValueError("a profile names six numbers of each kind")
        if any(d not in (-1, 1) for d in self.direction) or any(i < 0 for i in self.indices):
            raise ValueError("directions are -1 or 1, indices not negative")
        if any(self.tool) and (self.quaternions is None or len(self.quaternions) != 8):
            raise ValueError("a tool offset needs eight quaternion ordinals, x, y, z, w of each arm")

    def single_arm(self) -> bool:
        """Whether both arms read the same numbers."""
        return self.indices[:3] == self.indices[3:] and self.direction[:3] == self.direction[3:] and self.offset[:3] == self.offset[3:]

    def positions(self) -> dict[str, Column]:
        """Columns lx, ly, lz, rx, ry, rz: tool offset first, then sign, then offset."""
        out = {}
        for arm, at in (("l", 0), ("r", 3)):
            xyz = pose.components(f"`{self.vector}`", list(self.indices[at : at + 3]))
            if any(self.tool[at : at + 3]):
                q = self.quaternions[:4] if arm == "l" else self.quaternions[4:]
                xyz = pose.tool_offset(xyz, pose.components(f"`{self.vector}`", list(q)), list(self.tool[at : at + 3]))
            out |= {arm + n: x for n, x in zip("xyz", pose.affine(xyz, list(self.direction[at : at + 3]), list(self.offset[at : at + 3])), strict=True)}
        return out


# How a quaternion's four components may be named after the common beginning of its position's x, y and z.
QUATERNION_NAMES = (("qx", "qy", "qz", "qw"), ("quat_x", "quat_y", "quat_z", "quat_w"), ("i", "j", "k", "w"), ("wx", "wy", "wz", "w"))
# Places of x, y, z, w after a position's first component in the known layouts without names, by width.
LAYOUTS = {14: (4, 5, 6, 3), 16: (3, 4, 5, 6)}


def quaternion_ordinals(names: list[str], width: int, positions: list[int]) -> list[int]:
    """Ordinals of x, y, z, w of the quaternion that belongs to the position at the ordinals ``positions``.

    With ``width`` names the position's three names must share a beginning and end in x, y and z, and exactly one component of each of the four
    names must follow one of :data:`QUATERNION_NAMES` on that beginning (or on it without ``pos_``, before ``quat_``). Without names, vectors
    of 14 have w first and vectors of 16 last, after a position that begins each half. Anything else is an error: no layout is guessed.
    """
    if names:
        xyz = [names[i] for i in positions] if len(names) == width and all(i < width for i in positions) else []
        stem = xyz[0][:-1] if xyz and [n[-1:] for n in xyz] == ["x", "y", "z"] and len({n[:-1] for n in xyz}) == 1 else None
        if stem is not None:
            tries = [(stem, c) for c in QUATERNION_NAMES] + [(stem.removesuffix("pos_"), QUATERNION_NAMES[1])] * stem.endswith("pos_")
            for start, ends in tries:
                if all(names.count(start + e) == 1 for e in ends):
                    return [names.index(start + e) for e in ends]
        raise ValueError("no quaternion is named after the position")
    first = positions[0]
    if width in LAYOUTS and list(positions) == [first, first + 1, first + 2] and first in (0, width // 2):
        return [first + i for i in LAYOUTS[width]]
    raise ValueError("the quaternion's place is unknown")


def named_groups(state: list[str], action: list[str], arms: tuple[str, ...] = ("left", "right"), joints: int | None = None) -> dict[str, list[tuple[str, int]]]:
    """Components of a state and an action vector by what their names say: (vector, ordinal) of each arm's joints, of all ``joints``, of the ``other`` ones, of ``base`` commands and of ``still`` parts.

    An arm's joints are the state's components that begin with its name and don't speak of a gripper, and the action's of the same names; ``joints``
    asks for their number in the state. Base commands begin with cmd_vel_; still parts are head and waist. Concatenate them with :func:`picked`.
    """
    own = {arm: [i for i, n in enumerate(state) if n.startswith(f"{arm}_") and "gripper" not in n] for arm in arms}
    if joints is not None and any(len(x) != joints for x in own.values()):
        raise ValueError(f"each arm has {joints} joints")
    known = {state[i] for x in own.values() for i in x}
    out = {arm: [("state", i) for i in x] + [("action", i) for i, n in enumerate(action) if n in known and n.startswith(f"{arm}_")] for arm, x in own.items()}
    out["joints"] = [("state", i) for x in own.values() for i in x] + [("action", i) for i, n in enumerate(action) if n in known]
    out["other"] = [(v, i) for v, names in (("state", state), ("action", action)) for i, n in enumerate(names) if n not in known]
    out["base"] = [("action", i) for i, n in enumerate(action) if n.startswith("cmd_vel_")]
    out["still"] = [("state", i) for i, n in enumerate(state) if "head" in n or "waist" in n]
    return out


def picked(group: list[tuple[str, int]], vectors: dict[str, str | Column]) -> Column:
    """One array of doubles of the components of a group, from the columns of the vectors it names; null beyond a vector's end."""
    return F.array(*(F.get(vectors[v], F.lit(i)).cast("double") for v, i in group)) if group else F.array().cast("array<double>")


def same_name(name: str, among: list[str]) -> str | None:
    """The one of ``among`` that is ``name`` but for upper and lower case, none if there is none; more than one is an error."""
    found = [n for n in among if n.casefold() == name.casefold()]
    if len(found) > 1:
        raise ValueError(f"{name}: {found} differ in case only")
    return found[0] if found else None


def video_features(info: dict, probes: DataFrame) -> dict:
    """``info`` with the shape and format of each video feature as its files have them: probes are (video_key, height, width, codec, pix_fmt, rate), a row a file.

    Files of one feature must agree; one row a feature comes to the driver.
    """
    kinds = ("height", "width", "codec", "pix_fmt", "rate")
    told = probes.groupBy("video_key").agg(F.count_distinct("height", "width").alias("sizes"), *(F.min(c).alias(c) for c in kinds)).collect()  # a row a feature
    features = {k: dict(v) for k, v in info.get("features", {}).items()}
    for r in told:
        if r["sizes"] != 1:
            raise ValueError(f"{r['video_key']}: videos of several sizes")
        own = features[r["video_key"]]
        own |= {"shape": [3, r["height"], r["width"]], "names": ["channels", "height", "width"]}
        own["info"] = {**own.get("info", {}), "video.height": r["height"], "video.width": r["width"], "video.codec": r["codec"], "video.pix_fmt": r["pix_fmt"], "video.fps": r["rate"], "video.channels": 3, "has_audio": False}
    return {**info, "features": features}


def catalogue(text: str) -> dict[str, Profile]:
    """Profiles by name from YAML or JSON, {name: {vector, indices, direction, offset, tool, quaternions}}; the first is the default. Unknown keys are errors."""
    try:
        parsed = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        parsed = yaml.safe_load(text)
    return {name: Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()}) for name, fields in parsed.items()}


@dataclass
class Dataset:
    """A dataset's root with its declared metadata."""

    spark: SparkSession
    root: str
    info: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        """Reads meta/info.json by Spark; frames per second must be positive."""
        text = "\n".join(r[0] for r in spark.read.text(f"{root}/meta/info.json", wholetext=True).collect())
        info = json.loads(text)
        if not isinstance(info.get("fps"), (int, float)) or info["fps"] <= 0:
            raise ValueError(f"{root}: fps must be a positive number")
        return cls(spark, root, info)

    @property
    def fps(self) -> float:
        return float(self.info["fps"])

    def names(self, feature: str) -> list[str]:
        """Component names of a feature as a flat list; empty if none are declared."""
        names = self.info["features"][feature].get("names") or []
        return list(names[0]) if names and isinstance(names[0], list) else list(names)

    def ordinals(self, feature: str, names: list[str]) -> list[int]:
        """Ordinals of named components."""
        known = self.names(feature)
        if missing := [n for n in names if n not in known]:
            raise KeyError(f"{feature} has no {missing}")
        return [known.index(n) for n in names]

    def data_path(self, episode: int) -> str:
        """The file of an episode by the declared template."""
        chunk = episode // int(self.info.get("chunks_size", 1000))
        template = self.info.get("data_path", DATA_PATH)
        return f"{self.root}/{template.format(episode_chunk=chunk, episode_index=episode)}"

    def video_path(self, episode: int, key: str) -> str:
        """The file of an episode's video by the declared template."""
        template = self.info.get("video_path") or "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
        return f"{self.root}/{template.format(episode_chunk=episode // int(self.info.get('chunks_size', 1000)), episode_index=episode, video_key=key)}"

    def find(self, episode: int) -> str:
        """The file of an episode where ``chunks_size`` isn't declared: the only one of its name in any chunk; none or several are errors."""
        if "chunks_size" in self.info:
            return self.data_path(episode)
        found = publish.matching(self.spark, f"{self.root}/data/chunk-*/episode_{episode:06d}.parquet")
        if len(found) != 1:
            raise FileNotFoundError(f"{self.root}: {len(found)} files of episode {episode}")
        return found[0]

    def frames(self, episodes: list[int] | None = None) -> DataFrame:
        """Rows of all or some episodes; named episodes are read by their paths, so no other file is opened."""
        paths = [self.find(e) for e in episodes] if episodes else [f"{self.root}/data"]
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)

    def tasks(self) -> DataFrame:
        """(task_index, task)."""
        return self.spark.read.schema("task_index long, task string").json(f"{self.root}/meta/tasks.jsonl", mode="FAILFAST")

    def episodes(self) -> DataFrame:
        """(episode_index, tasks, length)."""
        return self.spark.read.schema("episode_index long, tasks array<string>, length long").json(f"{self.root}/meta/episodes.jsonl", mode="FAILFAST")

    def source_map(self, episode: int | None = None) -> DataFrame:
        """Rows of source_frame_map.csv, of one episode if given."""
        rows = self.spark.read.csv(f"{self.root}/source_frame_map.csv", header=True, inferSchema=True, mode="FAILFAST", escape='"')
        return rows if episode is None or "episode_index" not in rows.columns else rows.where(F.col("episode_index") == episode)


def misplaced(frames: DataFrame) -> DataFrame:
    """Files that hold more than one episode, or one other than their name says."""
    named = frames.withColumn("file", F.col("_metadata.file_path"))
    seen = named.groupBy("file").agg(F.count_distinct("episode_index").alias("episodes"), F.first("episode_index").alias("episode_index"))
    return seen.where((F.col("episodes") > 1) | (F.regexp_extract("file", EPISODE_FILE, 1).cast("long") != F.col("episode_index")))


def episode_view(frames: DataFrame, profile: Profile, fps: float) -> DataFrame:
    """Per frame: positions of both tools and their speeds, null at the first frame."""
    posed = frames.select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("frame"), *(x.alias(n) for n, x in profile.positions().items()))
    arms = {f"{a}_speed": series.speed([F.col(f"{a}{n}") for n in "xyz"], fps) for a in "lr"}
    return posed.withColumns(arms)


def sliced(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows of multi-episode files with their episode, by declared bounds (episode_index, dataset_from_index, length) on the row's index.

    Rows and bounds meet by bins of the index: an episode is dealt to the few bins that it touches, not to a row an index.
    """
    own = episodes.select("episode_index", F.col("dataset_from_index").alias("from_"), (F.col("dataset_from_index") + F.col("length") - 1).alias("last_"))
    return series.bin_join(frames.drop("episode_index"), own, [], "index", "from_", "last_", 4096).drop("from_", "last_")


def rebuilt(frames: DataFrame, selection: DataFrame, fps: float) -> DataFrame:
    """Selected frames (episode_index, frame_index) renumbered from 0: episodes, frames, the dataset's index and timestamps, with their source."""
    kept = frames.join(selection.select("episode_index", "frame_index").distinct(), ["episode_index", "frame_index"], "left_semi")
    lengths = series.with_offsets(kept.groupBy(F.col("episode_index").alias("episode")).agg(F.count("*").alias("length")))
    place = F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1
    joined = kept.withColumn("place", place.cast("long")).join(lengths, F.col("episode_index") == F.col("episode"))
    renamed = joined.withColumns({"source_episode": F.col("episode_index"), "source_frame": F.col("frame_index"), "episode_index": F.col("output_episode"), "frame_index": F.col("place"), "index": F.col("offset") + F.col("place"), "timestamp": (F.col("place") / fps).cast("float")})
    return renamed.select(*frames.columns, "source_episode", "source_frame")


DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"


def written(frames: DataFrame, root: str, chunks_size: int = 1000, template: str = DATA_PATH) -> None:
    """One Parquet file an episode under ``root`` by the declared path ``template``; refuses existing files.

    Spark writes all episodes side by side into a staging folder, each by one task; then files get their names, which is all the driver does.
    """
    spark, staging = frames.sparkSession, f"{root}/.staging-{uuid.uuid4().hex}"
    keyed = frames.withColumn("episode", F.col("episode_index"))
    keyed.repartition("episode").sortWithinPartitions("episode", "frame_index").write.partitionBy("episode").parquet(staging)
    try:
        found = spark.read.parquet(staging).select("episode", F.col("_metadata.file_path").alias("file")).distinct().toLocalIterator()  # a name an episode
        publish.renamed(spark, [(r["file"], f"{root}/{template.format(episode_chunk=r['episode'] // chunks_size, episode_index=r['episode'])}") for r in found])
    finally:
        publish.removed(spark, staging)


def write_table(rows: DataFrame, path: str, *order: str) -> None:
    """A CSV table with a header, as a folder of parts in order of the named columns; an existing one is an error."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("error").option("header", "true").csv(path)


def write_source_map(frames: DataFrame, root: str, source_index: str | None = None) -> None:
    """source_frame_map.csv of :func:`rebuilt` frames: output and source frames of each episode, their dataset indices where named, and the phase if there is one."""
    more = [F.col("index").alias("output_index"), F.col(source_index).alias("source_index")] if source_index else []
    phase = ["phase"] if "phase" in frames.columns else []
    rows = frames.select("episode_index", "source_episode", F.col("frame_index").alias("output_frame"), "source_frame", *more, *phase)
    write_table(rows, f"{root}/source_frame_map.csv", "episode_index", "output_frame")


def deletion_log(frames: DataFrame, selection: DataFrame, reasons: DataFrame) -> DataFrame:
    """Per source frame: kept, and the sorted reasons (episode_index, frame_index, reason) of the others, with ``frames``' columns phase and protection if they have them."""
    told = reasons.groupBy("episode_index", "frame_index").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reason"))
    more = [c for c in ("phase", "protection") if c in frames.columns]
    marked = frames.select("episode_index", "frame_index", *more).join(selection.select("episode_index", "frame_index", F.lit(True).alias("kept")).distinct(), ["episode_index", "frame_index"], "left").join(told, ["episode_index", "frame_index"], "left")
    return marked.select("episode_index", "frame_index", F.coalesce("kept", F.lit(False)).alias("kept"), F.when(F.col("kept"), "kept").otherwise(F.col("reason")).alias("reason"), *more)


def write_deletions(log: DataFrame, root: str) -> None:
    """deletion_reasons.csv of :func:`deletion_log`."""
    write_table(log.withColumnRenamed("frame_index", "source_frame"), f"{root}/deletion_reasons.csv", "episode_index", "source_frame")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def byte_range(header: str, size: int) -> tuple[int, int] | None:
    """First and last byte of a single range header; none if it can't be met."""
    found = re.fullmatch(r"bytes=(\d*)-(\d*)", header)
    if not found or not (found[1] or found[2]) or not size:
        return None
    if not found[1]:
        return (max(size - int(found[2]), 0), size - 1) if int(found[2]) else None
    first, last = int(found[1]), min(int(found[2]) if found[2] else size - 1, size - 1)
    return (first, last) if first <= last else None
