"""Which frames may be left out between two kept ones, and why not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import pose
from framelake.operators import series

#: Reasons in the order in which they are found.
REASONS = ("phase", "step", "rotation", "deviation")


@dataclass(frozen=True)
class Path:
    """Columns of a path's position, and of the degrees by which it has turned since the previous frame."""

    position: tuple[str, str, str]
    turned: str | None = None


def skip_check(frames: DataFrame, edges: DataFrame, paths: list[Path], max_step: float, max_rotation: float, deviation: float, phase: str | None = None) -> DataFrame:
    """(episode, i, j, reason) of edges (episode, i, j): why frame j may not follow frame i; null if it may.

    The first of these that fails on any path is told: both frames are of one ``phase``, if that is named; the step is within ``max_step``; the
    rotation of all frames on the way together is within ``max_rotation``, by prefix sums; no frame on the way is further than ``deviation`` from the
    segment between the two. Only edges that pass the others are joined with the frames on their way. The next frame may always follow.
    Edges to frames that don't exist have no row; null positions or rotations don't fail.
    """
    columns = [c for p in paths for c in p.position]
    sums = [F.sum(F.coalesce(F.col(p.turned), F.lit(0.0))).over(series.so_far()).alias(f"turned_{k}") if p.turned else F.lit(0.0).alias(f"turned_{k}") for k, p in enumerate(paths)]
    told = frames.select("episode", "frame", *columns, *sums, (F.col(phase) if phase else F.lit(0)).alias("phase_"))
    names = told.columns[2:]

    def end(at: str) -> DataFrame:
        return told.select("episode", F.col("frame").alias(at), *(F.col(c).alias(f"{at}_{c}") for c in names))

    both = edges.select("episode", "i", "j").distinct().join(end("i"), ["episode", "i"]).join(end("j"), ["episode", "j"])
    ends = [([F.col(f"i_{c}") for c in p.position], [F.col(f"j_{c}") for c in p.position]) for p in paths]
    step = F.greatest(*(pose.norm(pose.minus(b, a)) for a, b in ends), F.lit(0.0)) > max_step + 1e-9
    turn = F.greatest(*(F.col(f"j_turned_{k}") - F.col(f"i_turned_{k}") for k in range(len(paths))), F.lit(0.0)) > max_rotation
    early = F.when(F.col("j") <= F.col("i") + 1, None).when(~F.col("i_phase_").eqNullSafe(F.col("j_phase_")), "phase").when(step, "step").when(turn, "rotation")
    both = both.withColumn("early", early)
    way = both.where("early is null and j > i + 1").withColumn("frame", F.explode(F.sequence(F.col("i") + 1, F.col("j") - 1)))
    far = F.greatest(*(pose.segment_distance([F.col(c) for c in p.position], a, b) for p, (a, b) in zip(paths, ends, strict=True)), F.lit(0.0))
    off = way.join(told.select("episode", "frame", *columns), ["episode", "frame"]).groupBy("episode", "i", "j").agg(F.max(far).alias("far")).where(F.col("far") > deviation + 1e-9)
    return both.select("episode", "i", "j", "early").join(off, ["episode", "i", "j"], "left").select("episode", "i", "j", F.coalesce("early", F.when(F.col("far").isNotNull(), "deviation")).alias("reason"))


def band_edges(frames: DataFrame, gap: int, least: int = 2) -> DataFrame:
    """(episode, i, j) of frames ``least`` to ``gap`` apart."""
    return frames.select("episode", F.col("frame").alias("i"), F.explode(F.sequence(F.col("frame") + least, F.col("frame") + gap)).alias("j")) if gap >= least else frames.select("episode", F.col("frame").alias("i"), F.col("frame").alias("j")).limit(0)


def rejections(checked: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, reason, n): how many edges of :func:`skip_check` each reason refused, each edge by its first one; the sums are the refused edges."""
    return checked.where("reason is not null").groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def selected_edges(chosen: DataFrame) -> DataFrame:
    """(episode, i, j): each chosen frame and the next one, where frames are left out between them."""
    order = Window.partitionBy("episode").orderBy("frame")
    pairs = chosen.select("episode", "frame").distinct().select("episode", F.col("frame").alias("i"), F.lead("frame").over(order).alias("j"))
    return pairs.where("j > i + 1")


def illegal_skips(frames: DataFrame, chosen: DataFrame, paths: list[Path], max_step: float, max_rotation: float, deviation: float, phase: str | None = None) -> DataFrame:
    """(episode, i, j, reason) of the skips of a selection (episode, frame) that aren't allowed: a row a breach."""
    return skip_check(frames, selected_edges(chosen), paths, max_step, max_rotation, deviation, phase).where("reason is not null")
