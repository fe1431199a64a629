"""Single-arm episodes: gripper events, phases, lift apex, idle report and phase report.

Detection is DataFrame windows over one partitioning by episode, so all of it shares one exchange.
Frames are rows (episode, frame, state, action[, translation_limited, rotation_limited]): positions are components 0-2, a six-number rotation
3-8, the gripper 9.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import pose
from framelake.operators import series

#: Phases whose frames may be left out: approach, carry and retreat.
FAST = (0, 2, 4)


# The defaults.
@dataclass(frozen=True)
class Rules:
    """Limits of detection and selection in metres, degrees and seconds; all positive."""

    target_speed: float = 0.1
    speed_tolerance: float = 0.02
    max_step: float = 0.015
    max_rotation: float = 5.0
    deviation: float = 0.01
    skip_s: float = 3.0
    padding_s: float = 0.3
    contact_radius: float = 0.01
    closed: float = 0.8
    open: float = 0.9
    active_gripper: float = 0.005
    static_speed: float = 0.005
    static_rotation: float = 2.0
    static_range: float = 0.003
    static_angle: float = 2.0
    hold_s: float = 1.0
    turning: float = 8.0
    rise: float = 0.01

    def __post_init__(self) -> None:
        if not all(math.isfinite(x) and x > 0 for x in vars(self).values()):
            raise ValueError("rules are positive numbers")
        if self.closed >= self.open:
            raise ValueError("the gripper closes below the value at which it opens")


def _all() -> Window:
    return Window.partitionBy("episode")


def gripper_events(frames: DataFrame, rules: Rules, fps: float, state: Column, action: Column) -> DataFrame:
    """``frames`` with n, certain, and of the close and the open event: trigger (c, o), first and last frame (c0, c1, o0, o1).

    An episode is certain if the gripper closes once and then opens once. An event begins and ends where neither the gripper's state nor its
    command moves beside the trigger, with padding on both sides. Episodes that aren't certain have null events.
    """
    mode = series.hysteresis(state, rules.closed, rules.open)
    moves = (F.abs(state - F.lag(state).over(series.ep())) > rules.active_gripper) | (F.abs(action - F.lag(action).over(series.ep())) > rules.active_gripper)
    out = frames.withColumn("mode", mode).withColumn("moves", F.coalesce(moves, F.lit(False)))
    out = out.withColumn("turns", F.col("mode") != F.lag("mode", 1, "o").over(series.ep())).withColumn("moves_on", F.coalesce(F.lead("moves").over(series.ep()), F.lit(False)))
    first = [F.min(F.when(F.col("turns") & (F.col("mode") == m), F.col("frame"))).over(_all()) for m in "co"]
    out = out.withColumns({"n": F.count(F.lit(1)).over(_all()), "certain": F.count_if("turns").over(_all()) == 2, "c": first[0], "o": first[1]})
    # hysteresis starts open, so two turns are a close and an open
    pad = round(rules.padding_s * fps)
    for e in "co":
        trigger = F.when(F.col("certain"), F.col(e))
        low = F.max(F.when((F.col("frame") <= F.greatest(trigger - 1, F.lit(0))) & ~F.col("moves"), F.col("frame"))).over(_all())
        high = F.min(F.when((F.col("frame") >= F.least(trigger + 1, F.col("n") - 1)) & ~F.col("moves_on"), F.col("frame"))).over(_all())
        out = out.withColumns({e: trigger, f"{e}0": F.when(trigger.isNotNull(), F.greatest(low - pad, F.lit(0))), f"{e}1": F.when(trigger.isNotNull(), F.least(high + pad, F.col("n") - 1))})
    return out.drop("mode", "moves", "turns", "moves_on")


def apex(frames: DataFrame, rules: Rules, z: Column, action_z: Column, first: Column, last: Column) -> DataFrame:
    """``frames`` with apex: the first frame in [first, last] within the tolerance of the highest smoothed height; null if the rise is too small."""
    inside = (F.col("frame") >= first) & (F.col("frame") <= last) & (last > first)
    out = frames.withColumn("height", 0.7 * series.moving_mean(z, 5) + 0.3 * series.moving_mean(action_z, 5))
    here = F.when(inside, F.col("height"))
    base = F.median(F.when(F.col("frame") < first + 5, here)).over(_all())
    out = out.withColumns({"top": F.max(here).over(_all()), "rise": F.max(here).over(_all()) - base})
    near = F.greatest(F.lit(0.002), F.least(F.lit(0.005), F.col("rise") * 0.1))
    cut = F.min(F.when(inside & (F.col("height") >= F.col("top") - near), F.col("frame"))).over(_all())
    return out.withColumn("apex", F.when(F.col("rise") >= rules.rise, cut)).drop("height", "top", "rise")


def _basis_columns(vector: str) -> list[list[Column]]:
    return pose.rotation_basis(pose.components(vector, list(range(3, 9))))


def annotated(frames: DataFrame, rules: Rules = Rules(), fps: float = 10.0) -> DataFrame:
    """``frames`` with phase (0 approach, 1 grasp, 2 carry, 3 release, 4 retreat), apex, last (the last frame that counts), protection (sorted reasons), turned and action_turned (degrees from the previous frame).

    An episode whose gripper doesn't close once and open once is phase 2, protected whole.
    """
    grip, command = F.get("state", F.lit(9)).cast("double"), F.get("action", F.lit(9)).cast("double")
    out = gripper_events(frames, rules, fps, grip, command)
    for name, vector in (("p", "state"), ("a", "action")):
        out = out.withColumns({f"{name}{i}": x for i, x in enumerate(pose.components(vector, [0, 1, 2]))})
        flat = [x for axis in _basis_columns(vector) for x in axis]
        out = out.withColumns({f"{name}r{i}": x for i, x in enumerate(flat)})
    at, to = [F.col(f"p{i}") for i in range(3)], [F.col(f"a{i}") for i in range(3)]

    def turned(name: str) -> Column:
        axes = [[F.col(f"{name}r{3 * k + i}") for i in range(3)] for k in range(3)]
        return F.coalesce(pose.basis_angle([series.lagged(x) for x in axes], axes), F.lit(0.0))

    out = out.withColumns({"turned": turned("p"), "action_turned": turned("a")})
    frame, n, c, o = F.col("frame"), F.col("n"), F.col("c"), F.col("o")
    out = out.withColumn("grasped", F.least(o - 1, F.col("c1"))).withColumn("releasing", F.greatest(F.col("grasped") + 1, F.col("o0")))
    phase = F.when(~F.col("certain"), 2).when(frame < F.col("c0"), 0).when(frame <= F.col("grasped"), 1).when(frame < F.col("releasing"), 2).when(frame <= F.col("o1"), 3).otherwise(4)
    out = apex(out.withColumn("phase", phase), rules, at[2], to[2], F.col("grasped") + 1, F.least(F.col("o0") - 1, n - 1))
    out = out.withColumn("last", F.coalesce("apex", n - 1))

    def centre(first: Column, final: Column) -> list[Column]:
        return [F.median(F.when((frame >= first) & (frame <= final), x)).over(_all()) for x in at]

    centres = {"g": centre(c - 2, c), "q": centre(F.greatest(c, o - 3), o)}
    out = out.withColumns({f"{k}{i}": x for k, v in centres.items() for i, x in enumerate(v)})
    grasp, place = [F.col(f"g{i}") for i in range(3)], [F.col(f"q{i}") for i in range(3)]
    near = F.lit(False)
    for number, spot in ((0, grasp), (2, place)):
        for path in (at, to):
            near = near | ((F.col("phase") == number) & (pose.norm(pose.minus(path, spot)) <= rules.contact_radius))
    out = out.withColumn("turning", F.col("certain") & (series.moving_mean(F.col("turned") * fps, 3) >= rules.turning))
    out = out.withColumn("begins", F.col("turning") & ~F.coalesce(F.lag("turning").over(series.ep()), F.lit(False)))
    out = out.withColumn("turn_phase", F.last(F.when(F.col("begins"), F.col("phase")), ignorenulls=True).over(series.so_far()))

    jump = (frame >= 1) & (frame <= F.col("last")) & ((pose.norm(pose.minus(at, series.lagged(at))) > rules.max_step) | (pose.norm(pose.minus(to, series.lagged(to))) > rules.max_step) | (F.col("turned") > rules.max_rotation) | (F.col("action_turned") > rules.max_rotation))
    out = out.withColumn("jump", F.coalesce(jump, F.lit(False))).withColumn("jumps_next", F.coalesce(F.lead("jump").over(series.ep()), F.lit(False)))
    edges = F.lit(False)
    for first, end in ((F.lit(0), F.col("c0")), (F.col("c1") + 1, F.col("o0")), (F.col("o1") + 1, n)):
        edges = edges | ((end > first) & ((frame == first) | (frame == end - 1)))
    told = {
        "ambiguous_gripper": ~F.col("certain"), "close_event": frame.between(F.col("c0"), F.col("c1")), "open_event": frame.between(F.col("o0"), F.col("o1")),
        "lift_apex": frame == F.col("apex"), "contact": F.col("certain") & near, "grasp_trigger": frame == c, "release_trigger": frame == o,
        "orientation_activity": F.col("turning") & F.col("turn_phase").isin(2, 3), "phase_boundary": F.col("certain") & edges,
        "endpoint": (frame == 0) | (frame == F.col("last")), "inherited_jump": F.col("jump") | F.col("jumps_next"),
        **{c: F.col(c) & (frame <= F.col("last")) for c in ("translation_limited", "rotation_limited") if c in frames.columns},
    }
    protection = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), name) for name, when in told.items()))))
    return out.withColumn("protection", protection).select(*frames.columns, "n", "c", "c0", "c1", "o", "o0", "o1", "phase", "apex", "last", "protection", "turned", "action_turned")


def idle(marked: DataFrame, rules: Rules = Rules(), fps: float = 10.0) -> DataFrame:
    """Idle spans of :func:`annotated` frames between grasp and release: (episode, first, final, keep). A report; no frame is left out for it.

    A span lies in a run of still frames longer than the hold, begins every hold, lasts three at most, and stays within a small distance and
    angle of its first frame. keep spreads one hold's frames evenly over it.
    """
    hold = round(rules.hold_s * fps)
    parts = [(v, pose.components(v, [0, 1, 2]), _basis_columns(v)) for v in ("state", "action")]
    named = marked.select("episode", "frame", "n", "c1", "o0", *(x.alias(f"{v}_{k}") for v, p, b in parts for k, x in enumerate([*p, *(y for axis in b for y in axis)])))

    def clipped(x: str, by: int) -> Column:
        if by < 0:
            return F.coalesce(F.lag(x, -by).over(series.ep()), F.first(x).over(series.whole()))
        return F.coalesce(F.lead(x, by).over(series.ep()), F.last(x).over(series.whole()))

    span = (F.least(F.col("frame") + 3, F.col("n") - 1) - F.greatest(F.col("frame") - 2, F.lit(0))) / fps
    still = (F.col("frame") >= F.col("c1")) & (F.col("frame") < F.least(F.col("o0"), F.col("n") - 1)) & (F.least(F.col("o0"), F.col("n") - 1) - F.col("c1") >= hold)
    for v, *_ in parts:
        before, after = ([clipped(f"{v}_{k}", by) for k in range(12)] for by in (-2, 3))
        still = still & (pose.norm(pose.minus(after[:3], before[:3])) / span < rules.static_speed)
        still = still & (pose.basis_angle(*([x[3:6], x[6:9], x[9:12]] for x in (before, after))) / span < rules.static_rotation)
    runs = series.runs(named.withColumn("still", F.coalesce(still, F.lit(False))), F.col("still"), hold + 1)
    probes = runs.select("episode", "end_frame", F.explode(F.sequence("start_frame", F.col("end_frame") - hold - 1, F.lit(hold))).alias("first"))
    probes = probes.select("episode", "first", F.least("end_frame", F.col("first") + 3 * hold).alias("final"))
    state = F.struct(*(F.col(f"state_{k}") for k in range(12)))
    near = probes.withColumn("frame", F.explode(F.sequence("first", "final"))).join(named.select("episode", "frame", state.alias("here")), ["episode", "frame"])
    near = near.join(named.select("episode", F.col("frame").alias("first"), state.alias("start")), ["episode", "first"])
    here, start = ([F.col(f"{s}.state_{k}") for k in range(12)] for s in ("here", "start"))
    angle = pose.basis_angle(*([x[3:6], x[6:9], x[9:12]] for x in (here, start)))
    calm = (pose.norm(pose.minus(here[:3], start[:3])) <= rules.static_range) & (angle <= rules.static_angle)
    keep = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(hold)), lambda i: F.rint(F.col("first") + (F.col("final") - F.col("first")) * i / hold).cast("long")))
    return near.groupBy("episode", "first", "final").agg(F.every(calm).alias("calm")).where("calm").select("episode", "first", "final", keep.alias("keep"))


def phase_report(plan: DataFrame, frames: DataFrame, rules: Rules = Rules(), fps: float = 10.0) -> DataFrame:
    """Per episode and phase of a selection (episode, frame, phase, kept, reason, protection): frames before and after, mean speed over kept pairs without protection between, and whether a fast phase meets the target."""
    joined = plan.join(frames.select("episode", "frame", *(x.alias(f"p{i}") for i, x in enumerate(pose.components("state", [0, 1, 2])))), ["episode", "frame"]).where("reason <> 'discarded_after_lift_apex'")
    held = F.sum((F.col("protection") != "").cast("int")).over(series.so_far())
    order = Window.partitionBy("episode", "phase").orderBy("frame")
    at = [F.col(f"p{i}") for i in range(3)]
    kept = joined.withColumn("held", held).where("kept")
    free = (F.col("protection") == "") & (F.lag("protection").over(order) == "") & (F.col("held") == F.lag("held").over(order))
    speed = F.when(free, pose.norm(pose.minus(at, [F.lag(x).over(order) for x in at])) * fps)
    speeds = kept.withColumn("speed", speed).groupBy("episode", "phase").agg(F.count("*").alias("frames_after"), F.avg("speed").alias("mean_speed"), F.count("speed").alias("pairs"))
    before = joined.groupBy("episode", "phase").agg(F.count("*").alias("frames_before"), F.min("frame").alias("first"), F.max("frame").alias("final"))
    met = F.when(F.col("phase").isin(*FAST), F.abs(F.col("mean_speed") - rules.target_speed) <= rules.speed_tolerance)
    return before.join(speeds, ["episode", "phase"], "left").withColumn("target_met", met).withColumn("retained", F.coalesce("frames_after", F.lit(0)) / F.col("frames_before"))
