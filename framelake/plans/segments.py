"""Windows of an episode that a selection treats on its own: steady segments, return loops, departures and ordered phases; and checks of a selection against its source.

Frames are rows (episode, frame, ...) numbered from 0 without gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import pose
from framelake.operators import rounds, series


def steady_segments(frames: DataFrame, position: list[str], moving: Column, least: int, most: int, cosine: float) -> DataFrame:
    """(episode, start_frame, end_frame, ratio): segments in which a path keeps its direction, one after the other in each run of moving steps.

    ``moving`` tells of a frame whether its step to the next one may belong to a segment; null counts as false. From the run's start a segment takes as
    many steps as it can, from ``least`` to ``most``, as long as with each further step the way from start to end is at least ``cosine`` of the path and
    every step's direction has that cosine with it at least. The next begins where it ends, or one frame later where none can begin. Of each
    frame the end is found in one window; which frames are begun from follows by doubling hops between the frames that can begin one.
    """
    ahead = [F.lead(c).over(series.ep()) for c in position]
    step = pose.minus(ahead, [F.col(c) for c in position])
    steps = frames.select("episode", "frame", F.coalesce(moving & ahead[0].isNotNull(), F.lit(False)).alias("moving"), F.array(*(F.col(c).cast("double") for c in position)).alias("a"), F.array(*(x.cast("double") for x in ahead)).alias("b"), pose.norm(step).alias("size"))
    steps = steps.where("moving").withColumn("run", F.col("frame") - F.row_number().over(series.ep()))
    run = Window.partitionBy("episode", "run").orderBy("frame")
    near = F.collect_list(F.struct("a", "b", "size")).over(run.rowsBetween(0, most - 1))
    minus = lambda p, q: F.zip_with(p, q, lambda x, y: x - y)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def steady(n: Column) -> Column:
        way = minus(F.get("near", n - 1)["b"], F.col("a"))
        path = F.aggregate(F.slice("near", 1, n), F.lit(0.0), lambda s, x: s + x["size"])
        length = F.sqrt(dot(way, way))
        agree = F.forall(F.slice("near", 1, n), lambda x: dot(minus(x["b"], x["a"]), way) >= cosine * F.greatest(x["size"], F.lit(1e-12)) * F.greatest(length, F.lit(1e-12)))
        return (path > 0) & (length >= cosine * path) & agree

    found = F.aggregate(F.when(F.size("near") >= least, F.sequence(F.lit(least), F.size("near"))).otherwise(F.array().cast("array<int>")), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, n: F.when(s["on"] & steady(n), F.struct(F.lit(True).alias("on"), n.alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), s["n"].alias("n"))), lambda s: s["n"])
    told = steps.withColumn("near", near).withColumn("n", found)
    told = told.select("episode", "run", "frame", F.col("n").cast("int").alias("n"), F.when(F.col("n") > 0, F.sqrt(dot(minus(F.get("near", F.col("n") - 1)["b"], F.col("a")), minus(F.get("near", F.col("n") - 1)["b"], F.col("a")))) / F.aggregate(F.slice("near", 1, F.greatest("n", F.lit(1))), F.lit(0.0), lambda s, x: s + x["size"])).alias("ratio"))
    backwards = Window.partitionBy("episode", "run").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("begins", F.last(F.when(F.col("n") > 0, F.col("frame")), ignorenulls=True).over(backwards))  # the first frame from here on that can begin one
    able = rounds.settled(told, "segments")
    ends = able.where("n > 0").select("episode", "run", "frame", (F.col("frame") + F.col("n")).alias("end_frame"), "ratio")
    landing = able.select("episode", "run", F.col("frame").alias("end_frame"), F.col("begins").alias("next"))
    hops = ends.join(landing, ["episode", "run", "end_frame"], "left").select("episode", "run", "frame", "next")
    starts = able.groupBy("episode", "run").agg(F.min_by("begins", "frame").alias("frame")).where("frame is not null")
    return rounds.reachable(starts, hops, ["episode", "run"]).join(ends, ["episode", "run", "frame"]).select("episode", F.col("frame").alias("start_frame"), "end_frame", "ratio")


@dataclass(frozen=True)
class Loops:
    """Limits of return loops, in frames and the positions' unit: frames apart, path at least, distance at most, and its share of the path at most."""

    nearest: int
    furthest: int
    path: float
    back: float
    ratio: float


def return_loops(frames: DataFrame, position: list[str], limits: Loops, protected: Column | None = None, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """(``keys``, start_frame, end_frame, path, distance): pairs of frames of one key between which a path comes back, without a protected frame between the two.

    ``keys`` may name a phase beside the episode. Paths and protected frames are counted by prefix sums; pairs are a band join.
    """
    order = Window.partitionBy(*keys).orderBy("frame")
    f = frames.withColumns({"size_": F.coalesce(pose.norm([F.col(c) - F.lag(c).over(order) for c in position]), F.lit(0.0)), "held_": F.coalesce(protected, F.lit(False)).cast("long") if protected is not None else F.lit(0)})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    f = f.select(*keys, "frame", *position, F.sum("size_").over(so_far).alias("path_"), F.sum("held_").over(so_far).alias("held_"), F.col("held_").alias("own_"))
    first = f.select(*keys, F.col("frame").alias("start_frame"), *(F.col(c).alias(f"a_{c}") for c in position), F.col("path_").alias("a_path"), F.col("held_").alias("a_held"), F.explode(F.sequence(F.col("frame") + limits.nearest, F.col("frame") + limits.furthest)).alias("end_frame"))
    second = f.select(*keys, F.col("frame").alias("end_frame"), *(F.col(c).alias(f"b_{c}") for c in position), F.col("path_").alias("b_path"), (F.col("held_") - F.col("own_")).alias("b_held"))
    pairs = first.join(second, [*keys, "end_frame"]).where("a_held = b_held")
    pairs = pairs.withColumns({"path": F.col("b_path") - F.col("a_path"), "distance": pose.norm([F.col(f"b_{c}") - F.col(f"a_{c}") for c in position])})
    return pairs.where((F.col("path") >= limits.path) & (F.col("distance") <= limits.back) & (F.col("distance") <= F.col("path") * limits.ratio)).select(*keys, "start_frame", "end_frame", "path", "distance")


def best_apart(intervals: DataFrame, score: Column, most: int = 8, keys: tuple[str, ...] = ("episode",)) -> DataFrame:
    """(``keys``, place, start_frame, end_frame, score): of each key's intervals the best, then the best of those that share no frame with it, and so on, ``most`` at most.

    Equal scores go by start, then by end. Each round is a maximum over the key's rows that are left, so all rounds share one exchange.
    """
    own = Window.partitionBy(*keys)
    left = intervals.select(*keys, "start_frame", "end_frame", score.cast("double").alias("score"))
    for k in range(most):
        free = F.lit(True)
        for earlier in range(k):
            free = free & F.coalesce((F.col("end_frame") < F.col(f"best_{earlier}.start")) | (F.col("start_frame") > F.col(f"best_{earlier}.final")), F.lit(False))
        best = F.max(F.when(free, F.struct("score", (-F.col("start_frame")).alias("a"), (-F.col("end_frame")).alias("b")))).over(own)
        left = left.withColumn(f"best_{k}", best).withColumn(f"best_{k}", F.when(F.col(f"best_{k}").isNotNull(), F.struct((-F.col(f"best_{k}.a")).alias("start"), (-F.col(f"best_{k}.b")).alias("final"), F.col(f"best_{k}.score").alias("score"))))
    chosen = F.lit(None).cast("int")
    for k in reversed(range(most)):
        chosen = F.when((F.col("start_frame") == F.col(f"best_{k}.start")) & (F.col("end_frame") == F.col(f"best_{k}.final")) & (F.col("score") == F.col(f"best_{k}.score")), k).otherwise(chosen)
    return left.withColumn("place", chosen).where("place is not null").select(*keys, "place", "start_frame", "end_frame", "score").dropDuplicates([*keys, "place"])


def departures(frames: DataFrame, position: list[str], phases: DataFrame, events: DataFrame, tolerance: float, least: float) -> DataFrame:
    """(episode, start_frame, end_frame, anchor, distance, backtrack, status) of phases (episode, start_frame, end_frame, standard) of a path that should leave in one direction.

    A departure lasts to the phase's first event (episode, start_frame) after its start, else to its end: a forward as-of join, by one window over
    both tables' rows. backtrack is the largest fall of the progress towards the last frame's position below its maximum so far. status is
    ``unsupported`` where the distance is under ``least``, the departure shorter than 3 frames or the phase not standard, ``kept`` where backtrack is
    within ``tolerance``, else ``pending``. Phases of one episode don't overlap; backtrack is null where distance is 0.
    """
    both = phases.select("episode", F.col("start_frame").alias("at"), F.col("end_frame").alias("final"), "standard", F.lit(None).cast("long").alias("event")).unionByName(events.select("episode", F.col("start_frame").alias("at"), F.lit(None).cast("long").alias("final"), F.lit(None).cast("boolean").alias("standard"), F.col("start_frame").cast("long").alias("event")))
    # backwards in time, an event at a phase's own start comes after the phase
    later = Window.partitionBy("episode").orderBy(F.desc("at"), F.col("event").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("next", F.last("event", ignorenulls=True).over(later)).where("final is not null")
    told = told.select("episode", F.col("at").alias("start_frame"), F.least("final", F.col("next")).alias("end_frame"), F.when(F.col("next") <= F.col("final"), "next_event").otherwise("phase_end").alias("anchor"), "standard")
    for name in ("start", "end"):
        told = told.join(frames.select("episode", F.col("frame").alias(f"{name}_frame"), *(F.col(c).cast("double").alias(f"{name}_{c}") for c in position)), ["episode", f"{name}_frame"])
    way = [F.col(f"end_{c}") - F.col(f"start_{c}") for c in position]
    told = told.withColumn("distance", pose.norm(way))
    inside = series.bin_join(frames.select("episode", "frame", *position), told, ["episode"], "frame", "start_frame", "end_frame", 256)
    progress = F.try_divide(pose.dot([F.col(c) - F.col(f"start_{c}") for c in position], way), F.col("distance"))
    order = Window.partitionBy("episode", "start_frame").orderBy("frame")
    inside = inside.withColumn("progress", progress).withColumn("fall", F.max("progress").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("progress"))
    backs = inside.groupBy("episode", "start_frame").agg(F.max("fall").alias("backtrack"))
    status = F.when((F.col("distance") < least) | (F.col("end_frame") - F.col("start_frame") < 3) | ~F.coalesce("standard", F.lit(False)), "unsupported").when(F.col("backtrack") <= tolerance, "kept").otherwise("pending")
    return told.join(backs, ["episode", "start_frame"], "left").select("episode", "start_frame", "end_frame", "anchor", "distance", "backtrack", status.alias("status"))


#: Arms of the phases in order.
PHASE_ARMS = ("R", "L", "R", "L", "R")


def arm_blocks(frames: DataFrame, right: Column, left: Column, activity: float, dominance: float, least: int, starts: DataFrame | None = None) -> DataFrame:
    """(episode, block, arm, start_frame, end_frame) of the stretches in which one arm is active and ``dominance`` times as fast as the other.

    Runs shorter than ``least`` frames or over before the episode's start (episode, start_frame; 0 without one) go, then neighbours of one arm are merged; blocks are numbered from 0.
    """
    label = F.when((right > activity) & (right > dominance * left), "R").when((left > activity) & (left > dominance * right), "L")
    f = frames.select("episode", "frame", label.alias("arm"))
    runs = series.runs(f, F.col("arm") == "R", least).withColumn("arm", F.lit("R")).unionByName(series.runs(f, F.col("arm") == "L", least).withColumn("arm", F.lit("L")))
    begun = runs if starts is None else runs.join(starts.select("episode", F.col("start_frame").alias("begin")), "episode", "left")
    first = F.lit(0) if starts is None else F.coalesce("begin", F.lit(0))
    begun = begun.where(F.col("end_frame") > first).select("episode", "arm", F.greatest("start_frame", first.cast("long")).alias("a"), (F.col("end_frame") - 1).alias("b"))
    order = Window.partitionBy("episode").orderBy("a")
    turns = begun.withColumn("block", F.sum(F.coalesce((F.col("arm") != F.lag("arm").over(order)).cast("long"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return turns.groupBy("episode", "block").agg(F.first("arm").alias("arm"), F.min("a").alias("start_frame"), F.max("b").alias("end_frame"))


def ordered_phases(blocks: DataFrame, lengths: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(episode, phase, arm, start_frame, end_frame, standard): the :func:`arm_blocks` of each episode cut into five groups for arms R, L, R, L, R.

    Each group holds a block of its arm; the frames of blocks of the other arm, summed, are as few as can be. Of equal cuts the one whose last
    group begins first is taken, then the one before. Phases meet halfway between groups; the first begins at the episode's start, the last ends with
    the episode (episode, length). Episodes with fewer than five blocks, or that don't begin with R, have none.

    One fold over an episode's blocks carries, for each phase and whether its arm has been met, the cheapest cut: its cost and the groups' beginnings,
    from the last. That is ten short arrays, whatever the number of blocks.
    """
    state = "array<bigint>"
    slots = [(p, met) for p in range(5) for met in (False, True)]
    name = lambda p, met: f"p{p}{'m' if met else 'o'}"
    none = F.struct(*((F.array(F.lit(0)).cast(state) if (p, met) == (0, False) else F.lit(None).cast(state)).alias(name(p, met)) for p, met in slots))

    def step(s: Column, b: Column) -> Column:
        size, fields = b["end_frame"] - b["start_frame"] + 1, []
        for p, met in slots:
            own = b["arm"] == PHASE_ARMS[p]
            # staying costs a block of the other arm; a new group begins with this block, once the one before has met its arm
            dear = lambda x: F.when(x.isNotNull(), F.concat(F.array(x[0] + size), F.slice(x, 2, 6)))  # noqa: E731, B023
            stays = [F.when(own, F.least(s[name(p, False)], s[name(p, True)])).otherwise(dear(s[name(p, True)]))] if met else [F.when(~own, dear(s[name(p, False)]))]
            if p:
                before = s[name(p - 1, True)]
                cost = before[0] + F.when(own, F.lit(0)).otherwise(size)
                new = F.when(before.isNotNull() & (own if met else ~own), F.concat(F.array(cost, b["block"]), F.slice(before, 2, 6)))
                stays.append(new)
            fields.append((F.least(*stays) if len(stays) > 1 else stays[0]).cast(state).alias(name(p, met)))
        return F.struct(*fields)

    whole = blocks.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("block", "arm", "start_frame", "end_frame"))).alias("blocks"))  # a few dozens
    whole = whole.where((F.size("blocks") >= 5) & (F.col("blocks")[0]["arm"] == "R"))
    cut = whole.withColumn("cut", F.aggregate("blocks", none, step, lambda s: s[name(4, True)])).where("cut is not null")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.reverse(F.slice("cut", 2, 4)), F.array(F.size("blocks").cast("long")))
    cut = cut.select("episode", "blocks", begins.alias("begins")).join(lengths.select("episode", "length"), "episode")
    cut = cut.withColumn("first", F.lit(0).cast("long")) if starts is None else cut.join(starts.select("episode", F.col("start_frame").cast("long").alias("first")), "episode", "left").na.fill(0, ["first"])
    told = cut.select("episode", "blocks", "begins", "length", "first", F.posexplode(F.array(*map(F.lit, PHASE_ARMS))).alias("p", "arm"))
    begin, end = F.get("begins", F.col("p")), F.get("begins", F.col("p") + 1)
    halfway = lambda at: F.floor((F.get("blocks", (at - 1).cast("int"))["end_frame"] + F.get("blocks", at.cast("int"))["start_frame"] + 1) / 2)
    group = F.slice("blocks", begin.cast("int") + 1, (end - begin).cast("int"))
    return told.select("episode", (F.col("p") + 1).alias("phase"), "arm", F.when(F.col("p") == 0, F.col("first")).otherwise(halfway(begin)).alias("start_frame"), (F.when(F.col("p") == 4, F.col("length")).otherwise(halfway(end)) - 1).alias("end_frame"), F.forall(group, lambda b: b["arm"] == F.col("arm")).alias("standard"))


def dynamics_check(frames: DataFrame, chosen: DataFrame, phases: DataFrame, paths: dict[str, list[str]], fps: float, relative: float, absolute: float, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(episode, phase, quantity, source_peak, chosen_peak, holds): whether a selection (episode, frame) moves no faster than its source, in each phase (episode, phase, start_frame, end_frame).

    A quantity is a path (name: columns) and an order of difference, speed 1, acceleration 2, jerk 3, times fps to that power; its peak is the longest.
    The selection's are taken over the chosen frames of the phase and three on either side, as if they followed one another; the source's over
    all frames from three before the phase, or the first of these, to three after it, or the last. holds is chosen_peak <= source_peak *
    (1 + relative) + absolute. Phases without a chosen frame near have peaks of 0, as have those with too few frames for an order.
    """
    columns = sorted({c for p in paths.values() for c in p})
    quantities = {f"{name}_{order}": (path, order) for name, path in paths.items() for order in orders}

    def derived(rows: DataFrame, index: Column) -> DataFrame:
        return rows.select("episode", "frame", index.cast("long").alias("index"), *((series.difference_norm([F.col(c) for c in path], order) * fps**order).alias(q) for q, (path, order) in quantities.items()))

    source = derived(frames, F.col("frame"))
    picked = derived(frames.join(chosen.select("episode", "frame").distinct(), ["episode", "frame"], "left_semi").select("episode", "frame", *columns), F.row_number().over(series.ep()) - 1)
    last = frames.groupBy("episode").agg(F.max("frame").alias("last"))
    # a phase's slice of the selection by its frames' places: counts of chosen frames before the start, and up to the end
    near = phases.select("episode", "phase", "start_frame", "end_frame").join(picked.select("episode", "frame", "index"), "episode", "left")
    near = near.groupBy("episode", "phase", "start_frame", "end_frame").agg(F.count_if(F.col("frame") < F.col("start_frame")).alias("low"), F.count_if(F.col("frame") <= F.col("end_frame")).alias("high"), F.count("frame").alias("n"))
    near = near.withColumns({"low": F.greatest(F.col("low") - 3, F.lit(0)), "high": F.least(F.col("high") + 3, F.col("n")) - 1})

    def peaks(rows: DataFrame, slices: DataFrame, name: str) -> DataFrame:
        inside = series.bin_join(rows, slices, ["episode"], "index", "low", "high", 256)
        # a difference of order k needs k rows before its own within the slice
        most = [F.struct(F.lit(q).alias("quantity"), F.coalesce(F.max(F.when(F.col("index") - F.col("low") >= order, F.col(q))), F.lit(0.0)).alias(name)) for q, (_, order) in quantities.items()]
        return inside.groupBy("episode", "phase").agg(F.array(*most).alias("all"), F.min("frame").alias("first"), F.max("frame").alias("final"))

    out = peaks(picked, near.select("episode", "phase", "low", "high"), "chosen_peak")
    wide = phases.select("episode", "phase", "start_frame", "end_frame").join(out.select("episode", "phase", "first", "final"), ["episode", "phase"], "left").join(last, "episode")
    wide = wide.select("episode", "phase", F.greatest(F.least(F.col("start_frame") - 3, F.coalesce("first", F.col("start_frame"))), F.lit(0)).alias("low"), F.least(F.greatest(F.col("end_frame") + 3, F.coalesce("final", F.col("end_frame"))), "last").alias("high"))
    own = peaks(source, wide, "source_peak").select("episode", "phase", F.inline("all"))
    told = own.join(out.select("episode", "phase", F.inline("all")), ["episode", "phase", "quantity"], "left").na.fill(0.0, ["chosen_peak"])
    return told.select("episode", "phase", "quantity", "source_peak", "chosen_peak", (F.col("chosen_peak") <= F.col("source_peak") * (1 + relative) + absolute).alias("holds"))


def budget_weights(frames: DataFrame, protected: Column, budget: Column, ramp: int, least: float) -> DataFrame:
    """(episode, frame, weight): how densely to sample each frame so that an episode's weights sum to its ``budget``, where that can be.

    Protected frames weigh 1; the further from them, up to ``ramp`` frames, the nearer a weight is to the episode's level, which is between ``least``
    and 1. The sum is linear in the level, so the level is exact: two sums over the episode. An episode without a protected frame has the level everywhere.
    """
    far = F.least(F.coalesce(series.nearest_flag(protected).cast("double"), F.lit(float(ramp))), F.lit(float(ramp))) / ramp
    told = frames.select("episode", "frame", budget.cast("double").alias("budget"), far.alias("far"))
    own = Window.partitionBy("episode")
    level = 1 - F.try_divide(F.count(F.lit(1)).over(own) - F.col("budget"), F.sum("far").over(own))
    held = F.greatest(F.least(F.coalesce(level, F.lit(1.0)), F.lit(1.0)), F.lit(least))
    return told.withColumn("level", held).select("episode", "frame", (1 - (1 - F.col("level")) * F.col("far")).alias("weight"))
