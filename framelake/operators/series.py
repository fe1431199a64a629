"""Operators over episodes: frames ordered within an episode, by one window specification so that all share one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from framelake.functions.pose import Vec, clamp, dot, minus, norm, unit
from framelake.operators import rounds


def ep() -> WindowSpec:
    """Frames of an episode in order."""
    return Window.partitionBy("episode").orderBy("frame")


def whole() -> WindowSpec:
    """All frames of an episode."""
    return ep().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    """Frames of an episode up to the present one."""
    return ep().rowsBetween(Window.unboundedPreceding, 0)


def lagged(v: Vec, by: int = 1) -> Vec:
    """Components ``by`` frames earlier."""
    return [F.lag(x, by).over(ep()) for x in v]


def speed(v: Vec, fps: float, head: float | None = None) -> Column:
    """Length of the step from the previous frame times fps; ``head`` stands at the first frame."""
    s = norm(minus(v, lagged(v))) * fps
    return s if head is None else F.coalesce(s, F.lit(head))


def difference_norm(v: Vec, order: int) -> Column:
    """Length of the second or third difference; null in the first frames."""
    factors = {1: (1, -1), 2: (1, -2, 1), 3: (1, -3, 3, -1)}[order]
    return norm([sum((f * (x if not k else F.lag(x, k).over(ep())) for k, f in enumerate(factors)), F.lit(0.0)) for x in v])


def moving_mean(x: Column, size: int) -> Column:
    """Centred mean over an odd number of frames, with the first and last values repeated beyond the ends."""
    k = size // 2
    place, n = F.row_number().over(ep()), F.count(F.lit(1)).over(whole())
    left, right = F.greatest(F.lit(k + 1) - place, F.lit(0)), F.greatest(place + k - n, F.lit(0))
    return (F.sum(x).over(ep().rowsBetween(-k, k)) + left * F.first(x).over(whole()) + right * F.last(x).over(whole())) / size


def moving_median(x: Column, size: int) -> Column:
    """Centred median over an odd number of frames, with the first and last values repeated beyond the ends."""
    k = size // 2
    place, n = F.row_number().over(ep()), F.count(F.lit(1)).over(whole())
    left, right = F.greatest(F.lit(k + 1) - place, F.lit(0)), F.greatest(place + k - n, F.lit(0))
    near = F.concat(F.array_repeat(F.first(x).over(whole()), left.cast("int")), F.collect_list(x).over(ep().rowsBetween(-k, k)), F.array_repeat(F.last(x).over(whole()), right.cast("int")))
    return F.element_at(F.array_sort(near), k + 1)


def runs(frames: DataFrame, flag: Column, least: int = 1) -> DataFrame:
    """Maximal runs of true: (episode, start_frame, end_frame exclusive, n) with ``least`` frames or more."""
    island = F.col("frame") - F.row_number().over(Window.partitionBy("episode", "flag").orderBy("frame"))
    flagged = frames.withColumn("flag", F.coalesce(flag, F.lit(False))).where("flag")
    return flagged.withColumn("island", island).groupBy("episode", "island").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def hysteresis(x: Column, low: float, high: float) -> Column:
    """c after a value under ``low``, o after one over ``high``, else as before; o at first."""
    return F.coalesce(F.last(F.when(x < low, "c").when(x > high, "o"), ignorenulls=True).over(so_far()), F.lit("o"))


def nearest_flag(flag: Column) -> Column:
    """Frames to the nearest true flag on either side; null where the episode has none."""
    place = F.when(flag, F.col("frame"))
    before = F.last(place, ignorenulls=True).over(so_far())
    after = F.first(place, ignorenulls=True).over(ep().rowsBetween(0, Window.unboundedFollowing))
    return F.least(F.col("frame") - before, after - F.col("frame"))


def central_speed(v: Vec, reach: int, fps: float) -> Column:
    """Speed over ``reach`` frames on either side, clipped at the ends and divided by the real span."""
    place, n = F.row_number().over(ep()), F.count(F.lit(1)).over(whole())
    first = [F.coalesce(F.lag(x, reach).over(ep()), F.first(x).over(whole())) for x in v]
    last = [F.coalesce(F.lead(x, reach).over(ep()), F.last(x).over(whole())) for x in v]
    span = F.least(place + reach, n) - F.greatest(place - reach, F.lit(1))
    return F.when(span > 0, norm(minus(last, first)) * fps / span).otherwise(0.0)


def turn_angle(v: Vec, reach: int) -> Column:
    """Degrees between the ways into and out of a frame, each over ``reach`` frames clipped at the ends; null without both."""
    into = minus(v, [F.coalesce(F.lag(x, reach).over(ep()), F.first(x).over(whole())) for x in v])
    out = minus([F.coalesce(F.lead(x, reach).over(ep()), F.last(x).over(whole())) for x in v], v)
    moved = (norm(into) > 1e-9) & (norm(out) > 1e-9)
    return F.when(moved, F.degrees(F.acos(clamp(dot(unit(into), unit(out))))))


def excursion(v: Vec, reach: int) -> Column:
    """The shorter of the ways into and out of a frame, each over ``reach`` frames clipped at the ends."""
    into = minus(v, [F.coalesce(F.lag(x, reach).over(ep()), F.first(x).over(whole())) for x in v])
    out = minus([F.coalesce(F.lead(x, reach).over(ep()), F.last(x).over(whole())) for x in v], v)
    return F.least(norm(into), norm(out))


def starts(frames: DataFrame, moving: Vec, resting: Vec, fps: float, window: int, after: int, fast: float, still: float, straight: float, back: float) -> DataFrame:
    """(episode, start_frame): the first frame from which one path starts while the other rests; 0 where there is none.

    In the next ``window`` steps three in four of the moving path's are faster than ``fast`` and of the resting path's at most ``still``, their
    directions agree (mean cosine with their mean ``straight`` or more) and none goes back along it by more than ``back``; in the ``after``
    steps that follow, 55 in a hundred are fast.
    """
    step = minus(moving, lagged(moving))
    size = norm(step)
    f = frames.withColumns({"size": size, "rest": speed(resting, fps), **{f"step{i}": x for i, x in enumerate(step)}, **{f"way{i}": x / F.greatest(size, F.lit(1e-12)) for i, x in enumerate(step)}})
    near, later = ep().rowsBetween(1, window), ep().rowsBetween(window + 1, window + after)
    share = lambda flag, over: F.avg(F.when(flag, 1.0).otherwise(0.0)).over(over)
    mean = [F.avg(f"way{i}").over(near) for i in range(3)]
    told = f.withColumns({"n": F.count(F.lit(1)).over(whole()), "fast": share(F.col("size") * fps > fast, near), "still": share(F.col("rest") <= still, near), "on": share(F.col("size") * fps > fast, later), "steps": F.collect_list(F.array(*(F.col(f"step{i}") for i in range(3)))).over(near), **{f"mean{i}": x for i, x in enumerate(mean)}})
    agree = norm([F.col(f"mean{i}") for i in range(3)])
    along = lambda d: sum((d[i] * F.col(f"mean{i}") for i in range(3)), F.lit(0.0)) / F.greatest(F.col("agree"), F.lit(1e-12))
    told = told.withColumn("agree", agree).withColumn("back", F.exists("steps", lambda d: along(d) < -back))
    good = (F.col("frame") < F.col("n") - window - after) & (F.col("fast") >= 0.75) & (F.col("still") >= 0.75) & (F.col("agree") >= straight) & ~F.col("back") & (F.col("on") >= 0.55)
    return told.groupBy("episode").agg(F.coalesce(F.min(F.when(good, F.col("frame") + 1)), F.lit(0)).alias("start_frame"))


def started(starts: DataFrame, events: DataFrame) -> DataFrame:
    """(episode, start_frame, note) of found starts (episode, start_frame) after events (episode, start_frame, end_frame) are heeded.

    A whole event before the start puts it at 0, so that nothing real is left out (note ``earlier_event``); an event that has begun by then and isn't over
    puts it at the event's first frame (``inside_event``), in order of the events. Starts at 0 stay.
    """
    told = events.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame"))).alias("events"))  # a few an episode
    first, held = F.col("found").cast("long"), F.coalesce("events", F.array().cast("array<struct<start_frame:bigint,end_frame:bigint>>"))
    back = F.aggregate(held, first, lambda at, e: F.when((e["start_frame"] < at) & (at <= e["end_frame"]), e["start_frame"].cast("long")).otherwise(at))
    over = F.exists(held, lambda e: e["end_frame"] < first)
    note = F.when(over, "earlier_event").when(back < first, "inside_event")
    return starts.select("episode", F.col("start_frame").alias("found")).join(told, "episode", "left").select("episode", F.when(over, F.lit(0).cast("long")).otherwise(back).alias("start_frame"), note.alias("note"))


def backtrack(frames: DataFrame, position: list[str]) -> DataFrame:
    """(episode, backtrack): the sum of all steps' parts against the direction from the first to the last frame."""
    steps = frames.select("episode", "frame", *position, *((F.col(c) - F.lag(c).over(ep())).alias(f"step_{c}") for c in position))
    chord = frames.groupBy("episode").agg(*((F.max_by(c, "frame") - F.min_by(c, "frame")).alias(f"way_{c}") for c in position))
    way = [F.col(f"way_{c}") for c in position]
    back = -dot([F.col(f"step_{c}") for c in position], way) / F.greatest(norm(way), F.lit(1e-12))
    return steps.join(chord, "episode").groupBy("episode").agg(F.coalesce(F.sum(F.greatest(back, F.when(back.isNotNull(), 0.0))), F.lit(0.0)).alias("backtrack"))


def drawdown(x: Column) -> Column:
    """How far a value is below the largest so far."""
    return F.max(x).over(so_far()) - x


def band_pairs(frames: DataFrame, gap: int, columns: list[str]) -> DataFrame:
    """Frames i < j of one episode up to ``gap`` apart as i, j and both sides' columns, by an equi-join on exploded offsets."""
    left = frames.select("episode", F.col("frame").alias("i"), *(F.col(c).alias(f"{c}_i") for c in columns)).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + gap)))
    return left.join(frames.select("episode", F.col("frame").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns)), ["episode", "j"])


def bin_join(rows: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """``rows`` with each interval of the same ``keys`` in which ``at`` lies, ends included: an equality join on the key and a bin of ``width``, then the exact bounds.

    An interval is dealt to all bins that it touches, so a row meets only intervals near it and no key's rows meet in one task; ``width`` should be
    about an interval's length. ``how`` is inner or left_semi (``rows`` only, each once). Intervals with a null end, or an end before their start, hold nothing.
    """
    def of(c: Column) -> Column:
        return F.floor(c / F.lit(width)).cast("long")

    bins = intervals.where(F.col(low) <= F.col(high)).withColumn("bin_", F.explode(F.sequence(of(F.col(low)), of(F.col(high)))))
    left, right = rows.withColumn("bin_", of(F.col(at))).alias("r"), bins.alias("i")
    same = F.col("r.bin_") == F.col("i.bin_")
    for k in keys:
        same = same & (F.col(f"r.{k}") == F.col(f"i.{k}"))
    within = same & (F.col(f"r.{at}") >= F.col(f"i.{low}")) & (F.col(f"r.{at}") <= F.col(f"i.{high}"))
    joined = left.join(right, within, how)
    if how == "left_semi":
        return joined.drop("bin_")
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns), *(F.col(f"i.{c}") for c in intervals.columns if c not in keys))


def in_intervals(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Frames that lie in an interval [start_frame, end_frame) of their episode."""
    return bin_join(frames, intervals.select("episode", "start_frame", (F.col("end_frame") - 1).alias("last_")), ["episode"], "frame", "start_frame", "last_", 64, "left_semi")


def taken(frames: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected frames with source_frame and a dense frame number from 0."""
    kept = frames.join(selection.select("episode", "frame").distinct(), ["episode", "frame"], "left_semi")
    return kept.withColumn("source_frame", F.col("frame")).withColumn("frame", (F.row_number().over(ep()) - 1).cast("long"))


def numbered(rows: DataFrame, order: str, place: str, amount: str | None = None, begin: str | None = None) -> DataFrame:
    """``rows`` with their place from 0 by ``order`` (null first) and, if named, the sum ``begin`` of ``amount`` over all before; other columns as they are.

    Rows are cut by sampled quantiles of ``order`` into ranges of about the same number of rows, however its values lie, and written, so that the cut is
    made once; each range is ranked by itself and moved by the counts and sums of those before it. Rows of one value share a range.
    """
    part, many, much = rounds.free_names(rows, "part_", "many_", "much_")
    cut = rounds.settled(rows.repartitionByRange(F.col(order).asc_nulls_first()).withColumn(part, F.spark_partition_id()), "numbered")
    earlier = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = cut.groupBy(part).agg(F.count("*").alias(many), (F.sum(amount) if amount else F.lit(0)).alias(much))
    sums = sums.select(part, F.coalesce(F.sum(many).over(earlier), F.lit(0)).alias(many), F.coalesce(F.sum(much).over(earlier), F.lit(0)).alias(much))
    within = Window.partitionBy(part).orderBy(F.col(order).asc_nulls_first())
    out = cut.join(F.broadcast(sums), part).withColumn(place, (F.row_number().over(within) - 1 + F.col(many)).cast("long"))  # as many rows as ranges
    if amount and begin:
        out = out.withColumn(begin, F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(much))
    return out.drop(part, many, much)


def with_offsets(lengths: DataFrame) -> DataFrame:
    """(episode, length, output_episode, offset): dense numbers and exclusive sums of lengths; one row an episode."""
    return numbered(lengths, "episode", "output_episode", "length", "offset")


def nearest_before(frames: DataFrame, selection: DataFrame) -> DataFrame:
    """Each frame with how many selected frames of its episode lie before it and the last one at or before it."""
    marked = frames.join(selection.select("episode", "frame", F.lit(True).alias("chosen")).distinct(), ["episode", "frame"], "left")
    before = F.count_if("chosen").over(ep().rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("before", before).withColumn("at_or_before", F.last(F.when(F.col("chosen"), F.col("frame")), ignorenulls=True).over(so_far()))
