"""Queries over the driver's tables that exercise the trajectory operators, each with the SQL that DuckDB answers alike.

Embeddings stand for pose frames (label and block of numbers = episode), events for scalar signals (user_id = episode), orders and lineitem for episode metadata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import pose
from framelake.operators import series, stats
from framelake.plans import checks, single_arm
from framelake.sources import convert, datasets

FPS = 30.0
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is one."""

    def registered(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return registered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames: left and right positions, a quaternion and the vector. An episode is one label's vectors of 500 numbers, so there are more in a larger table."""
    block = F.floor(F.col("vec_id") / 500)
    frame = F.row_number().over(Window.partitionBy("label", block).orderBy("vec_id")) - 1
    names = ["lx", "ly", "lz", "qx", "qy", "qz", "qw", "s7", "rx", "ry", "rz"]
    return table(spark, sf_dir, "embeddings").select((F.col("label").cast("long") * 1000000 + block).alias("episode"), frame.cast("long").alias("frame"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)), F.col("embedding").alias("v"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one scalar."""
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), frame.cast("long").alias("frame"), "value", "event_type", "ts")


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def r6(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)



def left() -> list[Column]:
    return cols("lx", "ly", "lz")


def right() -> list[Column]:
    return cols("rx", "ry", "rz")


def quaternion() -> list[Column]:
    return cols("qx", "qy", "qz", "qw")


E_SQL = """e AS (SELECT CAST(label AS BIGINT) * 1000000 + vec_id // 500 AS episode, row_number() OVER (PARTITION BY label, vec_id // 500 ORDER BY vec_id) - 1 AS frame, embedding AS v,
 embedding[1]::DOUBLE AS lx, embedding[2]::DOUBLE AS ly, embedding[3]::DOUBLE AS lz, embedding[4]::DOUBLE AS qx, embedding[5]::DOUBLE AS qy, embedding[6]::DOUBLE AS qz, embedding[7]::DOUBLE AS qw,
 embedding[9]::DOUBLE AS rx, embedding[10]::DOUBLE AS ry, embedding[11]::DOUBLE AS rz FROM embeddings)"""
F_SQL = "f AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type, ts FROM events)"
EP_SQL = "WINDOW w AS (PARTITION BY episode ORDER BY frame)"
D_SQL = f"d AS (SELECT *, lx - lag(lx) OVER w AS dx, ly - lag(ly) OVER w AS dy, lz - lag(lz) OVER w AS dz FROM e {EP_SQL})"
S_SQL = "s AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS step FROM d)"


@query(f"""WITH {E_SQL}, {D_SQL}, {S_SQL} SELECT episode, count(*) AS frames, round(avg(step * 30) FILTER (WHERE step > 0), 6) AS mean_speed, round(median(step * 30) FILTER (WHERE step > 0), 6) AS median_speed FROM s GROUP BY episode""")
def pose_speed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median tool speed over moving frames of each episode."""
    moving = poses(spark, sf_dir).withColumn("speed", series.speed(left(), FPS)).withColumn("speed", F.when(F.col("speed") > 0, F.col("speed")))
    return moving.groupBy("episode").agg(F.count("*").alias("frames"), r6(F.avg("speed"), "mean_speed"), r6(F.median("speed"), "median_speed"))


@query(f"""WITH {E_SQL}, n AS (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS m FROM e), u AS (SELECT episode, frame, lx, ly, lz, qx/m AS x, qy/m AS y, qz/m AS z, qw/m AS w FROM n),
c AS (SELECT *, 2*(y*0.3 - z*0.2) AS cx, 2*(z*0.1 - x*0.3) AS cy, 2*(x*0.2 - y*0.1) AS cz FROM u)
SELECT episode, frame, round((lx + 0.1 + w*cx + (y*cz - z*cy)) * -1 + 0.5, 6) AS px, round(ly + 0.2 + w*cy + (z*cx - x*cz), 6) AS py, round(lz + 0.3 + w*cz + (x*cy - y*cx) - 0.25, 6) AS pz FROM c""")
def pose_tool_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool points after a quaternion offset, then sign and offset."""
    moved = pose.affine(pose.tool_offset(left(), quaternion(), [0.1, 0.2, 0.3]), [-1, 1, 1], [0.5, 0.0, -0.25])
    return poses(spark, sf_dir).select("episode", "frame", *(r6(x, n) for x, n in zip(moved, ("px", "py", "pz"), strict=True)))


@query(f"""WITH {E_SQL}, {D_SQL}, {S_SQL}, k AS (SELECT *, sqrt(pow(lx-2*lag(lx) OVER w+lag(lx,2) OVER w,2)+pow(ly-2*lag(ly) OVER w+lag(ly,2) OVER w,2)+pow(lz-2*lag(lz) OVER w+lag(lz,2) OVER w,2)) AS d2,
sqrt(pow(lx-3*lag(lx) OVER w+3*lag(lx,2) OVER w-lag(lx,3) OVER w,2)+pow(ly-3*lag(ly) OVER w+3*lag(ly,2) OVER w-lag(ly,3) OVER w,2)+pow(lz-3*lag(lz) OVER w+3*lag(lz,2) OVER w-lag(lz,3) OVER w,2)) AS d3 FROM s {EP_SQL})
SELECT episode, count(*) AS frames, round((count(*)-1)/30.0::DOUBLE, 6) AS span_s, round(coalesce(sum(step),0), 6) AS path, round(coalesce(avg(step*30) FILTER (WHERE step>0),0), 6) AS speed_mean, round(coalesce(median(step*30) FILTER (WHERE step>0),0), 6) AS speed_median,
round(coalesce(stddev_pop(step*30) FILTER (WHERE step>0)/avg(step*30) FILTER (WHERE step>0),0), 6) AS speed_cv, round(coalesce(max(step*30),0), 6) AS speed_max, CAST(count(*) FILTER (WHERE step=0) AS BIGINT) AS zero_count, round(coalesce(max(d2)*900,0), 4) AS peak_acceleration, round(coalesce(max(d3)*27000,0), 3) AS peak_jerk FROM k GROUP BY episode""")
def pose_path_metrics_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, speed, acceleration and jerk of each episode; means over moving frames."""
    f = poses(spark, sf_dir).withColumns({"step": series.speed(left(), 1.0), "d2": series.difference_norm(left(), 2), "d3": series.difference_norm(left(), 3)})
    moving, zero = F.when(F.col("step") > 0, F.col("step") * FPS), F.lit(0.0)
    return f.groupBy("episode").agg(
        F.count("*").alias("frames"), r6((F.count("*") - 1) / FPS, "span_s"), r6(F.coalesce(F.sum("step"), zero), "path"), r6(F.coalesce(F.avg(moving), zero), "speed_mean"), r6(F.coalesce(F.median(moving), zero), "speed_median"),
        r6(F.coalesce(F.stddev_pop(moving) / F.avg(moving), zero), "speed_cv"), r6(F.coalesce(F.max(F.col("step") * FPS), zero), "speed_max"), F.count_if(F.col("step") == 0).alias("zero_count"),
        F.round(F.coalesce(F.max("d2") * FPS**2, zero), 4).alias("peak_acceleration"), F.round(F.coalesce(F.max("d3") * FPS**3, zero), 3).alias("peak_jerk"),
    )


@query(f"""WITH {E_SQL}, {D_SQL}, {S_SQL}, c AS (SELECT episode, sqrt(pow(arg_max(lx,frame)-arg_min(lx,frame),2)+pow(arg_max(ly,frame)-arg_min(ly,frame),2)+pow(arg_max(lz,frame)-arg_min(lz,frame),2)) AS chord, sum(step) AS path, avg(coalesce(step,0)*30) AS m, median(coalesce(step,0)*30) AS md, max(coalesce(step,0)*30) AS mx FROM s GROUP BY episode),
t AS (SELECT episode, frame, dx/step AS ux, dy/step AS uy, dz/step AS uz FROM s WHERE step >= 0.001), a AS (SELECT episode, degrees(acos(greatest(least(ux*lag(ux) OVER w+uy*lag(uy) OVER w+uz*lag(uz) OVER w,1),-1))) AS turn FROM t {EP_SQL})
SELECT episode, round(path,6) AS path, round(chord,6) AS chord, round(chord/path,6) AS straightness, round(m,6) AS speed_mean, round(md,6) AS speed_median, round(mx,6) AS speed_max, round(turn,4) AS turn_sum FROM c JOIN (SELECT episode, sum(turn) AS turn FROM a GROUP BY episode) USING (episode)""")
def pose_path_metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path metrics with still frames counted, straightness and the sum of turns of steps over a millimetre."""
    f = poses(spark, sf_dir).withColumns({"step": series.speed(left(), 1.0), **{f"d{n}": F.col(f"l{n}") - F.lag(f"l{n}").over(series.ep()) for n in "xyz"}})
    ends = [F.max_by(c, "frame") - F.min_by(c, "frame") for c in ("lx", "ly", "lz")]
    rate = F.coalesce("step", F.lit(0.0)) * FPS
    whole = f.groupBy("episode").agg(F.sum("step").alias("path"), pose.norm(ends).alias("chord"), F.avg(rate).alias("m"), F.median(rate).alias("md"), F.max(rate).alias("mx"))
    way = pose.scaled(cols("dx", "dy", "dz"), 1 / F.col("step"))
    steps = f.where("step >= 0.001").select("episode", "frame", *(x.alias(n) for x, n in zip(way, "xyz", strict=True)))
    turn = F.degrees(F.acos(pose.clamp(pose.dot(cols(*"xyz"), series.lagged(cols(*"xyz"))))))
    turns = steps.withColumn("turn", turn).groupBy("episode").agg(F.sum("turn").alias("turn"))
    return whole.join(turns, "episode").select("episode", r6("path", "path"), r6("chord", "chord"), r6(F.col("chord") / F.col("path"), "straightness"), r6("m", "speed_mean"), r6("md", "speed_median"), r6("mx", "speed_max"), F.round("turn", 4).alias("turn_sum"))


@query(f"""WITH {E_SQL}, k AS (SELECT episode, unnest(range(1,65)) AS pos, frame, v FROM e), x AS (SELECT episode, frame, pos - 1 AS pos, v[pos]::DOUBLE AS x FROM k),
p AS (SELECT episode, pos, abs(x-lag(x) OVER w) AS d1, abs(x-2*lag(x) OVER w+lag(x,2) OVER w) AS d2, abs(x-3*lag(x) OVER w+3*lag(x,2) OVER w-lag(x,3) OVER w) AS d3 FROM x WINDOW w AS (PARTITION BY episode, pos ORDER BY frame))
SELECT episode, CAST(pos AS INTEGER) AS pos, round(max(d1),6) AS first_difference, round(max(d2),6) AS second_difference, round(max(d3),6) AS third_difference FROM p GROUP BY episode, pos""")
def dynamic_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest first, second and third differences of every component."""
    long = poses(spark, sf_dir).select("episode", "frame", F.posexplode("v").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy("episode", "pos").orderBy("frame")
    x, a, b, c = F.col("x"), *(F.lag("x", k).over(w) for k in (1, 2, 3))
    d = long.select("episode", "pos", F.abs(x - a).alias("d1"), F.abs(x - 2 * a + b).alias("d2"), F.abs(x - 3 * a + 3 * b - c).alias("d3"))
    return d.groupBy("episode", "pos").agg(r6(F.max("d1"), "first_difference"), r6(F.max("d2"), "second_difference"), r6(F.max("d3"), "third_difference"))


@query(f"""WITH {E_SQL}, n AS (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS m FROM e), u AS (SELECT episode, frame, qx/m AS x, qy/m AS y, qz/m AS z, qw/m AS q FROM n)
SELECT episode, frame, round(degrees(2*acos(least(abs(x*lag(x) OVER w+y*lag(y) OVER w+z*lag(z) OVER w+q*lag(q) OVER w),1))),6) AS angle FROM u {EP_SQL}""")
def quat_step_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation from the previous frame by quaternions."""
    f = poses(spark, sf_dir).select("episode", "frame", *(x.alias(n) for x, n in zip(pose.unit(quaternion()), "xyzq", strict=True)))
    return f.select("episode", "frame", r6(pose.quaternion_angle(cols(*"xyzq"), series.lagged(cols(*"xyzq"))), "angle"))


@query(f"""WITH {E_SQL}, a AS (SELECT episode, frame, qx, qy, qz, rx, ry, rz, sqrt(qx*qx+qy*qy+qz*qz) AS m FROM e), b AS (SELECT *, qx/m AS a1, qy/m AS a2, qz/m AS a3 FROM a), c AS (SELECT *, a1*rx+a2*ry+a3*rz AS p FROM b),
d AS (SELECT *, rx-p*a1 AS o1, ry-p*a2 AS o2, rz-p*a3 AS o3 FROM c), g AS (SELECT *, sqrt(o1*o1+o2*o2+o3*o3) AS k FROM d), h AS (SELECT episode, frame, a1, a2, a3, o1/k AS b1, o2/k AS b2, o3/k AS b3 FROM g),
i AS (SELECT *, a2*b3-a3*b2 AS c1, a3*b1-a1*b3 AS c2, a1*b2-a2*b1 AS c3 FROM h)
SELECT episode, frame, round(degrees(acos(greatest(least((a1*lag(a1) OVER w+a2*lag(a2) OVER w+a3*lag(a3) OVER w+b1*lag(b1) OVER w+b2*lag(b2) OVER w+b3*lag(b3) OVER w+c1*lag(c1) OVER w+c2*lag(c2) OVER w+c3*lag(c3) OVER w-1)/2,1),-1))),5) AS angle FROM i {EP_SQL}""")
def rot6d_step_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation from the previous frame by six-number rotations."""
    basis = [x for v in pose.rotation_basis([*cols("qx", "qy", "qz"), *right()]) for x in v]
    f = poses(spark, sf_dir).select("episode", "frame", *(x.alias(f"b{i}") for i, x in enumerate(basis)))
    now = [cols(*(f"b{i}" for i in range(k, k + 3))) for k in (0, 3, 6)]
    return f.select("episode", "frame", F.round(pose.basis_angle(now, [series.lagged(v) for v in now]), 5).alias("angle"))


VS_SQL = f"{E_SQL}, k AS (SELECT episode, unnest(range(1,65)) AS pos, v FROM e), x AS (SELECT episode, CAST(pos - 1 AS INTEGER) AS pos, v[pos]::DOUBLE AS x FROM k)"


@query(f"WITH {VS_SQL} SELECT episode, pos, round(min(x),6) AS min, round(max(x),6) AS max, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS std, count(x) AS count FROM x GROUP BY episode, pos")
def vector_stats_per_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each component by episode."""
    return stats.vector_stats(poses(spark, sf_dir), "v", ["episode"]).select("episode", "pos", *(r6(c, c) for c in ("min", "max", "mean", "std")), "count")


DIRECT_SQL = f"WITH {VS_SQL} SELECT pos, round(min(x),6) AS min, round(max(x),6) AS max, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS std, count(x) AS count FROM x GROUP BY pos"


@query(DIRECT_SQL)
def vector_stats_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all frames from those of the episodes."""
    return stats.pooled(stats.vector_stats(poses(spark, sf_dir), "v", ["episode"])).select("pos", *(r6(c, c) for c in ("min", "max", "mean", "std")), "count")


@query(DIRECT_SQL)
def vector_stats_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all frames at once."""
    return stats.vector_stats(poses(spark, sf_dir), "v", []).select("pos", *(r6(c, c) for c in ("min", "max", "mean", "std")), "count")


RUN_SQL = "r AS (SELECT episode, min(frame) AS start_frame, max(frame) + 1 AS end_frame, count(*) AS n FROM (SELECT episode, frame, frame - row_number() OVER (PARTITION BY episode ORDER BY frame) AS g FROM f WHERE value > 30) GROUP BY episode, g HAVING count(*) >= 3)"


@query(f"WITH {F_SQL}, {RUN_SQL} SELECT * FROM r")
def runs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three frames or more over a threshold."""
    return series.runs(signals(spark, sf_dir), F.col("value") > 30, 3)


@query(f"""WITH {F_SQL}, h AS (SELECT episode, frame, coalesce(last_value(CASE WHEN value < 20 THEN 'c' WHEN value > 60 THEN 'o' END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING), 'o') AS state FROM f),
t AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY episode ORDER BY frame), 'o') AS was FROM h) SELECT episode, frame, state FROM t WHERE state <> was""")
def hysteresis_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at which a two-threshold state changes."""
    held = signals(spark, sf_dir).withColumn("state", series.hysteresis(F.col("value"), 20, 60))
    return held.withColumn("was", F.coalesce(F.lag("state").over(series.ep()), F.lit("o"))).where("state <> was").select("episode", "frame", "state")


@query(f"""WITH {F_SQL}, d AS (SELECT *, abs(value - lag(value) OVER w) AS rate FROM f {EP_SQL}), g AS (SELECT *, frame - row_number() OVER (PARTITION BY episode ORDER BY frame) AS g FROM d WHERE rate > 20)
SELECT episode, min(frame) - 1 AS first_frame, max(frame) AS last_frame, round(max(rate), 6) AS peak FROM g GROUP BY episode, g HAVING max(rate) > 80""")
def event_intervals_min_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in which a signal keeps changing and once changes fast."""
    rated = signals(spark, sf_dir).withColumn("rate", F.abs(F.col("value") - F.lag("value").over(series.ep()))).where("rate > 20")
    island = F.col("frame") - F.row_number().over(series.ep())
    return rated.withColumn("g", island).groupBy("episode", "g").agg((F.min("frame") - 1).alias("first_frame"), F.max("frame").alias("last_frame"), r6(F.max("rate"), "peak")).where("peak > 80").drop("g")


@query(f"""WITH {F_SQL}, p AS (SELECT episode, frame, [least(greatest(frame + i, 0), n - 1) for i in [-2,-1,0,1,2]] AS ix, vals FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS n, list(value ORDER BY frame) OVER (PARTITION BY episode) AS vals FROM f))
SELECT episode, frame, round(list_sum([vals[i + 1] for i in ix]) / 5, 6) AS mean5 FROM p""")
def moving_mean_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred mean of five frames with repeated ends."""
    return signals(spark, sf_dir).select("episode", "frame", r6(series.moving_mean(F.col("value"), 5), "mean5"))


@query(f"""WITH {F_SQL}, p AS (SELECT episode, frame, [least(greatest(frame + i, 0), n - 1) for i in [-1,0,1]] AS ix, vals FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS n, list(value ORDER BY frame) OVER (PARTITION BY episode) AS vals FROM f))
SELECT episode, frame, list_sort([vals[i + 1] for i in ix])[2] AS median3 FROM p""")
def moving_median_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred median of three frames with repeated ends."""
    return signals(spark, sf_dir).select("episode", "frame", series.moving_median(F.col("value"), 3).alias("median3"))


@query(f"""WITH {F_SQL}, p AS (SELECT episode, frame, last_value(CASE WHEN value > 100 THEN frame END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS b, first_value(CASE WHEN value > 100 THEN frame END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM f)
SELECT episode, frame, CAST(least(frame - b, a - frame) AS BIGINT) AS distance FROM p""")
def distance_to_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to the nearest flag."""
    return signals(spark, sf_dir).select("episode", "frame", series.nearest_flag(F.col("value") > 100).cast("long").alias("distance"))


@query(f"""WITH {F_SQL}, p AS (SELECT episode, frame, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a, count(*) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n FROM f)
SELECT episode, min(frame) + 1 AS start_frame FROM p WHERE a >= 0.8 AND n = 5 GROUP BY episode""")
def forward_window_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First frame after which activity holds for five frames."""
    ahead = series.ep().rowsBetween(1, 5)
    f = signals(spark, sf_dir).withColumns({"a": F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).over(ahead), "n": F.count("*").over(ahead)})
    return f.where("a >= 0.8 and n = 5").groupBy("episode").agg((F.min("frame") + 1).alias("start_frame"))


@query(f"""WITH {E_SQL}, p AS (SELECT episode, frame, count(*) OVER (PARTITION BY episode) AS n FROM e), q AS (SELECT *, greatest(frame - 2, 0) AS i, least(frame + 2, n - 1) AS j FROM p)
SELECT q.episode, q.frame, round(CASE WHEN j > i THEN sqrt(pow(b.lx-a.lx,2)+pow(b.ly-a.ly,2)+pow(b.lz-a.lz,2))*30/(j-i) ELSE 0 END, 6) AS speed FROM q JOIN e a ON a.episode=q.episode AND a.frame=i JOIN e b ON b.episode=q.episode AND b.frame=j""")
def central_speed_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed over two frames on either side."""
    return poses(spark, sf_dir).select("episode", "frame", r6(series.central_speed(left(), 2, FPS), "speed"))


@query(f"""WITH {E_SQL}, p AS (SELECT episode, frame, count(*) OVER (PARTITION BY episode) AS n, lx, ly, lz FROM e), q AS (SELECT p.episode, p.frame, p.lx-a.lx AS x, p.ly-a.ly AS y, p.lz-a.lz AS z, b.lx-p.lx AS u, b.ly-p.ly AS v, b.lz-p.lz AS w FROM p JOIN e a ON a.episode=p.episode AND a.frame=greatest(p.frame-3,0) JOIN e b ON b.episode=p.episode AND b.frame=least(p.frame+3,n-1))
SELECT episode, frame, CASE WHEN x*x+y*y+z*z > 0 AND u*u+v*v+w*w > 0 THEN round(degrees(acos(greatest(least((x*u+y*v+z*w)/(sqrt(x*x+y*y+z*z)*sqrt(u*u+v*v+w*w)),1),-1))),5) END AS angle FROM q""")
def direction_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle between the ways in and out of each frame over three frames."""
    return poses(spark, sf_dir).select("episode", "frame", F.round(series.turn_angle(left(), 3), 5).alias("angle"))


@query(f"WITH {F_SQL}, p AS (SELECT episode, max(value) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) - value AS d FROM f) SELECT episode, round(max(d), 6) AS drawdown FROM p GROUP BY episode")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest fall below the maximum so far."""
    return signals(spark, sf_dir).withColumn("d", series.drawdown(F.col("value"))).groupBy("episode").agg(r6(F.max("d"), "drawdown"))


@query(f"""WITH {E_SQL}, {D_SQL}, k AS (SELECT *, abs(rx - lag(rx) OVER w) AS jx, abs(qw - lag(qw) OVER w) AS jq FROM d {EP_SQL}) SELECT episode, frame FROM k WHERE sqrt(dx*dx+dy*dy+dz*dz) <= 0.15 AND jx <= 0.2 AND jq <= 0.2""")
def static_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in which nothing moves beyond its threshold."""
    still = (series.speed(left(), 1.0) <= 0.15) & (F.abs(F.col("rx") - F.lag("rx").over(series.ep())) <= 0.2) & (F.abs(F.col("qw") - F.lag("qw").over(series.ep())) <= 0.2)
    return poses(spark, sf_dir).withColumn("still", still).where("still").select("episode", "frame")


@query(f"""WITH {F_SQL}, b AS (SELECT episode, median(value) FILTER (WHERE frame < 5) AS base, max(value) AS top FROM f GROUP BY episode), c AS (SELECT *, least(greatest(0.1*(top-base), 2), 5) AS tol FROM b WHERE top - base >= 10)
SELECT c.episode, min(f.frame) AS cut_frame FROM c JOIN f USING (episode) WHERE f.value >= top - tol GROUP BY c.episode""")
def lift_apex_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First frame near the highest value, where the rise over the first frames is large enough."""
    f = signals(spark, sf_dir)
    base = f.groupBy("episode").agg(F.median(F.when(F.col("frame") < 5, F.col("value"))).alias("base"), F.max("value").alias("top")).where("top - base >= 10")
    near = base.withColumn("near", F.col("top") - F.least(F.greatest(0.1 * (F.col("top") - F.col("base")), F.lit(2.0)), F.lit(5.0)))
    return f.join(near, "episode").where("value >= near").groupBy("episode").agg(F.min("frame").alias("cut_frame"))


@query("SELECT doc_id, sha256(text) AS digest, length(text) AS n FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))


@query(f"WITH {F_SQL}, t AS (SELECT episode, frame / 12.5::DOUBLE AS t, frame FROM f), a AS (SELECT episode, (count(*) - 1) / nullif(arg_max(t, frame) - arg_min(t, frame), 0) AS fps FROM t GROUP BY episode) SELECT episode, round(CASE WHEN abs(fps - round_even(fps, 0)) < 1e-4 THEN round_even(fps, 0) ELSE fps END, 6) AS fps FROM a")
def fps_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rate from the first and last timestamps, snapped to a whole number if near one."""
    t = signals(spark, sf_dir).withColumn("t", F.col("frame") / 12.5)
    rate = t.groupBy("episode").agg(((F.count("*") - 1) / F.nullif(F.max_by("t", "frame") - F.min_by("t", "frame"), F.lit(0.0))).alias("fps"))
    return rate.select("episode", r6(F.when(F.abs(F.col("fps") - F.rint("fps")) < 1e-4, F.rint("fps")).otherwise(F.col("fps")), "fps"))


@query(f"WITH {F_SQL} SELECT a.episode, count(*) AS pairs, CAST(count(*) FILTER (WHERE abs(a.value - b.value) <= 15) AS BIGINT) AS legal FROM f a JOIN f b ON a.episode = b.episode AND b.frame BETWEEN a.frame + 1 AND a.frame + 4 GROUP BY a.episode")
def band_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate skips of up to four frames, and the legal ones."""
    pairs = series.band_pairs(signals(spark, sf_dir), 4, ["value"])
    return pairs.groupBy("episode").agg(F.count("*").alias("pairs"), F.count_if(F.abs(F.col("value_i") - F.col("value_j")) <= 15).alias("legal"))


@query(f"WITH {F_SQL}, {RUN_SQL} SELECT episode, frame, value FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.episode = f.episode AND f.frame >= start_frame AND f.frame < end_frame)")
def interval_join_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames inside runs."""
    f = signals(spark, sf_dir)
    return series.in_intervals(f, series.runs(f, F.col("value") > 30, 3)).select("episode", "frame", "value")


@query("""WITH a AS (SELECT l_orderkey AS episode, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS episode, count(*) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT episode, n AS source_frames, m AS output_frames, round(n / 30.0::DOUBLE, 6) AS source_s, round(m / 30.0::DOUBLE, 6) AS output_s, round((1 - m / n::DOUBLE) * 100, 6) AS reduction_percent FROM a JOIN b USING (episode)""")
def before_after_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations before and after a selection."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), "l_returnflag")
    a, b = lines.groupBy("episode").agg(F.count("*").alias("n")), lines.where("l_returnflag = 'N'").groupBy("episode").agg(F.count("*").alias("m"))
    return a.join(b, "episode").select("episode", F.col("n").alias("source_frames"), F.col("m").alias("output_frames"), r6(F.col("n") / FPS, "source_s"), r6(F.col("m") / FPS, "output_s"), r6((1 - F.col("m") / F.col("n")) * 100, "reduction_percent"))


@query(f"WITH {F_SQL}, s AS (SELECT episode, frame FROM f WHERE value > 5) SELECT f.episode, f.frame FROM f ANTI JOIN s ON f.episode = s.episode AND f.frame = s.frame")
def anti_join_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a selection leaves out."""
    f = signals(spark, sf_dir).select("episode", "frame", "value")
    return f.join(f.where("value > 5").select("episode", "frame"), ["episode", "frame"], "left_anti").select("episode", "frame")


@query(f"WITH {F_SQL}, s AS (SELECT episode, frame AS source_frame, value, row_number() OVER (PARTITION BY episode ORDER BY frame) - 1 AS frame FROM f WHERE value > 25) SELECT episode, frame, source_frame, round(frame / 30.0::DOUBLE, 6) AS timestamp, value FROM s")
def semi_join_take_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected frames with dense numbers and rebuilt timestamps."""
    f = signals(spark, sf_dir)
    return series.taken(f, f.where("value > 25")).select("episode", "frame", "source_frame", r6(F.col("frame") / FPS, "timestamp"), "value")


@query(f"WITH {F_SQL}, n AS (SELECT episode, count(*) AS length FROM f GROUP BY episode) SELECT episode, length, row_number() OVER (ORDER BY episode) - 1 AS output_episode, CAST(coalesce(sum(length) OVER (ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def global_offset_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense episode numbers and where each begins in the dataset."""
    return series.with_offsets(signals(spark, sf_dir).groupBy("episode").agg(F.count("*").alias("length")))


@query(f"WITH {F_SQL}, m AS (SELECT *, value > 60 AS chosen FROM f) SELECT episode, frame, CAST(count(*) FILTER (WHERE chosen) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before, max(CASE WHEN chosen THEN frame END) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS at_or_before FROM m")
def asof_searchsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each frame among the selected ones."""
    f = signals(spark, sf_dir)
    return series.nearest_before(f.select("episode", "frame"), f.where("value > 60")).select("episode", "frame", "before", "at_or_before")


@query(f"WITH {F_SQL} SELECT episode, frame FROM f WHERE value > 60 UNION SELECT episode, frame FROM f WHERE event_type = 'error'")
def union_distinct_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected frames with restored ones, each once."""
    f = signals(spark, sf_dir)
    return f.where("value > 60").select("episode", "frame").union(f.where("event_type = 'error'").select("episode", "frame")).distinct()


@query("SELECT 'only_orders' AS side, count(*) AS n FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'only_lineitem', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) ANTI JOIN orders ON o_orderkey = l_orderkey")
def keyset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys only one of two tables has."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").agg(F.lit("only_orders").alias("side"), F.count("*").alias("n")).union(b.join(a, "k", "left_anti").agg(F.lit("only_lineitem"), F.count("*")))


@query(f"WITH {F_SQL}, t AS (SELECT * REPLACE (CASE WHEN value > 3 OR value < 1 THEN frame END AS frame), CASE WHEN value >= 1 THEN frame / 30.0::DOUBLE + CASE WHEN event_type = 'error' AND value > 90 THEN 0.001 ELSE 0 END END AS timestamp FROM f WHERE NOT (value > 250)), r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY frame NULLS FIRST) - 1 AS rank FROM t), v AS (SELECT episode, frame, CASE WHEN rank IS DISTINCT FROM frame THEN 'frame' WHEN timestamp IS NULL OR abs(timestamp - frame / 30.0::DOUBLE) > 1e-5 THEN 'timestamp' END AS reason FROM r) SELECT * FROM v WHERE reason IS NOT NULL")
def timeline_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-line breaches of a table with gaps, late timestamps, and nulls in both columns."""
    value = F.col("value")
    late = F.when((F.col("event_type") == "error") & (F.col("value") > 90), 0.001).otherwise(0.0)
    told = signals(spark, sf_dir).where("not (value > 250)").withColumn("timestamp", F.when(value >= 1, F.col("frame") / FPS + late))
    return checks.timeline(told.withColumn("frame", F.when((value > 3) | (value < 1), F.col("frame"))), FPS)


@query(f"WITH {E_SQL}, b AS (SELECT episode, CASE WHEN frame % 50 = 7 THEN NULL WHEN frame % 40 = 3 THEN v[1:60] ELSE v END AS v FROM e) SELECT episode, CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS unsound, CAST(count(*) FILTER (WHERE v IS NULL OR len(v) <> 64) AS BIGINT) AS wrong_width FROM b GROUP BY episode HAVING count(*) FILTER (WHERE v IS NULL OR len(v) <> 64) > 0")
def vector_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsound and short vectors of a table with both."""
    v = F.when(F.col("frame") % 50 == 7, None).when(F.col("frame") % 40 == 3, F.slice("v", 1, 60)).otherwise(F.col("v"))
    return checks.vectors(poses(spark, sf_dir).withColumn("v", v), "v", 64)


@query("WITH c AS (SELECT l_orderkey AS episode, count(*) AS n_rows FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS episode, 4::BIGINT AS length FROM orders) SELECT episode, length, n_rows FROM o FULL JOIN c USING (episode) WHERE length IS DISTINCT FROM n_rows")
def episode_meta_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared lengths that rows don't bear out."""
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), F.lit(4).cast("long").alias("length"))
    return checks.episode_lengths(declared, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode")))


@query("SELECT o_custkey, count(*) AS n FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY o_custkey")
def task_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a dimension lacks."""
    return checks.orphans(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query("""WITH m AS (SELECT conv_id AS episode, CASE WHEN conv_id % 11 <> 3 OR turn <> 1 THEN turn END AS output_frame, CASE WHEN conv_id % 7 <> 2 OR turn <> 1 THEN turn * 2 - CASE WHEN role = 'system' AND turn > 0 THEN 5 ELSE 0 END END AS source_frame FROM conversations),
k AS (SELECT episode, output_frame IS NOT DISTINCT FROM row_number() OVER w - 1 AS dense, coalesce(source_frame IS NOT NULL AND (row_number() OVER w = 1 OR source_frame > lag(source_frame) OVER w), false) AS rising FROM m WINDOW w AS (PARTITION BY episode ORDER BY output_frame NULLS FIRST)) SELECT episode, count(*) AS n, bool_and(dense AND rising) AS valid FROM k GROUP BY episode""")
def source_map_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source maps are dense and rising; some hold nulls."""
    shift = F.when((F.col("role") == "system") & (F.col("turn") > 0), 5).otherwise(0)
    known = lambda by, left: (F.col("conv_id") % by != left) | (F.col("turn") != 1)
    return checks.source_map(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), F.when(known(11, 3), F.col("turn")).alias("output_frame"), F.when(known(7, 2), F.col("turn") * 2 - shift).alias("source_frame")))


@query(f"WITH {F_SQL}, n AS (SELECT episode, count(*) / 30.0::DOUBLE AS d FROM f GROUP BY episode) (SELECT 'longest' AS which, episode, round(d,6) AS duration_s FROM n ORDER BY d DESC, episode LIMIT 3) UNION ALL (SELECT 'shortest', episode, round(d,6) FROM n ORDER BY d, episode LIMIT 3)")
def top3_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest and shortest episodes; ties by number."""
    n = signals(spark, sf_dir).groupBy("episode").agg((F.count("*") / FPS).alias("d"))
    part = lambda name, *order: n.orderBy(*order, "episode").limit(3).select(F.lit(name).alias("which"), "episode", r6("d", "duration_s"))
    return part("longest", F.desc("d")).union(part("shortest", F.asc("d")))


@query(f"""WITH {F_SQL}, n AS (SELECT episode, count(*) / 30.0::DOUBLE AS source_s, count(*) FILTER (WHERE value > 10) / 30.0::DOUBLE AS output_s FROM f GROUP BY episode), k AS (SELECT *, row_number() OVER (ORDER BY episode DESC) AS rank FROM n), g AS (SELECT 'all' AS grp, * FROM k UNION ALL SELECT CASE WHEN rank <= 50 THEN 'last50' ELSE 'before_last50' END, * FROM k)
SELECT grp, count(*) AS n, round(avg(output_s),6) AS mean_s, round(median(output_s),6) AS median_s, round(stddev_pop(output_s),6) AS std_s, round(min(output_s),6) AS min_s, round(max(output_s),6) AS max_s, round((1-sum(output_s)/sum(source_s))*100,6) AS reduction_percent, round(min((1-output_s/source_s)*100),6) AS least_reduction_percent, bool_and(output_s < source_s) AS all_shorter FROM g GROUP BY grp""")
def duration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations over all, the last fifty and earlier episodes."""
    n = signals(spark, sf_dir).groupBy("episode").agg((F.count("*") / FPS).alias("source_s"), (F.count_if(F.col("value") > 10) / FPS).alias("output_s"))
    return stats.duration_groups(n).select("grp", "n", *(r6(c, c) for c in ("mean_s", "median_s", "std_s", "min_s", "max_s", "reduction_percent", "least_reduction_percent")), "all_shorter")


CLASS_SQL = f"{F_SQL}, m AS (SELECT episode, greatest(0.35 * median(value), 1e-4) AS t FROM f GROUP BY episode), c AS (SELECT episode, frame, CASE WHEN value > t THEN 'moving' ELSE 'still' END AS activity FROM f JOIN m USING (episode))"


@query(f"WITH {CLASS_SQL} SELECT * FROM c")
def activity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over or under a share of their episode's median."""
    f = signals(spark, sf_dir)
    level = f.groupBy("episode").agg(F.greatest(0.35 * F.median("value"), F.lit(1e-4)).alias("t"))
    return f.join(level, "episode").select("episode", "frame", F.when(F.col("value") > F.col("t"), "moving").otherwise("still").alias("activity"))


@query(f"WITH {CLASS_SQL}, g AS (SELECT *, frame - row_number() OVER (PARTITION BY episode, activity ORDER BY frame) AS g FROM c) SELECT episode, activity, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM g GROUP BY episode, activity, g")
def activity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one activity."""
    g = F.col("frame") - F.row_number().over(Window.partitionBy("episode", "activity").orderBy("frame"))
    return activity_classes(spark, sf_dir).withColumn("g", g).groupBy("episode", "activity", "g").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame")).drop("g")


@query(f"WITH {E_SQL} SELECT episode, round(avg(rx-lx),6) AS x, round(avg(ry-ly),6) AS y, round(avg(rz-lz),6) AS z, arg_max(frame, pow(rx-lx,2)+pow(ry-ly,2)+pow(rz-lz,2)) AS widest_frame FROM e GROUP BY episode")
def camera_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean offset of the arms and the frame where they are widest apart."""
    d = pose.minus(right(), left())
    return poses(spark, sf_dir).groupBy("episode").agg(*(r6(F.avg(x), n) for x, n in zip(d, "xyz", strict=True)), F.max_by("frame", pose.dot(d, d)).alias("widest_frame"))


@query(f"WITH {F_SQL}, g AS (SELECT episode, frame, frame - row_number() OVER (PARTITION BY episode ORDER BY frame) AS g FROM f WHERE value > 15) SELECT episode, string_agg(r, ',' ORDER BY a) AS ranges FROM (SELECT episode, min(frame) AS a, CASE WHEN min(frame) = max(frame) THEN CAST(min(frame) AS VARCHAR) ELSE min(frame) || '-' || max(frame) END AS r FROM g GROUP BY episode, g) GROUP BY episode")
def consecutive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected frame numbers as a list of ranges."""
    one = series.runs(signals(spark, sf_dir), F.col("value") > 15).withColumn("b", F.col("end_frame") - 1)
    text = F.when(F.col("start_frame") == F.col("b"), F.col("start_frame").cast("string")).otherwise(F.concat_ws("-", "start_frame", "b"))
    return one.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("start_frame", text.alias("r")))).alias("all")).select("episode", F.array_join(F.transform("all", lambda s: s["r"]), ",").alias("ranges"))


@query(f"WITH {F_SQL}, c AS (SELECT episode, frame, event_type <> lag(event_type) OVER w AS a, event_type <> lead(event_type) OVER w AS b FROM f {EP_SQL}) SELECT episode, frame FROM c WHERE a OR b")
def label_transition_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames on either side of a label change."""
    label = F.col("event_type")
    edge = F.coalesce(label != F.lag(label).over(series.ep()), F.lit(False)) | F.coalesce(label != F.lead(label).over(series.ep()), F.lit(False))
    return signals(spark, sf_dir).withColumn("edge", edge).where("edge").select("episode", "frame")


@query(f"WITH {E_SQL} SELECT episode, round(median(lx),6) AS x, round(median(ly),6) AS y, round(median(lz),6) AS z FROM e WHERE frame BETWEEN 5 AND 14 GROUP BY episode")
def contact_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median position over a short range of frames."""
    return poses(spark, sf_dir).where("frame between 5 and 14").groupBy("episode").agg(*(r6(F.median(c), n) for c, n in zip(left(), "xyz", strict=True)))


@query("SELECT conv_id, sha256(string_agg(md5(text), chr(10) ORDER BY turn, md5(text))) AS digest FROM conversations GROUP BY conv_id")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each conversation's turns in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("h")))).alias("t"))
    return turns.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda s: s["h"]), "\n"), 256).alias("digest"))


@query("SELECT p_partkey, round(CAST(split_part(r,'/',1) AS DOUBLE)/CAST(split_part(r,'/',2) AS DOUBLE),6) AS fps FROM (SELECT p_partkey, (p_size*1000)||'/'||(1001) AS r FROM part)")
def fps_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rates given as fractions."""
    rate = F.split(F.concat_ws("/", F.col("p_size") * 1000, F.lit(1001)), "/")
    return table(spark, sf_dir, "part").select("p_partkey", r6(rate[0].cast("double") / rate[1].cast("double"), "fps"))


@query(f"WITH {F_SQL} SELECT event_type AS phase, count(*) AS frames_before, CAST(count(*) FILTER (WHERE value > 25) AS BIGINT) AS frames_after, round(avg(value) FILTER (WHERE value > 25),6) AS mean_fast, round(avg(CASE WHEN value BETWEEN 25 AND 75 THEN 1.0 ELSE 0.0 END),6) AS in_target FROM f GROUP BY event_type")
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean and share in the target range of each phase."""
    fast, between = F.when(F.col("value") > 25, F.col("value")), F.when(F.col("value").between(25, 75), 1.0).otherwise(0.0)
    return signals(spark, sf_dir).groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("frames_before"), F.count(fast).alias("frames_after"), r6(F.avg(fast), "mean_fast"), r6(F.avg(between), "in_target"))


GRIP_SQL = f"""{F_SQL}, h AS (SELECT episode, frame, value, coalesce(last_value(CASE WHEN value < 1.5 THEN 'c' WHEN value > 90 THEN 'o' END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING), 'o') AS mode,
 coalesce(abs(value - lag(value) OVER w) > 15, false) AS moves FROM f {EP_SQL}), t AS (SELECT *, mode <> lag(mode, 1, 'o') OVER w AS turns, coalesce(lead(moves) OVER w, false) AS moves_on FROM h {EP_SQL}),
 k AS (SELECT episode, count(*) AS n, min(frame) FILTER (WHERE turns AND mode = 'c') AS c, min(frame) FILTER (WHERE turns AND mode = 'o') AS o FROM t GROUP BY episode HAVING count(*) FILTER (WHERE turns) = 2),
 e AS (SELECT episode, n, 'close' AS kind, c AS x FROM k UNION ALL SELECT episode, n, 'open', o FROM k)"""


@query(f"""WITH {GRIP_SQL} SELECT e.episode, e.kind, e.x AS trigger, greatest(max(frame) FILTER (WHERE frame <= greatest(x - 1, 0) AND NOT moves) - 3, 0) AS first_frame,
 least(min(frame) FILTER (WHERE frame >= least(x + 1, n - 1) AND NOT moves_on) + 3, n - 1) AS last_frame FROM e JOIN t ON e.episode = t.episode GROUP BY e.episode, e.kind, e.x, e.n""")
def gripper_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close and open events of episodes whose signal closes once and then opens once."""
    value = F.col("value")
    rules = single_arm.Rules(closed=1.5, open=90, active_gripper=15)
    found = single_arm.gripper_events(signals(spark, sf_dir).select("episode", "frame", "value"), rules, 10.0, value, value).where("certain and frame = 0")
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(e).alias("trigger"), F.col(f"{e}0").alias("first_frame"), F.col(f"{e}1").alias("last_frame")) for k, e in (("close", "c"), ("open", "o")))))
    return found.select("episode", ends.alias("e")).select("episode", "e.kind", "e.trigger", "e.first_frame", "e.last_frame")


@query(f"""WITH {F_SQL}, p AS (SELECT episode AS video, frame AS packet, frame / 30.0::DOUBLE + CASE WHEN value > 90 THEN 0.003 ELSE 0 END AS pts, CASE WHEN value > 60 AND value < 62 THEN frame / 30.0::DOUBLE - 0.01 END AS dts, CASE WHEN value < 1 THEN NULL ELSE frame % 4 = 0 OR value > 30 END AS key FROM f),
m0 AS (SELECT *, row_number() OVER w = 1 OR pts > lag(pts) OVER w AS up FROM p WINDOW w AS (PARTITION BY video ORDER BY packet)), m AS (SELECT *, bool_and(coalesce(up, false)) OVER (PARTITION BY video) AS rises FROM m0), s AS (SELECT DISTINCT episode AS video, frame // 4 AS episode_index, (frame // 4) * 4 / 30.0::DOUBLE AS a, ((frame // 4) * 4 + 4) / 30.0::DOUBLE + CASE WHEN episode % 9 = 0 THEN 0.1 ELSE 0 END AS b, 4 AS length FROM f),
j AS (SELECT s.*, m.pts, m.dts, m.key, m.rises FROM s LEFT JOIN m ON s.video = m.video AND m.pts >= a - 1e-5 AND m.pts < a + 3.5 / 30.0::DOUBLE),
r AS (SELECT *, abs(pts - a - (row_number() OVER (PARTITION BY video, episode_index ORDER BY pts) - 1) / 30.0::DOUBLE) <= 1e-5 AS placed, abs(coalesce(dts, pts) - pts) < 1e-5 AS ordered FROM j),
g AS (SELECT video, episode_index, any_value(length) AS length, any_value(a) AS a, any_value(b) AS b, count(pts) AS n, bool_and(coalesce(rises, false)) AS rises, bool_and(coalesce(placed, false)) AS placed, bool_and(coalesce(ordered, false)) AS ordered, arg_min_null(key, pts) AS key FROM r GROUP BY video, episode_index),
t AS (SELECT video, episode_index, CASE WHEN n <> length THEN 'packets' WHEN abs((b - a) * 30 - length) >= 1e-4 THEN 'duration' WHEN NOT rises THEN 'times' WHEN NOT ordered THEN 'order' WHEN NOT placed THEN 'alignment' WHEN NOT coalesce(key, false) THEN 'key frame' END AS reason FROM g) SELECT * FROM t WHERE reason IS NOT NULL""")
def packet_slice_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of four frames that can't be cut from a video of late, re-ordered and missing packets."""
    f = signals(spark, sf_dir)
    at = F.col("frame") / FPS
    packets = f.select(F.col("episode").alias("video"), F.col("frame").alias("packet"), (at + F.when(F.col("value") > 90, 0.003).otherwise(0.0)).alias("pts"), F.when((F.col("value") > 60) & (F.col("value") < 62), at - 0.01).alias("dts"), F.when(F.col("value") >= 1, (F.col("frame") % 4 == 0) | (F.col("value") > 30)).alias("key"))
    first = F.floor(F.col("frame") / 4) * 4
    slices = f.select(F.col("episode").alias("video"), (first / 4).cast("long").alias("episode_index"), (first / FPS).alias("from_timestamp"), ((first + 4) / FPS + F.when(F.col("episode") % 9 == 0, 0.1).otherwise(0.0)).alias("to_timestamp"), F.lit(4).alias("length")).distinct()
    return convert.slice_breaches(packets, slices, FPS)


@query(f"""WITH {F_SQL}, q AS (SELECT episode, frame, n, [least(greatest(frame + i, 0), n - 1) for i in [-2,-1,0,1,2]] AS ix, vals FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS n, list(value ORDER BY frame) OVER (PARTITION BY episode) AS vals FROM f)),
h AS (SELECT episode, frame, n, (0.7::DOUBLE * 0.001 + 0.3::DOUBLE * 0.002) * list_sum([vals[i + 1] for i in ix]) / 5 AS height, frame >= 2 AND n - 1 > 2 AS inside FROM q),
t AS (SELECT episode, max(height) FILTER (WHERE inside) AS top, max(height) FILTER (WHERE inside) - median(height) FILTER (WHERE inside AND frame < 7) AS rise FROM h GROUP BY episode)
SELECT h.episode, min(frame) FILTER (WHERE inside AND rise >= 0.01 AND height >= top - greatest(0.002, least(0.005, rise * 0.1))) AS apex FROM h JOIN t USING (episode) GROUP BY h.episode""")
def lift_apex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apex of each episode's smoothed height from the third frame on."""
    f = signals(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("episode")))
    return single_arm.apex(f, single_arm.Rules(), F.col("value") * 0.001, F.col("value") * 0.002, F.lit(2), F.col("n") - 1).groupBy("episode").agg(F.min("apex").alias("apex"))


PLAN_SQL = "least(frame // 40, 4) AS phase, frame % 3 <> 1 AS kept, CASE WHEN frame > 190 THEN 'discarded_after_lift_apex' ELSE 'kept' END AS reason, CASE WHEN frame % 17 = 0 THEN 'contact' ELSE '' END AS protection"


@query(f"""WITH {E_SQL}, p AS (SELECT episode, frame, lx, ly, lz, {PLAN_SQL} FROM e), j AS (SELECT *, sum(CASE WHEN protection <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY frame) AS held FROM p WHERE reason <> 'discarded_after_lift_apex'),
k AS (SELECT *, protection = '' AND lag(protection) OVER w = '' AND held = lag(held) OVER w AS free, sqrt(pow(lx-lag(lx) OVER w,2)+pow(ly-lag(ly) OVER w,2)+pow(lz-lag(lz) OVER w,2))*10 AS speed FROM j WHERE kept WINDOW w AS (PARTITION BY episode, phase ORDER BY frame)),
s AS (SELECT episode, phase, count(*) AS frames_after, avg(speed) FILTER (WHERE free) AS mean_speed, CAST(count(speed) FILTER (WHERE free) AS BIGINT) AS pairs FROM k GROUP BY episode, phase), b AS (SELECT episode, phase, count(*) AS frames_before, min(frame) AS first, max(frame) AS final FROM j GROUP BY episode, phase)
SELECT episode, CAST(phase AS BIGINT) AS phase, frames_before, first, final, frames_after, round(mean_speed, 6) AS mean_speed, pairs, round(coalesce(frames_after, 0) / frames_before::DOUBLE, 6) AS retained, CASE WHEN phase IN (0, 2, 4) THEN abs(mean_speed - 14) <= 0.5 END AS target_met FROM b LEFT JOIN s USING (episode, phase)""")
def phase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, speeds and whether the target is met in each phase of a made selection."""
    e = poses(spark, sf_dir)
    plan = e.select("episode", "frame", F.least(F.floor(F.col("frame") / 40), F.lit(4)).cast("long").alias("phase"), (F.col("frame") % 3 != 1).alias("kept"), F.when(F.col("frame") > 190, "discarded_after_lift_apex").otherwise("kept").alias("reason"), F.when(F.col("frame") % 17 == 0, "contact").otherwise("").alias("protection"))
    told = single_arm.phase_report(plan, e.select("episode", "frame", F.array("lx", "ly", "lz").alias("state")), single_arm.Rules(target_speed=14, speed_tolerance=0.5), 10.0)
    return told.select("episode", "phase", "frames_before", "first", "final", "frames_after", r6("mean_speed", "mean_speed"), "pairs", r6("retained", "retained"), "target_met")


@query(f"""WITH {F_SQL}, c AS (SELECT episode, frame + CASE WHEN value > 150 THEN 100000 ELSE 0 END AS frame FROM f WHERE value > 25 UNION ALL SELECT episode, frame FROM f WHERE value > 120 AND value <= 150), l AS (SELECT episode, max(frame) AS last FROM c GROUP BY episode)
SELECT episode, frame, 'unknown' AS reason FROM c ANTI JOIN f USING (episode, frame) UNION ALL SELECT episode, frame, 'twice' FROM c GROUP BY episode, frame HAVING count(*) > 1
UNION ALL SELECT p.episode, p.frame, 'protected' FROM (SELECT f.episode, f.frame FROM f LEFT JOIN l USING (episode) WHERE event_type = 'error' AND (last IS NULL OR frame <= last)) p ANTI JOIN c ON p.episode = c.episode AND p.frame = c.frame""")
def selection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of a selection that names unknown frames, some twice, and leaves protected ones out."""
    f = signals(spark, sf_dir)
    far = F.col("frame") + F.when(F.col("value") > 150, 100000).otherwise(0)
    chosen = f.where("value > 25").select("episode", far.cast("long").alias("frame")).union(f.where("value > 120 and value <= 150").select("episode", "frame"))
    return checks.selection(f, chosen, f.where("event_type = 'error'"))


@query(f"""WITH {E_SQL}, x AS (SELECT episode, 'v' AS feature, v[1]::DOUBLE AS x, 64 AS width FROM e UNION ALL SELECT episode, 'lz', lz, 1 FROM e)
SELECT episode, feature, CAST(any_value(width) AS INTEGER) AS width, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS count FROM x GROUP BY episode, feature""")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a vector's first component and of a scalar, by episode."""
    told = convert.feature_stats(poses(spark, sf_dir), ["v", "lz"], ["episode"])
    return told.select("episode", "feature", F.size("mean").alias("width"), *(r6(F.col(c)[0], c) for c in ("min", "max", "mean", "std")), F.col("count")[0].alias("count"))


@query(f"""WITH {F_SQL}, r AS (SELECT episode, frame, 'still' AS reason FROM f WHERE value <= 10 UNION ALL SELECT episode, frame, 'error' FROM f WHERE event_type = 'error' UNION ALL SELECT episode, frame, 'still' FROM f WHERE value <= 2),
g AS (SELECT episode, frame, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reason FROM r GROUP BY episode, frame)
SELECT f.episode AS episode_index, f.frame AS frame_index, value > 25 AS kept, CASE WHEN value > 25 THEN 'kept' ELSE g.reason END AS reason, event_type AS phase FROM f LEFT JOIN g ON f.episode = g.episode AND f.frame = g.frame""")
def deletion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames a selection keeps, why others go, and their phase."""
    f = signals(spark, sf_dir).select(F.col("episode").alias("episode_index"), F.col("frame").alias("frame_index"), "value", F.col("event_type").alias("phase"))
    why = lambda when, name: f.where(when).select("episode_index", "frame_index", F.lit(name).alias("reason"))
    return datasets.deletion_log(f, f.where("value > 25"), why("value <= 10", "still").union(why("phase = 'error'", "error")).union(why("value <= 2", "still")))


@query(f"""WITH {F_SQL}, p AS (SELECT episode, count(*) AS s, count(*) FILTER (WHERE frame < 12) AS a, count(*) FILTER (WHERE frame < 12 AND value > 25) AS o, count(*) FILTER (WHERE value > 120) AS w, bool_or(frame >= 12) AS t, count(*) FILTER (WHERE value > 90) AS j FROM f GROUP BY episode)
SELECT count(*) AS total_episodes, CAST(sum(s) AS BIGINT) AS source_frames, CAST(sum(a) AS BIGINT) AS active_frames, CAST(sum(o) AS BIGINT) AS output_frames, CAST(count(*) FILTER (WHERE w > 0) AS BIGINT) AS ambiguous_episodes, CAST(count(*) FILTER (WHERE t) AS BIGINT) AS truncated_episodes, CAST(sum(j) AS BIGINT) AS inherited_jumps,
round(1 - sum(o) / sum(s)::DOUBLE, 6) AS frame_reduction_fraction, CAST(sum(s) - sum(a) AS BIGINT) AS discarded_frames, round(sum(s) / 30.0::DOUBLE, 6) AS source_duration_s, round(sum(a) / 30.0::DOUBLE, 6) AS active_duration_s, round(sum(o) / 30.0::DOUBLE, 6) AS output_duration_s FROM p""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a selection over all episodes."""
    episodes = signals(spark, sf_dir).groupBy("episode").agg(F.count("*").alias("source_frames"), F.count_if(F.expr("frame < 12")).alias("active_frames"), F.count_if(F.expr("frame < 12 and value > 25")).alias("output_frames"), F.count_if(F.expr("value > 120")).alias("warnings"), F.max(F.col("frame") >= 12).alias("truncated"), F.count_if(F.expr("value > 90")).alias("inherited_jumps"))
    told = stats.dataset_summary(episodes, FPS)
    rounded = ("frame_reduction_fraction", "source_duration_s", "active_duration_s", "output_duration_s")
    return told.select(*(r6(c, c) if c in rounded else c for c in told.columns))


ARMS_SQL = "a AS (SELECT episode, frame, CASE episode % 3 WHEN 0 THEN rx - lx WHEN 1 THEN (frame % 2 * 2 - 1) * 0.5 ELSE 0 END AS x, CASE episode % 3 WHEN 0 THEN ry - ly WHEN 1 THEN (frame % 2 * 2 - 1) * 0.25 ELSE 0 END AS y FROM e WHERE frame < 10)"


@query(f"""WITH {E_SQL}, {ARMS_SQL}, m AS (SELECT episode, avg(x) AS x, avg(y) AS y, max(sqrt(x*x+y*y)) AS w, arg_max(x, (sqrt(x*x+y*y), -frame)) AS wx, arg_max(y, (sqrt(x*x+y*y), -frame)) AS wy FROM a GROUP BY episode),
t AS (SELECT episode, greatest(1e-9, w * 1e-6) AS least, CASE WHEN sqrt(x*x+y*y) <= greatest(1e-9, w * 1e-6) THEN wx ELSE x END AS x, CASE WHEN sqrt(x*x+y*y) <= greatest(1e-9, w * 1e-6) THEN wy ELSE y END AS y FROM m)
SELECT episode, round(CASE WHEN sqrt(x*x+y*y) > least THEN 1.8 * y / sqrt(x*x+y*y) ELSE 1.25 END::DOUBLE, 6) AS x, round(CASE WHEN sqrt(x*x+y*y) > least THEN -1.8 * x / sqrt(x*x+y*y) ELSE 1.25 END::DOUBLE, 6) AS y, 0.9::DOUBLE AS z FROM t""")
def camera_eye(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras of arms that are apart, apart only in some frames, and one."""
    side, kind = F.col("frame") % 2 * 2 - 1, F.col("episode") % 3
    apart = {n: F.when(kind == 0, F.col(f"r{n}") - F.col(f"l{n}")).when(kind == 1, side * far).otherwise(0.0) for n, far in (("x", 0.5), ("y", 0.25))}
    made = poses(spark, sf_dir).where("frame < 10").select("episode", "frame", *(F.lit(0.0).alias(f"l{n}") for n in "xyz"), *(x.alias(f"r{n}") for n, x in apart.items()), F.lit(0.0).alias("rz"))
    return stats.camera_eye(made).select("episode", r6("x", "x"), r6("y", "y"), "z")


@query(f"""WITH {E_SQL}, p AS (SELECT episode, frame, count(*) OVER (PARTITION BY episode) AS n, lx, ly, lz FROM e), q AS (SELECT p.episode, p.frame, p.lx-a.lx AS x, p.ly-a.ly AS y, p.lz-a.lz AS z, b.lx-p.lx AS u, b.ly-p.ly AS v, b.lz-p.lz AS w FROM p JOIN e a ON a.episode=p.episode AND a.frame=greatest(p.frame-3,0) JOIN e b ON b.episode=p.episode AND b.frame=least(p.frame+3,n-1))
SELECT episode, frame, round(least(sqrt(x*x+y*y+z*z), sqrt(u*u+v*v+w*w)), 6) AS excursion FROM q""")
def turn_excursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shorter of the ways in and out of each frame over three frames."""
    return poses(spark, sf_dir).select("episode", "frame", r6(series.excursion(left(), 3), "excursion"))


@query(f"""WITH {E_SQL}, d AS (SELECT episode, frame, count(*) OVER (PARTITION BY episode) AS n, rx-lag(rx) OVER w AS x, ry-lag(ry) OVER w AS y, rz-lag(rz) OVER w AS z, sqrt(pow(lx-lag(lx) OVER w,2)+pow(ly-lag(ly) OVER w,2)+pow(lz-lag(lz) OVER w,2)) AS rest FROM e {EP_SQL}), s AS (SELECT *, sqrt(x*x+y*y+z*z) AS size FROM d),
t AS (SELECT episode, frame, n, avg(x/greatest(size,1e-12)) OVER v AS mx, avg(y/greatest(size,1e-12)) OVER v AS my, avg(z/greatest(size,1e-12)) OVER v AS mz, avg(CASE WHEN size*30 > 30 THEN 1.0 ELSE 0.0 END) OVER v AS fast, avg(CASE WHEN rest*30 <= 60 THEN 1.0 ELSE 0.0 END) OVER v AS still,
 avg(CASE WHEN size*30 > 30 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN 4 FOLLOWING AND 6 FOLLOWING) AS later FROM s WINDOW v AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
g AS (SELECT t.episode, t.frame FROM t JOIN s ON s.episode = t.episode AND s.frame BETWEEN t.frame + 1 AND t.frame + 3 WHERE t.frame < t.n - 6 AND fast >= 0.75 AND still >= 0.75 AND sqrt(mx*mx+my*my+mz*mz) >= 0.4 AND later >= 0.55 GROUP BY t.episode, t.frame HAVING min((s.x*mx+s.y*my+s.z*mz)/greatest(sqrt(mx*mx+my*my+mz*mz),1e-12)) >= -0.8)
SELECT e.episode, coalesce(any_value(a.first), 0) AS start_frame FROM e LEFT JOIN (SELECT episode, min(frame) + 1 AS first FROM g GROUP BY episode) a ON a.episode = e.episode GROUP BY e.episode""")
def start_of_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First frame from which the right arm keeps moving one way while the left one rests."""
    return series.starts(poses(spark, sf_dir), right(), left(), FPS, 3, 3, 30.0, 60.0, 0.4, 0.8)


@query("SELECT * FROM (SELECT 'total_episodes' AS name, 1::BIGINT AS declared, count(DISTINCT l_orderkey) AS found FROM lineitem UNION ALL SELECT 'total_frames', (SELECT count(*) FROM lineitem), count(*) FROM lineitem UNION ALL SELECT 'total_tasks', NULL, count(*) FROM part) WHERE declared IS DISTINCT FROM found")
def totals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared totals that the rows don't bear out, one of them null."""
    lines = table(spark, sf_dir, "lineitem")
    declared = lines.agg(F.lit(1).alias("total_episodes"), F.count("*").alias("total_frames"), F.lit(None).cast("long").alias("total_tasks"))
    return checks.totals(declared, lines, table(spark, sf_dir, "part"), "l_orderkey")


@query(f"WITH {F_SQL} SELECT episode, count(*) AS n FROM f GROUP BY episode HAVING count(*) < 8 OR count(*) > 12")
def row_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with too few or too many frames."""
    return checks.limits(signals(spark, sf_dir), 8, 12)


@query("SELECT 'data/chunk-' || lpad(CAST(o_custkey % 3 AS VARCHAR), 3, '0') || '/file-' || lpad(CAST(o_custkey % 40 AS VARCHAR), 3, '0') || '.parquet' AS file, count(*) AS n, min(o_orderkey) AS first_episode, max(o_orderkey) AS last_episode FROM orders GROUP BY o_custkey % 3, o_custkey % 40")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by the file that holds them."""
    episodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_index"), (F.col("o_custkey") % 3).alias("data/chunk_index"), (F.col("o_custkey") % 40).alias("data/file_index"))
    return convert.file_groups(episodes).select("file", "n", F.element_at("episodes", 1).alias("first_episode"), F.element_at("episodes", -1).alias("last_episode"))


@query(f"""WITH {E_SQL}, {D_SQL}, c AS (SELECT episode, arg_max(lx, frame) - arg_min(lx, frame) AS x, arg_max(ly, frame) - arg_min(ly, frame) AS y, arg_max(lz, frame) - arg_min(lz, frame) AS z FROM e GROUP BY episode)
SELECT d.episode, round(sum(greatest(-(dx*x+dy*y+dz*z)/greatest(sqrt(x*x+y*y+z*z),1e-12),0)), 6) AS backtrack FROM d JOIN c ON d.episode = c.episode WHERE dx IS NOT NULL GROUP BY d.episode""")
def path_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each path goes back along the line from its first to its last point."""
    return series.backtrack(poses(spark, sf_dir), ["lx", "ly", "lz"]).select("episode", r6("backtrack", "backtrack"))
