"""Queries that exercise skips, peaks, segments, phases and checks against the source, each with the SQL that DuckDB answers alike.

Frames are those of :mod:`framelake.queries`: embeddings as poses, events as scalar signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import pose
from framelake.operators import peaks, series
from framelake.plans import segments, skips
from framelake.queries import E_SQL, F_SQL, Query, cols, left, poses, quaternion, r6, right, signals, table
from framelake.sources import convert

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LEFT, RIGHT = ["lx", "ly", "lz"], ["rx", "ry", "rz"]


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def registered(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return registered


def minus(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b, strict=True)]


def dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def of(table: str, names: list[str]) -> list[str]:
    return [f"{table}.{n}" for n in names]


def length(a: list[str]) -> str:
    return f"sqrt({dot(a, a)})"


def off_segment(p: list[str], a: list[str], b: list[str]) -> str:
    """SQL of the distance of a point to a segment."""
    along = minus(b, a)
    t = f"greatest(least({dot(minus(p, a), along)} / greatest({dot(along, along)}, 1e-20), 1), 0)"
    return length([f"({x} - {t} * {d})" for x, d in zip(minus(p, a), along, strict=True)])


SKIPS = dict(max_step=0.3, max_rotation=250.0, deviation=0.17)
SKIP_SQL = f"""{E_SQL}, n AS (SELECT *, sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS m, frame // 10 AS phase FROM e),
t AS (SELECT *, coalesce(degrees(2*acos(least(abs((qx*lag(qx) OVER w+qy*lag(qy) OVER w+qz*lag(qz) OVER w+qw*lag(qw) OVER w)/(m*lag(m) OVER w)),1))),0) AS turned FROM n WINDOW w AS (PARTITION BY episode ORDER BY frame)),
s AS (SELECT *, sum(turned) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS turns FROM t)"""


def checked_sql(edges: str) -> str:
    """CTEs up to ``r`` (episode, i, j, reason) for the edges of a CTE."""
    steps = [length(minus(of("b", p), of("a", p))) for p in (LEFT, RIGHT)]
    away = [off_segment(of("k", p), of("a", p), of("b", p)) for p in (LEFT, RIGHT)]
    return f"""p AS (SELECT x.episode, i, j, CASE WHEN a.phase <> b.phase THEN 'phase' WHEN greatest({steps[0]}, {steps[1]}) > {SKIPS['max_step']} + 1e-9 THEN 'step' WHEN b.turns - a.turns > {SKIPS['max_rotation']} THEN 'rotation' END AS early
  FROM {edges} x JOIN s a ON a.episode = x.episode AND a.frame = i JOIN s b ON b.episode = x.episode AND b.frame = j),
v AS (SELECT p.episode, i, j, max(greatest({away[0]}, {away[1]})) AS far FROM p JOIN s a ON a.episode = p.episode AND a.frame = i JOIN s b ON b.episode = p.episode AND b.frame = j JOIN s k ON k.episode = p.episode AND k.frame > i AND k.frame < j WHERE early IS NULL GROUP BY p.episode, i, j),
r AS (SELECT p.episode, p.i, p.j, coalesce(early, CASE WHEN far > {SKIPS['deviation']} + 1e-9 THEN 'deviation' END) AS reason FROM p LEFT JOIN v ON v.episode = p.episode AND v.i = p.i AND v.j = p.j)"""


BAND_SQL = "x AS (SELECT a.episode, a.frame AS i, b.frame AS j FROM e a JOIN e b ON a.episode = b.episode AND b.frame BETWEEN a.frame + 2 AND a.frame + 5)"


def turning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[skips.Path]]:
    """Poses with phases of ten frames and the degrees by which the left tool turned, and the two paths."""
    unit = poses(spark, sf_dir).withColumns({f"u{k}": x for k, x in enumerate(pose.unit(quaternion()))}).withColumn("phase", F.floor(F.col("frame") / 10))
    u = cols(*(f"u{k}" for k in range(4)))
    return unit.withColumn("turned", pose.quaternion_angle(u, series.lagged(u))), [skips.Path(tuple(LEFT), "turned"), skips.Path(tuple(RIGHT))]


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, paths = turning(spark, sf_dir)
    return skips.skip_check(frames, skips.band_edges(frames, 5), paths, phase="phase", **SKIPS)


@query(f"WITH {SKIP_SQL}, {BAND_SQL}, {checked_sql('x')} SELECT episode, i, j, reason FROM r")
def skip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every skip of up to five frames with the first reason against it."""
    return checked(spark, sf_dir)


@query(f"WITH {SKIP_SQL}, {BAND_SQL}, {checked_sql('x')} SELECT episode, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY episode, reason")
def skip_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many skips each reason refuses, by episode."""
    return skips.rejections(checked(spark, sf_dir), ["episode"])


@query(f"WITH {SKIP_SQL}, y AS (SELECT episode, frame AS i, lead(frame) OVER (PARTITION BY episode ORDER BY frame) AS j FROM e WHERE frame % 3 <> 1), x AS (SELECT * FROM y WHERE j > i + 1), {checked_sql('x')} SELECT episode, i, j, reason FROM r WHERE reason IS NOT NULL")
def illegal_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skips of a selection that leaves out every third frame which aren't allowed."""
    frames, paths = turning(spark, sf_dir)
    return skips.illegal_skips(frames, frames.where("frame % 3 <> 1"), paths, phase="phase", **SKIPS)


PEAKS_SQL = f"""WITH RECURSIVE {F_SQL}, v AS (SELECT episode, frame, [least(greatest(frame + i, 0), n - 1) for i in [-1,0,1]] AS ix, vals, n FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS n, list(value ORDER BY frame) OVER (PARTITION BY episode) AS vals FROM f)),
m AS (SELECT episode, frame, n, -list_sort([vals[i + 1] for i in ix])[2] AS h FROM v),
c AS (SELECT *, CASE WHEN h <> lag(h) OVER (PARTITION BY episode ORDER BY frame) THEN 1 ELSE 0 END AS turn FROM m),
u AS (SELECT *, sum(turn) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT episode, min(frame) AS first, max(frame) AS final, any_value(h) AS h FROM u GROUP BY episode, run),
q AS (SELECT *, lag(h) OVER w AS before, lead(h) OVER w AS after FROM r WINDOW w AS (PARTITION BY episode ORDER BY first)),
t AS (SELECT episode, (first + final) // 2 AS frame, h FROM q WHERE before < h AND after < h),
o AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY h DESC, frame DESC) AS place FROM t),
g AS (SELECT DISTINCT episode, 0::BIGINT AS place, []::BIGINT[] AS kept FROM o UNION ALL
  SELECT g.episode, o.place, CASE WHEN len([k for k in g.kept if abs(k - o.frame) < 4]) = 0 THEN list_append(g.kept, o.frame) ELSE g.kept END FROM g JOIN o ON o.episode = g.episode AND o.place = g.place + 1),
k AS (SELECT o.* FROM o JOIN g ON o.episode = g.episode AND o.place = g.place AND list_contains(g.kept, o.frame)),
z AS (SELECT k.*, (SELECT max(frame) FROM m WHERE m.episode = k.episode AND m.frame < k.frame AND m.h > k.h) AS a, (SELECT min(frame) FROM m WHERE m.episode = k.episode AND m.frame > k.frame AND m.h > k.h) AS b FROM k),
p AS (SELECT z.episode, z.frame, z.h, any_value(m.n) AS n, z.h - greatest(min(m.h) FILTER (WHERE m.frame <= z.frame AND m.frame > coalesce(z.a, -1)), min(m.h) FILTER (WHERE m.frame >= z.frame AND m.frame < coalesce(z.b, m.n))) AS prominence FROM z JOIN m ON m.episode = z.episode GROUP BY z.episode, z.frame, z.h),
w AS (SELECT *, h - prominence / 2 AS level FROM p WHERE prominence >= 5),
x AS (SELECT w.*, (SELECT max(frame) FROM m WHERE m.episode = w.episode AND m.frame < w.frame AND m.h <= w.level AND w.frame - m.frame <= 3) AS l, (SELECT min(frame) FROM m WHERE m.episode = w.episode AND m.frame > w.frame AND m.h <= w.level AND m.frame - w.frame <= 3) AS d FROM w),
y AS (SELECT x.*, CASE WHEN l IS NULL THEN least(3, frame) ELSE frame - l - (level - (SELECT h FROM m WHERE m.episode = x.episode AND m.frame = l)) / ((SELECT h FROM m WHERE m.episode = x.episode AND m.frame = l + 1) - (SELECT h FROM m WHERE m.episode = x.episode AND m.frame = l)) END
  + CASE WHEN d IS NULL THEN least(3, n - 1 - frame) ELSE d - frame - (level - (SELECT h FROM m WHERE m.episode = x.episode AND m.frame = d)) / ((SELECT h FROM m WHERE m.episode = x.episode AND m.frame = d - 1) - (SELECT h FROM m WHERE m.episode = x.episode AND m.frame = d)) END AS width FROM x)
SELECT episode, frame, round(-h, 6) AS value, round(prominence, 6) AS prominence, round(width, 6) AS width FROM y WHERE width >= 2"""


@query(PEAKS_SQL)
def value_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valleys of a smoothed signal, four frames apart or more, with a prominence of 5 and a width of 2 frames."""
    smooth = signals(spark, sf_dir).select("episode", "frame", (-series.moving_median(F.col("value"), 3)).alias("low"))
    return peaks.peaks(smooth, "low", 4, 2.0, 5.0).select("episode", "frame", r6(-F.col("h"), "value"), r6("prominence", "prominence"), r6("width", "width"))


STEADY_SQL = f"""WITH RECURSIVE {E_SQL}, d AS (SELECT episode, frame, lx, ly, lz, lead(lx) OVER w AS nx, lead(ly) OVER w AS ny, lead(lz) OVER w AS nz FROM e WINDOW w AS (PARTITION BY episode ORDER BY frame)),
g AS (SELECT *, {length(minus(['nx', 'ny', 'nz'], LEFT))} AS size FROM d), s AS (SELECT *, frame - row_number() OVER (PARTITION BY episode ORDER BY frame) AS run FROM g WHERE size > 0.08),
q AS (SELECT c.episode, c.run, c.frame, z.frame - c.frame + 1 AS n, {length(minus(of('z', ['nx', 'ny', 'nz']), of('c', LEFT)))} AS far, sum(k.size) AS path,
  min({dot(minus(of('k', ['nx', 'ny', 'nz']), of('k', LEFT)), minus(of('z', ['nx', 'ny', 'nz']), of('c', LEFT)))} / (k.size * {length(minus(of('z', ['nx', 'ny', 'nz']), of('c', LEFT)))})) AS agree
  FROM s c JOIN s z ON z.episode = c.episode AND z.run = c.run AND z.frame BETWEEN c.frame + 1 AND c.frame + 4 JOIN s k ON k.episode = c.episode AND k.run = c.run AND k.frame BETWEEN c.frame AND z.frame GROUP BY c.episode, c.run, c.frame, z.frame, far, z.nx, z.ny, z.nz, c.lx, c.ly, c.lz),
b AS (SELECT episode, run, frame, coalesce(min(n) FILTER (WHERE NOT (far >= 0.1 * path AND agree >= 0.1)) - 1, max(n)) AS n FROM q GROUP BY episode, run, frame),
t AS (SELECT s.episode, s.run, s.frame, CASE WHEN b.n >= 2 THEN b.n END AS n FROM s LEFT JOIN b USING (episode, run, frame)),
w AS (SELECT episode, run, min(frame) AS frame FROM s GROUP BY episode, run UNION ALL SELECT w.episode, w.run, t.frame + coalesce(t.n, 1) FROM w JOIN t ON t.episode = w.episode AND t.run = w.run AND t.frame = w.frame)
SELECT w.episode, w.frame AS start_frame, w.frame + t.n AS end_frame, round(far / path, 6) AS ratio FROM w JOIN t ON t.episode = w.episode AND t.run = w.run AND t.frame = w.frame JOIN q ON q.episode = t.episode AND q.run = t.run AND q.frame = t.frame AND q.n = t.n"""


@query(STEADY_SQL)
def steady_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of two to five steps in which the left tool keeps its direction, roughly."""
    moving = pose.norm(pose.minus([F.lead(x).over(series.ep()) for x in left()], left())) > 0.08
    found = segments.steady_segments(poses(spark, sf_dir), LEFT, moving, 2, 5, 0.1)
    return found.select("episode", "start_frame", "end_frame", r6("ratio", "ratio"))


LOOPS = segments.Loops(nearest=3, furthest=9, path=0.5, back=0.2, ratio=0.25)
LOOP_SQL = f"""{E_SQL}, z AS (SELECT *, coalesce(sqrt(pow(lx - lag(lx) OVER w, 2) + pow(ly - lag(ly) OVER w, 2) + pow(lz - lag(lz) OVER w, 2)), 0) AS size FROM e WINDOW w AS (PARTITION BY episode ORDER BY frame)),
h AS (SELECT *, sum(size) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING) AS path FROM z),
l AS (SELECT a.episode, a.frame AS start_frame, b.frame AS end_frame, b.path - a.path AS path, {length(minus(of('b', LEFT), of('a', LEFT)))} AS distance FROM h a JOIN h b ON a.episode = b.episode AND b.frame BETWEEN a.frame + 3 AND a.frame + 9
  WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.episode = a.episode AND k.frame > a.frame AND k.frame < b.frame AND k.frame % 13 = 5)),
o AS (SELECT * FROM l WHERE path >= 0.5 AND distance <= 0.2 AND distance <= path * 0.25)"""
APART_SQL = ", ".join(
    f"c{k} AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT * FROM k{i}' for i in range(k)) or 'SELECT * FROM o WHERE false'}) b WHERE b.episode = o.episode AND o.end_frame >= b.start_frame AND o.start_frame <= b.end_frame)), k{k} AS (SELECT *, {k} AS place FROM c{k} QUALIFY row_number() OVER (PARTITION BY episode ORDER BY path - distance DESC, start_frame, end_frame) = 1)"
    for k in range(4)
)


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.return_loops(poses(spark, sf_dir), LEFT, LOOPS, F.col("frame") % 13 == 5)


@query(f"WITH {LOOP_SQL} SELECT episode, start_frame, end_frame, round(path, 6) AS path, round(distance, 6) AS distance FROM o")
def return_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of frames between which the left tool comes back."""
    return loops(spark, sf_dir).select("episode", "start_frame", "end_frame", r6("path", "path"), r6("distance", "distance"))


@query(f"WITH {LOOP_SQL}, {APART_SQL} SELECT episode, place, start_frame, end_frame, round(path - distance, 6) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM k{k}' for k in range(4))})")
def best_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each episode the four best return loops that don't overlap."""
    best = segments.best_apart(loops(spark, sf_dir), F.col("path") - F.col("distance"), 4)
    return best.select("episode", "place", "start_frame", "end_frame", r6("score", "score"))


DEPART_SQL = f"""WITH {E_SQL}, p AS (SELECT episode, min(frame) AS a, max(frame) AS b, min(frame) // 12 % 4 <> 3 AS standard FROM e GROUP BY episode, frame // 12),
v AS (SELECT episode, frame FROM e WHERE rx > 0.15), n AS (SELECT p.*, (SELECT min(frame) FROM v WHERE v.episode = p.episode AND v.frame > p.a AND v.frame <= p.b) AS event FROM p),
t AS (SELECT n.*, coalesce(event, b) AS z FROM n), x AS (SELECT t.*, {', '.join(f'e1.{c} AS a{c}, e2.{c} - e1.{c} AS w{c}' for c in LEFT)}, {length(minus(of('e2', LEFT), of('e1', LEFT)))} AS distance FROM t JOIN e e1 ON e1.episode = t.episode AND e1.frame = a JOIN e e2 ON e2.episode = t.episode AND e2.frame = z),
g AS (SELECT x.episode, x.a, e.frame, {dot(minus(of('e', LEFT), [f'a{c}' for c in LEFT]), [f'w{c}' for c in LEFT])} / nullif(distance, 0) AS progress FROM x JOIN e ON e.episode = x.episode AND e.frame BETWEEN a AND z),
f AS (SELECT episode, a, max(progress) OVER (PARTITION BY episode, a ORDER BY frame ROWS UNBOUNDED PRECEDING) - progress AS fall FROM g), d AS (SELECT episode, a, max(fall) AS back FROM f GROUP BY episode, a)
SELECT x.episode, x.a AS start_frame, z AS end_frame, CASE WHEN event IS NULL THEN 'phase_end' ELSE 'next_event' END AS anchor, round(distance, 6) AS distance, round(back, 6) AS backtrack, CASE WHEN distance < 0.05 OR z - x.a < 3 OR NOT standard THEN 'unsupported' WHEN back <= 0.1 THEN 'kept' ELSE 'pending' END AS status FROM x LEFT JOIN d ON d.episode = x.episode AND d.a = x.a"""


@query(DEPART_SQL)
def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the left tool falls back on its way to each phase's next event."""
    f = poses(spark, sf_dir)
    phases = f.groupBy("episode", F.floor(F.col("frame") / 12).alias("k")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).withColumn("standard", F.col("k") % 4 != 3)
    found = segments.departures(f, LEFT, phases, f.where("rx > 0.15").select("episode", F.col("frame").alias("start_frame")), 0.1, 0.05)
    return found.select("episode", "start_frame", "end_frame", "anchor", r6("distance", "distance"), r6("backtrack", "backtrack"), "status")


BLOCK_SQL = f"""{E_SQL}, z AS (SELECT episode, frame, coalesce(sqrt(pow(lx - lag(lx) OVER w, 2) + pow(ly - lag(ly) OVER w, 2) + pow(lz - lag(lz) OVER w, 2)), 0) AS l, coalesce(sqrt(pow(rx - lag(rx) OVER w, 2) + pow(ry - lag(ry) OVER w, 2) + pow(rz - lag(rz) OVER w, 2)), 0) AS r FROM e WINDOW w AS (PARTITION BY episode ORDER BY frame)),
a AS (SELECT *, CASE WHEN r > 0.1 AND r > 1.1 * l THEN 'R' WHEN l > 0.1 AND l > 1.1 * r THEN 'L' END AS arm FROM z),
i AS (SELECT episode, arm, min(frame) AS a, max(frame) AS b FROM (SELECT *, frame - row_number() OVER (PARTITION BY episode, arm ORDER BY frame) AS g FROM a WHERE arm IS NOT NULL) GROUP BY episode, arm, g HAVING count(*) >= 2),
j AS (SELECT episode, arm, greatest(a, 4) AS a, b FROM i WHERE b + 1 > 4),
m AS (SELECT *, CASE WHEN arm <> lag(arm) OVER (PARTITION BY episode ORDER BY a) THEN 1 ELSE 0 END AS turn FROM j),
n AS (SELECT *, sum(turn) OVER (PARTITION BY episode ORDER BY a ROWS UNBOUNDED PRECEDING) AS t FROM m),
b AS (SELECT episode, CAST(t AS BIGINT) AS t, any_value(arm) AS arm, min(a) AS a, max(b) AS b FROM n GROUP BY episode, t)"""
PHASE_SQL = f"""WITH {BLOCK_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY episode) AS many, coalesce(sum(CASE WHEN arm = 'R' THEN b - a + 1 END) OVER w, 0) AS r, coalesce(sum(CASE WHEN arm = 'L' THEN b - a + 1 END) OVER w, 0) AS l, coalesce(count(CASE WHEN arm = 'R' THEN 1 END) OVER w, 0) AS nr, coalesce(count(CASE WHEN arm = 'L' THEN 1 END) OVER w, 0) AS nl, first_value(arm) OVER (PARTITION BY episode ORDER BY t) AS head FROM b WINDOW w AS (PARTITION BY episode ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT episode, many, sum(CASE WHEN arm = 'R' THEN b - a + 1 ELSE 0 END) AS r, sum(CASE WHEN arm = 'L' THEN b - a + 1 ELSE 0 END) AS l, count(CASE WHEN arm = 'R' THEN 1 END) AS nr, count(CASE WHEN arm = 'L' THEN 1 END) AS nl FROM c WHERE many >= 5 AND head = 'R' GROUP BY episode, many),
x AS (SELECT y.episode, many, c1.t AS t1, c2.t AS t2, c3.t AS t3, c4.t AS t4, c1.l + (c2.r - c1.r) + (c3.l - c2.l) + (c4.r - c3.r) + (y.l - c4.l) AS cost FROM y JOIN (SELECT episode, t, r, l, nr, nl FROM c) c1 USING (episode) JOIN (SELECT episode, t, r, l, nr, nl FROM c) c2 ON c2.episode = y.episode AND c2.t > c1.t JOIN (SELECT episode, t, r, l, nr, nl FROM c) c3 ON c3.episode = y.episode AND c3.t > c2.t JOIN (SELECT episode, t, r, l, nr, nl FROM c) c4 ON c4.episode = y.episode AND c4.t > c3.t
  WHERE c1.nr > 0 AND c2.nl > c1.nl AND c3.nr > c2.nr AND c4.nl > c3.nl AND y.nr > c4.nr QUALIFY row_number() OVER (PARTITION BY y.episode ORDER BY cost, t4, t3, t2, t1) = 1),
g AS (SELECT episode, unnest([1, 2, 3, 4, 5]) AS phase, unnest(['R', 'L', 'R', 'L', 'R']) AS arm, unnest([0, t1, t2, t3, t4]) AS lo, unnest([t1, t2, t3, t4, many]) AS hi FROM x),
k AS (SELECT episode, count(*) AS length FROM e GROUP BY episode)
SELECT g.episode, phase, g.arm, CASE WHEN phase = 1 THEN 4 ELSE (SELECT (p.b + q.a + 1) // 2 FROM b p JOIN b q ON p.episode = q.episode WHERE p.episode = g.episode AND p.t = lo - 1 AND q.t = lo) END AS start_frame,
 CASE WHEN phase = 5 THEN length ELSE (SELECT (p.b + q.a + 1) // 2 FROM b p JOIN b q ON p.episode = q.episode WHERE p.episode = g.episode AND p.t = hi - 1 AND q.t = hi) END - 1 AS end_frame, NOT EXISTS (SELECT 1 FROM b WHERE b.episode = g.episode AND b.t >= lo AND b.t < hi AND b.arm <> g.arm) AS standard FROM g JOIN k USING (episode)"""


def blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arm blocks from frame 4 on, and the episodes' starts and lengths."""
    f = poses(spark, sf_dir).withColumns({"r": series.speed(right(), 1.0, 0.0), "l": series.speed(left(), 1.0, 0.0)})
    lengths = f.groupBy("episode").agg(F.count("*").alias("length"))
    starts = lengths.select("episode", F.lit(4).alias("start_frame"))
    return segments.arm_blocks(f, F.col("r"), F.col("l"), 0.1, 1.1, 2, starts), starts, lengths


@query(f"WITH {BLOCK_SQL} SELECT episode, t AS block, arm, a AS start_frame, b AS end_frame FROM b")
def arm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which one arm leads, neighbours of one arm merged."""
    return blocks(spark, sf_dir)[0].select("episode", "block", "arm", "start_frame", "end_frame")


@query(PHASE_SQL)
def ordered_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest cut of each episode's blocks into five phases of alternating arms."""
    own, starts, lengths = blocks(spark, sf_dir)
    return segments.ordered_phases(own, lengths, starts)


def norm_sql(path: list[str], order: int) -> str:
    factors = {1: (1, -1), 2: (1, -2, 1), 3: (1, -3, 3, -1)}[order]
    parts = ["(" + " + ".join(f"({f}) * {c if not k else f'lag({c}, {k}) OVER w'}" for k, f in enumerate(factors)) + ")" for c in path]
    return f"{length(parts)} * {30**order}"


NAMES = {"left": LEFT, "right": RIGHT}
PEAKS = ", ".join(f"{norm_sql(p, k)} AS {n}_{k}" for n, p in NAMES.items() for k in (1, 2, 3))
MOST = " UNION ALL ".join(f"SELECT episode, phase, '{n}_{k}' AS quantity, coalesce(max(CASE WHEN i - lo >= {k} THEN {n}_{k} END), 0) AS peak FROM %s GROUP BY episode, phase" for n in NAMES for k in (1, 2, 3))
DYNAMICS_SQL = f"""WITH {E_SQL}, p AS (SELECT episode, frame // 20 AS phase, min(frame) AS a, max(frame) AS b FROM e GROUP BY episode, frame // 20), n AS (SELECT episode, max(frame) AS last FROM e GROUP BY episode),
s AS (SELECT episode, frame, frame AS i, {PEAKS} FROM e WINDOW w AS (PARTITION BY episode ORDER BY frame)),
c AS (SELECT episode, frame, row_number() OVER w - 1 AS i, {PEAKS} FROM e WHERE frame % 4 <> 2 WINDOW w AS (PARTITION BY episode ORDER BY frame)),
q AS (SELECT p.episode, p.phase, p.a, p.b, greatest(count(*) FILTER (WHERE frame < a) - 3, 0) AS lo, least(count(*) FILTER (WHERE frame <= b) + 3, count(*)) - 1 AS hi FROM p JOIN c ON c.episode = p.episode GROUP BY p.episode, p.phase, p.a, p.b),
o AS (SELECT q.phase, q.lo, q.a, q.b, c.* FROM q JOIN c ON c.episode = q.episode AND c.i BETWEEN lo AND hi),
r AS (SELECT episode, phase, greatest(least(any_value(a) - 3, min(frame)), 0) AS lo, greatest(any_value(b) + 3, max(frame)) AS hi FROM o GROUP BY episode, phase),
t AS (SELECT r.phase, r.lo, s.* FROM r JOIN n ON n.episode = r.episode JOIN s ON s.episode = r.episode AND s.i BETWEEN lo AND least(hi, last)),
x AS ({MOST.replace('%s', 't')}), y AS ({MOST.replace('%s', 'o')})
SELECT x.episode, x.phase, x.quantity, round(x.peak, 4) AS source_peak, round(y.peak, 4) AS chosen_peak, y.peak <= x.peak * 1.02 + 1e-6 AS holds FROM x JOIN y USING (episode, phase, quantity)"""


@query(DYNAMICS_SQL)
def dynamics_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed, acceleration and jerk of a selection without every fourth frame against those of its source, by phase."""
    f = poses(spark, sf_dir)
    phases = f.groupBy("episode", F.floor(F.col("frame") / 20).alias("phase")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    told = segments.dynamics_check(f, f.where("frame % 4 <> 2"), phases, NAMES, 30.0, 0.02, 1e-6)
    return told.select("episode", "phase", "quantity", F.round("source_peak", 4).alias("source_peak"), F.round("chosen_peak", 4).alias("chosen_peak"), "holds")


BUDGET_SQL = f"""WITH {F_SQL}, p AS (SELECT *, value > 90 AS held, count(*) OVER (PARTITION BY episode) AS n FROM f),
d AS (SELECT *, least(coalesce(least(frame - last_value(CASE WHEN held THEN frame END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN held THEN frame END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - frame), 5), 5) / 5.0::DOUBLE AS far FROM p),
l AS (SELECT episode, greatest(least(1 - (count(*) - 0.6 * any_value(n)) / nullif(sum(far), 0), 1), 0.2) AS level FROM d GROUP BY episode)
SELECT episode, frame, round(1 - (1 - coalesce(level, 1)) * far, 6) AS weight FROM d JOIN l USING (episode)"""


@query(BUDGET_SQL)
def budget_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights that bring each episode to three fifths of its frames, denser near high values."""
    f = signals(spark, sf_dir).withColumn("budget", 0.6 * F.count(F.lit(1)).over(series.whole()))
    return segments.budget_weights(f, F.col("value") > 90, F.col("budget"), 5, 0.2).select("episode", "frame", r6("weight", "weight"))


EVENT_SQL = "v AS (SELECT episode, min(frame) - 1 AS a, max(frame) AS b FROM (SELECT *, frame - row_number() OVER (PARTITION BY episode ORDER BY frame) AS g FROM (SELECT episode, frame, abs(v[8]::DOUBLE - lag(v[8]::DOUBLE) OVER (PARTITION BY episode ORDER BY frame)) AS rate FROM e) WHERE rate > 0.12) GROUP BY episode, g HAVING max(rate) > 0.2)"


@query(f"WITH {E_SQL}, {EVENT_SQL}, s AS (SELECT episode, min(frame) AS first FROM e WHERE frame > 6 AND rx > 0.1 GROUP BY episode) SELECT s.episode, CASE WHEN bool_or(coalesce(b < first, false)) THEN 0 ELSE coalesce(min(a) FILTER (WHERE a < first AND first <= b), first) END AS start_frame, CASE WHEN bool_or(coalesce(b < first, false)) THEN 'earlier_event' WHEN min(a) FILTER (WHERE a < first AND first <= b) IS NOT NULL THEN 'inside_event' END AS note FROM s LEFT JOIN v ON v.episode = s.episode GROUP BY s.episode, first")
def starts_after_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts moved for gripper events that lie before them or hold them."""
    f = poses(spark, sf_dir)
    rated = f.withColumn("rate", F.abs(F.col("s7") - F.lag("s7").over(series.ep())))
    moving = rated.where("rate > 0.12").withColumn("g", F.col("frame") - F.row_number().over(series.ep()))
    events = moving.groupBy("episode", "g").agg((F.min("frame") - 1).alias("start_frame"), F.max("frame").alias("end_frame"), F.max("rate").alias("peak")).where("peak > 0.2")
    return series.started(f.where("frame > 6 and rx > 0.1").groupBy("episode").agg(F.min("frame").alias("start_frame")), events)


@query(f"WITH {E_SQL}, x AS (SELECT episode, 'v' AS feature, unnest(range(64)) AS pos, unnest(v)::DOUBLE AS x FROM e UNION ALL SELECT episode, 'lx', 0, lx FROM e) SELECT episode, feature, CAST(pos AS INTEGER) AS pos, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS count FROM x GROUP BY episode, feature, pos")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a vector and a scalar column by episode and component."""
    told = convert.feature_stats(poses(spark, sf_dir), ["v", "lx"], ["episode"])
    parts = told.select("episode", "feature", F.col("count")[0].alias("count"), F.posexplode(F.arrays_zip("min", "max", "mean", "std")).alias("pos", "s"))
    return parts.select("episode", "feature", "pos", *(r6(f"s.{n}", n) for n in ("min", "max", "mean", "std")), "count")


@query("WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -1, 1, NULL), a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 22 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def differing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a changed copy lacks, adds or holds otherwise, nulls told from values."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = lambda k: F.when(F.col("o_custkey") % k != 0, F.col("o_orderstatus"))
    more = spark.createDataFrame([(-1, 1, None)], own.schema)
    return convert.same_rows(own.withColumn("o_orderstatus", status(22)), own.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", status(11)).union(more), ["o_orderkey"])
