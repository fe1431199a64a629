"""Peaks, segments, loops and phases against plain loops on small random episodes, with plateaus, ties and episodes without any."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import peaks, rounds, series
from framelake.plans import segments, skips


def plain_peaks(x: list[float], distance: int, width: float, prominence: float) -> dict[int, tuple[float, float]]:
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(tops, key=lambda p: (-x[p], -p)):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    out, reach = {}, max(1, math.ceil(width)) + 1
    for p in kept:
        lows, sides = [], []
        for way in (-1, 1):
            i, low = p, x[p]
            while 0 <= i < len(x) and x[i] <= x[p]:
                low = min(low, x[i])
                i += way
            lows.append(low)
        height = x[p] - max(lows)
        level = x[p] - height / 2
        for way in (-1, 1):
            i, n = p, 0
            while 0 <= i + way < len(x) and n < reach and x[i] > level:
                i, n = i + way, n + 1
            sides.append(n - (level - x[i]) / (x[i - way] - x[i]) if x[i] <= level else n)
        if height >= prominence and sum(sides) >= width:
            out[p] = (height, sum(sides))
    return out


@pytest.mark.parametrize("distance,width,prominence", [(1, 0.0, 0.0), (4, 0.0, 0.0), (3, 2.0, 2.0)])
def test_peaks(spark, distance, width, prominence):
    r = random.Random(distance)
    episodes = {k: [float(r.randint(0, 6)) for _ in range(n)] for k, n in enumerate([1, 2, 3, 40, 200, 75])} | {90: [1.0] * 9, 91: [float(i) for i in range(20)], 92: [3.0, 3.0, 1.0, 2.0, 2.0, 2.0, 1.0, 4.0, 4.0]}
    rows = [(e, i, v) for e, x in episodes.items() for i, v in enumerate(x)]
    got = peaks.peaks(spark.createDataFrame(rows, "episode long, frame long, x double"), "x", distance, width, prominence).collect()
    want = {(e, p): v for e, x in episodes.items() for p, v in plain_peaks(x, distance, width, prominence).items()}
    assert {(g.episode, g.frame) for g in got} == set(want)
    assert all((g.prominence, g.width) == pytest.approx(want[g.episode, g.frame]) and g.h == episodes[g.episode][g.frame] for g in got)


def test_steady_segments_equal_the_walk(spark):
    r, least, most, cosine, rows, want = random.Random(5), 2, 6, 0.6, [], set()
    for e, n in enumerate([2, 3, 60, 150]):
        p = [[0.0, 0.0, 0.0]]
        way = [1.0, 0.0, 0.0]
        for _ in range(n - 1):
            way = way if r.random() < 0.7 else [r.uniform(-1, 1) for _ in range(3)]
            stop = r.random() < 0.08
            p.append([a + (0 if stop else 1) * (b + r.uniform(-0.2, 0.2)) for a, b in zip(p[-1], way, strict=True)])
        rows += [(e, i, *x) for i, x in enumerate(p)]
        d = [[b - a for a, b in zip(p[i], p[i + 1], strict=True)] for i in range(n - 1)]
        size = [math.hypot(*x) for x in d]
        moving = [s > 0.3 for s in size] + [False]
        i = 0
        while i < n:
            if not moving[i]:
                i += 1
                continue
            stop = next(k for k in range(i, n + 1) if not moving[k])
            cursor = i
            while cursor + least <= stop:
                best = None
                for end in range(cursor + least, min(stop, cursor + most) + 1):
                    w = [b - a for a, b in zip(p[cursor], p[end], strict=True)]
                    far = math.hypot(*w)
                    if far / sum(size[cursor:end]) < cosine or min(sum(a * b for a, b in zip(d[k], w, strict=True)) / size[k] / max(far, 1e-12) for k in range(cursor, end)) < cosine:
                        break
                    best = end
                if best is None:
                    cursor += 1
                else:
                    want.add((e, cursor, best))
                    cursor = best
            i = stop
    f = spark.createDataFrame(rows, "episode long, frame long, x double, y double, z double")
    moving = F.sqrt(sum((F.pow(F.lead(c).over(series.ep()) - F.col(c), 2) for c in "xyz"), F.lit(0.0))) > 0.3
    got = segments.steady_segments(f, ["x", "y", "z"], moving, least, most, cosine)
    assert {(g.episode, g.start_frame, g.end_frame) for g in got.collect()} == want and len(want) > 10


def test_reachable_doubles_hops(spark):
    hops = [(1, i, i + r) for i, r in zip(range(100), itertools.cycle([1, 3, 2]))]
    want, at = set(), 0
    while at < 100:
        want.add(at)
        at += [1, 3, 2][at % 3]
    want.add(at)
    got = rounds.reachable(spark.createDataFrame([(1, 0), (2, 7)], "episode long, frame long"), spark.createDataFrame(hops, "episode long, frame long, next long"), ["episode"])
    assert {tuple(g) for g in got.collect()} == {(1, a) for a in want} | {(2, 7)}


def test_best_apart_equals_greedy(spark):
    r = random.Random(8)
    rows = [(e, a, a + r.randint(0, 9), float(r.randint(0, 4))) for e in range(5) for a in (r.randint(0, 60) for _ in range(50))] + [(9, 1, 2, 1.0)]
    want = set()
    for e in {x[0] for x in rows}:
        chosen: list = []
        for _, a, b, s in sorted((x for x in rows if x[0] == e), key=lambda x: (-x[3], x[1], x[2])):
            if len(chosen) < 8 and all(b < u or a > v for u, v, _ in chosen):
                chosen.append((a, b, s))
        want |= {(e, k, *x) for k, x in enumerate(chosen)}
    f = spark.createDataFrame(rows, "episode long, start_frame long, end_frame long, s double")
    assert {tuple(g) for g in segments.best_apart(f, F.col("s")).collect()} == want


def test_ordered_phases_equal_exhaustive_search(spark):
    r, rows, want = random.Random(2), [], set()
    for e in range(40):
        at, arm, blocks = 3, "RL"[e % 8 == 7], []
        for _ in range(r.randint(3, 10)):
            blocks.append((arm, at, at := at + r.randint(0, 3)))
            at += r.randint(1, 3)
            arm = "RL"[arm == "R"]
        rows += [(e, k, *b) for k, b in enumerate(blocks)]
        best = None
        for cut in itertools.combinations(range(1, len(blocks)), 4):
            groups = [blocks[a:b] for a, b in itertools.pairwise((0, *cut, len(blocks)))]
            if blocks[0][0] == "R" and all(any(b[0] == arm for b in g) for g, arm in zip(groups, "RLRLR", strict=True)):
                cost = sum(b[2] - b[1] + 1 for g, arm in zip(groups, "RLRLR", strict=True) for b in g if b[0] != arm)
                best = min(best or (math.inf,), (cost, *reversed(cut), groups))
        if best:
            groups = best[5]
            bounds = [2, *((a[-1][2] + b[0][1] + 1) // 2 for a, b in itertools.pairwise(groups)), 99]
            want |= {(e, k + 1, arm, bounds[k], bounds[k + 1] - 1, all(b[0] == arm for b in groups[k])) for k, arm in enumerate("RLRLR")}
    f = spark.createDataFrame(rows, "episode long, block long, arm string, start_frame long, end_frame long")
    ids = spark.createDataFrame([(e, 99, 2) for e in range(40)], "episode long, length long, start_frame long")
    got = {tuple(g) for g in segments.ordered_phases(f, ids.select("episode", "length"), ids.select("episode", "start_frame")).collect()}
    assert got == want and len(want) > 50 and not all(x[5] for x in want)


def test_reasons_add_up(spark):
    r = random.Random(4)
    f = spark.createDataFrame([(1, i, *(r.uniform(0, 0.2) for _ in range(3)), r.uniform(0, 40), i // 9) for i in range(60)], "episode long, frame long, x double, y double, z double, turned double, phase long")
    checked = skips.skip_check(f, skips.band_edges(f, 4), [skips.Path(("x", "y", "z"), "turned")], 0.2, 60.0, 0.08, "phase")
    counts = {g.reason: g.n for g in skips.rejections(checked, ["episode"]).collect()}
    refused = checked.where("reason is not null").count()
    assert sum(counts.values()) == refused < checked.count() and set(counts) == set(skips.REASONS)


def test_weights_meet_the_budget(spark):
    f = spark.createDataFrame([(e, i, i % 17 == 3 and e != 2, {0: 30.0, 1: 45.5, 2: 40.0, 3: 1.0, 4: 99.0}[e]) for e in range(5) for i in range(60)], "episode long, frame long, held boolean, budget double")
    sums = {g.episode: (g.s, g.low) for g in segments.budget_weights(f, F.col("held"), F.col("budget"), 4, 0.25).groupBy("episode").agg(F.sum("weight").alias("s"), F.min("weight").alias("low")).collect()}
    assert all(sums[e][0] == pytest.approx(b, abs=1e-9) for e, b in ((0, 30.0), (1, 45.5), (2, 40.0)))
    assert sums[3][1] == pytest.approx(0.25) and sums[4] == (60.0, 1.0)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_bin_join(spark, width):
    r = random.Random(width)
    rows = [("hot" if r.random() < 0.4 else r.choice("abc"), r.randint(-50, 50), k) for k in range(300)]
    spans = [(r.choice(["hot", "a", "b", "z"]), a := r.randint(-60, 50), a + r.randint(-2, 20), k) for k in range(30)] + [("hot", None, 3, 99)]
    left, right = spark.createDataFrame(rows, "key string, at long, row int"), spark.createDataFrame(spans, "key string, low long, high long, span int")
    want = sorted((row, span) for key, at, row in rows for k, low, high, span in spans if key == k and low is not None and low <= at <= high)
    assert sorted((g.row, g.span) for g in series.bin_join(left, right, ["key"], "at", "low", "high", width).collect()) == want
    assert sorted(g.row for g in series.bin_join(left, right, ["key"], "at", "low", "high", width, "left_semi").collect()) == sorted({w[0] for w in want})
