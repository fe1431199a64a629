"""Durations, frame ranges and checks of selections."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framelake.functions import pose
from framelake.plans import checks
from framelake.sources import reports


def test_durations(spark, tmp_path):
    (tmp_path / "a/meta").mkdir(parents=True)
    (tmp_path / "a/meta/episodes.jsonl").write_text('{"episode_index": 0, "tasks": ["x"], "length": 40}\n\n{"episode_index": 1, "tasks": [], "length": 20}\n')
    spark.createDataFrame([(0, 30), (1, 20)], "episode_index int, length int").write.parquet(str(tmp_path / "b/meta/episodes"))
    sides = [reports.episode_lengths(spark, str(tmp_path / s)).where("length is not null").withColumnRenamed("episode_index", "episode") for s in "ab"]
    rows = reports.compared(*sides, 10.0)
    assert {r.episode: (r.source_s, r.output_s, r.reduction_percent) for r in rows.collect()} == {0: (4.0, 3.0, 25.0), 1: (2.0, 2.0, 0.0)}
    told = reports.write_durations(rows, str(tmp_path / "out"))
    assert told["all"]["mean_s"] == 2.5 and told["all"]["all_shorter"] is False and json.loads(reports.summary_json(told))["all"]["n"] == 2
    assert spark.read.csv(str(tmp_path / "out/episode_durations"), header=True).count() == 2
    with pytest.raises(ValueError):
        reports.compared(sides[0], sides[1].where("episode = 0"), 10.0)


def test_ticks():
    assert [reports.tick_step(n) for n in (1, 30, 31, 61, 150, 151, 3000)] == [1, 1, 2, 5, 5, 10, 100]


def test_selection(spark):
    frames = spark.createDataFrame([(0, f) for f in range(8)], "episode long, frame long")
    chosen = frames.where("frame in (0, 1, 2, 5, 6)")
    assert reports.frame_ranges(chosen).first()["filter"] == "between(n,0,2)+between(n,5,6)"
    guarded = frames.where("frame in (1, 3, 7)")
    assert [(r.frame, r.reason) for r in checks.selection(frames, chosen, guarded).collect()] == [(3, "protected")]
    bad = chosen.union(spark.createDataFrame([(0, 5), (0, 99)], chosen.schema))
    assert {(r.frame, r.reason) for r in checks.selection(frames, bad, guarded.where("frame = 1")).collect()} == {(5, "twice"), (99, "unknown")}


def test_times(spark):
    row = spark.range(1).select(
        *(pose.frame_at(F.lit(t), 30.0, 10).alias(f"f{i}") for i, t in enumerate((-1.0, 0.1, 0.0999999, 9.0))), pose.frame_at(pose.time_of(F.lit(7), 30.0), 30.0, 10).alias("back"),
        pose.clip_agrees(F.lit(3.34), F.lit(100), 30.0).alias("near"), pose.clip_agrees(F.lit(3.4), F.lit(100), 30.0).alias("far"),
    ).first()
    assert tuple(row) == (0, 3, 3, 9, 7, True, False)
