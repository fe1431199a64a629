"""Sources and validators on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framelake.operators import series
from framelake.plans import checks
from framelake.sources import convert, datasets, reports


@pytest.fixture
def root(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    info = {"fps": 10, "chunks_size": 1000, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features": {"pose": {"dtype": "float32", "shape": [8], "names": [[f"n{i}" for i in range(8)]]}}}
    (tmp_path / "meta/info.json").write_text(json.dumps(info))
    (tmp_path / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "pick"}\n')
    (tmp_path / "meta/episodes.jsonl").write_text('{"episode_index": 0, "tasks": ["pick"], "length": 4}\n{"episode_index": 1, "tasks": ["pick"], "length": 3}\n')
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "data/chunk-000").mkdir(parents=True)
    at = 0
    for e, n in ((0, 4), (1, 3)):
        vectors = [[float(i), 0, 0, 0, 0, 0, 1, 0] for i in range(n)]
        pq.write_table(pa.table({"episode_index": [e] * n, "frame_index": list(range(n)), "index": list(range(at, at + n)), "timestamp": pa.array([i / 10 for i in range(n)], pa.float32()), "pose": vectors}), tmp_path / f"data/chunk-000/episode_{e:06d}.parquet")
        at += n
    return str(tmp_path)


def test_dataset(spark, root):
    data = datasets.Dataset.open(spark, root)
    assert data.ordinals("pose", ["n3", "n1"]) == [3, 1] and data.frames().count() == 7 and data.frames([1]).count() == 3
    assert data.tasks().first().task == "pick" and data.episodes().count() == 2 and datasets.misplaced(data.frames()).count() == 0
    profile = datasets.Profile("pose", (0, 1, 2, 0, 1, 2), offset=(1.0, 0, 0, 0, 0, 0), tool=(0.5, 0, 0, 0, 0, 0), quaternions=(3, 4, 5, 6) * 2)
    view = datasets.episode_view(data.frames([0]), profile, data.fps).orderBy("frame").collect()
    assert [r.lx for r in view] == [1.5, 2.5, 3.5, 4.5] and [r.l_speed for r in view] == [None, 10.0, 10.0, 10.0] and not profile.single_arm()


def test_rebuild(spark, root, tmp_path):
    frames = datasets.Dataset.open(spark, root).frames()
    chosen = frames.where("frame_index <> 1")
    out = datasets.rebuilt(frames, chosen, 10.0)
    rows = out.orderBy("index").collect()
    assert [(r.episode_index, r.frame_index, r.source_frame) for r in rows] == [(0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 0), (1, 1, 2)] and [r["index"] for r in rows] == list(range(5))
    datasets.written(out, str(tmp_path / "out"))
    again = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out/data")).select(out.columns)
    assert again.exceptAll(out).count() == out.exceptAll(again).count() == 0
    log = datasets.deletion_log(frames, chosen, frames.where("frame_index = 1").selectExpr("episode_index", "frame_index", "'still' reason")).collect()
    assert sorted((r.frame_index, r.kept, r.reason) for r in log)[2:4] == [(1, False, "still"), (1, False, "still")]
    bounds = spark.createDataFrame([(0, 0, 4), (1, 4, 3)], "episode_index long, dataset_from_index long, length long")
    assert datasets.sliced(frames, bounds).groupBy("episode_index").count().orderBy("episode_index").collect()[1]["count"] == 3
    assert datasets.digests(spark, f"{root}/data").count() == 2


def test_written_datasets_open(spark, root, tmp_path):
    data = datasets.Dataset.open(spark, root)
    out = datasets.rebuilt(data.frames(), data.frames().where("frame_index <> 1"), 10.0).withColumn("phase", F.lit("carry"))
    target = str(tmp_path / "out")
    tasks, plain = data.tasks(), out.drop("phase", "source_episode", "source_frame")
    episodes = convert.with_task_set(plain.withColumn("task_index", F.lit(0)), tasks).join(plain.groupBy("episode_index").agg(F.count("*").alias("length")), "episode_index")
    convert.write_metadata(target, convert.info_of(plain, tasks, data.info), episodes, tasks, convert.feature_stats(plain, ["pose"], ["episode_index"]))
    datasets.written(plain, target)
    datasets.write_source_map(out, target)
    datasets.write_deletions(datasets.deletion_log(data.frames().withColumn("phase", F.lit("carry")), data.frames().where("frame_index <> 1"), data.frames().where("frame_index = 1").selectExpr("episode_index", "frame_index", "'still' reason")), target)
    again = datasets.Dataset.open(spark, target)
    assert again.frames().select(plain.columns).exceptAll(plain).count() == plain.exceptAll(again.frames().select(plain.columns)).count() == 0
    assert again.frames([1]).count() == 2 and again.info["total_frames"] == 5 and datasets.misplaced(again.frames()).count() == 0
    assert sorted((r.episode_index, r.tasks, r.length) for r in again.episodes().collect()) == [(0, ["pick"], 3), (1, ["pick"], 2)] and again.tasks().first().task == "pick"
    assert sorted((r.episode_index, r.length) for r in reports.episode_lengths(spark, target).collect()) == [(0, 3), (1, 2)]
    assert [(r.output_frame, r.source_frame, r.phase) for r in again.source_map(0).orderBy("output_frame").collect()] == [(0, 0, "carry"), (1, 2, "carry"), (2, 3, "carry")]
    gone = spark.read.csv(f"{target}/deletion_reasons.csv", header=True).where("kept = 'false'").collect()
    assert {(r.source_frame, r.reason, r.phase) for r in gone} == {("1", "still", "carry")} and len(gone) == 2
    declared = spark.createDataFrame([(2, 5, 1)], "total_episodes long, total_frames long, total_tasks long")
    assert checks.totals(declared, again.frames(), again.tasks(), "episode_index").count() == 0
    again.info.pop("chunks_size")
    assert again.frames([1]).count() == 2 and again.video_path(1, "cam").endswith("videos/chunk-000/cam/episode_000001.mp4")
    with pytest.raises(FileNotFoundError):
        again.find(7)
    with pytest.raises(FileExistsError):
        convert.write_metadata(target, data.info, episodes, tasks, tasks)


def test_nulls_are_breaches(spark):
    frames = spark.createDataFrame([(0, 0, 0.0), (0, 1, None), (1, 0, 0.0), (1, None, 0.1), (2, 0, float("nan"))], "episode long, frame long, timestamp double")
    assert sorted((r.episode, r.reason) for r in checks.timeline(frames, 10.0).collect()) == [(0, "timestamp"), (1, "frame"), (1, "frame"), (2, "timestamp")]
    entries = spark.createDataFrame([(0, 0, None), (0, 1, 3), (1, None, 2), (2, 0, 2), (2, 1, 4), (3, 0, 1), (3, 1, None), (4, 0, 0), (4, None, 1)], "episode long, output_frame long, source_frame long")
    assert {r.episode for r in checks.source_map(entries).where("valid").collect()} == {2}


def test_numbers_over_ranges(spark):
    """Ranges follow the rows, not the numbers: one far number puts no others together; callers' columns stay."""
    rows = [(e, e % 5 + 1, "mine") for e in (-7, -2, 0, 1, 2, 3, 9, 10, 11, 500, 10**15)]
    got = series.numbered(spark.createDataFrame(rows, "episode long, length long, PART_ string").repartition(4), "episode", "place", "length", "begin")
    assert got.columns == ["episode", "length", "PART_", "place", "begin"]
    assert {r.episode: (r.place, r.begin) for r in got.collect()} == {e: (i, sum(n for _, n, _ in rows[:i])) for i, (e, *_) in enumerate(rows)}
    many = spark.range(20000).selectExpr("id * 3 episode", "1L length").union(spark.createDataFrame([(10**15, 1), (None, 1)], "episode long, length long"))
    placed = series.numbered(many, "episode", "place").selectExpr("count(*) n", "count_if(place = if(episode is null, 0, if(episode = 1000000000000000, 20001, episode div 3 + 1))) good").first()
    assert tuple(placed) == (20002, 20002)
    assert series.with_offsets(spark.createDataFrame([], "episode long, length long")).count() == 0


def test_bad_input(spark):
    with pytest.raises(ValueError):
        datasets.Profile("pose", (0, 1, 2))
    bad = spark.createDataFrame([(1, 1, "x")], "episode long, frame long, reason string")
    with pytest.raises(ValueError):
        checks.require_valid(bad, "timeline")
    assert [datasets.byte_range(h, 10) for h in ("bytes=2-4", "bytes=5-", "bytes=-3", "bytes=11-", "x")] == [(2, 4), (5, 9), (7, 9), None, None]


def test_streamed_transitions(spark, tmp_path):
    from framelake.streaming import streamed_transitions

    schema = "episode long, frame long, value double"
    parts = [[(1, 0, 1.0), (1, 1, 0.5), (2, 0, 0.95)], [(1, 2, 0.85), (1, 3, 0.95), (2, 1, 0.7)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streamed_transitions(stream, 0.8, 0.9).writeStream.format("memory").queryName("transitions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("transitions").collect()) == [(1, 1, "c"), (1, 3, "o"), (2, 1, "c")]


def test_rest_stands_without_corpus_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    home = Path(__file__).parent.parent
    shutil.copytree(home / "framelake", tmp_path / "framelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pose_speed_stats' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
