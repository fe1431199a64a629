"""Conversion of multi-episode files, publishing, and predicates."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framelake.functions.predicates import matches
from framelake.sources import convert, datasets, publish


@pytest.fixture
def source(spark, tmp_path):
    """Three episodes of 3, 4 and 2 frames in one file."""
    rows, at = [], 0
    for e, n in ((0, 3), (1, 4), (2, 2)):
        rows += [(e, f, at + f, f / 10, e % 2, [float(f), 1.0]) for f in range(n)]
        at += n
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, index long, timestamp float, task_index long, pose array<float>")
    frames.coalesce(1).write.parquet(str(tmp_path / "data"))
    episodes = spark.createDataFrame([(0, 3, 0, 3, ["a"]), (1, 4, 3, 7, ["b"]), (2, 2, 7, 9, ["a"])], "episode_index long, length long, dataset_from_index long, dataset_to_index long, tasks array<string>")
    episodes.write.parquet(str(tmp_path / "meta/episodes"))
    spark.createDataFrame([(0, "a"), (1, "b")], "task_index long, __index_level_0__ string").coalesce(1).write.parquet(str(tmp_path / "meta/tasks.parquet"))
    return str(tmp_path)


def test_convert(spark, source, tmp_path):
    frames, episodes, tasks = spark.read.parquet(f"{source}/data"), convert.read_episodes(spark, source), convert.read_tasks(spark, source)
    assert convert.episode_breaches(episodes).count() == convert.gaps(frames, episodes).count() == convert.task_set_breaches(episodes, frames, tasks).count() == 0
    picked = convert.chosen(episodes, [2, 1])
    out = convert.relaid(frames, picked, 10.0)
    got = out.orderBy("index").collect()
    assert [(r.episode_index, r.frame_index, r["index"]) for r in got] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 4), (1, 1, 5)] and out.dtypes == frames.dtypes
    with pytest.raises(ValueError):
        convert.chosen(episodes, [1, 9])
    told = {(r.episode_index, r.feature): r for r in convert.feature_stats(out, ["pose", "timestamp"], ["episode_index"]).collect()}
    assert told[0, "pose"].max == [3.0, 1.0] and told[0, "pose"]["count"] == [4] and told[1, "timestamp"].mean == pytest.approx([0.05]) and told[1, "pose"].std == [0.5, 0.0]
    info = convert.info_of(out, tasks, {"fps": 10, "features": {"cam": {"dtype": "video"}, "pose": {"dtype": "float32"}}})
    assert (info["total_frames"], info["total_episodes"], info["total_videos"], info["total_chunks"]) == (6, 2, 2, 1)
    convert.write_metadata(str(tmp_path / "new"), info, picked.select("new_index", "length").withColumnRenamed("new_index", "episode_index"), tasks, convert.feature_stats(out, ["pose"], ["episode_index"]))
    assert json.loads((tmp_path / "new/meta/info.json").read_text()) == info and spark.read.json(str(tmp_path / "new/meta/episodes.jsonl")).count() == 2
    assert {r.episode_index: r.fps for r in convert.inferred_fps(frames).collect()} == {0: 10.0, 1: 10.0, 2: 10.0}
    assert convert.same_rows(frames, frames, ["index"]).count() == 0
    changed = frames.selectExpr("index", "if(index = 4, 9, frame_index) frame_index")
    assert [r[0] for r in convert.same_rows(frames, changed, ["index"], ["frame_index"]).collect()] == [4]
    assert convert.differing_schemas(spark, [f"{source}/data", f"{source}/meta/episodes"]) == [f"{source}/meta/episodes"]


def test_breaches(spark):
    bad = spark.createDataFrame([(0, 3, 0, 3), (2, 2, 3, 5), (3, 0, 5, 5), (4, 2, 6, 8)], "episode_index long, length long, dataset_from_index long, dataset_to_index long")
    assert {r.episode_index: r.reason for r in convert.episode_breaches(bad).collect()} == {2: "number", 3: "number", 4: "number"}
    bad = spark.createDataFrame([(0, 3, 0, 3), (1, 0, 3, 3), (2, 2, 4, 6)], "episode_index long, length long, dataset_from_index long, dataset_to_index long")
    assert {r.episode_index: r.reason for r in convert.episode_breaches(bad).collect()} == {1: "length", 2: "bounds"}
    frames = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 1)], "episode_index long, frame_index long, index long")
    assert convert.gaps(frames, bad).count() == 3
    column = [[[0.1]], [[0.2]], [[0.3]]]
    told = spark.createDataFrame([(0, column, column, column, column), (1, column, column, column, [[[0.1]], [[-1.0]], [[0.3]]]), (2, column, column, column[:2], column)], "episode_index long, min array<array<array<double>>>, max array<array<array<double>>>, mean array<array<array<double>>>, std array<array<array<double>>>")
    assert sorted(r.episode_index for r in convert.visual_breaches(told).collect()) == [1, 2]
    packets = spark.createDataFrame([("v", i, i / 10, i / 10, i in (0, 4)) for i in range(9)], "video string, packet long, pts double, dts double, key boolean")
    slices = spark.createDataFrame([("v", 0, 0.0, 0.4, 4), ("v", 1, 0.4, 0.9, 5), ("v", 2, 0.2, 0.4, 2), ("v", 3, 0.4, 0.9, 6)], "video string, episode_index long, from_timestamp double, to_timestamp double, length long")
    assert {r.episode_index: r.reason for r in convert.slice_breaches(packets, slices, 10.0).collect()} == {2: "key frame", 3: "packets"}
    late = packets.withColumn("pts", F.when(F.col("packet") >= 4, F.col("pts") + 0.03).otherwise(F.col("pts"))).withColumn("dts", F.col("pts"))
    early = packets.withColumn("dts", F.when(F.col("packet") == 5, 0.45).otherwise(F.col("dts")))
    one = spark.createDataFrame([("v", 1, 0.4, 0.9, 5), ("v", 4, 0.0, 0.5, 4), ("v", 5, 0.0, None, 4)], slices.schema)
    told = lambda p, **more: {r.episode_index: r.reason for r in convert.slice_breaches(p, one, 10.0, **more).collect()}
    assert told(packets) == {4: "duration", 5: "duration"} and told(late)[1] == "alignment" and told(early)[1] == "order"
    assert told(packets, rates=spark.createDataFrame([("v", 10.01)], "video string, rate double"))[1] == "frame rate" and told(packets, rates=spark.createDataFrame([("v", 10.0)], "video string, rate double")).get(1) is None
    side = spark.createDataFrame([(7, "x"), (8, "y")], "source_episode long, note string")
    assert [(r.episode_index, r.note) for r in convert.rekeyed(side, spark.createDataFrame([(7, 0)], "source_episode long, episode_index long")).collect()] == [(0, "x")]
    entries = spark.createDataFrame([(1, "h", 2), (1, "h", 9), (1, "other", 2)], "source_episode long, sha256 string, source_frame long")
    assert convert.trusted_map(entries, spark.createDataFrame([(1, "h", 5)], "source_episode long, sha256 string, n_frames long")).count() == 1


def test_publish(spark, tmp_path):
    target = str(tmp_path / "out/set")
    write = lambda n: lambda path: spark.range(n).write.parquet(path)
    publish.publish(spark, target, write(3))
    with pytest.raises(FileExistsError):
        publish.publish(spark, target, write(4))

    def refuse(path):
        raise ValueError(path)

    with pytest.raises(ValueError):
        publish.publish(spark, target, write(4), refuse, replace=True)
    assert spark.read.parquet(target).count() == 3
    publish.publish(spark, target, write(5), replace=True)
    assert spark.read.parquet(target).count() == 5 and len(publish.children(spark, str(tmp_path / "out"))) == 1
    assert publish.snapshot(spark, target, str(tmp_path / "kept")) and not publish.snapshot(spark, target, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept/data")).count() == 5
    calls = []

    def compute():
        calls.append(1)
        return spark.range(2)

    key = publish.content_key(code="1", rules={"a": 0.5})
    assert [publish.cached(spark, str(tmp_path / "cache"), key, compute).count() for _ in range(2)] == [2, 2] and len(calls) == 1
    with pytest.raises(ValueError):
        publish.content_key(x=float("nan"))
    assert publish.contained("/a/b", "c/../d") == "/a/b/d"
    for bad in ("../x", "/etc", "c/../../bc"):
        with pytest.raises(ValueError):
            publish.contained("/a/b", bad)
    (tmp_path / "many/one/meta").mkdir(parents=True)
    (tmp_path / "many/one/meta/info.json").write_text("{}")
    assert [p.rsplit("/", 1)[1] for p in publish.datasets_under(spark, str(tmp_path / "many"))] == ["one"]


def test_names(spark):
    ordinals = datasets.quaternion_ordinals
    assert ordinals(["l_x", "l_y", "l_z", "l_quat_w", "l_quat_x", "l_quat_y", "l_quat_z"], 7, [0, 1, 2]) == [4, 5, 6, 3]
    assert ordinals(["a_x", "a_y", "a_z", "a_w", "a_wx", "a_wy", "a_wz"], 7, [0, 1, 2]) == [4, 5, 6, 3] and ordinals(["x", "y", "z", "qx", "qy", "qz", "qw"], 7, [0, 1, 2]) == [3, 4, 5, 6]
    assert ordinals(["l_pos_x", "l_pos_y", "l_pos_z", "l_quat_x", "l_quat_y", "l_quat_z", "l_quat_w", "r_quat_x"], 8, [0, 1, 2]) == [3, 4, 5, 6]
    assert ordinals([], 14, [7, 8, 9]) == [11, 12, 13, 10] and ordinals([], 16, [8, 9, 10]) == [11, 12, 13, 14]
    for names, width, at in (([], 9, [0, 1, 2]), ([], 14, [1, 2, 3]), ([f"n{i}" for i in range(14)], 14, [0, 1, 2]), (["x", "y", "z", "b_qx", "b_qy", "b_qz", "b_qw"], 7, [0, 1, 2]), (["x", "y", "z", "qx", "qy", "qz", "qw", "qw"], 8, [0, 1, 2]), (["x"], 14, [0, 1, 2])):
        with pytest.raises(ValueError):
            ordinals(names, width, at)
    found = datasets.catalogue("arm:\n  vector: pose\n  indices: [0, 1, 2, 0, 1, 2]\n")
    assert found["arm"].single_arm()
    with pytest.raises(TypeError):
        datasets.catalogue('{"arm": {"vector": "pose", "indices": [0, 1, 2, 0, 1, 2], "more": 1}}')
    state, action = ["left_j1", "left_gripper", "right_j1", "head_yaw", "waist"], ["right_j1", "left_j1", "cmd_vel_x", "left_gripper"]
    groups = datasets.named_groups(state, action, joints=1)
    assert groups["left"] == [("state", 0), ("action", 1)] and groups["joints"] == [("state", 0), ("state", 2), ("action", 0), ("action", 1)]
    assert groups["other"] == [("state", 1), ("state", 3), ("state", 4), ("action", 2), ("action", 3)] and groups["base"] == [("action", 2)] and groups["still"] == [("state", 3), ("state", 4)]
    with pytest.raises(ValueError):
        datasets.named_groups(state, action, joints=7)
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [6.0, 7.0])], "s array<float>, a array<float>")
    assert row.select(datasets.picked(groups["joints"], {"state": F.col("s"), "action": F.col("a")})).first()[0] == [1.0, 3.0, 6.0, 7.0]
    assert datasets.same_name("h01", ["H01", "other"]) == "H01" and datasets.same_name("x", ["y"]) is None
    with pytest.raises(ValueError):
        datasets.same_name("a", ["A", "a"])


def test_video_features(spark):
    probes = spark.createDataFrame([("cam", 48, 64, "h264", "yuv420p", 30.0)] * 2 + [("top", 8, 8, "h264", "yuv420p", 30.0)], "video_key string, height int, width int, codec string, pix_fmt string, rate double")
    told = datasets.video_features({"features": {"cam": {"dtype": "video", "info": {"old": 1}}, "top": {}, "pose": {}}}, probes)["features"]
    assert told["cam"]["shape"] == [3, 48, 64] and told["cam"]["info"]["video.fps"] == 30.0 and told["cam"]["info"]["old"] == 1 and told["pose"] == {}
    with pytest.raises(ValueError):
        datasets.video_features({"features": {"cam": {}}}, probes.withColumn("video_key", F.lit("cam")))


def test_degenerate_quaternions_are_refused(spark):
    from framelake.functions import pose

    def turned(q):
        f = spark.createDataFrame([q], "x double, y double, z double, w double")
        return f.select(pose.tool_offset([F.lit(0.0)] * 3, [F.col(c) for c in "xyzw"], [1.0, 0.0, 0.0])[0]).first()[0]

    assert turned((0.0, 0.0, 0.0, 2.0)) == pytest.approx(1.0)
    for bad in ((0.0, 0.0, 0.0, 1e-9), (0.0, None, 0.0, 1.0), (0.0, float("nan"), 0.0, 1.0), (float("inf"), 0.0, 0.0, 1.0)):
        with pytest.raises(Exception, match="quaternion"):
            turned(bad)


def test_starts_heed_events(spark):
    from framelake.operators import series

    starts = spark.createDataFrame([(e, 10) for e in range(5)] + [(5, 0)], "episode long, start_frame long")
    events = spark.createDataFrame([(1, 2, 5), (2, 8, 12), (3, 6, 9), (3, 9, 11), (4, 8, 12), (4, 9, 10), (5, 0, 3)], "episode long, start_frame long, end_frame long")
    assert {r.episode: (r.start_frame, r.note) for r in series.started(starts, events).collect()} == {0: (10, None), 1: (0, "earlier_event"), 2: (8, "inside_event"), 3: (0, "earlier_event"), 4: (8, "inside_event"), 5: (0, None)}


def test_packets_of_one_long_video(spark):
    """A third of all packets are one video's; each slice meets the packets near it. A fall anywhere in a video tells on all its slices."""
    packets = spark.range(6000).selectExpr("if(id < 2000, 'hot', concat('v', id % 40)) video", "if(id < 2000, id, id div 40 - 50) packet").selectExpr("video", "packet", "packet / 10d pts", "cast(null as double) dts", "packet % 5 = 0 key")
    slices = packets.where("packet % 5 = 0").selectExpr("video", "packet div 5 episode_index", "packet / 10d from_timestamp", "(packet + 5) / 10d to_timestamp", "5L length")
    assert convert.slice_breaches(packets, slices, 10.0).count() == 0
    fallen = packets.withColumn("pts", F.when((F.col("video") == "v3") & (F.col("packet") == 7), F.col("pts") - 0.5).otherwise(F.col("pts")))
    told = convert.slice_breaches(fallen, slices, 10.0).groupBy("video").agg(F.count("*").alias("n"), F.collect_set("reason").alias("why")).collect()
    assert [(r.video, r.n) for r in told] == [("v3", 20)] and "times" in told[0].why
    twice = slices.where("video = 'hot' and episode_index < 2").union(slices.where("video = 'hot' and episode_index = 0").withColumn("length", F.lit(6)))
    assert [(r.episode_index, r.reason) for r in convert.slice_breaches(packets, twice, 10.0).collect()] == [(0, "duration")]


def test_file_tasks_and_digests(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "a"))
    (tmp_path / "a/more").mkdir()
    (tmp_path / "a/more/note.txt").write_bytes(b"x" * 10)
    assert publish.snapshot(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    listed = {r.path: (r.length, r.sha256) for r in spark.read.parquet(str(tmp_path / "b/manifest")).collect()}
    assert listed["more/note.txt"][0] == 10 and (tmp_path / "b/data/more/note.txt").read_bytes() == b"x" * 10 and spark.read.parquet(str(tmp_path / "b/data/*.parquet")).count() == 10
    spark.range(3).selectExpr("id + 0.5 id").coalesce(1).write.parquet(str(tmp_path / "c"))
    assert convert.differing_schemas(spark, [str(tmp_path / n) for n in "aac"]) == [str(tmp_path / "c")]
    (tmp_path / "c/part-bad.parquet").write_bytes(b"PAR1 nothing")
    with pytest.raises(ValueError, match="part-bad"):
        convert.differing_schemas(spark, [str(tmp_path / n) for n in "ac"])
    calls = []

    def compute():
        calls.append(1)
        return spark.range(50).repartition(2)

    def get():
        return publish.cached(spark, str(tmp_path / "cache"), "k", compute).count(), len(calls)

    assert (get(), get()) == ((50, 1), (50, 1))
    part = sorted((tmp_path / "cache/k").glob("part-*.parquet"))[0]
    held = bytearray(part.read_bytes())
    held[20] ^= 1
    part.write_bytes(held)
    (tmp_path / "cache/k" / f".{part.name}.crc").unlink()
    assert (get(), get()) == ((50, 2), (50, 2))
    sorted((tmp_path / "cache/k").glob("part-*.parquet"))[1].unlink()
    assert get() == (50, 3)


def test_predicates(spark):
    rows = spark.createDataFrame([(1, 5.0, ("x",)), (2, None, ("y",)), (3, 9.0, (None,))], "id long, v double, s struct<n: string>")
    ids = lambda q: [r.id for r in rows.where(matches(q)).orderBy("id").collect()]
    assert ids({"v": {"$gt": 4, "$lte": 5}}) == [1] and ids({"v": {"$ne": 5.0}}) == [2, 3] and ids({"v": None}) == [2]
    assert ids({"s.n": {"$in": ["x", None]}}) == [1, 3] and ids({"s.n": {"$nin": ["x"]}}) == [2, 3] and ids({"v": {"$not": {"$gte": 6}}}) == [1, 2]
    assert ids({"$or": [{"id": 1}, {"v": {"$gt": 8}}]}) == [1, 3] and ids({"$nor": [{"id": 1}]}) == [2, 3] and ids({"$and": [{"id": {"$lt": 3}}, {"s.n": "y"}]}) == [2] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        matches({"v": {"$near": 1}})
