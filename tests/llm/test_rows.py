"""Rows that share ids, null ids, clashing column names and stored maps: nothing is lost, doubled or decided in one lump."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from framelake.llm import capfilters, components, mixing, shards, winnowing


def test_null_ids_mix_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"{i} b c d e", "s") for i in range(400)] + [(7, "a b c d e", "s")] * 400, "doc_id long, text string, source string")
    got = mixing.copies(docs).agg(F.sum(F.col("size") * F.col("copies")), F.max("target"), F.max("copies")).first()
    assert abs(got[0] - got[1]) < 0.08 * got[1] and got[2] == 2
    assert abs(mixing.mixed(docs).count() * 5 - got[1]) < 0.08 * got[1]
    counts = collections.Counter(mixing.copies(docs.where("doc_id is null")).toPandas()["copies"])
    assert set(counts) == {1, 2}


def test_clashing_names(spark):
    data = [(i, f"w{i} x y", "s", 1, 2, 3, 4, 5, 6) for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, of int, rate int, chance int, copy int, Text_Hash int, text_crc int")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(data)
    bench = spark.createDataFrame([(1, "w3 x y")], "item_id long, text string")
    assert {tuple(r) for r in winnowing.without_contaminated(docs, bench).collect()} == {r for r in data if r[0] != 3}
    wide = docs.withColumns({"virtual_slot": F.lit(1), "whole_row": F.lit(2), "row_size": F.lit(3), "parts": F.lit(9), "bytes": F.lit(4), "n": F.lit(1)})
    out = shards.sharded(wide, 4)
    assert out.count() == 30 and out.where("parts = 9 and whole_row = 2").count() == 30


def test_one_id_fills_no_slot(spark):
    docs = spark.createDataFrame([(5, "same text " * 20)] * 400, "doc_id long, text string")
    for rows in (shards.shard_places(docs, 4), shards.sharded(docs.withColumn("k", F.monotonically_increasing_id()), 4)):
        load = collections.Counter(r.shard for r in rows.collect())
        assert sum(load.values()) == 400 and max(load.values()) - min(load.values()) <= 60
    places = collections.defaultdict(list)
    for r in shards.shard_places(docs, 4).collect():
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_fine_parts(spark, monkeypatch):
    monkeypatch.setattr(shards, "RANKED", 5)
    docs = spark.createDataFrame([(i % 90, f"text {i % 45}" * (i % 7)) for i in range(500)] + [(None, None)] * 3, "doc_id long, text string")
    places = collections.defaultdict(list)
    for r in shards.shard_places(docs, 3, 8).collect():
        places[r.shard].append(r.place)
    assert sum(map(len, places.values())) == 503 and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_version_is_stored_once(spark, tmp_path):
    sizes = spark.createDataFrame([(i, 100, 1) for i in range(8)], "virtual_slot int, bytes long, n long")
    first = shards.rebalanced(sizes, 2)
    shards.store_map(first, str(tmp_path))
    with pytest.raises(Exception, match="exist"):
        shards.store_map(first, str(tmp_path))
    assert shards.latest_map(spark.read.parquet(str(tmp_path))).count() == 8


def test_vectors_that_share_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.0], [1.0, 0.05, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    data = [(1, a, 0, 9), (1, b, 0, 9), (2, b, 0, 9), (1, c, 0, 9), (3, c, 0, 9)]
    got = sorted(tuple(r) for r in capfilters.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, n_links int")).collect())
    assert [r[:3] for r in got] == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_hubs(spark):
    links = spark.range(3000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(6000, 6300).select("id", (F.col("id") + 1)))
    got = components.components(links).groupBy("component").count().collect()
    assert sorted((r.component, r["count"]) for r in got) == [(0, 3001), (6000, 301)]


def test_many_items_and_runs(spark):
    items = [(i, f"alpha{i} " + "beta " * 12) for i in range(200)] + [(900, "zig " * 30)]
    text = " ".join(f"alpha{i} " + "beta " * 12 for i in range(200)) + " stop " + "zig " * 400
    got = winnowing.decontaminated(spark.createDataFrame([(1, text), (2, "beta " * 9)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[1].n_hit, len(rows[1].items), rows[2].n_hit) == (200 * 13 + 400, 201, 0)
    assert [(s.first_word, s.end_word) for s in rows[1].spans] == [(0, 2600), (2601, 3001)]
