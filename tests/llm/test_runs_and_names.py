"""Runs and periods of words, items that many documents hold, callers' columns with any name, draws of repeated rows, and large doubles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.llm import capfilters, langid_crf, mixing, shards, simhash, winnowing
from framelake.llm.winnowing import progressions


def hits(spark, docs: list[tuple], items: list[tuple]) -> dict:
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.n_hit, tuple(r["items"])) for r in winnowing.decontaminated(d, b).collect()}


def test_runs_and_periods(spark):
    docs = [(1, "a " * 50000), (2, "a " * 3 + "b " * 9), (3, "x y " * 25000), (4, "p q r " * 4000), (5, "x y " * 4 + "z")]
    items = [(1, "a " * 5000), (2, "x y " * 2500), (3, "r p q " * 700), (4, "y x")]
    assert hits(spark, docs, items) == {1: (50000, ("1",)), 2: (0, ()), 3: (50000, ("2", "4")), 4: (12000, ("3",)), 5: (6, ("4",))}


def test_progressions_cover_all_places():
    import numpy as np

    r = random.Random(1)
    no, g, at = (np.array(x) for x in zip(*sorted({(r.randint(0, 3), r.randint(0, 4), r.randint(0, 60)) for _ in range(200)} | {(7, 1, k) for k in range(50)} | {(8, 1, 3 * k) for k in range(50)}), strict=True))
    told = list(zip(*(x.tolist() for x in progressions(no, g, at)), strict=True))
    covered = {(n, h, p) for n, h, a, b, s in told for p in range(a, b + 1, max(s, 1))}
    assert covered == set(zip(no.tolist(), g.tolist(), at.tolist(), strict=True))
    assert [x[2:] for x in told if x[0] > 6] == [(0, 49, 1), (0, 147, 3)]
    assert all(len(x) == 0 for x in progressions(no[:0], g[:0], at[:0]))


def test_common_and_equal_items(spark):
    r = random.Random(3)
    words = lambda n, of="abcdefgh": " ".join(r.choice(of) * 3 + str(r.randint(0, 99)) for _ in range(n))
    common, rare = words(14), words(12)
    docs = [(i, f"{words(5, 'mnop')} {common} {words(5, 'mnop')}" + (f" {rare}" if i == 7 else "")) for i in range(600)]
    items = [(i, common) for i in range(1000)] + [(5000, rare), (5000, rare), (5001, common + " " + words(3))]
    got = hits(spark, docs, items)
    ids = tuple(sorted([str(i) for i in range(1000)] + ["5001"]))
    assert all(got[i] == ((14, ids) if i != 7 else (26, tuple(sorted([*ids, "5000"])))) for i in range(600))


ODD_NAMES = ["doc_id", "text", "lang", "source", "Lang_Pred", "SCORE", "Evidence", "a.b", "back`tick", "Row_Key", "whole_row", "text_hash", "rate", "chance", "draw_key", "m"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"the quick brown fox number {i} went over the hill and far away" if i % 3 else f"le petit renard {i} est sur la colline avec les autres", "en" if i % 3 else "fr", f"s{i % 2}", "mine", float(i), "kept", i, "x", i, i, "h", 0.5, "c", "k", {"a": i}) for i in range(40)]
    kinds = ["long", "string", "string", "string", "string", "double", "string", "long", "string", "long", "long", "string", "double", "string", "string", "map<string,int>"]
    return spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(ODD_NAMES, kinds, strict=True)))


@pytest.mark.parametrize("name,stage", [("identified", langid_crf.identified), ("keep_first", lambda d: simhash.keep_first(d, 0)), ("clean", lambda d: winnowing.without_contaminated(d, d.select(F.lit(1).alias("item_id"), F.lit("none of these words are there").alias("text")).limit(1))), ("mixed", mixing.mixed), ("sharded", shards.sharded)])
def test_callers_columns_stay(named, name, stage):
    kept = stage(named)
    assert kept.columns[: len(ODD_NAMES)] == ODD_NAMES
    want = {r.doc_id: tuple(r) for r in named.collect()}
    got = kept.collect()
    assert got and all(tuple(r)[: len(ODD_NAMES)] == want[r["doc_id"]] for r in got)


def test_repeated_rows_draw_alike_however_split(spark):
    rows = [(1, "some words that repeat", f"s{i % 3}", i % 5) for i in range(300)] + [(None, None, "s0", 0)] * 100 + [(i + 10, "other words here", "s1", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more int")
    sums = []
    for n in (1, 7):
        d = docs.repartition(n)
        taken = {r.source: (r.n, r.s) for r in mixing.copies(d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("s")).collect()}
        whole = sorted((r.source, r.more, r["count"]) for r in mixing.mixed(d).groupBy("source", "more").count().collect())
        sums.append((taken, whole))
    assert sums[0] == sums[1] and sum(n for n, _ in sums[0][0].values()) == len(rows)


def test_large_and_small_doubles_link(spark):
    rows = [(1, [1e200, 0.0, 1e199], 1), (2, [2e200, 0.0, 2e199], 1), (3, [1e-200, 0.0, 1e-201], 1), (4, [2e-250, 0.0, 2e-251], 1), (5, [0.0, 1e300, 0.0], 1), (6, [3.0, 0.0, 0.3], 1), (7, [float("inf"), 0.0, 0.0], 1), (8, [0.0, 0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (4, 1) for i in (1, 2, 3, 4, 6)}, 5: (0, 5), 7: (0, 7), 8: (0, 8)}


def test_all_languages_are_learned(spark):
    r = random.Random(6)
    made = {f"l{k:02d}": [f"{chr(97 + k // 9)}{chr(106 + k % 9)}{r.choice('aeiou')}{r.choice('bcdfg')}{i}" for i in range(12)] for k in range(70)}
    rows = [(i * 100 + k, " ".join(r.choice(w) for _ in range(8)), lang) for i in range(8) for k, (lang, w) in enumerate(made.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid_crf.sample(docs, total=140)
    assert set(drawn["lang"]) == set(made) and drawn.groupby("lang").size().max() == 2
    model = langid_crf.fit(docs, 3)
    assert len(model.langs) == 70
    got = langid_crf.labelled(docs, model).where(langid_crf.held_out()).selectExpr("lang_pred = lang good").collect()
    assert sum(g.good for g in got) >= 0.95 * len(got)
