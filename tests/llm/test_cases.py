"""Nulls, empty and odd rows, ties and empty tables for every corpus operator, and small planted cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import buckets, capfilters, components, langid_crf, licenses, mixing, paragraphs, pseudolm, resampling, shards, simhash, winnowing

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, h long, shard int, size int"
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60, 99)
ODD = [None, "", "   \n\n ", "!!!", "é", "——", "a", "MIT LICENSE", "word " * 3000, PASSAGE, prose(30, 1) + " " + PASSAGE + " " + prose(30, 2), prose(80, 3), prose(80, 3)]


@pytest.fixture(scope="module")
def odd(spark):
    data = [(i if i != 4 else None, t, "en" if i % 2 else None, None if i % 3 else "s", None, None, None, None, None, None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*data, data[11], data[11]], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0), (8, 0, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "a"), (3, None), (None, prose(12, 3)), (5, "")], "item_id long, text string")


def each(docs, labels, bench):
    """Every operator's main result over ``docs``, with how many rows it should have (None: any)."""
    n = docs.count()
    return {
        "languages": (langid_crf.labelled(docs, langid_crf.fit(docs), True), n), "identified": (langid_crf.identified(docs), None), "places": (shards.shard_places(docs, 4), n), "sharded": (shards.sharded(docs, 4), n),
        "decontaminated": (winnowing.decontaminated(docs, bench), n), "clean": (winnowing.without_contaminated(docs, bench), None), "resampled": (resampling.resampled(docs, labels), n), "passages": (paragraphs.repeated_passages(docs), None),
        "copies": (mixing.copies(docs), n), "mixed": (mixing.mixed(docs), None), "scored": (pseudolm.scored(docs), n), "groups": (simhash.simhash_groups(docs), n), "first": (simhash.keep_first(docs), None), "licenses": (licenses.scanned(docs), n),
    }


def test_odd_rows(odd, labels, bench):
    for name, (result, n) in each(odd, labels, bench).items():
        got = result.collect()
        assert n is None or len(got) == n, name


def test_empty_tables(spark, odd, labels, bench):
    for name, (result, _) in each(odd.limit(0), labels.limit(0), bench.limit(0)).items():
        assert result.collect() == [], name
    assert winnowing.decontaminated(odd, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_odd_results(odd, bench):
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid_crf.labelled(odd, langid_crf.fit(odd)).collect()}
    assert all(lang[i] == ("und", 0.0) for i in (0, 1, 2, 3, 5)) and lang[6][0] == "en"
    hits = {r.doc_id: r for r in winnowing.decontaminated(odd, bench).collect()}
    assert (hits[9].n_hit, hits[10].n_hit, hits[6].n_hit, hits[0].n_words, hits[7].n_hit) == (60, 60, 1, 0, 0)
    assert hits[11].items == [""] and hits[11].n_hit == 12
    prints = {r.doc_id: r.component_id for r in simhash.simhash_groups(odd).collect()}
    assert prints[0] == prints[1] == prints[2] == 0 and prints[11] == prints[12] == 11
    assert simhash.keep_first(odd).where("doc_id = 11").count() == 1
    passages = {r.doc_id for r in paragraphs.repeated_passages(odd).collect()}
    assert {9, 10, 11, 12} <= passages and not passages & {0, 1, 2, 3, 6}


def test_vectors_without_links(spark):
    v = [1.0] + [0.0] * 7
    data = [(1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0] * 8, 0), (6, [float("nan")] * 8, 0), (7, [None] + v[1:], 0), (8, [], 0), (9, [2.0, 0.3] + [0.0] * 6, 0), (10, v, 1), (None, v, 0), (11, [1.0, 0.0], 0)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilters.near_vectors(frame).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11))
    assert capfilters.near_vectors(frame.limit(0)).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100)], "a long, b long")
    got = {r.id: r.component for r in components.components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == got[200] == 100


def test_split_buckets_meet_all(spark, monkeypatch):
    prints = [random.Random(5).getrandbits(40)]
    for k in range(120):
        prints.append(prints[-1] ^ (1 << random.Random(k).randrange(40)))
    frame = spark.createDataFrame([(p,) for p in sorted(set(prints))], "fp long")
    whole = {tuple(r) for r in components.components(simhash.fingerprint_links(frame)).collect()}
    monkeypatch.setattr(simhash, "split_buckets", lambda rows: buckets.split_buckets(rows, 3))
    assert {tuple(r) for r in components.components(simhash.fingerprint_links(frame)).collect()} == whole and len({c for _, c in whole}) == 1


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 0 and abs(sum(got.values()) - 1.5 * 1510) < 1e-6 and all(got[s] <= 2 * n for s, n in (("b", 1000), (None, 500)))


def test_mix_repeats(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 5 > 0]) for i in range(3000)], "doc_id long, text string, source string")
    plan = mixing.copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) < 0.05 * r.t for r in plan)
    assert mixing.mixed(docs).count() == mixing.copies(docs).agg(F.sum("copies")).first()[0]


def test_map_is_edited(spark, tmp_path):
    sizes = spark.createDataFrame([(i, 100 + i % 7, 1) for i in range(64)], "virtual_slot int, bytes long, n long")
    first = shards.rebalanced(sizes, 4)
    second = shards.rebalanced(sizes, 5, first, 2)
    shards.store_map(first, str(tmp_path))
    shards.store_map(second, str(tmp_path))
    latest = shards.latest_map(spark.read.parquet(str(tmp_path))).collect()
    load = [sum(r.bytes for r in latest if r.shard == k) for k in range(5)]
    assert len(latest) == 64 and max(load) - min(load) <= 107
    assert sum(r.shard != r.moved_from for r in latest) <= 20


def test_kth_largest(spark):
    values = [random.Random(1).getrandbits(62) - (1 << 61) for _ in range(500)] + [7] * 20
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    assert all(resampling.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1] for k in (1, 250, 519))


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    model = langid_crf.Crf(["a", "b", "c"], None, None, None, r.standard_normal(3), r.standard_normal((3, 3)))
    scores, first = r.standard_normal((400, 3)), np.zeros(400, bool)
    first[[0, 1, 150, 399]] = True
    got, _ = langid_crf.forward_backward(scores, first, model)
    for a, b in ((0, 1), (1, 150), (150, 399), (399, 400)):
        e, move, start = np.exp(scores[a:b]), np.exp(model.move), np.exp(model.start)
        alpha, beta = [start * e[0]], [np.ones(3)]
        for t in range(1, b - a):
            alpha.append((alpha[-1] @ move) * e[t] / alpha[-1].sum())
        for t in range(b - a - 1, 0, -1):
            beta.append(move @ (e[t] * beta[-1]) / beta[-1].sum())
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_code_switched_words(spark):
    pairs = [(f"{'the that with ' * 3}shall thing other {i}", "en") for i in range(60)] + [(f"{'der und nicht ' * 3}schon können über {i}", "de") for i in range(60)]
    model = langid_crf.fitted([t for t, _ in pairs], [g for _, g in pairs])
    frame = spark.createDataFrame([(1, "the that other thing der nicht schon über und")], "doc_id long, text string")
    spans = langid_crf.labelled(frame, model, True).first().spans
    assert [(s.first_word, s.end_word, s.lang) for s in spans] == [(0, 4, "en"), (4, 9, "de")]


def test_gradient_is_the_derivative():
    r = np.random.default_rng(1)
    params = {k: v.astype(float) for k, v in pseudolm.initial().items()}
    token, context = r.integers(0, pseudolm.TOKENS, 50), [r.integers(0, pseudolm.TOKENS + 1, 50) for _ in range(4)]
    grads = pseudolm.gradient(params, token, context)
    for name, at in (("classes", (3, 4)), ("hidden", (5,)), ("context", (1, int(context[1][0]), 2)), ("tokens", (int(token[0]) // pseudolm.PER_CLASS, int(token[0]) % pseudolm.PER_CLASS, 1))):
        up = {k: v.copy() for k, v in params.items()}
        up[name][at] += 1e-5
        slope = (pseudolm.log_probabilities(up, token, context).mean() - pseudolm.log_probabilities(params, token, context).mean()) / 1e-5
        assert abs(slope - grads[name][at]) < 1e-5


def test_bands_reach_recall():
    bands, per_band = paragraphs.tune_bands()
    assert 1 - (1 - 0.8**per_band) ** bands >= 0.99 and bands <= paragraphs.MOST_BANDS
