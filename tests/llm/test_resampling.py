"""Importance resampling against plain loops: models, weights, keys and the choice, with ties, odd ids and repeated labels."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from framelake.llm import resampling
from framelake.llm.bytewords import gram_hashes, word_hashes


def hashed(word: bytes) -> int:
    return int(word_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def plain_grams(text: str | None) -> list[int]:
    import re

    h = [hashed(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x00-\x20\x7f-\xff]+", (text or "").encode().lower())]
    two = [int(gram_hashes(np.array(h[i : i + 2], np.uint64), 2)[0]) for i in range(len(h) - 1)]
    return [x % resampling.GRAMS for x in h + two]


def test_log_gamma():
    assert np.allclose(resampling.log_gamma(np.array([0.1, 0.5, 1, 7.3, 1e6])), [math.lgamma(x) for x in (0.1, 0.5, 1, 7.3, 1e6)], rtol=1e-10, atol=1e-6)


def test_models_are_normalised_and_tell_grams_apart():
    rng = np.random.default_rng(4)
    raw = np.concatenate([rng.integers(1, 5000, 3000), np.full(20, 3000), np.full(5, 60)]).astype(float)  # ordinary, junk, rare junk
    good = rng.binomial(raw.astype(int), 0.3).astype(float)
    good[3000:] = 0
    logs = resampling.log_ratio(raw, good)
    assert abs((raw * np.exp(logs)).sum() / raw.sum() - 1) < 1e-9
    assert np.median(np.abs(logs[:3000])) < 0.1 and (logs[3000:3020] < -5).all() and (logs[3020:] < -2).all()
    assert not resampling.log_ratio(raw, np.zeros(len(raw))).any()


@pytest.mark.parametrize("per_gram", [False, True])
def test_weights_keys_and_choice(spark, per_gram):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(5, 60))) + (" bad worse" * 3 if i % 3 == 0 else "") for i in range(240)] + [None, "", "###", texts_long := "w1 w2 " * 700]
    ids = [f"id{i}" for i in range(len(texts))]
    rows = [*zip(ids, texts, strict=True), (None, "w1 w2"), (ids[1], texts[1]), (ids[1], texts[1])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = [(ids[i], int(i % 3 > 0), 0) for i in range(0, 200, 2)] + [(ids[2], 1, 0), (ids[4], 0, 1), (None, 1, 0), (ids[5], None, 0)]
    out = resampling.resampled(docs, spark.createDataFrame(labels, "doc_id string, quality int, toxic int"), per_gram=per_gram)
    got = out.collect()
    good_ids = {i for i, q, _ in labels if i and q is not None} - {i for i, q, t in labels if q == 0 or t}
    folds = {r.doc_id: r.fold for r in docs.selectExpr("doc_id", "cast(pmod(xxhash64(doc_id, 11, 'fold'), 2) as int) fold").collect()}
    raw, good = np.zeros(resampling.GRAMS), np.zeros((2, resampling.GRAMS))
    for i, t in rows:
        for g, n in Counter(plain_grams(t)).items():
            raw[g] += n
            if i in good_ids:
                good[folds[i], g] += n
    logs = [resampling.log_ratio(raw, g) for g in good]
    if per_gram:
        logs = [lo - (o * lo).sum() / o.sum() for lo, o in zip(logs, good[::-1], strict=True)]
    length = raw.sum() / len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id or "", r.log_weight)), sorted(rows, key=lambda x: (x[0] or "", 0)), strict=True):
        g = plain_grams(t)
        want = sum(logs[1 - folds[i]][x] for x in g) * (length / len(g) if per_gram and g else 1)
        assert abs(r.log_weight - want) < 1e-3 * (1 + abs(want))
    k = round(len(rows) * len(good_ids) / len({i for i, q, _ in labels if i and q is not None}))
    least = sorted((r.sample_key for r in got), reverse=True)[k - 1]
    assert all(r.kept == (r.sample_key >= least) for r in got)
    assert len({r.sample_key for r in got if r.doc_id == ids[1]}) == 1  # ties stay together
    assert texts_long


def test_long_ids_and_no_labels(spark):
    ids = [2**60, 2**60 + 1, 2**60 + 2]
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1, 0), (ids[1], 0, 0), (ids[2], 0, 0)], "doc_id long, quality int, toxic int")
    assert sum(r.kept for r in resampling.resampled(docs, labels).collect()) == 1
    assert all(r.kept for r in resampling.resampled(docs, labels.limit(0)).collect())
