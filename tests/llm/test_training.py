"""The pseudo-likelihood network predicts every position, alike however the table is split, and scores equal plain loops."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from types import SimpleNamespace

from framelake.llm import pseudolm
from framelake.llm.bytewords import word_hashes


def test_every_position_is_predicted():
    texts = ["stone river cloud " * 3000, "river", None, "cloud stone"]
    shared = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, int), pseudolm.packed(pseudolm.initial())))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([5, 6, 7, 8])], ["text", "key"])
    (dealt,) = pseudolm._dealt(iter([batch]), shared, 1)
    assert dealt.num_rows == 5 and sum(len(x) // 2 for x in dealt.column("tokens").to_pylist()) == 9003 + 2 * 2 * pseudolm.REACH
    (out,) = pseudolm._trained(iter([dealt]), shared, 3)
    assert set(out.column("n").to_pylist()) == {9003}


def test_gradients_of_context_rows_are_summed_exactly_and_cheaply():
    rng = np.random.default_rng(5)
    sizes = np.concatenate([[5000, 1, 16, 17, 256, 257, 4097], rng.integers(1, 20, 2000)])
    x = rng.standard_normal((3000, pseudolm.WIDTH)).astype(np.float32)
    at = rng.integers(0, len(x), sizes.sum())
    ends = np.cumsum(sizes)

    def plain() -> np.ndarray:
        return np.add.reduceat(x[at], ends - sizes, axis=0)

    def seconds(f) -> float:
        def once() -> float:
            begin = time.process_time()
            f()
            return time.process_time() - begin

        return min(once() for _ in range(15))

    want = np.add.reduceat(x[at].astype(float), ends - sizes, axis=0)
    assert np.abs(pseudolm._row_sums(x, at, sizes) - want).max() < 1e-4
    assert seconds(lambda: pseudolm._row_sums(x, at, sizes)) < 0.8 * seconds(plain)


def hashed(word: str) -> np.uint64:
    raw = word.encode()
    return word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]


def test_scores_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "HEAD", 1300)
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(1152)], [f"r{i}" for i in range(700)]
    texts = [" ".join(rng.choices(common, k=250) + common[60 * i : 60 * i + 60] * 3 + rng.choices(rare, k=40)) for i in range(20)] + ["", None, "r1 r2 R2"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudolm.scored(docs.repartition(3)).collect()}
    again = {r.doc_id: r for r in pseudolm.scored(docs.repartition(1)).collect()}
    known, number, flat = pseudolm.fit(docs, counts := pseudolm.word_counts(docs))
    assert counts.where("n > 1").count() > 1300 - 1152  # some words must be joined
    params, own = pseudolm.unpacked(flat), dict(zip(known.tolist(), number.tolist(), strict=True))
    split = [re.findall("[0-9a-z]+", (t or "").lower()) for t in texts]
    n = Counter(w for words in [*split, split[0]] for w in words)
    token = {w: own.get(int(hashed(w)), int(pseudolm.shared_tokens(np.array([hashed(w)]))[0])) for w in n}
    in_token = Counter()
    for w, k in n.items():
        in_token[token[w]] += k
    for i, words in enumerate(split):
        total, t = 0.0, [token[w] for w in words]
        for k, w in enumerate(words):
            hidden = params["hidden"].astype(float).copy()
            for p, shift in enumerate((-2, -1, 1, 2)):
                hidden += params["context"][p][t[k + shift] if 0 <= k + shift < len(t) else pseudolm.TOKENS]
            hidden = np.tanh(hidden)
            c, j = divmod(t[k], pseudolm.PER_CLASS)
            for weights, bias, at in ((params["classes"], params["class_bias"], c), (params["tokens"][c], params["token_bias"][c], j)):
                logits = weights.astype(float) @ hidden + bias
                total += logits[at] - math.log(np.exp(logits).sum())
            total += math.log(n[w] / in_token[t[k]])
        assert got[i].n_tokens == len(words) and abs(got[i].log_likelihood - total) < 1e-3 * (1 + len(words))
        assert (got[i].mean_log_likelihood is None) == (not words)
        assert abs(got[i].log_likelihood - again[i].log_likelihood) < 1e-3 * (1 + len(words))


def test_equal_pieces_are_dealt_alike_over_all_parts(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "PART", 4000)
    monkeypatch.setattr(pseudolm, "FIRST_WAVE", 2)
    text = "stone river cloud " * 30
    rows = [(1, text)] * 400 + [(i, f"leaf {i} tree") for i in range(2, 400)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = {}
    for split in (1, 5):
        seen = []
        old = pseudolm._spread
        monkeypatch.setattr(pseudolm, "_spread", lambda *a: seen.append(old(*a)) or seen[-1])
        pseudolm.fit(docs.repartition(split), pseudolm.word_counts(docs))
        monkeypatch.setattr(pseudolm, "_spread", old)
        given[split] = Counter((r.part, r.wave, r.place, bytes(r.tokens)) for r in seen[0].collect())
    assert given[1] == given[5] and given[1].total() == 400 + 398
    hot, size = Counter(), Counter()
    for (part, wave, _, tokens), n in given[1].items():
        hot[part] += n * (len(tokens) == 180)
        size[part] += n
        assert wave == (part >= 2) + (part >= 4) + (part >= 8) + (part >= 16)
    assert len(size) > 5 and max(hot.values()) < 400 / 3


def test_more_waves_predict_held_out_texts_better(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "PART", 6000)
    monkeypatch.setattr(pseudolm, "FIRST_WAVE", 2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    after = {w: rng.sample(words, 2) for w in words}

    def text() -> str:
        out = [rng.choice(words)]
        while len(out) < 80:
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    texts = [text() for _ in range(1500)]
    n = Counter(w for t in texts for w in t.split())
    unigram = sum(k * math.log(k / n.total()) for k in n.values()) / n.total()
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    none, one, all_ = (pseudolm.held_out(docs, most_waves=n) for n in (0, 1, None))
    assert abs(none - unigram) < 0.1 and one > none + 0.1 and all_ > one + 0.1, (unigram, none, one, all_)


def test_words_whose_counts_are_large_and_many_are_not_all_collected(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "HEAD", 10)
    counts = spark.range(50).selectExpr("id h", "if(id < 4, 5000000000 + id, 3000000) n")
    head, logs, _, least = pseudolm.word_shares(counts, np.zeros(0, np.uint64))
    assert sorted(head.tolist()) == [0, 1, 2, 3] and 3000000 < least <= 5000000000
    everything = pseudolm.word_shares(counts.where("h >= 4"), np.zeros(0, np.uint64))
    assert not len(everything[0]) and everything[3] > 3000000
