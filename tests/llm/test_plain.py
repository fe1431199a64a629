"""The pipeline, the language query and the slot map against plain Python that goes row by row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import langid_crf, mixing, shards
from framelake.llm.queries import QUERIES
from framelake.llm.shared import row_hash

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid_crf.fit(docs)


def language(model, text: str | None) -> tuple[str, float, float]:
    """(language, score, evidence) of a text, word by word; the model gives each word's features their weights."""
    words = re.findall(r"[a-z\x80-\U0010ffff]+", (text or "").lower())
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0, model.usual
    scores, seen = [], []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        kinds, _, codes, begin = langid_crf.word_types(raw, np.array([0]), np.array([len(raw)]))
        scores.append(langid_crf.emissions(model, kinds, codes, begin)[0].astype(float))
        seen.append(model.seen[codes].mean())
    e, move = np.exp(np.array(scores) - np.max(scores, 1, keepdims=True)), np.exp(model.move)
    alpha, beta = [np.exp(model.start) * e[0]], [np.ones(len(model.langs))]
    for x in e[1:]:
        a = (alpha[-1] @ move) * x
        alpha.append(a / a.sum())
    for x in e[:0:-1]:
        b = move @ (x * beta[-1])
        beta.append(b / b.sum())
    gamma = np.array(alpha) * np.array(beta[::-1])
    share = (gamma / gamma.sum(1, keepdims=True)).mean(0)
    return model.langs[share.argmax()], float(share.max()), (sum(seen) + langid_crf.PRIOR_WORDS * model.usual) / (len(seen) + langid_crf.PRIOR_WORDS)


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def first_of_groups(rows: list) -> list:
    """One row of each group that is linked by four bits or fewer: all pairs, then the smallest id."""
    prints, group = [fingerprint(r.text) for r in rows], list(range(len(rows)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        k = root(i)
        if k not in best or r.doc_id < best[k].doc_id:
            best[k] = r
    return list(best.values())


def clean(rows: list, benchmark: list) -> list:
    """The rows in which no window of ten words of an item, or no whole shorter item, stands."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for item in benchmark:
        words = word.findall((item.text or "").translate(LOW))
        n = min(10, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def hit(text: str | None) -> bool:
        words = word.findall((text or "").translate(LOW))
        return any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    return [r for r in rows if not hit(r.text)]


def repeated(rows: list) -> list:
    """Each row as often as its source's rate and its own chance say; targets are found by sharing the excess again and again."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    own = Counter()
    for r in rows:
        own[r.source] += size(r)
    names = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in own)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = 1.5 * sum(own.values()) - sum(2.0 * own[s] for s in full)
        target = {s: 2.0 * own[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2.0 * own[s]}
        if not over:
            break
        full |= over
    out = []
    for r in rows:
        rate = target[r.source] / own[r.source] if own[r.source] else 0.0
        digest = hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else ""
        chance = int(hashlib.md5(f"7|{r.doc_id}|{digest}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (math.floor(rate) + (chance < rate - math.floor(rate)))
    return out


def greedy(sizes: dict[int, int], n_shards: int, current: dict[int, int] | None = None) -> dict[int, int]:
    """Slots keep their shard while it stays within the mean, largest first; the others go, largest first, to the shard with the fewest bytes."""
    mean, loads, owner, free, filled = sum(sizes.values()) / n_shards, [0] * n_shards, {}, [], defaultdict(int)
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        at = (current or {}).get(slot)
        if at is not None:
            filled[at] += sizes[slot]
        if at is not None and at < n_shards and filled[at] <= mean:
            owner[slot] = at
            loads[at] += sizes[slot]
        else:
            free.append(slot)
    for slot in free:
        to = loads.index(min(loads))
        owner[slot] = to
        loads[to] += sizes[slot]
    return owner


def test_slot_map_equals_a_greedy_loop(spark):
    r = random.Random(6)
    for slots, before, after in ((64, 5, 7), (64, 7, 5), (40, 4, 4), (9, 12, 3)):
        sizes = {s: r.choice((0, 16, r.randint(1, 400), r.randint(1, 9) ** 5)) for s in range(slots)}
        table = spark.createDataFrame([(s, b, 1) for s, b in sizes.items()], "virtual_slot int, bytes long, n long")
        first = {x.virtual_slot: x.shard for x in shards.rebalanced(table, before).collect()}
        assert first == greedy(sizes, before)
        grown = {s: b + r.choice((0, 0, 500)) for s, b in sizes.items()} | {slots: 77}
        table = spark.createDataFrame([(s, b, 1) for s, b in grown.items()], "virtual_slot int, bytes long, n long")
        current = spark.createDataFrame(list(first.items()), "virtual_slot int, shard int")
        assert {x.virtual_slot: x.shard for x in shards.rebalanced(table, after, current, 2).collect()} == greedy(grown, after, first)


def test_language_query_row_by_row(spark, docs, model):
    got = {r.doc_id: r for r in QUERIES["op1_crf"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score, _ = language(model, r.text)
        found = got[r.doc_id]
        assert found.lang_pred == lang and abs(found.score - score) < 1e-6 and found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_pipeline_equals_plain_stages(spark, docs, model):
    rows = [r for r in docs.collect() for lang, _, evidence in [language(model, r.text)] if lang != "und" and evidence >= 0.75 * model.usual]
    rows = first_of_groups(rows)
    rows = repeated(clean(rows, spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    # Spark's own hashes say in which slot, and in which part of a heavy one, a row stands
    hashed = {r.doc_id: r for r in docs.select("doc_id", shards.slot_of().alias("slot"), row_hash(docs).alias("h")).collect()}
    size = lambda r: len((r.text or "").encode()) + 16
    total, many = Counter({s: 0 for s in range(shards.SLOTS)}), Counter()
    for r in rows:
        total[hashed[r.doc_id].slot] += size(r)
        many[hashed[r.doc_id].slot] += 1
    share = max(sum(total.values()) / 40 * shards.HEAVY, 1.0)
    parts = {s: math.ceil(b / share) for s, b in total.items() if b > share and many[s] > 1}
    slot = {r.doc_id: hashed[r.doc_id].slot + shards.SLOTS * (hashed[r.doc_id].h % parts.get(hashed[r.doc_id].slot, 1)) for r in rows}
    sizes = Counter({s: 0 for s in range(shards.SLOTS)})
    for r in rows:
        sizes[slot[r.doc_id]] += size(r)
    owner = greedy(sizes, 40)
    want = sorted((r.doc_id, r.text or "", r.lang or "", r.source or "", slot[r.doc_id], owner[slot[r.doc_id]]) for r in rows)
    out = corpus_pipeline.run(spark, SF)
    got = sorted((r.doc_id, r.text or "", r.lang or "", r.source or "", r.virtual_slot, r.shard) for r in out.collect())
    assert got == want and out.where(F.col("map_version") != 1).isEmpty()
