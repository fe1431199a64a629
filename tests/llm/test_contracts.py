"""The corpus queries against brute force on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from framelake.llm import licenses
from framelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    """Components by union-find; the smallest member names a set."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def add(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def docs(spark) -> dict[int, str | None]:
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name: str) -> list[dict]:
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_languages(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op1_crf")}
    lang = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    assert set(got) == set(docs)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in got.items() if r["held_out"]) == sorted(held)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(map(str.isalpha, docs[i] or ""))) for i, r in got.items())


def test_shards(spark, docs):
    got = rows(spark, "op2_virtual_slots")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(load) <= set(range(40)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in got)


def test_decontamination(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    windows, sizes = collections.defaultdict(set), set()
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(10, len(w))
        sizes |= {n} - {0}
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    for r in rows(spark, "op3_winnowing"):
        w = WORD.findall(low(docs[r["doc_id"]]))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items_here
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), digest, bool(hit))


def test_importance(spark, docs):
    got = rows(spark, "op4_importance")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    share = np.mean([r.quality == 1 and r.toxic == 0 for r in labels])
    assert len(got) == len(docs) and sum(r["kept"] for r in got) == round(len(docs) * share)
    assert min(r["sample_key"] for r in got if r["kept"]) >= max(r["sample_key"] for r in got if not r["kept"])


def test_vectors(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = {r["vec_id"]: r for r in rows(spark, "op5_cap_filters")}
    sets, links = Sets(), collections.Counter()
    for a in data:
        x = np.array(a.embedding, float)
        for b in data:
            if a.vec_id < b.vec_id and a.label == b.label is not None:
                y = np.array(b.embedding, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    sets.add(a.vec_id, b.vec_id)
                    links.update((a.vec_id, b.vec_id))
    assert set(got) == {r.vec_id for r in data}
    assert all(r["n_links"] <= links[i] for i, r in got.items()) and sum(r["n_links"] for r in got.values()) >= 0.98 * sum(links.values())
    assert np.mean([r["component_id"] == sets.root(i) for i, r in got.items()]) >= 0.99


def test_passages(spark, docs):
    got = collections.defaultdict(list)
    for r in rows(spark, "op6_paragraphs"):
        got[r["doc_id"]].append((r["first_word"], r["end_word"]))
    seen = collections.defaultdict(set)
    for i, text in docs.items():
        w = WORD.findall(low(text))
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add((i, k))
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                assert any(a < k + 51 and b > k for a, b in got[i])


def test_pseudo_likelihood(spark, docs):
    got = rows(spark, "op8_pseudo_lm")
    n = sum(r["n_tokens"] for r in got)
    words = collections.Counter(w for t in docs.values() for w in WORD.findall(low(t)))
    assert len(got) == len(docs) and n == sum(words.values())
    # probabilities are those of words: on the whole they beat the words' shares of the corpus
    assert sum(r["log_likelihood"] for r in got) / n > sum(k * np.log(k / n) for k in words.values()) / n + 0.05


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op9_simhash")}
    prints = {}
    for i, text in docs.items():
        w = TOKEN.findall(low(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    sets = Sets()
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                sets.add(a, b)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", sets.root(i)) for i in prints}


def test_licenses(spark, docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in rows(spark, "op10_license_join"):
        w = WORD.findall(low(docs[r["doc_id"]]))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        base = {label for _, label in places}
        own = {label for label, text in licenses.TEMPLATES for line in (docs[r["doc_id"]] or "").split("\n") if len(set(text.split()) & set(WORD.findall(low(line)))) >= 0.8 * len(set(text.split())) - 1e-9}
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(base | own))) and 0 <= r["score"] <= 1
