"""Ranked search, token counts and source divergence against plain Python."""

from __future__ import annotations

import collections
import math
import random
import re
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from framelake.llm import divergence, tokencounts, wand
from framelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, Score double, n long, TERM string, n_tokens long"


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def made(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 3))) for _ in range(60)]
    rows = [(i // 2 if i % 7 else None, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 30, 200]))), r.choice(["en", "fr", None]), "hot" if i % 3 == 0 else r.choice(["a", "b", None, "é"]), 1.0, 2, "x", 3) for i in range(n)]
    odd = [None, "", "  \n", "!!!", "É A9 a9 Ab", rows[0][1], rows[0][1]]
    return rows + [(1000 + i, t, "xx" if i < 4 else "en", "s" if i % 2 else None, None, None, None, None) for i, t in enumerate(odd)]


def ranked(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    counts = [(i, collections.Counter(WORD.findall(low(t)))) for i, t, *_ in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    total, length, df = len(counts), sum(n for *_, n in counts), collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        terms, scored = set(WORD.findall(low(text))), []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scored += [(-s, i is None, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def key(row: tuple) -> tuple:
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("shard,block", [(1 << 21, 1 << 20), (300, 40)])
def test_search_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(wand, "SHARD", shard)
    monkeypatch.setattr(wand, "BLOCK", block)
    docs = made(400, 1)
    items = [(i, d[1]) for i, d in enumerate(made(12, 2)[:9])] + [(3, docs[5][1]), (None, docs[8][1]), (50, None), (51, "!"), (52, "zzzz")]
    got = wand.searched(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked(docs, items), key=key)


def test_search_query_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet").select(*c).collect() for n, c in (("documents", ["doc_id", "text"]), ("benchmark", ["item_id", "text"])))
    assert sorted(map(tuple, QUERIES["op12_wand"](spark, SF).collect())) == sorted(ranked(docs, items))


def test_pivots_skip_documents():
    r = random.Random(3)
    lists = []
    for much, often in ((5, 0.9), (9, 0.5), (400, 0.01), (900, 0.005)):
        docs = [d for d in range(20000) if r.random() < often]
        impacts = [r.randint(1, much) for _ in docs]
        lists.append((array("i", docs), array("q", impacts), max(impacts)))
    sums = collections.Counter()
    for docs, impacts, _ in lists:
        sums.update(dict(zip(docs, impacts, strict=True)))
    heap: list = []
    scored = wand.ranked_shard(lists, list(range(20000)), heap, 10)
    assert sorted(heap, reverse=True) == sorted(((s, 1, -d) for d, s in sums.items()), reverse=True)[:10]
    assert scored < len(sums) / 20


def diverging(docs: list[tuple], least: int) -> list[tuple]:
    held, seen, groups = collections.Counter(), collections.defaultdict(set), set()
    for at, (_, text, lang, source, *_) in enumerate(docs):
        groups.add((lang or "", source or ""))
        for t in LETTERS.findall(low(text)):
            held[lang or "", source or "", t] += 1
            seen[lang or "", t].add(at)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (x, t), ids in seen.items() if x == lang and len(ids) >= least]
        sources = [s for g, s in groups if g == lang]
        count = {s: {t: held[lang, s, t] for t in kept} for s in sources}
        count[None] = {t: sum(held[lang, s, t] for s in sources) for t in kept}
        p = {s: {t: 1 + 1000000000 * (c + 2) // (sum(count[s].values()) + 2 * len(kept)) for t, c in count[s].items()} for s in count}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t])[:10]
            out += [(lang, s, part, o, -v, i) for part, rows in (("pair", pairs), ("term", terms)) for i, (v, _, o) in enumerate(rows, 1)]
    return out


@pytest.mark.parametrize("least", [1, 10, 10**6])
def test_divergence_equals_brute_force(spark, least):
    docs = made(300, 5)
    got = divergence.source_divergence(spark.createDataFrame(docs, SCHEMA).repartition(3), least)
    assert sorted(map(tuple, got.collect())) == sorted(diverging(docs, least))


def test_divergence_of_large_counts(spark):
    row = spark.range(1).select(divergence.share("9223372036854775000L", "9223372036854775800L").alias("p"), divergence.share("0L", "9223372036854775800L").alias("q")).select("p", "q", divergence.apart("p", "q").alias("f")).first()
    assert tuple(row) == (1 + 10**9 * (9223372036854775002) // 9223372036854775800, 1, (row.p - 1) ** 2 // (row.p + 1))


def counter(name: str):
    path = public_tokenizers.path(name)
    if path.endswith(".model"):
        pieces = SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    whole = Tokenizer.from_file(path)
    return lambda text: len(whole.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_whole_texts(spark, monkeypatch, name):
    monkeypatch.setattr(tokencounts, "REMEMBERED", 500)
    monkeypatch.setattr(tokencounts, "BATCH_BYTES", 300)
    r = random.Random(7)
    bits = ["a", "b's", "It's", "don't", "É", "é", "é", "́", "Σ", "ΟΔΟΣ", "12", "3a", "--", "...", "<|endoftext|>", "<|startoftext|>", "</s>", "▁", "中文", "‍", "🙂", "naïve", "¨"]
    gaps = [" ", " ", " ", "  ", "\n", "\t", "\r\n", " ", "  ", "　", "  ", "\u0085", "\x1c", " ", "", " \n "]
    texts = ["".join(r.choice(bits) + r.choice(gaps) for _ in range(r.choice([1, 3, 40]))) for _ in range(300)]
    rows = made(60, 8) + [(5000 + i, t, None, None, None, None, None, None) for i, t in enumerate([*texts, " lead", "trail ", "  two  ", " ", "x" * 5000, "word " * 30000])]
    count = counter(name)
    got = tokencounts.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(2), public_tokenizers.path(name), 100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 100) for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_token_query(spark):
    count = counter("word_bpe_49k.json")
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 2048) for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_token_counts"](spark, SF).collect())) == sorted(want)


def test_files_without_safe_boundaries_encode_whole_texts(tmp_path, spark):
    import json

    settings = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    settings["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    path = tmp_path / "whole.json"
    path.write_text(json.dumps(settings))
    whole = Tokenizer.from_file(str(path))
    got = tokencounts.token_counts(spark.createDataFrame([(1, "a b c\nd e"), (2, None)], "doc_id long, text string"), str(path))
    assert sorted(r.n_tokens for r in got.collect()) == [0, len(whole.encode("a b c\nd e", add_special_tokens=False))]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame(made(5, 1), SCHEMA)
    items = one.select(F.col("doc_id").alias("item_id"), "text")
    results = [divergence.source_divergence(none), wand.searched(none, items), wand.searched(one, items.limit(0)), tokencounts.token_counts(none, public_tokenizers.path("word_bpe_49k.json"))]
    assert [r.collect() for r in results] == [[], [], [], []]
