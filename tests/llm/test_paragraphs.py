"""Repeated passages against brute force on both sides: every passage that is there, and no other."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from framelake.llm import paragraphs, shared
from framelake.llm.bytewords import mixed, word_hashes

NEAR = paragraphs.NEAR


def pair_hash(a: str, b: str) -> int:
    h = [word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in (a, b)]
    return int(mixed(np.array([h[0] * np.uint64(3) + h[1]], np.uint64))[0])


def pieces(line: list[str]) -> list[tuple[int, int]]:
    """Cuts before each word pair whose hash is the smallest within reach, and around runs of one word."""
    n = len(line)
    pairs = [pair_hash(line[k], line[k + 1]) for k in range(n - 1)]
    cuts = {0}
    for k in range(NEAR, n - 1):
        near = [pairs[j] for j in range(max(0, k - NEAR), min(n - 1, k + NEAR + 1)) if j != k]
        if all(pairs[k] < x for x in near):
            cuts.add(k)
    k = 0
    while k < n:
        e = k
        while e < n and line[e] == line[k]:
            e += 1
        if e - k > NEAR:
            cuts |= {k, e} - {n}
        k = e
    cuts = sorted(cuts)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def units(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    found, out, blocks, at = [], [], [[]], 0
    for raw in (text or "").split("\n"):
        line = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), raw))
        if not line:
            blocks.append([])
            continue
        cut = pieces(line)
        out += [(at + a, at + b) for a, b in cut]
        if len(cut) > 1 and len(line) >= 8:
            out.append((at, at + len(line)))
        blocks[-1].append((at, at + len(line)))
        at += len(line)
        found += line
    blocks = [b for b in blocks if b]
    out += [(b[0][0], b[-1][1]) for b in blocks if len(blocks) > 1 and len(b) > 1 and b[-1][1] - b[0][0] >= 8]
    return found, out


def brute(rows: list[tuple[int | None, str | None]], least: int) -> set:
    places = defaultdict(list)
    for r, (_, text) in enumerate(rows):
        words, own = units(text)
        for a, b in own:
            places[tuple(words[a:b])].append((r, a, b))
    shingles = {p: {p[k : k + 5] for k in range(max(1, len(p) - 4))} for p in places}
    up = {p: p for p in places}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    keys = list(places)
    for i, p in enumerate(keys):
        for q in keys[:i]:
            both = len(shingles[p] & shingles[q])
            if both and 5 * both >= 4 * len(shingles[p] | shingles[q]):
                up[root(p)] = root(q)
    groups = defaultdict(lambda: defaultdict(list))
    for p, found in places.items():
        for r, a, b in found:
            groups[root(p)][r].append((a, b))
    stretches = defaultdict(list)
    for group in groups.values():
        spots = []
        for r, found in group.items():
            merged = []
            for a, b in sorted(found):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            spots += [(rows[r][0], r, a, b) for a, b in merged]
        if len(spots) > 1:
            least_spot = min(spots)
            for spot in spots:
                stretches[spot[1], spot == least_spot].append((spot[2], spot[3], least_spot[0]))
    out = set()
    for (r, kept), found in stretches.items():
        merged = []
        for a, b, c in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1:] = [max(b, merged[-1][1]), min(c, merged[-1][2])]
            else:
                merged.append([a, b, c])
        out |= {(rows[r][0], a, b, b - a, c, kept) for a, b, c in merged if b - a >= least}
    return out


def test_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "tune_bands", lambda: (24, 1))  # a recall of one, as good as
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(600)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    long, block = prose(60), "\n".join(prose(12) for _ in range(5))
    edited, other = long.split(), block.split(" ")
    edited[30] = "changed"
    other[24] = "changed"
    texts = [prose(40) + "\n" + long + "\n" + prose(9), " ".join(edited), prose(20) + " " + " ".join(long.split()[5:58]) + " " + prose(20), block + "\n\n" + prose(30), prose(8) + "\n\n" + " ".join(other), block.replace("\n", " ")]
    texts += ["All rights reserved.\n" + prose(25) for _ in range(3)] + [None, "", "!!", "one", "w " * 30, "w " * 30 + prose(20), long[: len(long) // 2] + "\n" + long[: len(long) // 2], prose(50), prose(70)]
    rows = list(enumerate(texts)) + [(20, texts[-1]), (20, texts[-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 15):
        got = {tuple(x) for x in paragraphs.repeated_passages(docs, least).collect()}
        assert got == brute(rows, least)
    assert {(1, 0, 60, 60, 0, False), (20, 0, 70, 70, 17, False)} <= got
    assert any(x[0] == 4 and x[3] == 60 for x in got)


def test_similar_is_exact(spark):
    import pyarrow as pa

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 60))) for _ in range(80)]
    sets += [np.unique(np.append(s[1:], 77)) for s in sets]
    table = pa.table({"shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    want = [5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j, strict=True)]
    for most in (50, 1 << 21):
        paragraphs.COMPARED, was = most, paragraphs.COMPARED
        assert paragraphs._similar(table, i, j).tolist() == want
        paragraphs.COMPARED = was


def test_band_keys_take_little_disk(spark, monkeypatch):
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijklm", k=6)) for _ in range(40_000)]
    texts = ["\n".join(" ".join(r.choices(words, k=12)) for _ in range(20)) for _ in range(2_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    sizes, real = [], shared.settled_at

    def sized(df, name, by=None):
        out = real(df, name, by)
        sizes.append(sum(f.stat().st_size for f in Path(out[1].removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(shared, "settled_at", sized)
    monkeypatch.setattr(paragraphs, "settled_at", sized)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    docs = shared.settled(docs, "texts")
    sizes.clear()
    before = written()
    assert paragraphs.repeated_passages(docs).count() == 0
    assert max(sizes) + written() - before < 4.5 * sum(map(len, texts))


def test_bitmaps_grow_with_their_hashes(spark):
    hashes = spark.range(1 << 22).select(F.xxhash64("id").alias("h"))
    bitmap = shared.hash_bitmap(hashes, "h", 1 << 22).value
    told = lambda x: shared.in_bitmap(bitmap, x.toArrow()["h"].to_numpy().view(np.uint64)).mean()
    assert told(hashes.limit(100_000)) == 1
    assert told(spark.range(1 << 40, (1 << 40) + 100_000).select(F.xxhash64("id").alias("h"))) < 0.1
