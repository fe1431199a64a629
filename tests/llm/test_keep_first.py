"""One row of each near-duplicate group stays, whatever the ids."""

from __future__ import annotations

import random

from framelake.llm import simhash


def test_repeated_and_null_ids(spark):
    words = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(400)]
    a, b, c, d = (" ".join(random.Random(i).choices(words, k=200)) for i in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (None, c, "x"), (None, c, "x"), (None, c, None), (None, a, "x"), (2, d, "x"), (2, d, "x"), (None, d, "x")]
    for seed in range(2):
        shuffled = random.Random(seed).sample(rows, len(rows))
        got = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(shuffled, "doc_id long, text string, source string").repartition(3)).collect()]
        assert sorted(r[1] for r in got) == sorted([a, b, c, d])
        assert {r[:2] for r in got} == {(1, a), (1, b), (None, c), (2, d)}
        if seed:
            assert set(got) == before
        before = set(got)
