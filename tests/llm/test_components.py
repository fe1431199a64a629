"""Components against a union-find in plain Python, and the size of what the driver plans for them."""

from __future__ import annotations

import random

from framelake.llm import components, shared


def test_rounds_are_planned_in_small_steps(spark, monkeypatch):
    r = random.Random(5)
    links = [(0, k) for k in range(1, 3_000)] + [(k, k + 1) for k in range(5_000, 5_060)]  # a hub and a chain
    links += [(r.randrange(10_000, 14_000), r.randrange(10_000, 14_000)) for _ in range(2_500)]
    links += [links[0], links[0][::-1], (20_000, 20_000), (None, 3), (20_001, None)]
    tables, plans, real = [], [], shared.settled_at

    def seen(df, name, by=None):
        plan = df._jdf.queryExecution().optimizedPlan()
        tables.append(plan.collectLeaves().size())
        plans.append(len(plan.toString()))
        return real(df, name, by)

    for module in (shared, components):
        monkeypatch.setattr(module, "settled_at", seen, raising=False)
    got = {(x.id, x.component) for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {(x, root(x)) for x in up}
    assert max(tables) <= 6 and max(plans) < 10_000
