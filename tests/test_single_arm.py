"""Single-arm detection and selection on a made episode."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from framelake.plans import single_arm

FPS = 10.0


def made(n: int = 140, lift: float = 0.0) -> pd.DataFrame:
    """Approach along x, close at 40, carry and lift, open at 100, retreat."""
    t = np.arange(n)
    state, action = np.zeros((n, 34)), np.zeros((n, 10))
    state[:, 0] = 0.004 * np.clip(t, 0, 36) + 0.004 * np.clip(t - 55, 0, 35) + 0.004 * np.clip(t - 110, 0, None)
    state[:, 2] = lift * np.clip(t - 50, 0, 15) / 15
    state[:, [3, 7]] = 1
    state[:, 9] = np.where((t >= 40) & (t < 100), 0.5, 1.0)
    action[:] = state[:, :10]
    return pd.DataFrame({"episode": 0, "frame": t, "state": list(state), "action": list(action)})


def spark_frames(spark, *parts):
    rows = pd.concat([p.assign(episode=i) for i, p in enumerate(parts)])
    rows["state"], rows["action"] = rows["state"].map(lambda x: x.tolist()), rows["action"].map(lambda x: x.tolist())
    return spark.createDataFrame(rows.sample(frac=1, random_state=1), "episode long, frame long, state array<double>, action array<double>")


def test_phases_and_report(spark):
    vague = made(60)
    lifted = made(lift=0.05)
    frames = spark_frames(spark, made(), vague, lifted)
    marked = {(r.episode, r.frame): r for r in single_arm.annotated(frames, fps=FPS).collect()}
    first = marked[0, 0]
    # the gripper jumps into frames 40 and 100; growth stops at 39 and 41, padding is 3
    assert (first.c, first.c0, first.c1, first.o, first.o0, first.o1) == (40, 36, 44, 100, 96, 104) and first.apex is None
    assert [marked[0, f].phase for f in (35, 36, 44, 45, 95, 96, 104, 105)] == [0, 1, 1, 2, 2, 3, 3, 4]
    assert marked[1, 5].phase == 2 and marked[1, 5].protection[0] == "ambiguous_gripper" and marked[1, 5].c0 is None
    assert marked[2, 0].apex == marked[2, 0].last and 60 <= marked[2, 0].apex <= 66
    # a selection of every third frame of the approach, and of all else
    plan = single_arm.annotated(frames, fps=FPS).where("episode = 0").selectExpr("episode", "frame", "phase", "(phase <> 0 or frame % 3 = 0 or size(protection) > 0) kept", "'kept' reason", "array_join(protection, ',') protection")
    report = {r.phase: r for r in single_arm.phase_report(plan, frames, fps=FPS).collect()}
    assert report[1].target_met is None and report[0].frames_before == 36 and report[0].mean_speed == pytest.approx(0.12) and report[0].retained == pytest.approx(14 / 36)


def test_idle(spark):
    still = made()
    for v in (still["state"], still["action"]):
        for f in range(46, 95):
            v[f][:3] = v[46][:3]
    frames = spark_frames(spark, still, made())
    spans = single_arm.idle(single_arm.annotated(frames, fps=FPS), fps=FPS).where("episode = 0").orderBy("first").collect()
    assert spans and all(10 < s.final - s.first <= 30 for s in spans)
    assert all(s.keep[0] == s.first and s.keep[-1] == s.final and len(s.keep) == 11 for s in spans)


def test_rules():
    with pytest.raises(ValueError):
        single_arm.Rules(closed=0.95)
    with pytest.raises(ValueError):
        single_arm.Rules(hold_s=float("nan"))
