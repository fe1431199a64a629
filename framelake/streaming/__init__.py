"""Extension beyond batch episodes: the state of a two-threshold signal followed over a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_transitions(frames: DataFrame, low: float, high: float) -> DataFrame:
    """State changes (episode, frame, state) of a stream of (episode, frame, value) whose frames arrive in order within an episode.

    The state kept for an episode is one letter: c after a value under ``low``, o after one over ``high``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get[0] if state.exists else "o", []
        rows = pd.concat(list(batches)).sort_values("frame")
        for frame, value in zip(rows["frame"], rows["value"], strict=True):
            new = "c" if value < low else "o" if value > high else now
            if new != now:
                out.append((key[0], int(frame), new))
            now = new
        state.update((now,))
        yield pd.DataFrame(out, columns=["episode", "frame", "state"])

    return frames.groupBy("episode").applyInPandasWithState(step, "episode long, frame long, state string", "state string", "append", GroupStateTimeout.NoTimeout)
