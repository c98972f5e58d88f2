"""Frames of streams at a fixed rate, after what is dark at first, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "skipped long, start double, taken long"


def decimate_stream(frames: DataFrame, key: str, ts: str, interval: float, dark: str | None = None, most_dark: int = 0) -> DataFrame:
    """key and ts of the frames that operators.temporal.decimate_accumulating takes of each key, in order of time.

    dark: a boolean column; a key's frames up to its first that is not dark, or up to `most_dark` of
    them, are passed over. Within a micro-batch frames are put in order; between them they have to be. The state
    of a key is three numbers.
    """
    kinds = dict(frames.dtypes)
    names = [key, ts, *([dark] if dark else [])]

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        skipped, start, taken = state.get if state.exists else (0, None, 0)
        out = []
        for row in pd.concat(list(parts)).sort_values(ts, kind="stable")[names].itertuples(index=False):
            if start is None:
                if dark and row[2] and skipped < most_dark:
                    skipped += 1
                    continue
                start = float(row[1])
            if row[1] >= start + taken * interval:
                out.append(row[:2])
                taken += 1
        state.update((skipped, start, taken))
        yield pd.DataFrame(out, columns=[key, ts])

    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ts} {kinds[ts]}", STATE, "append", GroupStateTimeout.NoTimeout)
