"""Checks of frames as they arrive. Fixed bands need a whole recording, so what needs them stays a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(frames: DataFrame, late: str = "30 seconds", window: str = "1 minute") -> DataFrame:
    """Frames and lines per recording and window of ``frames(recording_id, ts, n_lines)``; later rows are dropped."""
    return (
        frames.withWatermark("ts", late)
        .groupBy("recording_id", F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("n_frames"), F.sum("n_lines").alias("n_lines"))
        .select("recording_id", F.col("w.start").alias("start"), "n_frames", "n_lines")
    )


STATE, OUT = "last_ms double, n long", "recording_id long, n_frames long, n_disordered long, last_ms double"


def monotonic_times(frames: DataFrame) -> DataFrame:
    """Running count per recording of frames whose time is not after the latest before them.

    ``frames(recording_id, time_ms)``; the state is one time and one count per recording.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        last, n = state.get if state.exists else (float("-inf"), 0)
        bad = 0
        for pdf in batches:
            for t in pdf["time_ms"]:
                bad += t <= last
                last, n = max(last, t), n + 1
        state.update((last, n))
        yield pd.DataFrame({"recording_id": [key[0]], "n_frames": [n], "n_disordered": [bad], "last_ms": [last]})

    return frames.groupBy("recording_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
