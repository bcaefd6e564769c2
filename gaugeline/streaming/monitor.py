"""Sampling of live runs, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_stream(frames: DataFrame, period: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The first frame of every period of a run; frames later than ``late`` are dropped.

    ``frames`` has run_id, ts (event time) and frame columns; state is one row a
    run and open period.
    """
    rest = [c for c in frames.columns if c not in ("run_id", "ts")]
    first = F.min_by(F.struct("ts", *rest), F.col("ts")).alias("f")
    return frames.withWatermark("ts", late).groupBy("run_id", F.window("ts", period)).agg(first).select("run_id", "f.*")
