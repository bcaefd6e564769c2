"""Choosing frames: at a rate, evenly, or every k-th."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions.scalars import half_even
from gaugeline.operators.catalog import need


def sample_at_rate(frames: DataFrame, fps: float = 2.0, start_sec: float = 0.0, end_sec: float | None = None, most: int | None = None) -> DataFrame:
    """Frames (run_id, time, seq) at a rate, numbered from 0 by frame_id.

    A frame is taken when it reaches the next due time (a nanosecond early is
    in time); the due time then moves on by whole periods until it is later.
    Where the period is exact in binary this is the first frame of each period.
    Else sums of periods drift, and frames are held against the sums themselves:
    one is taken if more due times are reached at it than have passed at the
    frame before.  Both are windows over the frames of a run.
    """
    if fps <= 0:
        raise ValueError("fps must be over zero")
    if start_sec < 0:
        raise ValueError("start_sec must not be negative")
    if end_sec is not None and end_sec < start_sec:
        raise ValueError("end_sec must not be before start_sec")
    need(frames, "run_id", "time", "seq")
    within = frames.where((F.col("time") >= start_sec) & (F.lit(True) if end_sec is None else F.col("time") <= end_sec))
    period = 1.0 / fps
    order = W.partitionBy("run_id").orderBy("time", "seq")
    if math.frexp(period)[0] == 0.5 and (start_sec / period).is_integer():
        bucket = F.floor((F.col("time") + 1e-9 - start_sec) / period)
        taken = within.withColumn("_b", bucket).withColumn("_p", F.lag("_b").over(order)).where("_p is null or _b > _p").drop("_b", "_p")
    else:
        counted = _due_times(within, start_sec, period)
        taken = counted.withColumn("_p", F.lag("_passed").over(order)).where("(_p is null and _reached > 0) or _reached > _p").select(*frames.columns)
    numbered = taken.withColumn("frame_id", F.row_number().over(order) - 1)
    return numbered if most is None else numbered.where(F.col("frame_id") < most)


#: Due times that are summed up together.
DUE_BLOCK = 1 << 16


class DueTimes:
    """Sums of periods from a start, one after the other, of which only every ``DUE_BLOCK``-th is kept."""

    def __init__(self, start: float, period: float):
        self._period, self._firsts = period, [start]

    def _block(self, first: float) -> np.ndarray:
        return np.add.accumulate(np.concatenate([[first], np.full(DUE_BLOCK, self._period)]))

    def upto(self, times: np.ndarray) -> np.ndarray:
        """How many due times are at most each time."""
        if not len(times):
            return np.zeros(0, dtype=np.int64)
        while self._firsts[-1] <= times.max():
            self._firsts.append(self._block(self._firsts[-1])[-1])
        block = np.searchsorted(self._firsts, times, side="right") - 1
        out = np.zeros(len(times), dtype=np.int64)
        for b in np.unique(block[block >= 0]):  # neighbouring frames share a block
            mine = block == b
            out[mine] = b * DUE_BLOCK + np.searchsorted(self._block(self._firsts[b])[:-1], times[mine], side="right")
        return out


def _due_times(frames: DataFrame, start_sec: float, period: float) -> DataFrame:
    """Frames with _reached and _passed: how many due times are at most a nanosecond after them, and not after them.

    Each task sums up the due times of its own frames: no table of them, no join.
    """
    at = frames.columns.index("time")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = DueTimes(start_sec, period)
        for part in parts:
            times = part.column(at).to_numpy().astype(float)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(due.upto(times + 1e-9)), pa.array(due.upto(times))], [*part.schema.names, "_reached", "_passed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(run, f"{schema}, _reached long, _passed long")


def sample_evenly(frames: DataFrame, count: int = 4, start_sec: float = 0.0, end_sec: float | None = None) -> DataFrame:
    """At most ``count`` frames a run, evenly spaced by position; halves round to even."""
    if count < 1:
        raise ValueError("count must be at least one")
    need(frames, "run_id", "time", "seq")
    within = frames.where((F.col("time") >= start_sec) & (F.lit(True) if end_sec is None else F.col("time") <= end_sec))
    run = W.partitionBy("run_id")
    ranked = within.withColumn("_i", (F.row_number().over(run.orderBy("time", "seq")) - 1).cast("long")).withColumn("_n", F.count("*").over(run))
    # the wanted positions of a run are few: each row asks whether it is one of them
    k = F.least(F.lit(count).cast("long"), F.col("_n"))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.when(k > 1, half_even(j * ((F.col("_n") - 1) / (k - 1)))).otherwise(F.lit(0).cast("long")))
    return ranked.where(F.array_contains(wanted, F.col("_i"))).withColumnRenamed("_i", "position").drop("_n")


def every_kth(frames: DataFrame, source_fps: float, fps: float, start: int = 0, end: int | None = None) -> DataFrame:
    """Frames (frame_index) start, start + k, ...; k is the rounded ratio of the rates, at least 1.

    A source without a rate counts as 30 frames a second.
    """
    step = max(1, round((source_fps if source_fps > 0 else 30.0) / fps))
    kept = frames.where((F.col("frame_index") >= start) & ((F.col("frame_index") - start) % step == 0))
    return kept if end is None else kept.where(F.col("frame_index") <= end)


def interleave(sampled: DataFrame, topics: list[str], count: int, word: str = "camera") -> DataFrame:
    """Frames of several topics by position and then topic; short topics are passed over."""
    from gaugeline.functions.scalars import slug

    need(sampled, "run_id", "topic", "position")
    place = F.row_number().over(W.partitionBy("run_id", "topic").orderBy("position")) - 1
    order = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic"))
    rows = sampled.where(F.col("topic").isin(topics)).withColumn("time_index", place).where(F.col("time_index") < count)
    rows = rows.withColumn("input_index", F.row_number().over(W.partitionBy("run_id").orderBy("time_index", order)) - 1)
    return rows.withColumn("label", F.format_string(f"Time %d, {word} %s:", F.col("time_index") + 1, slug(F.col("topic"))))


def paired(raw: DataFrame, heat: DataFrame) -> DataFrame:
    """Two lists of inputs joined by position, raw then heat map, up to the shorter."""
    sides = raw.select("run_id", "input_index", F.col("label").alias("a")).join(heat.select("run_id", "input_index", F.col("label").alias("b")), ["run_id", "input_index"])
    return sides.select("run_id", "input_index", F.posexplode(F.array("a", "b")).alias("side", "label"))
