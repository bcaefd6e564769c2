"""Camera frames against a nominal memory, from embeddings to alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.operators import timeline, vectors


def nominal_memory(frames: DataFrame, events: DataFrame | None = None, stages: int = 3) -> DataFrame:
    """A memory of embedded frames (group, frame_id, timestamp_sec, features, attention, cls) with progress and stage.

    With markers (run_id is the group) stages come from each group's timeline,
    which ends at its last sampled frame; else from the frame number.
    """
    items = frames.withColumn("item_id", F.xxhash64("group", "frame_id"))
    if events is None:
        return vectors.with_progress(items).withColumn("stage_source", F.lit("frame_progress"))
    ends = items.groupBy(F.col("group").alias("run_id")).agg(F.max("timestamp_sec").alias("end_sec")).where("end_sec > 0")
    points = items.select(F.col("group").alias("run_id"), "item_id", F.col("timestamp_sec").alias("time"))
    placed = timeline.locate(points, timeline.stage_timeline(events, ends, stages)).select("item_id", "stage", "progress", "stage_source")
    return items.join(placed, "item_id")


def score_run(test: DataFrame, memory: DataFrame, curve: DataFrame | None = None, fixed: float | None = None, by_stage: bool = False, k: int = 5, power: float = 1.5, least: float = 0.15) -> DataFrame:
    """Result rows of embedded test frames (run_id, frame_id, timestamp_sec, features, attention, cls[, stage])."""
    asked = test.withColumn("query_id", F.xxhash64("run_id", "frame_id"))
    if by_stage and (lost := [r["stage"] for r in vectors.missing_stages(asked, memory).limit(20).collect()]):
        raise ValueError(f"the memory has no frames of stages {sorted(lost)}")
    found = vectors.compare(asked, memory, k, by_stage, power=power, least=least)
    matched = memory.select("item_id", F.col("group").alias("matched_video_id"), F.col("frame_id").alias("matched_frame_id"), F.col("timestamp_sec").alias("matched_timestamp_sec"), F.col("progress").alias("matched_progress"), F.col("stage").alias("matched_stage"))
    rows = found.join(asked.select("query_id", "run_id", "frame_id", "timestamp_sec", *(["stage"] if "stage" in asked.columns else [])), "query_id").join(matched, "item_id")
    rows = rows.withColumnRenamed("stage", "execution_stage") if "stage" in rows.columns else rows.withColumn("execution_stage", F.lit(None).cast("int"))
    judged = vectors.judge(rows, curve, fixed)
    return judged.select("run_id", "frame_id", "timestamp_sec", "score", "threshold", "epsilon", "alarm", "threshold_mode", "cls_distance", "matched_video_id", "matched_frame_id", "matched_timestamp_sec", "matched_progress", "execution_stage", "matched_stage")


def with_recorded_stages(results: DataFrame, events: DataFrame, stages: int = 3) -> DataFrame:
    """Results with stage and progress by the last sampled time, and the latest marker at each frame."""
    points = results.withColumn("time", F.col("timestamp_sec")).withColumn("_end", F.max("timestamp_sec").over(W.partitionBy("run_id")))
    ends = points.groupBy("run_id").agg(F.max("_end").alias("end_sec"))
    placed = timeline.locate(points.drop("execution_stage", "_end"), timeline.stage_timeline(events, ends, stages))
    placed = placed.withColumnsRenamed({"stage": "execution_stage", "progress": "execution_progress"})
    return timeline.latest_marker(placed, events).withColumnRenamed("latest_marker", "latest_recorded_marker").drop("time")
