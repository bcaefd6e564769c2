"""Stages of a run from its markers, and what holds at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions.scalars import clamp
from gaugeline.functions.texts import stage_number
from gaugeline.operators.catalog import need


def stage_timeline(events: DataFrame, ends: DataFrame, stages: int = 3) -> DataFrame:
    """run_id, end_sec, starts (of each stage) and source of every run of ``ends``.

    Going back from the last stage, each stage starts at its latest marker that
    lies more than the least gap before the next one's start; that passes over
    bursts of markers while a recording starts.  A run without a whole sequence
    gets equal intervals.  All steps are windows on one shuffle by run.
    """
    if stages < 1:
        raise ValueError("stages must be at least one")
    need(events, "run_id", "time", "marker")
    need(ends, "run_id", "end_sec")
    per_run = W.partitionBy("run_id")
    marked = ends.join(events.select("run_id", "time", stage_number(F.col("marker"), stages).alias("stage")), "run_id", "left")
    gap = F.greatest(F.lit(0.05), F.col("end_sec") * 0.001)
    before: Column | None = None
    for k in range(stages, 0, -1):
        fits = F.col("stage") == k
        if before is not None:
            fits = fits & (F.col("time") < before - gap)
        marked = marked.withColumn(f"_s{k}", F.max(F.when(fits, F.col("time"))).over(per_run))
        before = F.col(f"_s{k}")
    starts = marked.groupBy("run_id").agg(F.first("end_sec").alias("end_sec"), F.array(*[F.first(f"_s{k}") for k in range(1, stages + 1)]).alias("_found"))
    first, last = F.get("_found", F.lit(0)), F.get("_found", F.lit(stages - 1))
    whole = ~F.exists("_found", lambda s: s.isNull()) & ~((first > F.col("end_sec")) | (last >= F.col("end_sec")))
    equal = F.array(*[F.lit(k) * F.col("end_sec") / stages for k in range(stages)])
    return starts.select("run_id", "end_sec", F.when(whole, F.col("_found")).otherwise(equal).alias("starts"), F.when(whole, "recorded").otherwise("equal_intervals").alias("source"))


def locate(points: DataFrame, timelines: DataFrame) -> DataFrame:
    """``points`` (run_id, time) with stage (from 1) and progress over all stages."""
    need(points, "run_id", "time")
    n = F.size("starts")
    at = clamp(F.col("time").cast("double"), F.lit(0.0), F.col("end_sec"))
    index = clamp(F.size(F.filter("starts", lambda s: s <= F.col("_at"))) - 1, F.lit(0), n - 1)
    start, end = F.get("starts", F.col("_i")), F.coalesce(F.get("starts", F.col("_i") + 1), F.col("end_sec"))
    part = F.when(end > start, (F.col("_at") - start) / (end - start)).otherwise(0.0)
    joined = points.join(timelines, "run_id").withColumn("_at", at).withColumn("_i", index)
    progress = clamp((F.col("_i") + clamp(part, F.lit(0.0), F.lit(1.0))) / n, F.lit(0.0), F.lit(1.0))
    return joined.select(*[points[c] for c in points.columns], (F.col("_i") + 1).alias("stage"), progress.alias("progress"), F.col("source").alias("stage_source"))


def latest_marker(points: DataFrame, events: DataFrame) -> DataFrame:
    """``points`` (run_id, time) with the last marker at or before each time, null before the first.

    One sort of points and markers together; no join on ranges.
    """
    need(points, "run_id", "time")
    need(events, "run_id", "time", "seq", "marker")
    both = points.select("run_id", "time", F.struct(*points.columns).alias("_p"), F.lit(None).cast("struct<seq:bigint,marker:string>").alias("_m"))
    marks = events.select("run_id", "time", F.lit(None).cast(both.schema["_p"].dataType).alias("_p"), F.struct(F.col("seq").cast("bigint").alias("seq"), "marker").alias("_m"))
    order = W.partitionBy("run_id").orderBy("time", F.col("_p").isNotNull(), F.col("_m.seq"))
    seen = both.unionByName(marks).withColumn("_last", F.last("_m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return seen.where("_p is not null").select("_p.*", F.col("_last.marker").alias("latest_marker"))
