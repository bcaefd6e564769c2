"""Tables behind pictures: any plotting or video tool can draw them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.scalars import spread


def curves(results: DataFrame, position: str, *values: str) -> DataFrame:
    """Long form for line plots: run_id, position, line, value."""
    return results.unpivot(["run_id", position], list(values), "line", "value").withColumnRenamed(position, "position")


def alarm_points(results: DataFrame, position: str, value: str, alarm: str = "alarm") -> DataFrame:
    return results.where(F.col(alarm)).select("run_id", F.col(position).alias("position"), F.col(value).alias("value"))


def overlay(patches: Column) -> Column:
    """Weighted patch scores between 0 and 1, as a heat map's strength."""
    return spread(patches)


def panel(results: DataFrame) -> DataFrame:
    """Lines of text that stand on a frame of a result video."""
    line = lambda form, *c: F.format_string(form, *[F.col(x) for x in c])
    state = F.when(F.col("alarm"), "ALARM").otherwise("normal")
    return results.select(
        "run_id", "frame_id",
        F.array(line("t %.2f s", "timestamp_sec"), line("score %.4f / %.4f (%s)", "score", "threshold", "threshold_mode"), F.concat(F.format_string("ratio %.2f ", F.col("epsilon")), state), line("match %s frame %d at %.2f", "matched_video_id", "matched_frame_id", "matched_progress"), line("distance %.4f", "cls_distance")).alias("lines"),
    )


def storyboard(inputs: DataFrame, columns: int = 4) -> DataFrame:
    """Places of inputs on a sheet of at most ``columns`` columns, labels of at most 55 characters."""
    return inputs.withColumn("row", F.floor(F.col("input_index") / columns).cast("int")).withColumn("column", (F.col("input_index") % columns).cast("int")).withColumn("caption", F.substring("label", 1, 55))
