"""Signals of a run: gaps, resampling, the active segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions.scalars import magnitude, number
from gaugeline.operators.catalog import need

WRENCH = ("force_x", "force_y", "force_z", "torque_x", "torque_y", "torque_z")

#: Fixed values of the baseline rule: rows of the head at least, the share of it that is quiet, quiet rows at least, the
#: factor from a median deviation to a standard deviation, and the deviation under which it counts as none.
LEAST_HEAD, QUIET, LEAST_QUIET, NORMAL_DEVIATION, LEAST_DEVIATION = 20, 0.75, 10, 1.4826, 1e-6


def filled(value: Column, index: Column, run: W) -> Column:
    """A value, or the line between its neighbours by row number, or the next, or the last one."""
    before, after = run.rowsBetween(W.unboundedPreceding, 0), run.rowsBetween(0, W.unboundedFollowing)
    here = F.when(value.isNotNull(), F.struct(index.alias("i"), value.alias("v")))
    low, high = F.last(here, ignorenulls=True).over(before), F.first(here, ignorenulls=True).over(after)
    between = low["v"] + (high["v"] - low["v"]) * ((index - low["i"]) / (high["i"] - low["i"]))
    return F.coalesce(value, between, high["v"], low["v"])


def fill_gaps(series: DataFrame, columns: list[str], order: tuple[str, ...] = ("time", "seq")) -> DataFrame:
    """Columns as numbers without gaps (a column without any number stays null)."""
    need(series, "run_id", *order, *columns)
    run = W.partitionBy("run_id").orderBy(*order)
    read = series.withColumns({c: number(F.col(c)) for c in columns}).withColumn("_i", F.row_number().over(run))
    return read.withColumns({c: filled(F.col(c), F.col("_i"), run) for c in columns}).drop("_i")


def resample(series: DataFrame, columns: list[str], length: int = 500, order: tuple[str, ...] = ("time", "seq")) -> DataFrame:
    """``length`` rows a run (sample from 0, phase 0 to 1), columns interpolated over the row number.

    Each row makes the samples between itself and the next one, so nothing is
    joined: one sort by run.  Runs of under two rows have none.
    """
    if length < 2:
        raise ValueError("length must be at least two")
    need(series, "run_id", *order, *columns)
    run = W.partitionBy("run_id")
    ordered = run.orderBy(*order)
    rows = series.withColumn("_i", (F.row_number().over(ordered) - 1).cast("long")).withColumn("_n", F.count("*").over(run)).where("_n > 1")
    rows = rows.withColumns({f"_next_{c}": F.lead(c).over(ordered) for c in columns})
    steps, last = F.lit(length - 1).cast("long"), F.col("_n") - 1
    first = F.expr(f"(_i * {length - 1} + _n - 2) div (_n - 1)")
    past = F.when(F.col("_i") == last, steps).otherwise(F.expr(f"((_i + 1) * {length - 1} + _n - 2) div (_n - 1)") - 1)
    made = rows.where(first <= past).withColumn("sample", F.explode(F.sequence(first, past)))
    part = (F.col("sample") * last) / steps - F.col("_i")
    return made.select("run_id", "sample", (F.col("sample") / steps).alias("phase"), *[(F.col(c) + F.coalesce(F.col(f"_next_{c}") - F.col(c), F.lit(0.0)) * part).alias(c) for c in columns])


def preprocess(series: DataFrame, columns: list[str] = list(WRENCH), length: int = 500) -> DataFrame:
    """Filled and resampled signals with time and phase."""
    every = [*columns, "time"]
    return resample(fill_gaps(series, list(columns)).withColumn("_t", F.col("time")), every, length, ("_t", "seq"))


def add_force_magnitude(series: DataFrame) -> DataFrame:
    need(series, "force_x", "force_y", "force_z")
    return series.withColumn("force_mag", magnitude(F.col("force_x"), F.col("force_y"), F.col("force_z")))


def active_segment(series: DataFrame, signal: str = "force_mag", baseline: float = 0.1, factor: float = 4.0, least_change: float = 0.5, padding: float = 0.5) -> DataFrame:
    """Where a signal leaves its baseline: a row a run.

    The baseline is the first tenth of a run (20 rows at least), without its
    upper quarter; its spread is the scaled median deviation, or the standard
    deviation where that vanishes.  Windows on one shuffle by run.
    """
    if not 0 < baseline <= 1:
        raise ValueError("baseline must be over 0 and at most 1")
    need(series, "run_id", "time", "seq", signal)
    run = W.partitionBy("run_id")
    x = F.col("_x")
    rows = series.select("run_id", F.col("time").cast("double").alias("time"), number(F.col(signal)).alias("_x"), F.row_number().over(run.orderBy("time", "seq")).alias("_i"), F.count("*").over(run).alias("_n"))
    rows = rows.withColumn("_b", F.least(F.col("_n"), F.greatest(F.lit(LEAST_HEAD), F.floor(F.col("_n") * baseline))))
    head = F.col("_i") <= F.col("_b")
    rows = rows.withColumn("_q", F.percentile(F.when(head, x), F.lit(QUIET)).over(run))
    rows = rows.withColumn("_enough", F.count_if(head & (x <= F.col("_q"))).over(run) >= F.least(F.lit(LEAST_QUIET), F.col("_b")))
    rows = rows.withColumn("_c", F.when(head & (~F.col("_enough") | (x <= F.col("_q"))), x))
    rows = rows.withColumn("_m", F.percentile("_c", F.lit(0.5)).over(run))
    rows = rows.withColumn("_mad", NORMAL_DEVIATION * F.percentile(F.abs(F.col("_c") - F.col("_m")), F.lit(0.5)).over(run)).withColumn("_sd", F.stddev_pop("_c").over(run))
    rows = rows.withColumn("_std", F.when(F.col("_mad") < LEAST_DEVIATION, F.col("_sd")).otherwise(F.col("_mad")))
    rows = rows.withColumn("_thr", F.col("_m") + F.greatest(factor * F.col("_std"), F.lit(float(least_change))))
    active = F.when(x > F.col("_thr"), F.col("time"))
    found = rows.groupBy("run_id").agg(F.first("_m").alias("baseline_median"), F.first("_std").alias("baseline_std"), F.first("_thr").alias("threshold"), F.min(active).alias("_first"), F.max(active).alias("_last"), F.min("time").alias("_from"), F.max("time").alias("_to"))
    return found.select(
        "run_id", "baseline_median", "baseline_std", "threshold", F.col("_first").isNotNull().alias("active_found"),
        F.coalesce(F.greatest(F.col("_first") - padding, F.col("_from")), F.col("_from")).alias("start_time"),
        F.coalesce(F.least(F.col("_last") + padding, F.col("_to")), F.col("_to")).alias("end_time"),
    )


def trim(series: DataFrame, segments: DataFrame, least_rows: int = LEAST_HEAD) -> DataFrame:
    """Rows inside each run's segment, time from its first kept row.

    Under ``least_rows`` rows the whole run stays (used_full_trajectory).
    """
    run = W.partitionBy("run_id")
    inside = F.col("time").between(F.col("start_time"), F.col("end_time"))
    rows = series.join(segments.select("run_id", "start_time", "end_time"), "run_id").withColumn("_in", inside)
    rows = rows.withColumn("used_full_trajectory", F.count_if("_in").over(run) < least_rows)
    kept = rows.where(F.col("_in") | F.col("used_full_trajectory"))
    return kept.withColumn("time", F.col("time") - F.min("time").over(run)).drop("_in", "start_time", "end_time")


def synchronize(series: DataFrame, length: int = 500, **options) -> tuple[DataFrame, DataFrame]:
    """Signals resampled over their active segments, and the segments."""
    segments = active_segment(add_force_magnitude(series), **options)
    return preprocess(trim(series, segments), list(WRENCH), length), segments


def first_sample_time(series: DataFrame) -> DataFrame:
    """Seconds from each run's first row of the topic (the other zero is the recording's start)."""
    zero = F.min("time_ns").over(W.partitionBy("run_id"))
    return series.withColumn("time", (F.col("time_ns") - zero) / F.lit(1e9))
