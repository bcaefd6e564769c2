"""Thresholds over a position (phase, progress), and alarms by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions.scalars import ratio
from gaugeline.operators.catalog import need
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.sources.shared import settle
from gaugeline.operators.series import filled


def centered(order: W, width: int) -> W:
    """The rows of a centred window; an even width has one more before than after."""
    return order.rowsBetween(-(width - 1 - (width - 1) // 2), (width - 1) // 2)


def rolling_median(value: Column, order: W, width: int) -> Column:
    return F.percentile(value, F.lit(0.5)).over(centered(order, width))


def bin_of(position: Column, bins: int) -> Column:
    """The bin whose edges k * (1 / bins) hold a position; the last one is closed, null outside."""
    step = 1.0 / bins
    near = F.floor(position * bins)
    edge = F.when(position < near * F.lit(step), near - 1).when(position >= (near + 1) * F.lit(step), near + 1).otherwise(near)
    return F.when(position == 1, F.lit(bins - 1)).when((position >= 0) & (position < 1), F.least(edge, F.lit(bins - 1))).cast("int")


def binned_threshold(scores: DataFrame, position: str, score: str, bins: int = 50, quantile: float = 0.999, margin: float = 1.6, least_points: int = 5, floor_quantile: float | None = 0.8, smooth: int | None = 5) -> DataFrame:
    """center, threshold and count of every bin of positions 0 to 1.

    A bin's threshold is a quantile of its scores times the margin; bins with
    few scores are filled from their neighbours, or by the quantile of all; no
    threshold is under the floor; a rolling median smooths them.  Quantiles are
    exact (see ``exact_quantiles``): bins and all scores are counted in the same
    passes over scores that are written first.
    """
    need(scores, position, score)
    if bins < 1:
        raise ValueError("bins must be at least one")
    rows = settle(scores.select(bin_of(F.col(position), bins).alias("bin"), F.col(score).cast("double").alias("_s")), "binned-scores")
    # every bin and all scores together (bin -1) in the same passes
    each = rows.select(F.explode(F.array("bin", F.lit(-1))).alias("bin"), "_s")
    quantiles = settle(exact_quantiles(each, "_s", {"_q": quantile, "_floor": floor_quantile or 0.0}, by="bin").drop("n"), "bin-quantiles", few=True)
    counted = rows.groupBy("bin").agg(F.count("*").alias("count")).where("bin is not null")
    found = counted.join(quantiles.drop("_floor"), "bin", "left")
    whole = quantiles.where("bin = -1").select(F.col("_q").alias("_all"), "_floor")
    floor = F.lit(0.0) if floor_quantile is None else F.col("_floor")
    # one row, also where there are no scores
    whole = whole.agg((F.max("_all") * margin).alias("_all"), F.max(floor).alias("_floor")).withColumn("_one", F.lit(1))
    grid = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(1).alias("_one"))
    table = grid.join(found, "bin", "left").join(F.broadcast(whole), "_one")  # one row
    order = W.partitionBy("_one").orderBy("bin")
    enough = F.when(F.col("count") >= least_points, F.col("_q") * margin)
    table = table.withColumn("_t", enough).withColumn("_t", F.greatest(F.coalesce(filled(F.col("_t"), F.col("bin"), order), F.col("_all")), F.col("_floor")))
    if smooth is not None and smooth > 1:
        table = table.withColumn("_t", rolling_median(F.col("_t"), order, smooth))
    step = 1.0 / bins
    edge = lambda k: F.when(k == bins, F.lit(1.0)).otherwise(k * F.lit(step))
    return table.select("bin", (0.5 * (edge(F.col("bin")) + edge(F.col("bin") + 1))).alias("center"), F.col("_t").alias("threshold"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def phase_threshold(scores: DataFrame, **options) -> DataFrame:
    return binned_threshold(scores, "phase", "mahalanobis", **options).select(F.col("center").alias("phase_center"), F.col("threshold").alias("threshold_mahalanobis"), "count")


def visual_threshold(scores: DataFrame, **options) -> DataFrame:
    chosen = {"bins": 30, "quantile": 0.95, "margin": 1.1, "least_points": 3, "floor_quantile": 0.2, "smooth": 3} | options
    return binned_threshold(scores, "matched_progress", "score", **chosen).select(F.col("center").alias("stage_center"), F.col("threshold").alias("adaptive_threshold"), "count")


def lookup(points: DataFrame, position: str, table: DataFrame, center: str, value: str, out: str) -> DataFrame:
    """The table's value at each position: linear between centers, level beyond the ends.

    The table (a row a bin) becomes one row of two arrays that goes to every task.
    """
    need(points, position)
    need(table, center, value)
    curve = table.agg(F.array_sort(F.collect_list(F.struct(F.col(center).alias("c"), F.col(value).alias("v")))).alias("_curve")).withColumn("_one", F.lit(1))
    x, n = F.col(position), F.size("_curve")
    low = F.get("_curve", F.col("_k") - 1)
    high = F.get("_curve", F.col("_k"))
    slope = (high["v"] - low["v"]) / (high["c"] - low["c"])
    here = F.when(F.col("_k") == 0, F.get("_curve", F.lit(0))["v"]).when(F.col("_k") == n, F.get("_curve", n - 1)["v"]).otherwise(low["v"] + slope * (x - low["c"]))
    joined = points.withColumn("_one", F.lit(1)).join(F.broadcast(curve), "_one")
    return joined.withColumn("_k", F.size(F.filter("_curve", lambda s: s["c"] <= x))).withColumn(out, F.when(x.isNotNull(), here)).drop("_one", "_curve", "_k")


def apply_phase_threshold(results: DataFrame, table: DataFrame, smooth: int = 11, window: int = 8, votes: int = 6) -> DataFrame:
    """Scores (run_id, index, phase, mahalanobis) over the threshold, smoothed, and alarms by votes."""
    need(results, "run_id", "index", "phase", "mahalanobis")
    if smooth < 1 or window < 1:
        raise ValueError("windows must be at least one")
    if not 1 <= votes <= window:
        raise ValueError("votes must be from 1 to the window")
    order = W.partitionBy("run_id").orderBy("index")
    found = lookup(results, "phase", table, "phase_center", "threshold_mahalanobis", "adaptive_threshold_mahalanobis")
    found = found.withColumn("epsilon_adaptive", ratio(F.col("mahalanobis"), F.col("adaptive_threshold_mahalanobis")))
    found = found.withColumn("epsilon_smooth", rolling_median(F.col("epsilon_adaptive"), order, smooth)).withColumn("alarm_raw", F.coalesce(F.col("epsilon_smooth") > 1, F.lit(False)))
    return found.withColumn("alarm_filtered", F.count_if("alarm_raw").over(order.rowsBetween(-(window - 1), 0)) >= votes)


def summary(scores: DataFrame, score: str, quantile: float) -> DataFrame:
    """Least, mean, largest and a quantile of scores in one row."""
    one = F.lit(1).alias("_one")
    found = exact_quantiles(scores, score, {"quantile": quantile}).agg(F.max("quantile").alias("quantile"), F.max(one).alias("_one"))
    rest = scores.agg(F.min(score).alias("least"), F.avg(score).alias("mean"), F.max(score).alias("most"), F.max(one).alias("_one"))
    return rest.join(F.broadcast(found), "_one", "left").drop("_one")  # one row each


def alarm_summary(results: DataFrame, score: str = "epsilon", alarm: str = "alarm") -> DataFrame:
    return results.groupBy("run_id").agg(F.count("*").alias("rows"), F.count_if(F.col(alarm)).alias("alarms"), F.max(score).alias("most"), (F.count_if(F.col(alarm)) / F.count("*")).alias("alarm_ratio"))
