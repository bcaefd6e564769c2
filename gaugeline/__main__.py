"""python -m gaugeline topics|stages|manifest PATH [--topic T] [--out FOLDER]
python -m gaugeline time-series TEST --nominal PATH [--nominal PATH ...] [--topic T] [--out FOLDER]
python -m gaugeline vision SETTINGS.json --model MODULE:NAME --out FOLDER
python -m gaugeline judge SETTINGS.json --model MODULE:NAME --description FILE --out FOLDER
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import catalog, thresholds
from gaugeline.plans import launch, settings, time_series
from gaugeline.sources import bags, messages, results


def score_wrench(spark: SparkSession, nominal: list[str], test: str, topic: str) -> time_series.TimeSeriesResult:
    """Scores and alarms of a recording's wrench against those of correct runs."""
    if len(nominal) < 2:
        raise SystemExit("at least two --nominal recordings are needed")
    if lost := settings.missing_paths([*nominal, test]):
        raise SystemExit(f"no such paths: {lost}")
    wrench = lambda path: messages.numeric_topic(bags.read(spark, path, [topic]), topic, messages.WRENCH_FIELDS)
    known = wrench(nominal[0])
    for path in nominal[1:]:
        known = known.unionByName(wrench(path))
    return time_series.run(known, wrench(test))


def bag_manifest(spark: SparkSession, path: str, topic: str, startup: float) -> DataFrame:
    """The manifest of a folder of recordings; of damaged ones it says what is wrong.

    Counts come from the recordings' indexes.  The markers' topic alone is read,
    once for its markers and once for what of the files cannot be read.
    """
    runs = catalog.indexed_runs(spark.read.format("bag_index").option("mode", "PERMISSIVE").load(path), topic)
    log = bags.read(spark, path, [topic], tolerant=True)
    damage = log.where("read_error is not null").groupBy("run_id").agg(catalog.read_errors().alias("_damage"))
    errors = F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array("read_error", "_damage"))), "; "), F.lit(""))
    runs = runs.join(damage, "run_id", "left").withColumn("read_error", errors).drop("_damage")
    return catalog.manifest(runs, messages.stage_events(log, topic), startup)


def main() -> None:
    args = argparse.ArgumentParser(prog="gaugeline", description="Look into recordings.")
    args.add_argument("what", choices=["topics", "stages", "manifest", "time-series", "vision", "judge"])
    args.add_argument("path")
    args.add_argument("--topic", help="the markers' topic, or the wrench topic of time-series")
    args.add_argument("--nominal", action="append", default=[], help="a recording of a correct run")
    args.add_argument("--startup", type=float, default=1.0)
    args.add_argument("--model", help="module:name of an object with load() and extract() or answer()")
    args.add_argument("--description", help="a file with the description of a correct execution")
    args.add_argument("--out")
    a = args.parse_args()
    spark = SparkSession.builder.appName("gaugeline").getOrCreate()
    bags.register(spark)
    if a.what in ("vision", "judge"):
        if not a.model or not a.out or (a.what == "judge" and not a.description):
            args.error("--model and --out are needed, and --description for judge")
        given, model = json.loads(Path(a.path).read_text()), launch.named_model(a.model)
        if a.what == "judge":
            launch.run_judging(spark, given, Path(a.description).read_text(), model, a.out).show(1000, False)
        else:
            for found in launch.run_vision(spark, given, model, a.out).values():
                thresholds.alarm_summary(found).show(1000, False)
        return
    if a.what == "time-series":
        result = score_wrench(spark, a.nominal, a.path, a.topic or "/tcp_force")
        summary = thresholds.alarm_summary(result.alarms, "epsilon_adaptive", "alarm_filtered")
        if a.out:
            for name in ("segments", "calibration", "threshold", "alarms"):
                results.write_csv(getattr(result, name), f"{a.out}/{name}")
            results.write_csv(summary, f"{a.out}/summary")
        summary.show(1000, False)
        return
    topic = a.topic or "/recording_stage"
    if a.what == "topics":
        out = catalog.indexed_catalog(spark.read.format("bag_index").load(a.path), "run_id")
    elif a.what == "stages":
        out = messages.stage_events(bags.read(spark, a.path, [topic]), topic)
    else:
        out = bag_manifest(spark, a.path, topic, a.startup)
    results.write_csv(out, a.out) if a.out else out.show(1000, False)


if __name__ == "__main__":
    main()
