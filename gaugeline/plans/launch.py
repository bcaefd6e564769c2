"""Whole runs from settings: recordings in, tables and their settings out.

Models are the caller's: an object with ``load()`` and, for vision,
``extract(model, batch)`` as ``models.embed`` takes it, for judging
``answer(model, batch)`` as ``models.generate`` does (a batch has the prompt and
the images of one question a row).
"""

from __future__ import annotations

import importlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import models
from gaugeline.functions.scalars import slug
from gaugeline.operators import sampling, thresholds, vectors
from gaugeline.plans import settings, tasks, vision
from gaugeline.sources import bags, messages, results
from gaugeline.sources.shared import settle

#: Settings of these runs beside those of ``settings.DEFAULTS``.
VISION = {"sample_fps": 2.0, "start_sec": 0.0, "end_sec": None, "candidates": 5, "threshold_mode": "adaptive", "memory_path": None}
JUDGING = {"frames_per_topic": 4, "input_modes": ["raw"], "ground_truth_label": "", "start_sec": 0.0, "end_sec": None}


def named_model(place: str):
    """The object that ``module:name`` names."""
    module, _, name = place.partition(":")
    if not name:
        raise ValueError(f"{place!r} is no module:name")
    return getattr(importlib.import_module(module), name)


def _read(spark: SparkSession, paths: list[str], topics: list[str]) -> DataFrame:
    if lost := settings.missing_paths(paths):
        raise ValueError(f"no such recordings: {lost}")
    return reduce(DataFrame.unionByName, [bags.read(spark, p, topics) for p in paths])


def sampled_frames(spark: SparkSession, paths: list[str], topic: str, choose, decoder=None) -> DataFrame:
    """Decoded frames of a topic that ``choose`` takes of rows (run_id, seq, time); it may number them (frame_id, position).

    Images are not shuffled: the choice is made on their times, and the logs are
    read again for what was chosen.
    """
    times = _read(spark, paths, [topic]).select("run_id", "seq", ((F.col("time_ns") - F.col("start_ns")) / F.lit(1e9)).alias("time"))
    chosen = settle(choose(times).drop("time"), "chosen-frames", few=True)  # its size decides how it meets the logs
    log = _read(spark, paths, [topic])
    frames = messages.frames(log.join(chosen.select("run_id", "seq"), ["run_id", "seq"], "left_semi"), topic, decoder)
    return frames.join(chosen, ["run_id", "seq"])


def embedded_frames(spark: SparkSession, paths: list[str], topic: str, config: dict, model, decoder=None) -> DataFrame:
    """run_id, frame_id, timestamp_sec, features, attention and cls of frames at the settings' rate."""
    choose = lambda rows: sampling.sample_at_rate(rows, config["sample_fps"], config["start_sec"], config["end_sec"])
    frames = sampled_frames(spark, paths, topic, choose, decoder)
    found = models.embed(frames, f"vision-{topic}", model.load, model.extract)
    return found.select("run_id", F.col("frame_id").cast("int").alias("frame_id"), F.col("time").alias("timestamp_sec"), "features", "attention", "cls")


def run_vision(spark: SparkSession, given: dict, model, out: str, decoder=None) -> dict[str, DataFrame]:
    """Results by topic; tables go to out/<topic>: results, threshold, calibration, summary.

    A memory under ``memory_path`` is used if it was made with the same settings
    (and made anew with ``rebuild_nominal_cache``).
    """
    config = {**VISION, **settings.load(**given)}
    if config["threshold_mode"] not in ("adaptive", "fixed"):
        raise ValueError("threshold_mode must be adaptive or fixed")
    by_stage, found = bool(config["stage_constrained_matching"]), {}
    for topic, name in zip(config["camera_topics"], _slugs(config["camera_topics"])):
        recorded = not config["ignore_recorded_stages"]
        markers = lambda paths: messages.stage_events(_read(spark, paths, [config["stage_topic"]]), config["stage_topic"])
        nominal, test = list(config["nominal_bags"]), [config["test_bag"]]
        events = markers(nominal) if recorded else None
        signature = {k: config[k] for k in ("sample_fps", "start_sec", "end_sec", "candidates", "stage_count", "stage_constrained_matching", "ignore_recorded_stages", "dino_input_size")} | {"sources": nominal, "topic": topic}
        place = f"{config['memory_path']}/{name}" if config["memory_path"] else None
        held = results.load_memory(spark, place, signature) if place and not config["rebuild_nominal_cache"] else None
        if held is None:
            frames = embedded_frames(spark, nominal, topic, config, model, decoder).withColumnRenamed("run_id", "group")
            keyed = frames.withColumn("run", F.col("group")).withColumn("group", F.xxhash64("group"))
            if events is not None:
                events = events.withColumn("run_id", F.xxhash64("run_id"))
            memory = settle(vision.nominal_memory(keyed, events, config["stage_count"]), "nominal-memory")
            curve, calibration = vectors.calibrate(memory, by_stage, config["candidates"])
            if place:
                results.save_memory(memory, curve, calibration, place, signature)
        else:
            memory, curve, calibration = held
        asked = embedded_frames(spark, test, topic, config, model, decoder)
        if by_stage:
            points = asked.withColumn("time", F.col("timestamp_sec")).withColumn("frame", F.col("frame_id"))
            ends = points.groupBy("run_id").agg(F.max("time").alias("end_sec"))
            from gaugeline.operators import timeline

            placed = timeline.locate(points.select("run_id", "time", "frame"), timeline.stage_timeline(markers(test), ends, config["stage_count"]))
            asked = asked.join(placed.select("run_id", F.col("frame").alias("frame_id"), "stage"), ["run_id", "frame_id"])
        asked = settle(asked, "test-frames")
        fixed = vectors.fixed_threshold(memory, by_stage=by_stage, k=config["candidates"]).first()["threshold"] if config["threshold_mode"] == "fixed" else None
        judged = vision.score_run(asked, memory, None if config["threshold_mode"] == "fixed" else curve, fixed, by_stage, config["candidates"])
        names = memory.select(F.col("group").alias("matched_video_id"), F.col("run").alias("matched_run")).distinct()
        judged = settle(judged.join(names, "matched_video_id", "left"), "vision-results")
        found[topic] = vision.with_recorded_stages(judged, markers(test), config["stage_count"]) if recorded else judged
        for part, table in (("results", found[topic]), ("threshold", curve), ("calibration", calibration), ("summary", thresholds.alarm_summary(judged))):
            results.write_csv(results.csv_ready(table), f"{out}/{name}/{part}")
    settings.save(config, f"{out}/settings.json")
    return found


def _slugs(topics: list[str]) -> list[str]:
    """Names of topics as folders; two of one name are an error."""
    spark = SparkSession.active()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(topics)], "k int, t string").select("k", slug(F.col("t")).alias("s")).orderBy("k").collect()
    names = [r["s"] for r in rows]
    if len(set(names)) < len(names) or "" in names:
        raise ValueError(f"topics {topics} have no names of their own")
    return names


def run_judging(spark: SparkSession, given: dict, description: str, model, out: str, heatmaps: DataFrame | None = None, decoder=None) -> DataFrame:
    """Judgements of a recording in every input mode; out has results, responses and frames.

    ``heatmaps`` (run_id, topic, position, image) are what ``heatmap`` and
    ``paired`` show; evenly spaced frames of each topic are what ``raw`` shows.
    """
    config = {**JUDGING, **settings.load(**given)}
    topics, count = list(config["camera_topics"]), config["frames_per_topic"]
    if (lost := set(config["input_modes"]) - {"raw", "heatmap", "paired"}) or (heatmaps is None and set(config["input_modes"]) != {"raw"}):
        raise ValueError(f"unknown modes {sorted(lost)}" if lost else "heat maps are needed for the modes that show them")
    choose = lambda rows: sampling.sample_evenly(rows, count, config["start_sec"], config["end_sec"])
    each = [sampled_frames(spark, [config["test_bag"]], t, choose, decoder).withColumn("topic", F.lit(t)).select("run_id", "topic", "position", "time", "image") for t in topics]
    raw = settle(sampling.interleave(reduce(DataFrame.unionByName, each), topics, count), "raw-inputs")
    shown = {"raw": raw.select("run_id", "input_index", F.lit(0).alias("side"), "label", "image")}
    if heatmaps is not None:
        heat = settle(sampling.interleave(heatmaps, topics, count, "heat map"), "heat-inputs")
        shown["heatmap"] = heat.select("run_id", "input_index", F.lit(1).alias("side"), "label", "image")
        both = raw.select("run_id", "input_index").join(heat.select("run_id", "input_index"), ["run_id", "input_index"])  # up to the shorter
        shown["paired"] = shown["raw"].unionByName(shown["heatmap"]).join(both, ["run_id", "input_index"])
    answers = []
    for mode in config["input_modes"]:
        # the images of one question: a few of each topic
        asked = shown[mode].groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("input_index", "side", "label", "image"))).alias("inputs"))
        asked = asked.withColumn("prompt", F.lit(tasks.judging_prompt(description, mode)))
        answers.append(models.generate(asked, f"judge-{mode}", model.load, model.answer).select("prompt", "response", F.lit(mode).alias("mode")))
    answered = settle(reduce(DataFrame.unionByName, answers), "answers")
    label = answered.select("*", F.lit(config["test_bag"]).alias("test_bag"), F.lit(config["ground_truth_label"]).alias("ground_truth_label"))
    judged = reduce(DataFrame.unionByName, [tasks.judgements(label.where(F.col("mode") == m), m) for m in config["input_modes"]])
    results.write_csv(judged, f"{out}/results")
    results.write_json(answered.select(F.col("mode").alias("input_mode"), "prompt", "response", F.lit(description).alias("nominal_description")), f"{out}/responses")
    results.write_csv(raw.select("run_id", "topic", "position", "time", "input_index", "label"), f"{out}/frames")
    settings.save(config, f"{out}/settings.json")
    return judged
