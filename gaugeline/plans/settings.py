"""Names of recordings and settings of a pipeline."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {"stage_topic": "/recording_stage", "stage_count": 3, "ignore_recorded_stages": False, "stage_constrained_matching": False, "rebuild_nominal_cache": False, "preview_only": False, "max_preview_frames": None, "dino_input_size": 518}
NEEDED = ("nominal_bags", "test_bag", "camera_topics")


def load(path: str | None = None, **given) -> dict:
    """Settings: what is given, else the JSON file's, else the defaults."""
    held = json.loads(Path(path).read_text()) if path else {}
    out = {**DEFAULTS, **held, **{k: v for k, v in given.items() if v is not None}}
    if lost := [k for k in NEEDED if not out.get(k)]:
        raise ValueError(f"settings lack {lost}")
    if int(out["stage_count"]) < 1:
        raise ValueError("stage_count must be at least one")
    return out


def save(settings: dict, path: str) -> None:
    """Settings as a JSON file with sorted keys, as ``load`` reads it."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(settings, indent=2, sort_keys=True) + "\n")


def run_grid(spark: SparkSession, items: list[str], repetitions: int, pattern: str = "%s_%02d") -> DataFrame:
    """Every item as often as it is repeated, with the name of its recording."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item int, task string")
    return rows.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("run_name", F.format_string(pattern, F.col("task"), F.col("repetition")))


def missing_paths(paths: list[str]) -> list[str]:
    return [p for p in paths if not Path(p).exists()]
