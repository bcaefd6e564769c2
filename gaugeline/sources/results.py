"""Writing and reading back what plans produce."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _text(signature: dict) -> str:
    return json.dumps(signature, sort_keys=True)


def save_memory(memory: DataFrame, curve: DataFrame, scores: DataFrame, path: str, signature: dict) -> None:
    """A nominal memory, its threshold curve and calibration, and what they were made with.

    The signature is written last: a memory without it counts as missing.
    """
    memory.write.mode("overwrite").parquet(f"{path}/memory")
    curve.write.mode("overwrite").parquet(f"{path}/curve")
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    memory.sparkSession.createDataFrame([(_text(signature),)], "signature string").coalesce(1).write.mode("overwrite").json(f"{path}/signature")


def load_memory(spark: SparkSession, path: str, expected: dict) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """What was saved, if every expected entry of the signature agrees; further entries do not matter."""
    try:
        held = json.loads(spark.read.schema("signature string").json(f"{path}/signature").first()["signature"])
    except Exception as e:  # noqa: BLE001  a missing path is a missing memory
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, TypeError):
            return None
        raise
    wanted = json.loads(_text(expected))
    if any(k not in held or held[k] != v for k, v in wanted.items()):
        return None
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("memory", "curve", "scores"))


def runtime_signature(signature: dict) -> dict:
    """What must agree when a saved memory is only used: not where its frames came from."""
    return {k: v for k, v in signature.items() if k != "sources"}


def check_sources(held: list[dict], asked: list[dict]) -> list[str]:
    """Topics and stage settings in which a saved memory and a test differ."""
    pick = lambda rows: {(r.get("topic"), r.get("stage_topic"), r.get("stage_count")) for r in rows}
    return sorted(map(str, pick(asked) - pick(held)))


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON texts, which CSV can hold."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
