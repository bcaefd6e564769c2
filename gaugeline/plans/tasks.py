"""Task descriptions and judgements by a language model that sees frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions import models, texts

DESCRIBE = "You see frames of one correct execution of a robot task, in time order. Describe the goal, the objects, the steps in order, and the visible signs that each step has succeeded."
MERGE = "Several descriptions of correct executions of one task follow. Write one description that keeps what they agree on.\n\n{descriptions}"
JUDGE = "A correct execution looks like this:\n{memory}\n\nYou see {what} of another execution. Say whether it reached the same result.\nAnswer with the lines\nDecision: success, failure or uncertain\nConfidence: high, medium or low\nand one sentence of reasons."
WHAT = {"raw": "camera frames", "heatmap": "heat maps of unusual image regions", "paired": "camera frames, each with its heat map"}


def judging_prompt(memory: str, mode: str) -> str:
    if mode not in WHAT:
        raise ValueError(f"mode must be one of {sorted(WHAT)}")
    return JUDGE.format(memory=memory.strip(), what=WHAT[mode])


def descriptions(inputs: DataFrame, name: str, load, answer) -> DataFrame:
    """A description a nominal run; one more try where too little came back, and an error column after that."""
    asked = inputs.withColumn("prompt", F.lit(DESCRIBE))
    first = models.generate(asked, name, load, answer).withColumn("ok", texts.is_meaningful(F.col("response")))
    again = models.generate(first.where("not ok").drop("response", "ok"), name, load, answer).withColumn("ok", texts.is_meaningful(F.col("response")))
    return first.where("ok").unionByName(again)


#: Descriptions of one prompt: a model reads only so much at a time.
MERGED = 16


def merged(described: DataFrame, by: str | None = None, most: int = MERGED) -> DataFrame:
    """Prompts (task, part, prompt) that join at most ``most`` descriptions each, in order of their runs.

    ``described`` has run_id, response, ok and, with ``by``, the column of the
    task; without it all runs are of one task.  What a model makes of the parts
    of a task is described again (run_id: the part) until one part is left.
    """
    if most < 2:
        raise ValueError("a prompt joins at least two descriptions")
    rows = described.where("ok").select((F.col(by).cast("string") if by else F.lit("")).alias("task"), "run_id", "response")
    # numbered by ids alone: what is sorted of a task has no texts
    place = F.row_number().over(W.partitionBy("task").orderBy("run_id")) - 1
    parts = rows.select("task", "run_id").distinct().select("task", "run_id", F.floor(place / most).alias("part"))
    held = F.array_sort(F.collect_list(F.struct("run_id", "response")))
    text = F.array_join(F.transform(held, lambda r: F.concat(F.lit("Run "), r["run_id"].cast("string"), F.lit(":\n"), r["response"])), "\n\n")
    joined = rows.join(parts, ["task", "run_id"]).groupBy("task", "part").agg(text.alias("descriptions"))
    return joined.select("task", "part", F.replace(F.lit(MERGE), F.lit("{descriptions}"), "descriptions").alias("prompt"))


def judgements(answered: DataFrame, mode: str) -> DataFrame:
    """Rows (test_bag, ground_truth_label, response) with decision and confidence."""
    return answered.select("test_bag", F.lit(mode).alias("input_mode"), texts.decision(F.col("response")).alias("decision"), texts.confidence(F.col("response")).alias("confidence"), "ground_truth_label", "response")
