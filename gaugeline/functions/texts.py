"""Markers, responses of a language model, and labels of inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make a marker a failure.
FAILURE_WORDS = "error|anomaly|fail|failure|failed|nok|not[_ -]?ok|fehler"
#: What a response may answer, and what is not part of the answer.
DECISIONS = ["success", "failure", "uncertain"]
CONFIDENCES = ["high", "medium", "low"]
REASONING = r"(?is)<think>.*?</think>"
ANSWER_MARKS = r"(?i)</?answer>|####"
ANSWER_HEAD = r"(?i)^\s*answer\s*:\s*"


def is_failure(marker: Column) -> Column:
    """Whether a marker holds a failure word that no letter touches."""
    return F.rlike(marker, F.lit(f"(?i)(^|[^a-z])({FAILURE_WORDS})($|[^a-z])"))


def stage_number(marker: Column, stages: int) -> Column:
    """The stage a marker names, or null: a whole number from 1 to ``stages``."""
    n = F.btrim(marker, F.lit(" \t\n\r\x0b\x0c")).try_cast("int")
    return F.when(n.between(1, stages), n)


def choice(response: Column, key: str, values: list[str]) -> Column:
    """The value after ``key:`` in a response, lower case, or ``not_parsed``."""
    found = F.regexp_extract(response, rf"(?i){key}\s*:\s*({'|'.join(values)})", 1)
    return F.coalesce(F.lower(F.nullif(found, F.lit(""))), F.lit("not_parsed"))


def decision(response: Column) -> Column:
    return choice(response, "Decision", DECISIONS)


def confidence(response: Column) -> Column:
    return choice(response, "Confidence", CONFIDENCES)


def is_meaningful(response: Column, chars: int = 40, words: int = 8) -> Column:
    """Whether enough is left of a response without its reasoning and its answer tags."""
    seen = F.regexp_replace(response, REASONING, " ")
    seen = F.regexp_replace(seen, ANSWER_MARKS, " ")
    seen = F.regexp_replace(seen, ANSWER_HEAD, "")
    return (F.length(F.regexp_replace(seen, r"^\s+|\s+$", "")) >= chars) & (F.size(F.regexp_extract_all(seen, F.lit("[A-Za-z]{2,}"), F.lit(0))) >= words)


def marker_line(time: Column, marker: Column) -> Column:
    return F.format_string("%.6fs:%s", time, F.btrim(marker, F.lit(" \t\n\r\x0b\x0c")))
