"""What recordings hold: topics, counts, durations, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.texts import is_failure, marker_line


def need(df: DataFrame, *columns: str) -> None:
    """Columns are checked when an operator is called, not when it runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def topic_catalog(messages: DataFrame, *by: str) -> DataFrame:
    """Topics with their type and number of messages, by topic."""
    need(messages, "topic", "message_type", *by)
    messages = messages.where("topic is not null")  # rows of what could not be read have none
    return messages.groupBy(*by, "topic", "message_type").agg(F.count("*").alias("message_count")).orderBy(*by, "topic", "message_type")


def indexed_catalog(index: DataFrame, *by: str) -> DataFrame:
    """The same from a table of ``bag_index``: no message is read.  Topics without messages have the count 0."""
    need(index, "topic", "message_type", "message_count", *by)
    return index.where("topic is not null").groupBy(*by, "topic", "message_type").agg(F.sum("message_count").alias("message_count")).orderBy(*by, "topic", "message_type")


def indexed_durations(index: DataFrame) -> DataFrame:
    """Seconds from the first to the last message of each run, from a table of ``bag_index``."""
    need(index, "run_id", "first_ns", "last_ns")
    return index.groupBy("run_id").agg(F.min("first_ns").alias("start_ns"), ((F.max("last_ns") - F.min("first_ns")) / F.lit(1e9)).alias("duration_sec"))


def indexed_runs(index: DataFrame, marker_topic: str) -> DataFrame:
    """run_id, message_count, has_markers and read_error of each run, as ``manifest`` takes them."""
    need(index, "run_id", "topic", "message_count", "read_error")
    return index.groupBy("run_id").agg(
        F.sum("message_count").alias("message_count"), (F.count_if(F.col("topic") == marker_topic) > 0).alias("has_markers"), read_errors().alias("read_error"),
    )


def read_errors() -> Column:
    """An aggregate: what could not be read of a run, in order, null where all could."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set("read_error")), "; "), F.lit(""))


def require_topic(messages: DataFrame, topic: str, types: set[str] | None = None) -> DataFrame:
    """Messages of one topic; an error names what there is when it is missing or of another type."""
    found = messages.where(F.col("topic") == topic)
    kinds = {r["message_type"] for r in found.select("message_type").distinct().limit(100).collect()}
    if not kinds:
        known = [r["topic"] for r in messages.select("topic").distinct().orderBy("topic").limit(1000).collect()]
        raise ValueError(f"no topic {topic!r}; there are {known}")
    if types is not None and not kinds <= types:
        raise TypeError(f"topic {topic!r} has types {sorted(kinds - types)}")
    return found


def durations(messages: DataFrame) -> DataFrame:
    """Seconds from the first to the last message of each run."""
    return messages.groupBy("run_id").agg(F.min("time_ns").alias("start_ns"), ((F.max("time_ns") - F.min("time_ns")) / F.lit(1e9)).alias("duration_sec"))


def ordered_markers(*keep: Column) -> Column:
    """An aggregate: lines of markers in time order; null lines are left out."""
    order, line = keep
    rows = F.collect_list(F.when(line.isNotNull(), F.struct(order.alias("o"), line.alias("line"))))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["line"]), " | ")


def marker_texts(events: DataFrame) -> DataFrame:
    """All markers of each run (run_id, seq, time, marker) as one text."""
    need(events, "run_id", "seq", "time", "marker")
    return events.groupBy("run_id").agg(ordered_markers(F.struct("time", "seq"), marker_line(F.col("time"), F.col("marker"))).alias("markers"))


def manifest(bags: DataFrame, events: DataFrame, startup_sec: float) -> DataFrame:
    """A row a recording: counts, marker texts and a label.

    ``bags`` has run_id, message_count, has_markers (whether it has the marker
    topic) and, if errors are known, read_error; ``events`` run_id, seq, time,
    marker.  Markers before ``startup_sec`` are ignored.  A failure marker makes
    a failure, any other marker a normal run; without markers the label is
    unknown.  A recording that could not be read whole stays in the table: its
    status says why, its label is unknown, and what could be read is counted.
    """
    need(bags, "run_id", "message_count", "has_markers")
    if "read_error" not in bags.columns:
        bags = bags.withColumn("read_error", F.lit(None).cast("string"))
    damaged = F.col("read_error").isNotNull()
    early = F.col("time") < startup_sec
    line, order = marker_line(F.col("time"), F.col("marker")), F.struct("time", "seq")
    bad = ~early & is_failure(F.col("marker"))
    seen = events.groupBy("run_id").agg(
        ordered_markers(order, F.when(early, line)).alias("ignored_startup_markers"),
        ordered_markers(order, F.when(~early, line)).alias("used_stage_markers"),
        ordered_markers(order, F.when(bad, line)).alias("failure_markers"),
        F.count_if(~early).alias("_used"), F.count_if(bad).alias("_bad"),
    )
    label = F.when(damaged, "unknown").when(F.col("_bad") > 0, "fail").when(F.col("_used") > 0, "normal").otherwise("unknown")
    used = F.when(F.col("has_markers") | damaged, F.coalesce("used_stage_markers", F.lit(""))).otherwise("<stage topic missing>")
    return bags.join(seen, "run_id", "left").select(
        "run_id", F.when(damaged, F.concat(F.lit("error: "), "read_error")).otherwise("ok").alias("read_status"), "message_count", F.lit(float(startup_sec)).alias("startup_ignore_sec"),
        F.coalesce("ignored_startup_markers", F.lit("")).alias("ignored_startup_markers"), used.alias("used_stage_markers"),
        F.coalesce("failure_markers", F.lit("")).alias("failure_markers"), label.alias("label"),
    )


def label_counts(manifest_: DataFrame) -> DataFrame:
    return manifest_.groupBy("label").agg(F.count("*").alias("runs"))


def relative_path(path: Column, root: str) -> Column:
    """A path under ``root`` without it; others stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(path)
