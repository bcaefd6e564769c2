"""Which reader a path asks for."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

from gaugeline.sources import bags, messages

#: Endings of video files; all else is a recording.
VIDEOS = (".mp4", ".avi", ".mov", ".mkv")


def read_frames(spark: SparkSession, path: str, topic: str | None = None, video: Callable[[SparkSession, str], DataFrame] | None = None, decoder=None) -> DataFrame:
    """Frames of a video by the caller's reader, or of an image topic of a recording."""
    if PurePath(path).suffix.lower() in VIDEOS:
        if video is None:
            raise ValueError(f"{path}: a video needs a reader (video=)")
        return video(spark, path)
    if topic is None:
        raise ValueError(f"{path}: a recording needs a topic")
    return messages.frames(bags.read(spark, path, [topic]), topic, decoder)


def first_that_reads(path: str, readers: dict[str, Callable[[str], DataFrame]]) -> DataFrame:
    """The rows of the first reader that finds any; the error names what each one said."""
    said = []
    for name, reader in readers.items():
        try:
            rows = reader(path)
            if not rows.isEmpty():
                return rows
            said.append(f"{name}: no rows")
        except Exception as e:  # noqa: BLE001  the next reader may know the format
            said.append(f"{name}: {e}")
    raise ValueError(f"no reader for {path}: " + "; ".join(said))
