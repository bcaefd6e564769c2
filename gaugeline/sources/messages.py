"""Decoding payloads of messages (little-endian common data representation)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Message types and the fields of numeric ones.
WRENCH = {"geometry_msgs/msg/Wrench", "geometry_msgs/msg/WrenchStamped"}
POSE = {"geometry_msgs/msg/Pose", "geometry_msgs/msg/PoseStamped"}
JOINTS = "sensor_msgs/msg/JointState"
TEXT = "std_msgs/msg/String"
IMAGES = {"sensor_msgs/msg/Image", "sensor_msgs/msg/CompressedImage"}
WRENCH_FIELDS = ["force_x", "force_y", "force_z", "torque_x", "torque_y", "torque_z"]
POSE_FIELDS = ["position_x", "position_y", "position_z", "orientation_x", "orientation_y", "orientation_z", "orientation_w"]


class Cursor:
    """Walks one payload; values are aligned to their size after the four-byte head.

    ``fixed`` are the places of the bytes that decide where the rest lies.
    """

    def __init__(self, data: bytes):
        self.order = "<" if data[1] == 1 else ">"
        self.data, self.at = data, 4
        self.fixed = [(1, 2)]

    def place(self, kind: str, n: int = 1) -> int:
        """Where n values lie; the next thing comes after them."""
        size = struct.calcsize(kind)
        self.at += -(self.at - 4) % size
        at = self.at
        self.at += n * size
        if self.at > len(self.data):
            raise ValueError(f"payload of {len(self.data)} bytes ends within {n} values at {at}")
        return at

    def take(self, kind: str, n: int = 1) -> tuple:
        return struct.unpack_from(f"{self.order}{n}{kind}", self.data, self.place(kind, n))

    def count(self) -> int:
        n = self.take("I")[0]
        self.fixed.append((self.at - 4, self.at))
        return n

    def text(self, fixed: bool = False) -> str:
        n = self.count()
        at = self.place("B", n)
        if fixed:
            self.fixed.append((at, at + n))
        return self.data[at : at + max(n - 1, 0)].decode("utf-8", "replace")

    def raw(self) -> bytes:
        n = self.count()
        at = self.place("B", n)
        return self.data[at : at + n]

    def doubles(self, n: int) -> list[int]:
        """Places of n numbers."""
        at = self.place("d", n) if n else self.at
        return [at + 8 * k for k in range(n)]

    def header(self) -> None:
        self.take("i"), self.take("I"), self.text()


def joint_channel(name: str, field: str) -> str:
    return re.sub("[^a-zA-Z0-9]+", "_", name).strip("_").lower() + "_" + field


def layout(payload: bytes, kind: str) -> tuple[list[str], list[int], Cursor]:
    """Channels of a wrench, pose or joint state and where their numbers lie; joints without a name are numbered."""
    c = Cursor(payload)
    if kind in WRENCH | POSE:
        if kind.endswith("Stamped"):
            c.header()
        fields = WRENCH_FIELDS if kind in WRENCH else POSE_FIELDS
        return list(fields), c.doubles(len(fields)), c
    if kind == JOINTS:
        c.header()
        names = [c.text(fixed=True) for _ in range(c.count())]
        channels, places = [], []
        for field in ("position", "velocity", "effort"):
            at = c.doubles(c.count())
            channels += [joint_channel(names[k] if k < len(names) else f"joint_{k}", field) for k in range(len(at))]
            places += at
        return channels, places, c
    raise TypeError(f"no numeric channels in {kind}")


def decoded(payloads: pa.Array, kinds: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Rows that share a layout, its channels, and their numbers (rows x channels).

    Of rows of one type and length the first is parsed; all that agree with it
    in the bytes that decide the layout are read by its places in one gather.
    """
    payloads = payloads.cast(pa.binary())
    if not len(payloads):
        return
    ends = np.frombuffer(payloads.buffers()[1], dtype=np.int32)[payloads.offset : payloads.offset + len(payloads) + 1].astype(np.int64)
    data = np.frombuffer(payloads.buffers()[2] or b"", dtype=np.uint8)
    alike: dict[tuple[str, int], list[int]] = {}
    for row, key in enumerate(zip(kinds, np.diff(ends).tolist())):
        alike.setdefault(key, []).append(row)
    for (kind, size), rows in alike.items():
        left = np.array(rows)
        bytes_ = data[ends[left][:, None] + np.arange(size)]
        while len(left):
            channels, places, cursor = layout(bytes_[0].tobytes(), kind)
            fixed = np.concatenate([np.arange(a, b) for a, b in cursor.fixed])
            same = (bytes_[:, fixed] == bytes_[0, fixed]).all(axis=1)
            at = (np.array(places, dtype=np.int64)[:, None] + np.arange(8)).ravel()
            numbers = np.ascontiguousarray(bytes_[same][:, at]).view(f"{cursor.order}f8")
            yield left[same], channels, numbers.astype(np.float64)
            left, bytes_ = left[~same], bytes_[~same]


def _since_start() -> Column:
    return (F.col("time_ns") - F.col("start_ns")) / F.lit(1e9)


_KEYS = ["run_id", "topic", "seq", "time_ns", "time"]
_KEY_SCHEMA = "run_id string, topic string, seq long, time_ns long, time double"


def _numeric(messages: DataFrame) -> DataFrame:
    return messages.where("payload is not null").select("run_id", "topic", "seq", "time_ns", _since_start().alias("time"), "message_type", "payload")


def numeric_channels(messages: DataFrame) -> DataFrame:
    """Long form: run_id, topic, seq, time_ns, time (since the recording began), channel, value."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, channels, numbers in decoded(part.column("payload"), part.column("message_type").to_pylist()):
                if not channels:
                    continue
                key = part.select(_KEYS).take(pa.array(np.repeat(rows, len(channels))))
                names = pa.DictionaryArray.from_arrays(np.tile(np.arange(len(channels), dtype=np.int32), len(rows)), pa.array(channels)).dictionary_decode()
                yield pa.RecordBatch.from_arrays([*key.columns, names, pa.array(numbers.ravel())], [*_KEYS, "channel", "value"])

    return _numeric(messages).mapInArrow(run, f"{_KEY_SCHEMA}, channel string, value double")


def numeric_topic(messages: DataFrame, topic: str, names: list[str]) -> DataFrame:
    """A column a channel of one topic, in no order; null where a message lacks the channel.

    Wide columns come out of the bytes as they are: no row is shuffled or
    sorted.  Of joints whose channels have the same name the first counts.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.full((len(names), len(part)), np.nan)
            there = np.zeros((len(names), len(part)), dtype=bool)
            for rows, channels, numbers in decoded(part.column("payload"), part.column("message_type").to_pylist()):
                for k, name in enumerate(names):
                    if name in channels:
                        values[k, rows], there[k, rows] = numbers[:, channels.index(name)], True
            columns = [pa.array(v, mask=~t) for v, t in zip(values, there)]
            yield pa.RecordBatch.from_arrays([*part.select(_KEYS).columns, *columns], [*_KEYS, *names])

    return _numeric(messages.where(F.col("topic") == topic)).mapInArrow(run, _KEY_SCHEMA + "".join(f", `{c}` double" for c in names))


def numeric_topics(messages: DataFrame, topics: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One table a topic; they are not aligned with each other."""
    if not topics:
        raise ValueError("at least one topic is needed")
    return {t: numeric_topic(messages, t, names) for t, names in topics.items()}


def stage_events(messages: DataFrame, topic: str = "/recording_stage") -> DataFrame:
    """Markers of a text topic: run_id, seq, time_ns, time, marker.

    A text is a length and its bytes, so the decoding needs no Python.
    """
    rows = messages.where((F.col("topic") == topic) & (F.col("message_type") == TEXT))
    size = F.conv(F.hex(F.reverse(F.substring("payload", 5, 4))), 16, 10).cast("int")
    text = F.decode(F.substring(F.col("payload"), F.lit(9), F.greatest(size - 1, F.lit(0))), "UTF-8")
    return rows.select("run_id", "seq", "time_ns", _since_start().alias("time"), text.alias("marker"))


def image(payload: bytes, kind: str) -> dict:
    """Fields of an image message."""
    c = Cursor(payload)
    c.header()
    if kind == "sensor_msgs/msg/CompressedImage":
        return {"encoding": c.text(), "height": None, "width": None, "data": c.raw()}
    (height,), (width,) = c.take("I"), c.take("I")
    encoding, _, (step,) = c.text(), c.take("B"), c.take("I")
    return {"encoding": encoding, "height": height, "width": width, "data": to_rgb(c.raw(), encoding, height, width, step)}


def to_rgb(data: bytes, encoding: str, height: int, width: int, step: int) -> bytes:
    """Rows of any of the five plain encodings as packed RGB."""
    depth = {"rgb8": 3, "bgr8": 3, "rgba8": 4, "bgra8": 4, "mono8": 1}.get(encoding.lower())
    if depth is None:
        raise ValueError(f"no decoder for encoding {encoding!r}")
    pixels = np.frombuffer(data, np.uint8)[: height * step].reshape(height, step)[:, : width * depth].reshape(height, width, depth)
    if depth == 1:
        pixels = np.repeat(pixels, 3, axis=2)
    elif encoding.lower().startswith("bgr"):
        pixels = pixels[:, :, 2::-1]
    else:
        pixels = pixels[:, :, :3]
    return np.ascontiguousarray(pixels).tobytes()


def frames(messages: DataFrame, topic: str, decoder=None) -> DataFrame:
    """Image frames of a topic: run_id, seq, time, encoding, height, width, image.

    Sample by time first, as only what is left is decoded.  ``decoder`` turns
    the bytes of a compressed image into (height, width, RGB bytes).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [image(p, k) for p, k in zip(part.pop("payload"), part.pop("message_type"))]
            for f in found:
                if f["height"] is None and decoder is not None:
                    f["height"], f["width"], f["data"] = decoder(f["data"])
            out = pd.DataFrame(found, columns=["encoding", "height", "width", "data"]).rename(columns={"data": "image"})
            yield pd.concat([part.reset_index(drop=True), out.astype({"height": "Int32", "width": "Int32"})], axis=1)

    rows = messages.where((F.col("topic") == topic) & F.col("message_type").isin(*IMAGES))
    return rows.select("run_id", "seq", _since_start().alias("time"), "message_type", "payload").mapInPandas(run, "run_id string, seq long, time double, encoding string, height int, width int, image binary")
