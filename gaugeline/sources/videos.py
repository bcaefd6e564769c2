"""Where the frames of a video lie, from the tables of its container.

    register(spark)
    spark.read.format("video_index").load(folder)   # or one .mp4 / .mov file

gives a row a frame: run_id, path, frame_index (in the order of showing),
timestamp_sec, key_frame, byte_offset, byte_size, fps and frame_count.  Only the
container's tables are read, no frame and no decoder: samplers choose rows
first (``sampling.every_kth``, ``sampling.sample_evenly``), and a decoder then
reads the bytes of what is left, from the key frame before it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "run_id string, path string, frame_index long, timestamp_sec double, key_frame boolean, byte_offset long, byte_size long, fps double, frame_count long"
ENDINGS = (".mp4", ".mov", ".m4v")
BATCH_ROWS = 100_000


def _boxes(f: BinaryIO, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first and last place of the contents of the boxes between two places."""
    at = start
    while at + 8 <= end:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", f.read(8))[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} goes beyond its frame")
        yield kind, at + head, at + size
        at += size


def _within(f: BinaryIO, start: int, end: int, *kinds: bytes) -> tuple[int, int] | None:
    """Contents of the first box on a path of kinds."""
    for kind in kinds:
        found = next(((a, b) for k, a, b in _boxes(f, start, end) if k == kind), None)
        if found is None:
            return None
        start, end = found
    return start, end


def _table(f: BinaryIO, box: tuple[int, int] | None, kinds: str, skip: int = 4) -> np.ndarray | None:
    """Rows of a box's table after its version (and ``skip - 4`` further bytes) and count."""
    if box is None:
        return None
    f.seek(box[0] + skip)
    n = struct.unpack(">I", f.read(4))[0]
    kind = np.dtype([(f"f{k}", t) for k, t in enumerate(kinds.split())])
    raw = f.read(n * kind.itemsize)
    if len(raw) < n * kind.itemsize:
        raise EOFError(f"table of {n} rows is cut off")
    return np.frombuffer(raw, dtype=kind)


def frame_table(path: Path) -> dict[str, np.ndarray] | None:
    """Columns of the frames of a file's first video track in the order of showing; None where there is none."""
    with path.open("rb") as f:
        size = f.seek(0, 2)
        movie = _within(f, 0, size, b"moov")
        if movie is None:
            raise ValueError(f"{path} has no movie box")
        for kind, a, b in _boxes(f, *movie):
            media = _within(f, a, b, b"mdia") if kind == b"trak" else None
            handler = _within(f, *media, b"hdlr") if media else None
            if handler is None:
                continue
            f.seek(handler[0] + 8)
            if f.read(4) == b"vide":
                break
        else:
            return None
        head, tables = _within(f, *media, b"mdhd"), _within(f, *media, b"minf", b"stbl")
        if head is None or tables is None:
            raise ValueError(f"{path} has no sample tables")
        f.seek(head[0])
        f.seek(head[0] + (20 if f.read(1) == b"\x01" else 12))
        scale = struct.unpack(">I", f.read(4))[0]
        box = lambda kind: _within(f, *tables, kind)
        if (sizes_at := box(b"stsz")) is None:
            raise ValueError(f"{path} has no table of sample sizes")
        f.seek(sizes_at[0] + 4)
        same, n = struct.unpack(">II", f.read(8))
        sizes = np.full(n, same, dtype=np.int64) if same else _table(f, sizes_at, ">u4", 8)["f0"].astype(np.int64)
        durations = _table(f, box(b"stts"), ">u4 >u4")
        shown = _table(f, box(b"ctts"), ">u4 >i4")
        keys = _table(f, box(b"stss"), ">u4")
        runs = _table(f, box(b"stsc"), ">u4 >u4 >u4")
        chunks = _table(f, box(b"stco"), ">u4")
        chunks = (_table(f, box(b"co64"), ">u8") if chunks is None else chunks)["f0"].astype(np.int64)
    steps = np.repeat(durations["f1"].astype(np.int64), durations["f0"])[:n]
    ticks = np.concatenate([[0], np.cumsum(steps)[:-1]]) if n else np.empty(0, np.int64)
    if shown is not None:
        ticks = ticks + np.repeat(shown["f1"].astype(np.int64), shown["f0"])[:n]
    # samples of each chunk: a run of chunks holds until the next run starts
    firsts = runs["f0"].astype(np.int64) - 1
    each = np.repeat(runs["f1"].astype(np.int64), np.diff(np.append(firsts, len(chunks))))
    chunk = np.repeat(np.arange(len(chunks)), each)[:n]
    before = np.cumsum(sizes) - sizes
    begins = (np.cumsum(each) - each)[chunk]
    offsets = chunks[chunk] + before - before[begins] if n else np.empty(0, np.int64)
    key = np.ones(n, dtype=bool)
    if keys is not None:
        key[:] = False
        key[keys["f0"].astype(np.int64) - 1] = True
    order = np.argsort(ticks, kind="stable")
    ticks = ticks[order] - (ticks.min() if n else 0)
    spent = int(steps.sum()) / scale
    return {"frame_index": np.arange(n), "timestamp_sec": ticks / scale, "key_frame": key[order], "byte_offset": offsets[order], "byte_size": sizes[order], "fps": np.full(n, n / spent if spent else 0.0), "frame_count": np.full(n, n)}


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class VideoIndexReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self._files = files

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self._files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        path = Path(partition.path)
        found = frame_table(path)
        n = 0 if found is None else len(found["frame_index"])
        for a in range(0, n, BATCH_ROWS):
            part = {c: v[a : a + BATCH_ROWS] for c, v in found.items()}
            size = len(part["frame_index"])
            yield pa.RecordBatch.from_arrays([pa.array([path.stem] * size), pa.array([str(path)] * size), *(pa.array(v) for v in part.values())], [c.split()[0] for c in SCHEMA.split(", ")])


class VideoIndexSource(DataSource):
    """Options: ``path`` (a video, or a folder of videos)."""

    @classmethod
    def name(cls) -> str:
        return "video_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VideoIndexReader:
        path = Path(self.options["path"]).expanduser()
        files = sorted(p for p in path.rglob("*") if p.suffix.lower() in ENDINGS) if path.is_dir() else [path]
        if not files or not all(p.is_file() for p in files):
            raise FileNotFoundError(f"no videos at {path}")
        return VideoIndexReader([str(p) for p in files])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VideoIndexSource)


def decoding_ranges(chosen: DataFrame, index: DataFrame) -> DataFrame:
    """Of chosen frames (rows of an index) the key frame that decoding starts from: key_index and key_offset."""
    run = W.partitionBy("path").orderBy("frame_index").rowsBetween(W.unboundedPreceding, 0)
    last = F.last_value(F.when(F.col("key_frame"), F.struct(F.col("frame_index").alias("i"), F.col("byte_offset").alias("o"))), True).over(run)
    keyed = index.select("path", "frame_index", last.alias("_k")).select("path", "frame_index", F.col("_k.i").alias("key_index"), F.col("_k.o").alias("key_offset"))
    return chosen.join(keyed, ["path", "frame_index"])
