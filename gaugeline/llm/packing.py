"""Sum-of-squares packing of documents into fixed token windows.

A document's ids are cut into full windows and one tail.  Tails are placed
online: an array holds, for every fill level, how many open windows have that
level, and a tail goes to the level (or to a new window) that makes the sum of
the squared counts least.  This keeps every level in supply, so that windows
close full.

Each task packs the documents of its own partition, so no text is shuffled.
Windows still open at its end, some hundred whatever its size, send their tails
on to a few packers, a MERGED-th as many as there are shuffle partitions, which
place them online again.  What those leave open at the very end is poured
together, cutting where windows meet, and at most one stays partly filled.

Memory a task: one Arrow batch of texts and the tails of its open windows.

Defined results: a null or empty text is the end id alone; repeated documents
are packed each time they occur; an empty table gives no rows; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import settle
from gaugeline.llm.tokens import MAX_PIECES, batches, encoder

WINDOW = 1024
END_ID = 0
#: Shuffle partitions whose open windows one packer takes.
MERGED = 4
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"
_TYPES = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


class LevelArray:
    """Open windows by fill level; ``counts[h]`` of them hold ``h`` tokens."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def best_level(self, size: int) -> int:
        """The level to place ``size`` tokens at; 0 stands for a new window."""
        n, top = self.counts, self.window - size
        change = np.zeros(top + 1, dtype=np.int64)
        change[1:] = 1 - 2 * n[1 : top + 1]
        change += np.where(np.arange(size, self.window + 1) < self.window, 2 * n[size : self.window + 1] + 1, 0)
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        # of equal changes the fullest window
        return top - int(np.argmin(change[::-1]))

    def place(self, piece, size: int) -> list | None:
        """Add a piece; gives the window's pieces if that fills it."""
        level = self.best_level(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.counts[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def remaining(self) -> Iterator[list]:
        """Windows still open, fullest first."""
        for level in sorted(self.open, reverse=True):
            yield from self.open[level]


def _padded(fill: int, window: int) -> int:
    return fill if fill & (fill - 1) == 0 else window


class Packer:
    """Packs (doc_id, ids) one after another and yields rows of full windows."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next, self.levels = window, first_sequence, LevelArray(window)

    def _close(self, pieces: list) -> Iterator[tuple]:
        fill, at = sum(len(p[2]) for p in pieces), 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, fill, _padded(fill, self.window)
            at += len(ids)
        self.next += 1

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        full = total - total % self.window
        for start in range(0, full, self.window):
            yield from self._close([(doc_id, start, ids[start : start + self.window], total)])
        if full < total:
            yield from self.tail(doc_id, full, ids[full:].copy(), total)

    def tail(self, doc_id: int, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        done = self.levels.place((doc_id, start, ids, total), len(ids))
        if done:
            yield from self._close(done)

    def open_tails(self) -> Iterator[tuple]:
        """The tails of windows still open."""
        for window in self.levels.remaining():
            yield from window

    def finish(self) -> Iterator[tuple]:
        pieces, fill = [], 0
        for window in self.levels.remaining():
            for doc_id, start, ids, total in window:
                while len(ids):
                    part = ids[: self.window - fill]
                    pieces.append((doc_id, start, part, total))
                    fill += len(part)
                    start, ids = start + len(part), ids[len(part) :]
                    if fill == self.window:
                        yield from self._close(pieces)
                        pieces, fill = [], 0
        if pieces:
            yield from self._close(pieces)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_TYPES)


def pack(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", most_pieces: int = MAX_PIECES) -> DataFrame:
    """Pieces of all documents with their sequence and place in it (see SCHEMA)."""
    kinds = _TYPES.append(pa.field("ids", pa.binary()))

    def start(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], dtype="<u4")
        for part in parts:
            doc_ids, texts = part.column(0).to_pylist(), part.column(1)
            for a, b in batches(texts):
                found = []
                for doc_id, ids in zip(doc_ids[a:b], encoder(tokenizer_path, most_pieces).ids(texts.slice(a, b - a))):
                    found.extend(packer.add(doc_id, np.concatenate([ids, end])))
                if found:
                    yield pa.RecordBatch.from_arrays([*_rows(found).columns, pa.nulls(len(found), pa.binary())], schema=kinds)
        if tails := list(packer.open_tails()):
            rows = [(doc_id, at, len(ids), None, total, None, None, None, None) for doc_id, at, ids, total in tails]
            yield pa.RecordBatch.from_arrays([*_rows(rows).columns, pa.array([t[2].tobytes() for t in tails], pa.binary())], schema=kinds)

    def go_on(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sequences after those of all first packers
        packer = Packer(window, (1 << 62) + (TaskContext.get().partitionId() << 36))
        for part in parts:
            found = []
            for doc_id, at, total, ids in zip(*(c.to_pylist() for c in part.columns)):
                found.extend(packer.tail(doc_id, at, np.frombuffer(ids, dtype="<u4"), total))
            if found:
                yield _rows(found)
        if found := list(packer.finish()):
            yield _rows(found)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = settle(docs.mapInArrow(start, f"{SCHEMA}, ids binary"), "packed")
    packers = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // MERGED)
    rest = packed.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids").repartition(packers)
    return packed.where("ids is null").drop("ids").unionByName(rest.mapInArrow(go_on, SCHEMA))
