"""Recorded message logs as Spark data sources.

    register(spark)
    read(spark, folder, topics=["/tcp_force"])     # the messages: spark.read.format("bag") with options
    spark.read.format("bag_index").load(folder)    # topics, counts and times alone

``bag`` gives run_id, topic, message_type, seq, time_ns, start_ns, payload and
read_error.  A file of more than ``maxPartitionBytes`` is read in parts: ranges
of chunks by the index at its end, or ranges of row ids, so a task has about so
many bytes.  The options ``topics``, ``minTimeNs`` and ``maxTimeNs`` are handed to
the file's own index: chunks that hold no wanted topic or time are neither read
nor decompressed.  They are options and not filters that Spark pushes, as Spark
4.1 keeps the last pushed filters of a Python source for all plans on the same
DataFrame: two differently filtered scans of one would both read what the last
one asked for.  Decoding is a later step, so only messages that are kept are
decoded.

``bag_index`` reads no payload: counts and times come from a log's statistics,
from the message indexes behind its chunks, or from sums that SQLite makes; only
a log without any index is read through.

With ``mode`` PERMISSIVE what cannot be read (a file, or one chunk) is a row of
nulls with read_error, and reading goes on at the next chunk; FAILFAST, the
default, raises.

Storage is SQLite (.db3) or the chunked log format (.mcap), plain or with
zstandard or lz4 chunks.  Tasks open the files by path: recordings must lie on
storage that all executors mount.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "run_id string, topic string, message_type string, seq long, time_ns long, start_ns long, payload binary, read_error string"
INDEX_SCHEMA = "run_id string, path string, topic string, message_type string, message_count long, first_ns long, last_ns long, origin string, read_error string"
#: Bytes of a part of a file, of a batch of rows, and rows of a batch.
PART_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 16 << 20, 1000
#: Fixed values of the chunked log format: its magic and the codes of the records that are read here.
_MCAP_MAGIC = b"\x89MCAP0\r\n"
_FOOTER, _SCHEMA, _CHANNEL, _MESSAGE, _CHUNK, _MESSAGE_INDEX, _CHUNK_INDEX, _STATISTICS, _DATA_END = 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x0B, 0x0F

#: Says what could not be read; a reader without one raises.
Damage = Callable[[str], None] | None


def resolve_bag(path: str) -> Path:
    """The folder or file that a path to a recording names.

    A folder needs its metadata.yaml, a .db3 file has it beside it (the folder
    is meant), a .mcap file stands alone.
    """
    p = Path(path).expanduser()
    if not p.exists():
        raise FileNotFoundError(f"no recording at {p}")
    if p.is_dir():
        if (p / "metadata.yaml").is_file():
            return p
        raise ValueError(f"{p} has no metadata.yaml")
    if p.suffix == ".mcap":
        return p
    if p.suffix == ".db3":
        if (p.parent / "metadata.yaml").is_file():
            return p.parent
        raise ValueError(f"{p} has no metadata.yaml beside it")
    raise ValueError(f"{p} is no recording: a folder, .mcap or .db3 is expected")


def discover_bags(root: str, recursive: bool = True) -> list[Path]:
    """Folders under ``root`` that hold a metadata.yaml, sorted."""
    return sorted({p.parent.resolve() for p in Path(root).glob("**/metadata.yaml" if recursive else "*/metadata.yaml")})


def storage_files(path: str) -> list[Path]:
    found = resolve_bag(path)
    return sorted([*found.glob("*.db3"), *found.glob("*.mcap")]) if found.is_dir() else [found]


class Span(NamedTuple):
    """Wanted times, both ends included; None is open."""

    low: int | None = None
    high: int | None = None

    def meets(self, first: int, last: int) -> bool:
        return (self.low is None or last >= self.low) and (self.high is None or first <= self.high)


def _read_at(f: BinaryIO, place: int, size: int) -> bytes:
    """All bytes of a file that this module asks for by place come through here."""
    f.seek(place)
    data = f.read(size)
    if len(data) < size:
        raise EOFError(f"cut off: {len(data)} of {size} bytes at {place}")
    return data


def _records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        size = int.from_bytes(data[at + 1 : at + 9], "little")
        if at + 9 + size > len(data):
            raise EOFError(f"record of {size} bytes at {at} of {len(data)}")
        yield data[at], data[at + 9 : at + 9 + size]
        at += 9 + size


def _string(data: bytes, at: int) -> tuple[str, int]:
    n = int.from_bytes(data[at : at + 4], "little")
    return data[at + 4 : at + 4 + n].decode(), at + 4 + n


def _unpacked(path: Path, body: bytes) -> bytes:
    """The records of a chunk, checked where it has a checksum."""
    size, checksum = struct.unpack_from("<QI", body, 16)
    kind, at = _string(body, 28)
    data = body[at + 8 : at + 8 + int.from_bytes(body[at : at + 8], "little")]
    if kind == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    elif kind == "lz4":
        data = pa.Codec("lz4").decompress(data, decompressed_size=size).to_pybytes()
    elif kind:
        raise ValueError(f"{path}: no decoder for {kind} chunks")
    if checksum and zlib.crc32(data) != checksum:
        raise ValueError("checksum of a chunk does not agree")
    return data


class _Channels:
    """Topic and type of each channel, from the schema and channel records seen so far."""

    def __init__(self):
        self.types: dict[int, str] = {}
        self.known: dict[int, tuple[str, str]] = {}

    def learn(self, op: int, body: bytes) -> None:
        if op == _SCHEMA:
            self.types[int.from_bytes(body[:2], "little")] = _string(body, 2)[0]
        elif op == _CHANNEL:
            channel, schema = struct.unpack_from("<HH", body)
            self.known[channel] = (_string(body, 4)[0], self.types.get(schema, ""))


class _Chunk(NamedTuple):
    first: int
    last: int
    place: int
    size: int
    indexes: dict[int, int]  # the place of each channel's message index


class _Index(NamedTuple):
    channels: _Channels
    chunks: list[_Chunk]
    statistics: tuple[int, int, dict[int, int]] | None  # first and last time, messages of each channel

    def wanted(self, chunk: _Chunk, topics: set[str] | None, span: Span) -> bool:
        # a chunk that lists no channels may hold any
        other = topics is not None and chunk.indexes and all(c in self.channels.known and self.channels.known[c][0] not in topics for c in chunk.indexes)
        return not other and span.meets(chunk.first, chunk.last)


def _index(path: Path) -> _Index | None:
    """What the index at a file's end tells; None where there is none, or none that can be read."""
    with path.open("rb") as f:
        size = f.seek(0, 2)
        if size < 45:
            return None
        foot = _read_at(f, size - 37, 37)
        start = int.from_bytes(foot[9:17], "little")
        if foot[0] != _FOOTER or foot[29:] != _MCAP_MAGIC or not 0 < start <= size - 37:
            return None
        data = _read_at(f, start, size - 37 - start)
    channels, chunks, statistics = _Channels(), [], None
    try:
        for op, body in _records(data):
            channels.learn(op, body)
            if op == _CHUNK_INDEX:
                first, last, place, length, n = struct.unpack_from("<QQQQI", body)
                chunks.append(_Chunk(first, last, place, length, dict(struct.iter_unpack("<HQ", body[36 : 36 + n]))))
            elif op == _STATISTICS:
                first, last, n = struct.unpack_from("<QQI", body, 26)
                statistics = (first, last, dict(struct.iter_unpack("<HQ", body[46 : 46 + n])))
    except (EOFError, struct.error, UnicodeDecodeError):
        return None
    return _Index(channels, sorted(chunks, key=lambda c: c.place), statistics) if chunks else None


def _walk(path: Path, span: Span, damage: Damage) -> Iterator[tuple[int, int, bytes]]:
    """op, place and body of the records of a log one after the other; chunks of other times are passed over."""
    with path.open("rb") as f:
        size = f.seek(0, 2)
        if size < 8 or _read_at(f, 0, 8) != _MCAP_MAGIC:
            raise ValueError(f"{path} is no chunked log")
        at = 8
        while at < size:
            try:
                head = _read_at(f, at, 9)
                length = int.from_bytes(head[1:], "little")
                if head[0] == _CHUNK and (first_last := struct.unpack("<QQ", _read_at(f, at + 9, 16))) and not span.meets(*first_last):
                    at += 9 + length
                    continue
                body = _read_at(f, at + 9, length)
            except EOFError as e:
                if size - at == 8 and _read_at(f, at, 8) == _MCAP_MAGIC:
                    return
                if damage is None:
                    raise
                damage(f"{path.name}: {e}")
                return
            yield head[0], at, body
            if head[0] == _DATA_END:  # an index may follow
                return
            at += 9 + length


def _read_log(path: Path, topics: set[str] | None, span: Span = Span(), places: list[int] | None = None, damage: Damage = None) -> Iterator[tuple]:
    """topic, type, seq, time and payload of the wanted messages; ``places`` are the chunks of a part of a file."""
    found = _index(path)
    channels = found.channels if found else _Channels()

    def messages(records) -> Iterator[tuple]:
        for op, body in records:
            channels.learn(op, body)
            if op == _MESSAGE:
                channel, seq, time_ns = struct.unpack_from("<HIQ", body)
                if channel not in channels.known:
                    raise ValueError(f"message of an unknown channel {channel}")
                topic, kind = channels.known[channel]
                if (topics is None or topic in topics) and span.meets(time_ns, time_ns):
                    yield topic, kind, seq, time_ns, body[22:]

    def sound(place: int, records) -> Iterator[tuple]:
        try:
            yield from messages(records())
        except Exception as e:  # noqa: BLE001  whatever a damaged chunk does, the next one may be sound
            if damage is None:
                raise
            damage(f"{path.name}: chunk at {place}: {type(e).__name__}: {e}")

    if found is None:
        for op, place, body in _walk(path, span, damage):
            yield from sound(place, (lambda body=body: _records(_unpacked(path, body))) if op == _CHUNK else (lambda op=op, body=body: [(op, body)]))
        return
    with path.open("rb") as f:
        for chunk in found.chunks:
            if (places is None or chunk.place in places) and found.wanted(chunk, topics, span):
                yield from sound(chunk.place, lambda chunk=chunk: _records(_unpacked(path, _body_at(f, chunk))))


def _body_at(f: BinaryIO, chunk: _Chunk) -> bytes:
    body = _read_at(f, chunk.place, chunk.size)
    if body[0] != _CHUNK or int.from_bytes(body[1:9], "little") != chunk.size - 9:
        raise ValueError("no chunk where the index has one")
    return body[9:]


def _open(path: Path) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _read_sqlite(path: Path, topics: set[str] | None, span: Span = Span(), ids: tuple[int, int] | None = None, damage: Damage = None) -> Iterator[tuple]:
    """The wanted messages in the order of their row ids; ``ids`` bounds a part of a file (the end not included)."""
    tests, values = ["t.id = m.topic_id"], []
    for wanted, text, given in (
        (topics is not None, f"t.name IN ({','.join('?' * len(topics or ()))})", sorted(topics or ())),
        (span.low is not None, "m.timestamp >= ?", [span.low]),
        (span.high is not None, "m.timestamp <= ?", [span.high]),
        (ids is not None, "m.id >= ? AND m.id < ?", list(ids or ())),
    ):
        if wanted:
            tests.append(text)
            values += given
    try:
        with _open(path) as db:
            yield from db.execute(f"SELECT t.name, t.type, m.id, m.timestamp, m.data FROM messages m JOIN topics t ON {' AND '.join(tests)} ORDER BY m.id", values)
    except sqlite3.Error as e:
        if damage is None:
            raise
        damage(f"{path.name}: {type(e).__name__}: {e}")


def _start(path: Path) -> int | None:
    """Time of the first message of a file, whatever its topic; no chunk is unpacked."""
    if path.suffix == ".db3":
        with _open(path) as db:
            return db.execute("SELECT min(timestamp) FROM messages").fetchone()[0]
    found = _index(path)
    if found is not None:
        return min(c.first for c in found.chunks)
    times = []
    for op, _, body in _walk(path, Span(), lambda text: None):
        if op in (_CHUNK, _MESSAGE):
            times.append(int.from_bytes(body[:8] if op == _CHUNK else body[6:14], "little"))
    return min(times, default=None)


def start_of_run(files: list[str]) -> int:
    """Time of the first message of a run; files that cannot be read have none."""
    times = []
    for f in files:
        try:
            times.append(_start(Path(f)))
        except Exception:  # noqa: BLE001, PERF203  the reader of that file says what is wrong
            continue
    return min((t for t in times if t is not None), default=0)


class _Part(InputPartition):
    """A file or a part of one: the places of its chunks or the bounds of its row ids."""

    def __init__(self, run: str, path: str, files: list[str], part=None):
        super().__init__(path)
        self.run, self.path, self.files, self.part = run, path, files, part


def file_parts(path: Path, size: int) -> list:
    """Parts of a file of about so many bytes each; [None] is the whole file.  Smaller files are not opened."""
    total = path.stat().st_size
    if total <= size:
        return [None]
    try:
        if path.suffix == ".db3":
            with _open(path) as db:
                low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
            if low is None:
                return [None]
            n = min(-(-total // size), high - low + 1)
            cuts = [low + (high + 1 - low) * k // n for k in range(n + 1)]
            return list(zip(cuts, cuts[1:]))
        found = _index(path)
    except Exception:  # noqa: BLE001  the task that reads the file says what is wrong
        return [None]
    if found is None or not found.channels.known:
        return [None]
    parts, held = [[]], 0
    for chunk in found.chunks:
        if parts[-1] and held + chunk.size > size:
            parts.append([])
            held = 0
        parts[-1].append(chunk.place)
        held += chunk.size
    return parts


class BagReader(DataSourceReader):
    def __init__(self, runs: list[tuple[str, list[str]]], tolerant: bool, part_bytes: int, topics: set[str] | None, span: Span):
        self._runs, self._tolerant, self._part_bytes, self._topics, self._span = runs, tolerant, part_bytes, topics, span

    def partitions(self) -> list[InputPartition]:
        return [_Part(run, f, files, part) for run, files in self._runs for f in files for part in file_parts(Path(f), self._part_bytes)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        path, errors = Path(partition.path), []
        damage = errors.append if self._tolerant else None
        start = start_of_run(partition.files)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        try:
            for topic, kind, seq, time_ns, payload in (_read_sqlite if path.suffix == ".db3" else _read_log)(path, self._topics, self._span, partition.part, damage):
                rows.append((partition.run, topic, kind, seq, time_ns, start, bytes(payload), None))
                held += len(payload)
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        except Exception as e:  # noqa: BLE001  a file that is none
            if damage is None:
                raise
            damage(f"{path.name}: {type(e).__name__}: {e}")
        rows += [(partition.run, None, None, None, None, start, None, e) for e in errors]
        if rows:
            yield batch()


def _log_summary(path: Path, damage: Damage) -> tuple[str, int | None, int | None, dict[tuple[str, str], int]]:
    """Where the figures come from, first and last time, and messages of each topic and type."""
    found = _index(path)
    topics: dict[tuple[str, str], int] = {}
    counts = None
    if found is not None:
        counts = found.statistics[2] if found.statistics else _indexed_counts(path, found.chunks)
    if counts is not None:
        for channel, key in found.channels.known.items():
            topics[key] = topics.get(key, 0) + counts.get(channel, 0)
        return "statistics" if found.statistics else "message index", min(c.first for c in found.chunks), max(c.last for c in found.chunks), topics
    times: list[int] = []
    for topic, kind, _, time_ns, _ in _read_log(path, None, damage=damage):
        topics[topic, kind] = topics.get((topic, kind), 0) + 1
        times = [min([time_ns, *times]), max([time_ns, *times])]
    return "scan", *(times or [None, None]), topics


def _indexed_counts(path: Path, chunks: list[_Chunk]) -> dict[int, int] | None:
    """Messages of each channel from the heads of the message indexes behind the chunks; None where they are not there."""
    counts: dict[int, int] = {}
    with path.open("rb") as f:
        for chunk in chunks:
            for channel, place in chunk.indexes.items():
                head = _read_at(f, place, 15)  # the record's head, the channel, the bytes of its entries
                if head[0] != _MESSAGE_INDEX or int.from_bytes(head[9:11], "little") != channel:
                    return None
                counts[channel] = counts.get(channel, 0) + int.from_bytes(head[11:15], "little") // 16
    return counts or None


def _sqlite_summary(path: Path) -> tuple[str, int | None, int | None, dict[tuple[str, str], int]]:
    with _open(path) as db:
        first, last = db.execute("SELECT min(timestamp), max(timestamp) FROM messages").fetchone()
        counted = dict(db.execute("SELECT topic_id, count(*) FROM messages GROUP BY topic_id"))
        topics: dict[tuple[str, str], int] = {}
        for key, name, kind in db.execute("SELECT id, name, type FROM topics"):
            topics[name, kind] = topics.get((name, kind), 0) + counted.get(key, 0)
    return "sums", first, last, topics


class IndexReader(DataSourceReader):
    def __init__(self, runs: list[tuple[str, list[str]]], tolerant: bool):
        self._runs, self._tolerant = runs, tolerant

    def partitions(self) -> list[InputPartition]:
        return [_Part(run, f, []) for run, files in self._runs for f in files]

    def read(self, partition: _Part) -> Iterator[tuple]:
        path, errors = Path(partition.path), []
        rows: list[tuple] = []
        try:
            origin, first, last, topics = _sqlite_summary(path) if path.suffix == ".db3" else _log_summary(path, errors.append if self._tolerant else None)
            rows = [(partition.run, str(path), t, k, n, first, last, origin, None) for (t, k), n in sorted(topics.items())]
        except Exception as e:  # noqa: BLE001  a damaged file stays visible
            if not self._tolerant:
                raise
            errors.append(f"{path.name}: {type(e).__name__}: {e}")
        # a row of the file itself: it is there even if nothing could be read
        yield from [*rows, *((partition.run, str(path), None, None, 0, None, None, None, e) for e in errors or ([] if rows else [None]))]


class BagSource(DataSource):
    """Options: ``path`` (a recording, or a folder of recordings), ``recursive``, ``mode``, ``maxPartitionBytes``, ``topics``, ``minTimeNs``, ``maxTimeNs``.

    ``topics``, separated by commas, are the only ones that are read; the two
    times are both included.  Rows of what cannot be read are kept.
    """

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def _runs(self) -> list[tuple[str, list[str]]]:
        path = self.options["path"]
        try:
            paths = [resolve_bag(path)]
        except ValueError:
            paths = discover_bags(path, self.options.get("recursive", "true") == "true")
        if not paths:
            raise ValueError(f"no recordings under {path}")
        return [(p.stem if p.is_file() else p.name, [str(f) for f in storage_files(str(p))]) for p in paths]

    def _tolerant(self) -> bool:
        return self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def reader(self, schema) -> BagReader:
        topics, times = self.options.get("topics"), (self.options.get("minTimeNs"), self.options.get("maxTimeNs"))
        span = Span(*(int(t) if t else None for t in times))
        return BagReader(self._runs(), self._tolerant(), int(self.options.get("maxPartitionBytes", PART_BYTES)), set(topics.split(",")) if topics else None, span)


class BagIndexSource(BagSource):
    """Options: ``path``, ``recursive``, ``mode``."""

    @classmethod
    def name(cls) -> str:
        return "bag_index"

    def schema(self) -> str:
        return INDEX_SCHEMA

    def reader(self, schema) -> IndexReader:
        return IndexReader(self._runs(), self._tolerant())


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.dataSource.register(BagSource)
    spark.dataSource.register(BagIndexSource)


def read(spark: SparkSession, path: str, topics: list[str] | None = None, low: int | None = None, high: int | None = None, tolerant: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """Messages of one recording or a folder of them: of some topics, and of times from ``low`` to ``high``."""
    given = {"topics": ",".join(topics or ()), "minTimeNs": low, "maxTimeNs": high, "mode": "PERMISSIVE" if tolerant else "FAILFAST", "maxPartitionBytes": part_bytes}
    return spark.read.format("bag").options(**{k: str(v) for k, v in given.items() if v not in ("", None)}).load(path)
