"""Token ids in files of independent zstandard frames with a seek table.

A file is a run of frames, one a document, each a complete zstandard stream of
the document's ids (little-endian, two bytes an id where the vocabulary allows,
else four).  Two skippable frames end it: an index of documents (doc_id and
token count, itself compressed), then the seek table of the public seekable
format: compressed size, plain size and the low half of the XXH64 of every
frame's plain bytes, their number and a magic number.  A reader takes the tail,
looks up a document, and decompresses that frame alone.

How it runs: ids are made where the texts lie; only compressed frames are
shuffled, to ranges of doc_id whose bounds come from a distributed quantile
sketch; each task streams its sorted range to one file in the shared folder.
A shard holds about SHARD_DOCS documents at most, so that its index stays small,
and documents without an id are dealt to shards of their own, ahead of all
others.  Files are read on end, a block at a time.  A retried task writes a file
of its own, and only files named in the manifest (written by Spark's commit
protocol) count.

Defined results: a null or empty text is the end id alone; documents with the
same doc_id follow each other in the order of their compressed frames; a null
doc_id comes first; an empty table gives an empty manifest and no rows; a
document of 4 GB of ids or more is an error, as the format's sizes end there.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import fresh_path
from gaugeline.llm.tokens import batches, encoder

#: Fixed values of the format: skippable-frame and seek-table magic numbers.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Documents of a shard aimed at, and bytes that a reader holds of a file.
SHARD_DOCS, READ_BYTES = 1_000_000, 8_000_000
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n_tokens", "<u8")])

MANIFEST = "shard long, path string, n_docs long, n_tokens long, width int"


def checksum(plain: bytes) -> int:
    """The low half of XXH64, as the seekable format has it."""
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def file_system(uri: str):
    """pyarrow's file system and path for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://") if uri.startswith("file:") else f"file://{uri}")


class FrameWriter:
    """Streams frames to one file; ``close`` adds the tail and gives its name."""

    def __init__(self, folder: str, name: str, width: int):
        self._fs, path = file_system(folder)
        self._fs.create_dir(path, recursive=True)
        self.path, self.width = f"{path}/{name}", width
        self._out = self._fs.open_output_stream(self.path, compression=None)
        self._entries: list[tuple] = []
        self._docs: list[tuple] = []

    def add(self, doc_id: int | None, n_tokens: int, packed: bytes, check: int) -> None:
        if n_tokens * self.width >= 1 << 32:
            raise ValueError(f"document {doc_id} is too long for one frame")
        self._out.write(packed)
        self._entries.append((len(packed), n_tokens * self.width, check))
        self._docs.append((doc_id or 0, doc_id is not None, n_tokens))

    def close(self) -> tuple[int, int]:
        import zstandard

        index = zstandard.ZstdCompressor().compress(bytes([self.width]) + np.array(self._docs, dtype=_DOC).tobytes())
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = np.array(self._entries, dtype=_ENTRY).tobytes() + struct.pack("<IBI", len(self._entries), CHECKSUM_FLAG, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self._out.close()
        return len(self._docs), sum(d[2] for d in self._docs)


class FrameReader:
    """Reads single documents of a file by position or by doc_id."""

    def __init__(self, uri: str):
        import zstandard

        self._fs, path = file_system(uri)
        self._in = self._fs.open_input_file(path)
        self._zstd = zstandard.ZstdDecompressor()
        size = self._in.size()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flag != CHECKSUM_FLAG:
            raise ValueError(f"no seek table at the end of {uri}")
        seek_at = size - 9 - n * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(seek_at, n * _ENTRY.itemsize), dtype=_ENTRY)
        self._starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        index_at = int(self._starts[-1]) + 8
        index = self._zstd.decompress(self._at(index_at, seek_at - 8 - index_at))
        self.width, self.docs = index[0], np.frombuffer(index, dtype=_DOC, offset=1)

    def _at(self, where: int, length: int) -> bytes:
        self._in.seek(where)
        return self._in.read(length)

    def _plain(self, k: int, packed: bytes) -> np.ndarray:
        entry = self.entries[k]
        plain = self._zstd.decompress(packed, max_output_size=int(entry["plain"]))
        if checksum(plain) != entry["check"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, dtype=f"<u{self.width}")

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, checked against its checksum."""
        return self._plain(k, self._at(int(self._starts[k]), int(self.entries[k]["packed"])))

    def all_ids(self, block: int = READ_BYTES) -> Iterator[np.ndarray]:
        """The ids of every document in order; the file is read a block of whole frames at a time."""
        k, n = 0, len(self.entries)
        while k < n:
            first = int(self._starts[k])
            end = max(k + 1, int(np.searchsorted(self._starts, first + block, side="right")) - 1)
            held = memoryview(self._at(first, int(self._starts[end]) - first))
            for j in range(k, end):
                yield self._plain(j, held[int(self._starts[j]) - first : int(self._starts[j + 1]) - first])
            k = end

    def find(self, doc_id: int) -> list[np.ndarray]:
        """All documents with this id; only their frames are read."""
        return [self.ids(int(k)) for k in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["has_id"] == 1))]

    def close(self) -> None:
        self._in.close()


def write_frames(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode all documents and write them in ascending doc_id order; gives the manifest."""
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "frames")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    # a task each, and more where they would hold too many documents
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-named // SHARD_DOCS))
    nameless = -(-(rows - named) // SHARD_DOCS)  # shards of rows without an id
    wanted = [i / shards for i in range(1, shards)]
    bounds = docs.agg(F.percentile_approx("doc_id", wanted, 100 * shards)).first()[0] if wanted else []
    edges = np.array(sorted(set(bounds or [])), dtype=np.int64)  # fewer than shards values
    width = 2 if _vocabulary(tokenizer_path) <= 65536 and end_id < 65536 else 4

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for part in parts:
            doc_ids, texts = part.column(0).to_pylist(), part.column(1)
            for a, b in batches(texts):
                sized, packed, checks = [], [], []
                for ids in encoder(tokenizer_path).ids(texts.slice(a, b - a)):
                    plain = np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()
                    sized.append(len(plain) // width)
                    packed.append(zstd.compress(plain))
                    checks.append(checksum(plain))
                shard = [check % nameless if d is None else nameless + int(np.searchsorted(edges, d, side="left")) for d, check in zip(doc_ids[a:b], checks)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((shard, pa.int32()), (doc_ids[a:b], pa.int64()), (sized, pa.int64()), (packed, pa.binary()), (checks, pa.int64()))], ["shard", "doc_id", "n_tokens", "frame", "check"])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, name = None, None, ""
        for part in parts:
            for shard, *row in zip(*(c.to_pylist() for c in part.columns)):
                if out is None:
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.ids.zst"
                    out = FrameWriter(folder, name, width)
                out.add(*row)
        if out is not None:
            n_docs, n_tokens = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int64()), (f"{folder}/{name}", pa.string()), (n_docs, pa.int64()), (n_tokens, pa.int64()), (width, pa.int32()))], ["shard", "path", "n_docs", "n_tokens", "width"])

    manifest = (
        docs.mapInArrow(encode, "shard int, doc_id long, n_tokens long, frame binary, check long")
        .repartitionById(nameless + len(edges) + 1, F.col("shard"))
        .sortWithinPartitions("doc_id", "frame")
        .mapInArrow(write, MANIFEST)
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _vocabulary(tokenizer_path: str) -> int:
    return encoder(tokenizer_path).size


def read_frames(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of four-byte ids) of every document, from the files.

    The running total is over the manifest alone: a row a file, not a row a document.
    """
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, before in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                reader = FrameReader(path)
                n = reader.docs["n_tokens"].astype(np.int64)
                starts = before + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
                doc_ids = pa.array(reader.docs["doc_id"].astype(np.int64), mask=reader.docs["has_id"] == 0)
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in reader.all_ids()]
                reader.close()
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return placed.select("path", "before", F.monotonically_increasing_id().alias("k")).repartition(files, "k").select("path", "before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
