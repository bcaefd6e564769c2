"""Media columns: byte payloads as WAV, short-time spectra, peak-pair fingerprints.

``to_wav`` stores each payload losslessly as 8-bit mono samples.  ``fingerprint``
opens the stored bytes with the wave module, takes windowed Fourier transforms
of overlapping frames, keeps in each frequency band the bins that are louder
than the band is in all frames NEAR around, and pairs every peak with the next
few that follow within a time limit.  The first and last sample are held on, so
that every sample lies in two frames or more; in the last END frames each band
that sounds counts, as nothing follows to peak over.  All recordings, short or
long, are transformed alike and times are frames, so a peak depends on the
samples about it alone.  A pair is coded (bin, bin, distance) beside its time:
two recordings that share a passage have equal codes with a constant offset.

Both run where the rows lie, with no shuffle.  Rows are taken by the bytes of
their texts and frames are transformed in blocks, so memory is a small multiple
of one slice or of one long payload.

Defined results: a null or empty text is a payload of 64 zero bytes; payloads
with no peak (silence) have empty arrays; rows that repeat give equal values;
an empty table gives no rows; other columns of the table are not touched.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.tokens import batches

RATE = 8000
FRAME = 64
HOP = 32
#: First bins of the bands, and one past the last; a window spreads what is constant over bins 0 and 1.
BANDS = (2, 5, 10, 18, 33)
#: Following peaks that a peak is paired with, and the most frames between them.
FAN_OUT = 3
REACH = 31
#: Frames to either side that a peak is louder than, and last frames of a recording.
NEAR, END = 8, 2
_BLOCK = 4096
#: Bytes of texts or recordings that are turned into rows together.
SLICE = 1_000_000
_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def payload(text: str | None, unit: int = 64) -> bytes:
    """UTF-8 with zeros up to a positive multiple of ``unit`` bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % unit if raw else unit)


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and bins of spectral peaks, by time and then bin."""
    x = np.frombuffer(samples, dtype=np.uint8)
    before = FRAME // 2
    n = 1 + -(-len(x) // HOP)
    x = np.pad(x, (before, FRAME + (n - 1) * HOP - before - len(x)), "edge")
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    level = np.empty((n, len(BANDS) - 1), dtype=np.float32)
    place = np.empty((n, len(BANDS) - 1), dtype=np.int64)
    for a in range(0, n, _BLOCK):
        spectrum = np.fft.rfft((frames[a : a + _BLOCK].astype(np.float32) - 128) * _HANN, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            at = power[:, low:high].argmax(axis=1)
            level[a : a + _BLOCK, b] = power[np.arange(len(at)), low + at]
            place[a : a + _BLOCK, b] = low + at
    # silence rounds to almost nothing and has no peaks
    peak = level > 1e-3
    sounds = peak[n - END :].copy()
    for k in range(1, min(NEAR, n - 1) + 1):
        peak[k:] &= level[k:] > level[:-k]
        peak[:-k] &= level[:-k] >= level[k:]
    peak[n - END :] = sounds
    times, bands = np.nonzero(peak)
    return times, place[times, bands]


def peak_pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (bin, later bin, distance) and the times of their first peaks."""
    codes, at = [], []
    for k in range(1, FAN_OUT + 1):
        apart = times[k:] - times[:-k]
        near = (apart >= 1) & (apart <= REACH)
        codes.append((bins[:-k][near] << 13) | (bins[k:][near] << 5) | apart[near])
        at.append(times[:-k][near])
    codes, at = np.concatenate(codes), np.concatenate(at)
    order = np.lexsort((codes, at))
    return codes[order].astype(np.int32), at[order].astype(np.int32)


def to_wav(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding) and media, the payload as a WAV file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            doc_ids, texts = part.columns
            for a, b in batches(texts, SLICE):
                some = texts.slice(a, b - a).to_pylist()
                media = [wav_bytes(payload(t)) for t in some]
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in some]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FINGERPRINT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codes array<int>, times array<int>"


def fingerprint(media: DataFrame) -> DataFrame:
    """Digests of what the stored bytes hold, and the time-coded pair arrays."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            doc_ids, sizes, stored = part.columns
            for a, b in batches(stored, SLICE):
                rows = []
                for m in stored.slice(a, b - a):
                    m = m.as_py()
                    back = read_wav(m)
                    codes, times = peak_pairs(*band_peaks(back))
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), codes, times))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), sizes.slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [c.split()[0] for c in FINGERPRINT.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FINGERPRINT)


def feature_text(codes, times):
    """A column: number of pairs and a digest of the two arrays."""
    return F.concat_ws(":", F.size(codes).cast("string"), F.sha2(F.concat_ws(",", F.concat(codes, times).cast("array<string>")), 256))
