"""Words and hashed word shingles of many texts, computed on Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gaugeline.llm.tokens import strings

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close values part."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts on end, and the count of words of each text.

    Words are runs of anything but space, tab, LF, VT, FF and CR; null has none.
    Each distinct word of the batch is hashed once.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    counts[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
    coded = split.flatten().filter(pc.not_equal(split.flatten(), "")).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, strings(coded.dictionary)), dtype=np.uint64, count=len(coded.dictionary))
    return hashes[coded.indices.to_numpy()], counts


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` neighbouring values."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        n = len(hashes) - width + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            out = mixed(out * _ODD + hashes[k : k + n])
    return out


def shingle_sets(texts: pa.Array, width: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    With fewer words the whole sequence is one shingle; without words none.
    """
    hashes, counts = word_hashes(texts, lower)
    runs = rolled(hashes, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        elif n:
            out.append(rolled(hashes[at : at + n], n))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += n
    return out
