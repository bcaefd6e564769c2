"""Runs of words that repeat with a period, by probing a harmonic grid.

A run is a stretch of words with smallest period q (words q apart are equal), of
at least max(6, 4 q) words, that no neighbouring word extends.  For a period p
only the grid 0, p, 2p, ... is tested for word jp = word (j+1)p: a run of 4p
words holds three such points in a row.  That costs n/p tests a period, n log n
for all.  Three in a row are then extended both ways by comparing chunks of the
array with itself p words on.  A point in a found run whose period divides p is
passed over with the rest of that run, as its stretch is that run again; so
long runs cost a step a multiple and no comparing.

The words of many documents are coded as numbers and laid out one after the
other, the longest documents first, each with an end mark that equals nothing:
one pass over the array serves all of them, and as p grows only the documents
of 4p words or more are tested.

Runs where the rows lie, with no shuffle; a batch holds some megabytes of text
or one long document.

Defined results: null, empty and blank texts have no words and no runs; ties of
the longest run go to the smallest start, then period; runs of different
periods may overlap, and a word goes if any run has it after its first period;
rows that repeat give equal values; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import words_of
from gaugeline.llm.tokens import batches

#: Least words of a run, and least periods.
LEAST, TIMES = 6, 4
#: First and largest chunk of an extension.
CHUNKS = (64, 1 << 20)


def _right(w: np.ndarray, p: int, at: int) -> int:
    """The first place from ``at`` on whose word differs from that p later."""
    end, size = len(w) - p, CHUNKS[0]
    while at < end:
        stop = min(at + size, end)
        differs = w[at:stop] != w[at + p : stop + p]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, size = stop, min(2 * size, CHUNKS[1])
    return end


def _left(w: np.ndarray, p: int, at: int) -> int:
    """The first place of the stretch up to ``at`` in which each word equals that p later."""
    size = CHUNKS[0]
    while at > 0:
        stop = max(at - size, 0)
        differs = (w[stop:at] != w[stop + p : at + p])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return at - k
        at, size = stop, min(2 * size, CHUNKS[1])
    return 0


def runs_of(w: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length and period of all runs of documents laid out in ``w``, by start and period.

    ``sizes`` are their words, falling; one value that occurs nowhere else ends each document.
    """
    ends = np.cumsum(sizes + 1)
    out: list[tuple[int, int, int]] = []
    known: dict[int, tuple[list[int], list[int]]] = {}
    for p in range(1, (int(sizes.max(initial=0)) // TIMES) + 1):
        long = int(np.searchsorted(-sizes, -TIMES * p, side="right"))
        part = w[: ends[long - 1]]
        grid = part[::p]
        same = grid[1:] == grid[:-1]
        hits = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if not len(hits):
            continue
        smaller = [known[q] for q in known if p % q == 0]
        at = 0
        while at < len(hits):
            i, last = int(hits[at]) * p, None
            for starts, stops in smaller:
                k = bisect_right(starts, i) - 1
                if k >= 0 and i + p < stops[k] and stops[k] - starts[k] >= 2 * p:
                    last = stops[k] - p
                    break
            if last is None:
                first, last = _left(part, p, i), _right(part, p, i)
                length = last - first + p
                if length >= max(LEAST, TIMES * p):
                    out.append((first, length, p))
                    starts, stops = known.setdefault(p, ([], []))
                    starts.append(first)
                    stops.append(last + p)
            at = int(np.searchsorted(hits, last // p + 1))
    return sorted(out, key=lambda r: (r[0], r[2]))


FOUND = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "array<struct<start:long,length:long,period:long>>"


def _collapsed(doc_ids: pa.Array, texts: pa.Array, whole: bool) -> Iterator[pa.RecordBatch]:
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    words = split.flatten()
    real = pc.not_equal(words, "")
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    counts[(counts == 1) & (pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))).to_numpy() == 0)] = 0
    coded = words.filter(real).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    # places in the long array, an end mark after each document
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    w = np.empty(int((sizes + 1).sum()), dtype=np.int64)
    w[begin + sizes] = -1 - np.arange(len(sizes))
    from_ = np.repeat(offsets[order] - begin, sizes)
    inner = np.arange(len(codes)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    w[inner] = codes[inner + from_]
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    gone = np.zeros(len(w) + 1, dtype=np.int64)
    for start, length, period in runs_of(w, sizes):
        k = int(np.searchsorted(begin, start, side="right")) - 1
        found[order[k]].append((start - int(begin[k]), length, period))
        gone[start + period] += 1
        gone[start + length] -= 1
    stays = np.cumsum(gone)[:-1] == 0
    at = np.empty(len(counts), dtype=np.int64)
    at[order] = begin
    rows = []
    empty = hashlib.sha256(b"").hexdigest()
    kept = np.zeros(len(codes), dtype=bool)
    kept[inner + from_] = stays[inner]
    left = np.add.reduceat(np.append(kept, False).astype(np.int64), offsets[:-1]) if len(counts) else np.empty(0, np.int64)
    left[counts == 0] = 0
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), coded.dictionary.take(pa.array(codes[kept])))
    joined = pc.binary_join(lists, " ")
    for runs, text in zip(found, joined):
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        text = text.as_py()
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest() if runs else empty
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        rows.append((len(runs), *top, listed, digest, *([[dict(zip(("start", "length", "period"), r)) for r in runs], text] if whole else [])))
    kinds = [*(pa.int64(),) * 5, pa.string(), pa.string()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    if whole:
        kinds += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
        names += ["runs", "collapsed"]
    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """FOUND for every row; if ``whole`` also all runs and the text without their repeats."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            doc_ids, texts = part.columns
            for a, b in batches(texts):
                yield from _collapsed(doc_ids.slice(a, b - a), texts.slice(a, b - a), whole)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND + (f", runs {RUNS}, collapsed string" if whole else ""))


def looped(doc_id: Column, text: Column) -> Column:
    """Texts of which one in ten by crc32 of the id repeats itself from some word on; a null id changes nothing.

    With h the crc32 of the id in decimal, g = h div 10 and n words: if h mod 10
    is 0 and there are words, word i from a = g mod n on becomes word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10), words_of(text)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.concat_ws(" ", F.slice(w, 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p)))

    # the words as a lambda's variable, so that they are split once
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w))), 1)
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)
