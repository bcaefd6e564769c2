"""Exact repeats of word windows by prefix-partitioned suffix trees.

A window of ``WINDOW`` words that starts anywhere else too is a repeat, and all
words that repeats cover are removed.  All suffixes of a corpus are too many to
sort, so the trees are sparse and partitioned:

1. Each window is seen from its anchor: the leftmost least hash among its runs
   of as many words as a prefix has.  Equal windows have equal anchors at equal
   places, so only suffixes that start at anchors enter a tree (one word in ten
   for the shortest prefix), and only those whose prefix occurs twice.
2. Suffixes are dealt out by prefix.  Prefixes have variable lengths: where a
   group would outgrow ``GROUP`` leaves, its windows, and these alone, are seen
   anew from anchors with the next longer prefix of ``PREFIXES``.
3. A task sorts the suffixes of many groups; the lengths of common prefixes of
   neighbours are the suffix trees.  Cutting a tree at depth ``WINDOW - d``
   gives the nodes whose leaves agree on the words right of the anchor; leaves
   of a node that also agree on the ``d`` words left of it are repeats.
4. The longest prefix is the whole window: nothing is left of the tree but one
   node, and its leaves are counted.  A batch of texts counts its own windows
   first and sends one row for each; sums and a join that Spark can split for
   hot keys do the rest.

Rows with equal words enter once, and each such row of at least a window is a
repeat throughout.

Rows have a key of their own.  Texts are shuffled once, into buckets of that
key; later passes bring prefixes and spans to the buckets.  Memory of a task: a
batch of texts, or ``CHUNK`` leaves and one group.  A word stands for itself by
32 bits inside a group that shares a 64-bit prefix hash, a whole window by 128
bits: of 10**13 windows two that differ are taken as equal with a chance under
10**-12.

Defined results: null and blank texts have no words; the digest of no words is
that of the empty string; documents under a window keep everything; repeated
rows repeat each other; an empty table gives no rows; other columns are
ignored.  doc_id may be null or shared: every row is judged by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import scratch, settle, with_rows
from gaugeline.llm.shingles import mixed, rolled, word_hashes
from gaugeline.llm.tokens import batches

WINDOW = 35
#: Words of a prefix, from the first try to the whole window.
PREFIXES = (12, 24, WINDOW)
#: Leaves of a group; longer prefixes split what is larger.
GROUP = 1024
CHUNK = 60_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_FACTORS = np.random.default_rng(35).integers(1, 1 << 63, size=(2, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def starts_of(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places where windows start, in texts on end."""
    n = np.maximum(counts - window + 1, 0)
    return _ragged(np.cumsum(counts) - counts, n)


def anchors(hashes: np.ndarray, starts: np.ndarray, width: int, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: prefix hash, anchor, and first and last window start of the run.

    Places count words of all texts on end.  Windows of two texts never share
    an anchor, as both would have to hold it.
    """
    none = np.empty(0, dtype=np.int64)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    prefixes = rolled(hashes, width)
    least = np.lib.stride_tricks.sliding_window_view(prefixes, window - width + 1)
    at = np.concatenate([starts[k : k + CHUNK] + least[starts[k : k + CHUNK]].argmin(axis=1) for k in range(0, len(starts), CHUNK)])
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    return prefixes[at[first]], at[first], starts[first], starts[last]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _marked(owner: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(prefix.view(np.uint64) ^ mixed((owner + 1).astype(np.uint64) * _STEP))


def _among(owner: np.ndarray, prefix: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether the prefix is in the list of its text."""
    of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    return np.isin(_marked(owner, prefix), _marked(of, lists.flatten().to_numpy()))


def followed(hashes: np.ndarray, counts: np.ndarray, hot: list[pa.Array]) -> tuple[np.ndarray, ...]:
    """Owner and anchors (see ``anchors``) of the windows whose shorter prefixes are all hot, with the prefix after these."""
    starts, ends = starts_of(counts), np.cumsum(counts)
    for level in range(len(hot) + 1):
        prefix, at, first, last = anchors(hashes, starts, PREFIXES[level])
        owner = np.searchsorted(ends, at, side="right")
        if level < len(hot):
            again = _among(owner, prefix, hot[level])
            starts = _ragged(first[again], (last - first + 1)[again])
    return owner, prefix, at, first, last


def _counted(owner: np.ndarray, prefix: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """Of each text its distinct prefixes and how often each occurs."""
    order = np.lexsort((prefix, owner))
    owner, prefix = owner[order], prefix[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (prefix[1:] != prefix[:-1])])) if len(owner) else owner
    times = np.diff(np.append(first, len(owner)))
    cuts = np.searchsorted(owner[first], np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.array(prefix[first].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))


SURVEYED = "_row long, n_words long, digest binary, kept binary, prefixes array<long>, times array<int>"


def _named(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def survey(rows: DataFrame) -> DataFrame:
    """Of each row (_row, text) its words' digests and the prefixes of its anchors with their counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, texts = part.columns
            for a, b in batches(texts):
                some = texts.slice(a, b - a)
                hashes, counts = word_hashes(some, lower=False)
                owner, prefix, *_ = followed(hashes, counts, [])
                kept, digests, at = [], [], 0
                for n, text in zip(counts.tolist(), some.to_pylist()):
                    kept.append(hashlib.sha256(" ".join(_words(text)).encode("utf-8", "surrogatepass")).digest())
                    digests.append(hashlib.blake2b(hashes[at : at + n].tobytes(), digest_size=16).digest() if n else None)
                    at += n
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary()), *_counted(owner, prefix, b - a)], _named(SURVEYED))

    return rows.select("_row", "text").mapInArrow(run, SURVEYED)


def resurvey(joined: DataFrame, level: int) -> DataFrame:
    """Of each row (_row, text, hot prefixes of all levels before) the prefixes of its windows that these leave, with counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(1)):
                row, texts, *hot = (c.slice(a, b - a) for c in part.columns)
                owner, prefix, *_ = followed(*word_hashes(texts, lower=False), hot)
                yield pa.RecordBatch.from_arrays([row, *_counted(owner, prefix, b - a)], ["_row", "prefixes", "times"])

    return joined.select("_row", "text", *[f"hot{k}" for k in range(level)]).mapInArrow(run, "_row long, prefixes array<long>, times array<int>")


def _words(text: str | None) -> list[str]:
    """As word_hashes: Python's bytes split at exactly these six kinds of white space."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]


LEAVES = "key long, _row long, at int, near int, far int, codes binary"
SPANS = "_row long, first int, past int"


def leaves(joined: DataFrame, levels: int) -> DataFrame:
    """Leaves of trees: anchors whose prefix is wanted, with the words around them.

    ``joined`` has _row, text, and for each level but the last want{k} and hot{k}.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(1)):
                row, texts, *lists = (c.slice(a, b - a) for c in part.columns)
                hashes, counts = word_hashes(texts, lower=False)
                base = np.cumsum(counts) - counts
                for level in range(levels):
                    owner, prefix, at, first, last = followed(hashes, counts, lists[levels : levels + level])
                    wanted = np.flatnonzero(_among(owner, prefix, lists[level]))
                    for k in range(0, len(wanted), CHUNK):
                        x = wanted[k : k + CHUNK]
                        lengths = last[x] + WINDOW - first[x]
                        words = np.maximum(hashes[_ragged(first[x], lengths)] >> np.uint64(32), np.uint64(1)).astype("<u4")
                        codes = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(4 * lengths)]).astype(np.int32)), pa.py_buffer(words)])
                        with np.errstate(over="ignore"):
                            key = prefix[x] + np.uint64(level)
                        numbers = [(at - base[owner])[x], (at - last)[x], (at - first)[x]]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), row.take(pa.array(owner[x])), *(pa.array(n.astype(np.int32)) for n in numbers), codes], _named(LEAVES))

    lists = [f"{kind}{k}" for kind in ("want", "hot") for k in range(levels)]
    return joined.select("_row", "text", *lists).mapInArrow(run, LEAVES)


WHOLE = "key long, more long, times int, _row long, first int, past int"


def whole_windows(joined: DataFrame, levels: int) -> DataFrame:
    """Windows whose prefixes are all hot, counted in each batch of texts.

    A window that a batch holds once has its row and place; one that it holds
    more often has times 2 and none, and its places come as spans without a key.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(1)):
                row, texts, *hot = (c.slice(a, b - a) for c in part.columns)
                hashes, counts = word_hashes(texts, lower=False)
                owner, _, _, start, last = followed(hashes, counts, hot)
                n = last - start + 1
                owner, start = np.repeat(owner, n), _ragged(start, n)
                digest = np.empty((len(start), 2), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(0, len(start), CHUNK):
                        words = hashes[start[k : k + CHUNK, None] + np.arange(WINDOW)]
                        for side in range(2):
                            digest[k : k + CHUNK, side] = mixed((mixed(words + np.uint64(side)) * _WORD_FACTORS[side]).sum(axis=1, dtype=np.uint64))
                order = np.lexsort((digest[:, 1], digest[:, 0]))
                new = np.concatenate([[True], (digest[order[1:]] != digest[order[:-1]]).any(axis=1)]) if len(order) else np.empty(0, bool)
                times = np.diff(np.append(np.flatnonzero(new), len(order)))
                one, often = order[new], np.empty(len(order), bool)
                often[order] = np.repeat(times > 1, times)
                again = np.flatnonzero(often)
                again = again[np.lexsort((start[again], owner[again]))]
                first, final = _runs(owner[again], start[again])
                base = np.cumsum(counts) - counts

                def out(key, more, seen, owner, start, past, placed):
                    m = ~np.full(len(key), placed)
                    cells = [pa.array(start.astype(np.int32), mask=m), pa.array(past.astype(np.int32), mask=m)]
                    return pa.RecordBatch.from_arrays([key, more, pa.array(seen.astype(np.int32)), row.take(pa.array(owner, mask=m)), *cells], _named(WHOLE))  # noqa: B023

                for seen, x in ((1, one[times == 1]), (2, one[times > 1])):
                    at = start[x] - base[owner[x]]
                    yield out(*(pa.array(digest[x, side].view(np.int64)) for side in range(2)), np.full(len(x), seen), owner[x], at, at + WINDOW, seen == 1)
                d, s, e = owner[again][first], start[again][first], start[again][final]
                nothing = pa.nulls(len(d), pa.int64())
                yield out(nothing, nothing, np.zeros(len(d)), d, s - base[d], e - base[d] + WINDOW, True)

    return joined.select("_row", "text", *[f"hot{k}" for k in range(levels)]).mapInArrow(run, WHOLE)


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of neighbouring places of one text."""
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]) if len(owner) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(owner)) - 1 if len(owner) else first


def repeats_among(key: np.ndarray, near: np.ndarray, far: np.ndarray, codes: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of leaves grouped by key: leaf, and the nearest and farthest start of each run of repeats."""
    n, reach = len(key), window - PREFIXES[0]
    offsets = np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset : codes.offset + n + 1].astype(np.int64) // 4
    flat = np.append(np.frombuffer(codes.buffers()[2], dtype="<u4"), np.uint32(0))
    end = len(flat) - 1
    j = np.arange(window)
    right = flat[np.where(j < (window - near)[:, None], (offsets[:-1] + far)[:, None] + j, end)]
    j = np.arange(reach)
    left = flat[np.where(j < far[:, None], (offsets[:-1] + far - 1)[:, None] - j, end)]
    # the suffix array of all groups: by key, then word by word; an end comes before any word
    pairs = np.pad(right, ((0, 0), (0, window % 2))).astype(np.uint64)
    pairs = (pairs[:, 0::2] << np.uint64(32)) | pairs[:, 1::2]
    order = np.lexsort((*pairs.T[::-1], key))
    right, left, key, lo, hi = right[order], left[order], key[order], near[order], far[order]
    differs = right[1:] != right[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), window)
    common[key[1:] != key[:-1]] = -1
    common = np.concatenate([[-1], common])
    hit = np.zeros((n, reach + 2), dtype=np.int8)
    behind = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for d in range(reach + 1):
            node = np.cumsum(common < window - d).astype(np.uint64)
            some = np.flatnonzero((lo <= d) & (d <= hi))
            _, which, times = np.unique(mixed(node[some] * _STEP ^ behind[some]), return_inverse=True, return_counts=True)
            hit[some[times[which] > 1], d] = 1
            if d < reach:
                behind = mixed(behind * _STEP + left[:, d] + np.uint64(1))
    edge = np.diff(np.pad(hit, ((0, 0), (1, 0))), axis=1)
    leaf, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return order[leaf], first, past - 1


def grow(dealt: DataFrame) -> DataFrame:
    """Spans of words that repeats cover, from leaves sorted by key in each partition."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in parts:
            held.append(part)
            size += len(part)
            # a group is bounded, so the last one that is held back is small
            if size >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table["key"].chunk(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield spans(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), len(table) - cut
        if size:
            yield spans(pa.Table.from_batches(held))

    def spans(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        near, far, at = (table[c].to_numpy().astype(np.int64) for c in ("near", "far", "at"))
        leaf, nearest, farthest = repeats_among(table["key"].to_numpy(), near, far, table["codes"].chunk(0))
        return pa.RecordBatch.from_arrays([table["_row"].chunk(0).take(pa.array(leaf)), pa.array((at[leaf] - farthest).astype(np.int32)), pa.array((at[leaf] - nearest + WINDOW).astype(np.int32))], _named(SPANS))

    return dealt.mapInArrow(run, SPANS)


def _remove(joined: DataFrame) -> DataFrame:
    """_row, n_removed and the digest of kept words of rows (_row, text, spans)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            removed, kept = [], []
            for text, spans in zip(part.column(1), part.column(2)):
                words = _words(text.as_py())
                first, past = (spans.values.field(k).to_numpy() for k in range(2))
                depth = np.bincount(first, minlength=len(words) + 1) - np.bincount(past, minlength=len(words) + 1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["_row", "n_removed", "left"])

    return joined.select("_row", "text", "spans").mapInArrow(run, "_row long, n_removed long, left binary")


def _split(surveyed: DataFrame, name: str) -> DataFrame:
    """_row, want and hot: of each row the prefixes that occur again, those of small groups and those of groups to split."""
    each = surveyed.select("_row", F.inline(F.arrays_zip("prefixes", "times")))
    # written, so that a prefix in very many rows is a hot key that Spark can split
    twice = settle(each.groupBy("prefixes").agg(F.sum("times").alias("leaves")).where("leaves > 1"), name)
    found = each.select("_row", "prefixes").join(twice, "prefixes").withColumn("is_hot", F.col("leaves") > GROUP)
    lists = [F.coalesce(F.collect_list(F.when(hot, F.col("prefixes"))), F.array().cast("array<long>")) for hot in (~F.col("is_hot"), F.col("is_hot"))]
    return settle(found.groupBy("_row").agg(lists[0].alias("want"), lists[1].alias("hot")), f"{name}-of-rows")


def repeated_spans(rows: DataFrame, surveyed: DataFrame) -> DataFrame:
    """_row, first and past (words) of what repeats cover, among rows of different texts (_row, text)."""
    texts, levels = rows.select("_row", "text"), 0
    lists = None
    found: DataFrame | None = surveyed
    for level in range(len(PREFIXES) - 1):
        of_rows = _split(found, f"prefixes-{PREFIXES[level]}").withColumnsRenamed({"want": f"want{level}", "hot": f"hot{level}"})
        lists = of_rows if lists is None else lists.join(of_rows, "_row", "left")
        levels = level + 1
        again = lists.where(F.size(f"hot{level}") > 0)
        if again.isEmpty():
            again = None
            break
        if levels < len(PREFIXES) - 1:
            found = settle(resurvey(texts.join(again.hint("shuffle_hash"), "_row"), levels), f"windows-{PREFIXES[levels]}")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    any_wanted = F.lit(False)
    for k in range(levels):
        any_wanted = any_wanted | (F.coalesce(F.size(f"want{k}"), F.lit(0)) > 0)
    dealt = leaves(texts.join(lists.where(any_wanted).hint("shuffle_hash"), "_row"), levels)
    spans = grow(dealt.repartition(partitions, "key").sortWithinPartitions("key"))
    if again is None:
        return spans
    whole = settle(whole_windows(texts.join(again.hint("shuffle_hash"), "_row"), levels), "whole-windows")
    repeated = settle(whole.where("times > 0").groupBy("key", "more").agg(F.sum("times").alias("n")).where("n > 1").select("key", "more"), "repeated-windows")
    once = whole.where("times = 1").join(repeated, ["key", "more"], "left_semi")
    columns = _named(SPANS)
    return spans.unionByName(once.select(*columns)).unionByName(whole.where("times = 0").select(*columns))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows = with_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    surveyed = settle(survey(rows), "survey")
    classes = settle(surveyed.where("digest is not null").groupBy("digest").agg(F.min("_row").alias("one"), F.count("*").alias("copies")), "equal-texts")
    different = surveyed.join(classes.select(F.col("one").alias("_row")), "_row", "left_semi")
    with scratch():
        by_row = settle(repeated_spans(rows, different).groupBy("_row").agg(F.collect_list(F.struct("first", "past")).alias("spans")), "spans", keep=True)
    removed = _remove(rows.join(by_row.hint("shuffle_hash"), "_row"))
    out = rows.select("_row", "doc_id").join(surveyed.select("_row", "n_words", "digest", "kept"), "_row").join(removed, "_row", "left").join(classes.select("digest", "copies"), "digest", "left")
    whole = F.coalesce((F.col("copies") > 1) & (F.col("n_words") >= WINDOW), F.lit(False))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, nothing).otherwise(F.lower(F.hex(F.coalesce("left", "kept")))).alias("kept_sha256"),
    )
