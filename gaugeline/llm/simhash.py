"""Near-duplicate documents by SimHash fingerprints under a generalised pigeonhole.

Fingerprints: 64 bits; a bit is 1 if more than half of the XXH64 values (seed
42) of the text's word shingles have it, repeats included.

How links are found
1. Documents with one fingerprint are a class; only distinct fingerprints go on.
2. Bits that go together (a 64 x 64 table of counts over all fingerprints) are
   grouped into four cells of 16, and cells into two to four partitions.
3. A fingerprint shares at most t units of difference over its partitions: with
   thresholds t_i that sum to t - m + 1 over m partitions (one may be -1, not
   probed), whatever lies within t differs by at most t_i in some partition.
   For each fingerprint the thresholds are those with the least estimated work,
   by dynamic programming on how many fingerprints differ how much from it in
   each partition.  Counts in a cell are exact, from its histogram of 65,536
   values; cells of a partition are taken as independent.  So common values are
   not probed where others are rarer, and the number of partitions is that of
   the least total.  Estimates decide the work, never the result.
4. Each fingerprint is filed under its value in every partition and goes to all
   values that its thresholds allow.  Where a probe meets what is filed,
   differences of whole fingerprints are counted.  A bucket gives no pairs but a
   spanning forest of its links: fingerprints within reach of a leader are one
   star, and two stars are compared only if their leaders are near enough for
   a link and nothing has joined them yet.
5. A bucket of more than ``BLOCK`` is cut, each pair of blocks a task's group.
   Components of the forests are the answer; no link is left out.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; with fewer words than a shingle the whole sequence is one;
repeated rows and equal texts share a class; a class is named by its least
doc_id (null ids name nothing: a group without any other is null); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import scratch, settle
from gaugeline.llm.components import components

SEED = 42
WIDTH = 3
#: Most differing bits of a link.
REACH = 3
CELLS, CELL_BITS = 4, 16
#: Work of meeting one filed fingerprint, in probes: a comparison against a row that is shuffled.
MEETING = 0.02
#: Fingerprints of a block of a bucket.
BLOCK = 1 << 17
#: Bytes of a text that are split into words together.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Groups of up to so many are compared all with all at once, for all groups of a task together.
FEW = 8


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a long text in parts, cut at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def _bits_of(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit (least first), and how many shingles there are."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    n = len(words) - width + 1
    first, last = [0, *ends[: n - 1].tolist()], (ends[width - 1 :] - 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)), dtype="<u8", count=n)
    return np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64), n


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of a whole text, unsigned."""
    counts, total, before = np.zeros(64, dtype=np.int64), 0, []
    for part in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = before + part
        if len(words) >= width:
            some, n = _bits_of(words, width)
            counts, total = counts + some, total + n
            before = words[1 - width :]
        else:
            before = words
    if not total:
        if not before:
            return 0
        counts, total = _bits_of([b" ".join(before)], 1)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.fromiter((fingerprint(t.as_py()) for t in part.column(1)), dtype=np.uint64, count=len(part))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bit_counts(classes: DataFrame) -> np.ndarray:
    """Of every pair of bits how many fingerprints have both: 4,096 sums, added up by Spark."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        for part in parts:
            bits = np.unpackbits(part.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.ravel())], ["at", "n"])

    out = np.zeros(4096)
    for row in classes.select("fp").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out.reshape(64, 64)


def cells_of(both: np.ndarray, total: int) -> list[list[int]]:
    """Bits in four cells of 16, those that go together in one; cells 0 and 1, 2 and 3 lie next to each other."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    likeness = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(likeness, 0)
    left, out = set(range(64)), []
    for _ in range(CELLS):
        near = out[-1] if len(out) % 2 else sorted(left)
        cell = [max(sorted(left), key=lambda b: likeness[b, near].sum())]
        left.discard(cell[0])
        while len(cell) < CELL_BITS:
            cell.append(max(sorted(left), key=lambda b: likeness[b, cell].sum()))
            left.discard(cell[-1])
        out.append(sorted(cell))
    return out


def cell_values(fps: np.ndarray, cell: list[int]) -> np.ndarray:
    """The bits of a cell as a number."""
    out = np.zeros(len(fps), dtype=np.int64)
    for k, bit in enumerate(cell):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def _histograms(classes: DataFrame, cells: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value of each cell: 4 x 65,536 counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((CELLS, 1 << CELL_BITS), dtype=np.int64)
        for part in parts:
            fps = part.column(0).to_numpy().view(np.uint64)
            for k, cell in enumerate(cells):
                seen[k] += np.bincount(cell_values(fps, cell), minlength=1 << CELL_BITS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], ["at", "n"])

    counted = classes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS << CELL_BITS)
    out[counted["at"].to_numpy()] = counted["n"].to_numpy()
    return out.reshape(CELLS, -1)


def distances(histogram: np.ndarray, most: int = REACH) -> np.ndarray:
    """Of every value, which share of all lies at each number of differing bits up to ``most``."""
    out = np.zeros((len(histogram), most + 1))
    out[:, 0] = histogram / max(histogram.sum(), 1)
    at = np.arange(len(histogram))
    for bit in range(CELL_BITS):
        flipped = out[at ^ (1 << bit)]
        out[:, 1:] += flipped[:, :-1]
    return out


def schemes() -> list[list[tuple[int, ...]]]:
    """Ways to make partitions of the cells: two, three or four."""
    return [[(0, 1), (2, 3)], [(0,), (1,), (2, 3)], [(0,), (1,), (2,), (3,)]]


def allocate(fps: np.ndarray, cells: list[list[int]], near: np.ndarray, total: int, scheme: list[tuple[int, ...]], reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Units (threshold + 1) of each fingerprint in each partition of a scheme, and the estimated work.

    Units sum to reach + 1.  Dynamic programming over the partitions: the best
    for the first so many with so many units spent.
    """
    values = [cell_values(fps, cell) for cell in cells]
    best = np.full((len(fps), reach + 2), np.inf)
    best[:, 0] = 0
    taken = []
    for part in scheme:
        share = np.zeros((len(fps), reach + 1))
        share[:, 0] = 1
        for c in part:
            own = near[c][values[c]]
            share = np.stack([(share[:, : d + 1] * own[:, d::-1]).sum(axis=1) for d in range(reach + 1)], axis=1)
        width = CELL_BITS * len(part)
        probes = np.cumsum([comb(width, d) for d in range(reach + 1)])
        work = np.concatenate([np.zeros((len(fps), 1)), MEETING * total * np.cumsum(share, axis=1) + probes], axis=1)
        after, choice = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int64)
        for spent in range(reach + 2):
            for units in range(spent + 1):
                cost = best[:, spent - units] + work[:, units]
                less = cost < after[:, spent]
                after[less, spent], choice[less, spent] = cost[less], units
        taken.append(choice)
        best = after
    units, spent = np.zeros((len(fps), len(scheme)), dtype=np.int64), np.full(len(fps), reach + 1)
    for k in reversed(range(len(scheme))):
        units[:, k] = taken[k][np.arange(len(fps)), spent]
        spent -= units[:, k]
    return units, best[:, -1]


@lru_cache(maxsize=64)
def _flips(bits: tuple[int, ...], most: int) -> np.ndarray:
    """Masks that flip up to so many of the bits."""
    return np.array([sum(1 << b for b in some) for d in range(most + 1) for some in combinations(bits, d)], dtype=np.uint64)


def probes(fps: np.ndarray, cells: list[list[int]], scheme: list[tuple[int, ...]], units: np.ndarray) -> tuple[np.ndarray, ...]:
    """part, value, fp and filed of all entries: each fingerprint where it is filed, and where it asks."""
    out = []
    for k, part in enumerate(scheme):
        bits = tuple(b for c in part for b in cells[c])
        mask = np.uint64(sum(1 << b for b in bits))
        out.append((np.full(len(fps), k), fps & mask, fps, np.ones(len(fps), dtype=bool)))
        for u in range(2, int(units[:, k].max(initial=0)) + 1):  # what is filed asks at its own value too
            some = fps[units[:, k] == u]
            flips = _flips(bits, u - 1)[1:]
            asked = ((some & mask)[:, None] ^ flips[None, :]).ravel()
            out.append((np.full(len(asked), k), asked, np.repeat(some, len(flips)), np.zeros(len(asked), dtype=bool)))
    return tuple(map(np.concatenate, zip(*out)))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def star_forest(fps: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """Places of links that join what the links between distinct fingerprints join."""
    left, leaders, stars, links = np.arange(len(fps)), [], [], []
    while len(left):
        near = apart(fps[left], fps[left[0]]) <= reach
        leaders.append(left[0])
        stars.append(left[near])
        links += [(int(left[0]), int(x)) for x in left[near][1:]]
        left = left[~near]
    heads = fps[np.array(leaders)]
    parent = list(range(len(stars)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(stars)):
        gaps = apart(heads[i + 1 :], heads[i])
        for j in (np.flatnonzero(gaps <= 3 * reach) + i + 1)[np.argsort(gaps[gaps <= 3 * reach], kind="stable")].tolist():
            if root(i) == root(j):
                continue
            # a link's ends lie within twice the reach of the other leader
            a = stars[i][apart(fps[stars[i]], heads[j]) <= 2 * reach]
            b = stars[j][apart(fps[stars[j]], heads[i]) <= 2 * reach]
            for x in a.tolist():
                hit = np.flatnonzero(apart(fps[b], fps[x]) <= reach)
                if len(hit):
                    links.append((x, int(b[hit[0]])))
                    parent[root(i)] = root(j)
                    break
    return links


def _links_of(key: np.ndarray, fps: np.ndarray, filed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all groups of equal ``key`` that hold something filed, by groups small and large."""
    order = np.lexsort((~filed, fps, key))
    key, fps, filed = key[order], fps[order], filed[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (fps[1:] != fps[:-1])])  # a fingerprint that is filed may ask there too
    key, fps, filed = key[fresh], fps[fresh], filed[fresh]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    live = (size > 1) & (np.add.reduceat(filed.astype(np.int64), start) > 0)
    small = np.repeat(live & (size <= FEW), size)
    key_s, fps_s = key[small], fps[small]
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for k in range(1, FEW):
        same = (key_s[k:] == key_s[:-k]) & (apart(fps_s[k:], fps_s[:-k]) <= REACH)
        a.append(fps_s[:-k][same])
        b.append(fps_s[k:][same])
    for g in np.flatnonzero(live & (size > FEW)):
        own = fps[start[g] : start[g] + size[g]]
        if links := star_forest(own):
            x, y = np.array(links).T
            a.append(own[x])
            b.append(own[y])
    return np.concatenate(a), np.concatenate(b)


def links(classes: DataFrame) -> DataFrame:
    """a and b: links of distinct fingerprints that join what all links join; ``classes`` has fp, settled."""
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = classes.count()
    cells = cells_of(_bit_counts(classes), total)
    near = np.stack([distances(h) for h in _histograms(classes, cells)])
    shared = spark.sparkContext.broadcast(near)  # 4 x 65,536 x 4 numbers, 8 MB whatever the table

    def works(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = [0.0] * len(schemes())
        for part in parts:
            fps = part.column(0).to_numpy().view(np.uint64)
            for k, scheme in enumerate(schemes()):
                work[k] += float(allocate(fps, cells, shared.value, total, scheme)[1].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(work)), pa.int64()), pa.array(work, pa.float64())], ["scheme", "work"])

    costs = classes.select("fp").mapInArrow(works, "scheme long, work double").groupBy("scheme").agg(F.sum("work").alias("work")).collect()
    scheme = schemes()[min(costs, key=lambda r: (r["work"], r["scheme"]))["scheme"]]

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = part.column(0).to_numpy().view(np.uint64)
            entries = probes(fps, cells, scheme, allocate(fps, cells, shared.value, total, scheme)[0])
            k, value, fp, filed = entries
            # one key for part and value: the bits of other partitions are free to tell partitions apart
            with np.errstate(over="ignore"):
                key = (value * np.uint64(0x9E3779B97F4A7C15)) ^ (k.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(filed)], ["key", "fp", "filed"])

    asked = classes.select("fp").mapInArrow(ask, "key long, fp long, filed boolean")
    heavy = asked.groupBy("key").agg(F.count("*").alias("n"), F.count_if("filed").alias("filed")).where((F.col("n") > BLOCK) & (F.col("filed") > 0))
    heavy = settle(heavy.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "heavy-buckets", few=True)
    if not heavy.isEmpty():
        whole = asked.join(heavy, "key", "left_anti")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        paired = asked.join(heavy, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        asked = whole.unionByName(paired.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "filed"))

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, filed in _whole_groups(parts):
            a, b = _links_of(keys, fps.view(np.uint64), filed)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return asked.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def _whole_groups(parts: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of about so many rows, or of one group, that end where a key ends."""
    held, count, enough = [], 0, rows
    for part in parts:
        columns = tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "filed"))
        held.append(columns)
        count += len(part)
        if count >= enough:
            together = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(together[0], together[0][-1]))
            if cut:
                yield tuple(c[:cut] for c in together)
            held, count = [tuple(c[cut:] for c in together)], len(together[0]) - cut
            enough = max(rows, 2 * count)
    if count:
        yield tuple(np.concatenate(c) for c in zip(*held))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row."""
    found = settle(fingerprints(df, id_col, text_col), "fingerprints")
    classes = settle(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    with scratch():
        groups = settle(components(settle(links(classes), "links")), "groups", few=True, keep=True)
    named = classes.join(groups, F.col("fp") == F.col("node"))
    names = settle(named.groupBy("component").agg(F.min("least").alias("least")), "group-names", few=True)
    linked = named.select("fp", "component").join(names, "component").select("fp", "least")
    every = classes.select("fp", F.col("least").alias("own")).join(linked, "fp", "left")
    # the name of a class is the least id it reaches; a class without links has its own
    named = settle(every.select("fp", F.when(F.col("least").isNull(), F.col("own")).otherwise(F.col("least")).alias("component_id")), "named-classes")
    out = found.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
