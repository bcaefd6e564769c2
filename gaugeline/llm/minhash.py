"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Signatures: shingle hashes pass through one permutation (a bijection of 64-bit
values, cut to ``SLOTS`` places) and index a second one, a fixed table.
Coordinate k is the least table value when the table is shifted by k places, so
two permutations give all coordinates, and the K coordinates of one shingle are
K neighbouring table entries: one contiguous read.

How it runs
1. The rows are written with a key of their own, which stands for them from
   here on: ids may be null or shared.  Where texts lie: shingle sets, their
   digest, and band keys.  Rows with equal sets form a class; one of each goes
   on.
2. Band keys that several classes share tie each member to the least of them.
   Components of these ties are clusters: a link (Jaccard at or over the
   threshold) lies inside a cluster, but for the chance in ``miss_chance``.
3. A cluster of more than a block is tied anew by narrower bands, which part
   texts that only share a template (their midpoint is at 0.58).  Its members
   meet in groups of bounded size, a task each, and a member makes one row, not
   one a band; of a key that several groups of a cluster have, each sends one
   member on.  Of each member the ties of most bands are verified exactly; what
   the verified ties join needs no more comparing.  So of a large group of near
   copies one part is settled, and only the rest is compared, with each other
   and with it.  Where that rest outgrows a block too and best ties are of few
   bands, texts of a template, members meet by narrow buckets instead of by
   cluster.
4. The sets of what is left of a cluster go to tasks that compare: an estimate
   from long signatures first, then exact intersections.  What outgrows a block
   is cut, and each pair of blocks is a task of its own.  A task emits no pairs
   but a spanning forest of its true links: fewer rows than it has members.
5. Components of verified ties and forests are the answer.  No link between
   compared classes is lost, since leaving one out needs a path of others.

Nothing is capped: large buckets and clusters only make more blocks.

Defined results: null, empty and blank texts have no shingles, link with
nothing and are kept; with fewer words than a shingle the whole sequence is
one; repeated rows are one class; an empty table gives no rows; other columns
are ignored.  Of each group exactly one row stands for it: that of the least
doc_id (a null one last, then any one row), and the group is named by that id,
null where no row of it has one.  ``near_duplicates`` says of every row whether
it has that id (``kept``: all rows that repeat it, none without an id) and
whether it is that one row (``stands``); ``kept_documents`` keeps that row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import scratch, settle, with_rows
from gaugeline.llm.components import components
from gaugeline.llm.shingles import mixed, shingle_sets
from gaugeline.llm.tokens import batches

SLOTS = 1 << 20
BANDS, ROWS = 32, 4
#: Bands that are tied first, before what they tie counts as one in the others.
EARLY = 8
#: Bands within clusters of more than a block; a link at 0.75 is missed with 1.6e-6.
NARROW_BANDS, NARROW_ROWS = 230, 10
#: Coordinates of the estimate that precedes an exact comparison, and how far
#: under the threshold it may be: five standard deviations (3e-7 a pair at it).
LONG = 512
MARGIN = 0.096
#: Ties of each member that are verified, those of most bands, and members that meet one copy of their leader's set.
LEADERS, LED = 3, 256
#: Members of a large cluster whose narrow keys meet in one task.
MEET = 4096
#: Marks that tell which narrow keys only one row has, and the pieces that they are merged by.
MARKS, PIECES = 1 << 25, 16
#: Shingles and members of a block.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1_000_000, 128
#: Mean narrow bands of best ties up to which a cluster is one of a template: sets at a similarity of 0.65 share three.
FEW_BANDS = 3


def miss_chance(similarity: float = 0.75, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that no band of two sets agrees: 5e-6 at the threshold."""
    return (1 - similarity**rows) ** bands


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """Row i holds the table values that slot i meets under as many shifts as there are coordinates."""
    most = max(LONG, BANDS * ROWS, NARROW_BANDS * NARROW_ROWS)
    table = np.random.default_rng(20240229).permutation(SLOTS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:most]]), most)


def signature(shingles: np.ndarray, coordinates: int = LONG) -> np.ndarray:
    slots = (mixed(shingles) & np.uint64(SLOTS - 1)).astype(np.int64)
    rows = _shifts()[:, :coordinates]
    return np.minimum.reduce([rows[slots[a : a + 2048]].min(axis=0) for a in range(0, len(slots), 2048)])


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for r in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
    return key.view(np.int64)


SKETCH = "_row long, doc_id long, n_shingles long, digest binary, bands array<long>"


def sketches(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, doc_ids, texts = part.columns
            for a, b in batches(texts):
                sets = shingle_sets(texts.slice(a, b - a))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = [band_keys(s, BANDS, ROWS) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), doc_ids.slice(a, b - a), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["_row", "doc_id", "n_shingles", "digest", "bands"])

    return rows.select("_row", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SKETCH)


def _sets(df: DataFrame, narrow: bool = False) -> DataFrame:
    """node and the shingles of its text as bytes; if ``narrow`` the keys of its narrow bands too."""
    fields = ["node", "grams", "bands"][: 3 if narrow else 2]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            node, texts = part.columns
            for a, b in batches(texts, 1_000_000):
                sets = shingle_sets(texts.slice(a, b - a))
                columns = [node.slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())]
                if narrow:
                    columns.append(pa.array([band_keys(s, NARROW_BANDS, NARROW_ROWS) for s in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, fields)

    return df.select("node", "text").mapInArrow(run, "node long, grams binary" + (", bands array<long>" if narrow else ""))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at or over the threshold."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def forest(nodes: np.ndarray, sets: list[np.ndarray], block: np.ndarray, joined: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different blocks (of one block: all).

    Sets with an equal ``joined`` are known to be of one component.
    """
    n = np.array([len(s) for s in sets])
    short = np.stack([signature(s, LONG) for s in sets]).astype(np.uint16)
    first = {}
    parent = [first.setdefault(v, k) for k, v in enumerate(joined.tolist())]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    alone = len(set(block.tolist())) == 1
    found, links = [], []
    for i in range(len(sets) - 1):
        # sizes first: a link needs the smaller set to be that share of the larger
        later = np.arange(i + 1, len(sets))
        fit = (100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i])) & (joined[later] != joined[i])
        if not alone:
            fit &= block[later] != block[i]
        later = later[fit]
        if len(later):
            likeness = (short[later] == short[i]).mean(axis=1)
            near = likeness >= percent / 100 - MARGIN
            found.append((np.full(near.sum(), i), later[near], likeness[near]))
    if not found:
        return []
    a, b, likeness = map(np.concatenate, zip(*found))
    for k in np.argsort(-likeness, kind="stable"):
        x, y = int(a[k]), int(b[k])
        p, q = root(x), root(y)
        if p != q and linked(sets[x], sets[y], percent):
            parent[p] = q
            links.append((int(nodes[x]), int(nodes[y])))
    return links


def _ties(keyed: DataFrame) -> DataFrame:
    """node, least and bands: the least node of each bucket, and in how many bands it is that."""
    # written, so that both sides of the join are shuffles and a hot key can be split
    shared = settle(keyed.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least"), "shared-bands")
    return keyed.join(shared, "band").where("node <> least").groupBy("node", "least").agg(F.count("*").alias("bands"))


def _joined(banded: DataFrame) -> DataFrame:
    """Edges (node, least) that join what shares a key in ``bands``; a key belongs to one band.

    Ties of the first bands come first; what they tie to one node is that node
    to the other bands, so a large group of near copies is not tied once a band.
    """
    early = settle(_ties(banded.select("node", F.explode(F.slice("bands", 1, EARLY)).alias("band"))).select("node", "least"), "early-ties", few=True)
    first = components(early).withColumnRenamed("component", "stands")
    later = banded.join(first, "node", "left").select(F.coalesce("stands", "node").alias("node"), F.explode(F.slice("bands", EARLY + 1, BANDS)).alias("band"))
    return early.unionByName(_ties(later).select("node", "least"))


def _shared_keys(banded: DataFrame) -> DataFrame:
    """node and band of the keys in ``bands`` that tie: those of one row alone are left out before anything is shuffled.

    A bounded table of marks says which keys may be met twice.  Keys that share
    a mark by chance stay, so with very many keys more rows come out, never less.
    """
    spark = banded.sparkSession
    marks, size = (lambda bands: bands.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(MARKS - 1)), MARKS // PIECES // 8

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(MARKS, bool), np.zeros(MARKS, bool)
        for part in parts:
            at, n = np.unique(marks(part.column(0)), return_counts=True)
            twice[at[(n > 1) | once[at]]] = True
            once[at] = True
        once, twice = (np.packbits(x).reshape(PIECES, size) for x in (once, twice))
        for k in range(PIECES):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once[k].tobytes()], pa.binary()), pa.array([twice[k].tobytes()], pa.binary())], ["piece", "once", "twice"])

    def merge(group: pa.Table) -> pa.Table:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for a, b in zip(group.column("once"), group.column("twice")):
            a, b = (np.frombuffer(x.as_py(), np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
        return pa.table({"piece": group.column("piece").slice(0, 1), "twice": pa.array([twice.tobytes()], pa.binary())})

    marked = banded.select("bands").mapInArrow(mark, "piece int, once binary, twice binary").groupBy("piece").applyInArrow(merge, "piece int, twice binary")
    held = {r["piece"]: r["twice"] for r in marked.collect()}  # of bounded size
    shared = spark.sparkContext.broadcast(b"".join(held.get(k, bytes(size)) for k in range(PIECES)))

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for part in parts:
            node, bands = part.columns
            tie = twice[marks(bands)]
            of = np.repeat(node.to_numpy(), bands.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(of[tie]), pa.array(bands.flatten().to_numpy(zero_copy_only=False)[tie])], ["node", "band"])

    return banded.select("node", "bands").mapInArrow(keys, "node long, band long")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that edges (a, b) join it with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _met(large: DataFrame, sets: DataFrame) -> DataFrame:
    """A row for each member of a large cluster (wide), from ties by narrow keys within its group of about MEET members.

    tied: the least member that ties join it with; shared: the bands of its best
    tie; leaders: the least members of its buckets, those of most bands; heads,
    where the cluster has several groups: the keys whose least member it is.
    """
    groups = settle(large.groupBy("wide").agg(F.ceil(F.count("*") / MEET).alias("groups")), "groups-to-meet", few=True)
    dealt = large.join(groups, "wide").select("node", "wide", "groups", F.pmod(F.xxhash64("node"), F.col("groups")).alias("group"))

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("node").combine_chunks()
        node, bands = group.column("node").to_numpy(), group.column("bands").combine_chunks()
        n, keys = len(node), bands.flatten().to_numpy(zero_copy_only=False)
        # members are in order, so the first of a bucket is its least
        order = np.argsort(keys, kind="stable")
        owner, sorted_ = np.repeat(np.arange(n), bands.value_lengths().to_numpy(zero_copy_only=False))[order], keys[order]
        starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)])
        least = np.repeat(owner[starts], np.diff(np.append(starts, len(sorted_))))
        pairs, count = np.unique((owner * n + least)[owner != least], return_counts=True)
        a, b = np.divmod(pairs, n)
        best = np.lexsort((b, -count, a))
        a, b, count = a[best], b[best], count[best]
        first = np.searchsorted(a, np.arange(n + 1))
        most = np.zeros(n, np.int64)
        np.maximum.at(most, a, count)
        asked = np.arange(len(a)) - first[a] < LEADERS
        per_node = lambda owners, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))
        if group.column("groups")[0].as_py() > 1:
            by_head = np.argsort(owner[starts], kind="stable")
            heads = per_node(owner[starts][by_head], sorted_[starts][by_head])
        else:
            heads = pa.nulls(n, pa.list_(pa.int64()))
        return pa.table([pa.array(node), pa.array(node[_labels(n, a, b)]), pa.array(most, mask=most == 0), per_node(a[asked], node[b[asked]]), heads], ["node", "tied", "shared", "leaders", "heads"])

    rows = sets.select("node", "bands").join(dealt, "node")
    return settle(rows.groupBy("wide", "group").applyInArrow(meet, "node long, tied long, shared long, leaders array<long>, heads array<long>"), "met-members")


def _weighed(members: DataFrame, *by: str) -> DataFrame:
    """How many blocks the members of each group fill."""
    return members.groupBy(*by).agg(F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).alias("blocks"))


def _verified(ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the ties (node, leader) those that are links."""
    leaders = settle(ties.groupBy("leader").agg(F.ceil(F.count("*") / LED).alias("parts")), "leaders", few=True)
    asked = ties.join(leaders, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    held = sets.select(F.col("node").alias("leader"), F.col("grams").alias("theirs")).join(leaders, "leader").select("leader", "theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pairs = asked.join(held, ["leader", "part"]).join(sets.select("node", "grams"), "node")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            same = [linked(*(np.frombuffer(x.as_py(), dtype=np.uint64) for x in pair), percent) for pair in zip(part.column(2), part.column(3))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return pairs.select("node", "leader", "grams", "theirs").mapInArrow(run, "a long, b long")


MEMBER = ("cluster", "own", "others", "joined", "node")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of groups that still have several parts, with the blocks of the largest part (main) and of the rest.

    ``members`` has cluster, joined (the part), node and n_shingles.
    """
    sizes = members.groupBy("cluster", "joined").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("joined", F.struct("n", -F.col("joined"))).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    known = settle(members.join(settle(main, "largest-parts", few=True), "cluster").withColumn("settled", F.col("joined") == F.col("most")), "mixed-members")
    blocks = _weighed(known, "cluster", "settled").groupBy("cluster").agg(F.max(F.when(~F.col("settled"), F.col("blocks"))).alias("rest"), F.max(F.when(F.col("settled"), F.col("blocks"))).alias("main"))
    # the settled part meets the rest alone
    others = F.when(F.col("settled"), F.col("rest")).otherwise(F.col("rest") + F.col("main"))
    return known.join(settle(blocks, "mixed-blocks", few=True), "cluster").withColumn("others", others)


def _parted(heavy: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links of members of heavy clusters (wide, node, n_shingles), and what is still to be compared (MEMBER)."""
    met = _met(heavy, sets)
    best, asked, tied = met.select("node", "shared"), met.select("node", F.explode("leaders").alias("leader")), met.select("node", F.col("tied").alias("least"))
    heads = met.where("heads is not null").select("node", F.col("heads").alias("bands"))
    if not heads.isEmpty():
        # groups of one cluster are tied by one member a key
        ties = settle(_ties(settle(_shared_keys(heads), "keys-of-groups")), "ties-of-groups")
        order = W.partitionBy("node").orderBy(F.desc("bands"), "least")
        best = best.unionByName(ties.select("node", F.col("bands").alias("shared"))).groupBy("node").agg(F.max("shared").alias("shared"))
        asked = asked.unionByName(ties.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS).select("node", F.col("least").alias("leader")))
        tied = tied.unionByName(ties.select("node", "least"))
    sure = settle(_verified(settle(asked, "asked-ties", few=True), sets, percent), "verified-ties", few=True)
    parts = heavy.select("node", "n_shingles").join(components(sure).withColumnRenamed("component", "joined"), "node", "left").withColumn("joined", F.coalesce("joined", "node"))
    parts = settle(parts.join(best, "node", "left"), "parts")
    clusters = _mixed(components(tied).withColumnRenamed("component", "cluster").join(parts, "node"))
    cut = clusters.groupBy("cluster").agg(F.max("rest").alias("most"), F.avg("shared").alias("shared")).where((F.col("most") > 1) & (F.col("shared") <= FEW_BANDS))
    cut = settle(cut.select("cluster"), "template-clusters", few=True)
    groups = clusters.join(cut, "cluster", "left_anti")
    if not cut.isEmpty():
        of_template = clusters.join(cut, "cluster", "left_semi").select("node")
        # a bucket of one member has one part
        keyed = settle(_shared_keys(sets.select("node", "bands").join(of_template, "node", "left_semi")), "narrow-keys")
        banded = keyed.select("node", F.col("band").alias("cluster"))
        groups = groups.unionByName(_mixed(banded.join(parts, "node")))
    own = F.when(F.col("settled"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("main"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest")))
    return sure, groups.select("cluster", own.alias("own"), "others", "joined", "node")


def _groups(rows: DataFrame, classes: DataFrame, banded: DataFrame, percent: int, text_col: str) -> DataFrame:
    """node and component of the classes that have links; ``banded`` has their bands."""
    clusters = settle(components(_joined(settle(banded, "bands"))).join(classes.select("node", "n_shingles"), "node"), "clusters")
    heavy = settle(_weighed(clusters, "component").where("blocks > 1").select("component"), "heavy-clusters", few=True)
    texts = rows.select(F.col("_row").alias("node"), F.col(text_col).alias("text"))
    light = clusters.join(heavy, "component", "left_anti")
    light = light.select(F.col("component").alias("cluster"), F.lit(0).cast("long").alias("own"), F.lit(1).cast("long").alias("others"), F.col("node").alias("joined"), "node")
    members = _sets(texts.join(light.select("node").hint("shuffle_hash"), "node")).join(light, "node").select(*MEMBER, "grams")
    sure = None
    if not heavy.isEmpty():
        large = settle(clusters.join(heavy, "component", "left_semi").select(F.col("component").alias("wide"), "node", "n_shingles"), "heavy-nodes")
        sets = settle(_sets(texts.join(large.select("node"), "node"), narrow=True), "heavy-sets")
        sure, parted = _parted(large, sets, percent)
        members = members.unionByName(parted.join(sets.select("node", "grams"), "node").select(*MEMBER, "grams"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    paired = paired.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "joined", "node", "grams")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        sets = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
        links = forest(group["node"].to_numpy(), sets, group["own"].to_numpy(), group["joined"].to_numpy(), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    links = paired.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")
    return components(links if sure is None else links.unionByName(sure))


def decided(rows: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id, n_shingles, component_id, kept and stands for every row of a table ``with_rows``."""
    sketch = settle(sketches(rows, id_col, text_col), "sketches")
    # one row of each set stands for the class; its first row may come to name the group
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    classes = settle(sketch.where("digest is not null").groupBy("digest").agg(F.min("_row").alias("node"), F.max("n_shingles").alias("n_shingles"), F.min(order).alias("first")), "classes")
    banded = sketch.where("digest is not null").select(F.col("_row").alias("node"), "bands").join(classes.select("node"), "node", "left_semi")
    with scratch():
        found = settle(_groups(rows, classes, banded, percent, text_col), "groups", few=True, keep=True)
    # of each group the first row; classes without links name themselves
    linked = classes.join(found, "node").select("digest", "component", "first")
    firsts = settle(linked.groupBy("component").agg(F.min("first").alias("named")), "firsts", few=True)
    named = linked.select("digest", "component").join(firsts, "component").select("digest", "named")
    of_class = classes.select("digest", "first").join(named, "digest", "left").select("digest", F.coalesce("named", "first").alias("first"))
    out = sketch.select("_row", "doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stands = F.col("digest").isNull() | (F.col("first._row") == F.col("_row"))
    return out.select("_row", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), stands.alias("stands"))


def near_duplicates(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and stands for every row."""
    return decided(with_rows(df.select(id_col, text_col)), percent, id_col, text_col).drop("_row")


def kept_documents(df: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``df`` that stay: one row of each group, and all that link with nothing."""
    rows = with_rows(df)
    gone = decided(rows, percent).where("not stands").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*df.columns)
