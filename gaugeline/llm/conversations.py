"""A trie of the turns that conversations share from their start.

How it runs
1. Turns are numbered (``numbered``), and each prefix of a conversation gets a
   polynomial rolling fingerprint: one running sum over the turns in order,
   numpy in each task (``scans``).  A conversation of any length spreads over
   tasks.
2. Prefixes group by depth and fingerprint.  Equal turns (whole role and text)
   after one parent are added up before and in the shuffle; each distinct one
   is then held against the group's representative, that of the least
   conversation.  What differs in its turn or its parent is a collision: the
   conversations behind it get fingerprints of their own from that depth on,
   and grouping is repeated until no group holds two.  As parents are compared
   too, a group that is left is one sequence of turns.
3. The least conversation of a node owns it, so the nodes that a conversation
   owns are the end of its path: a chain.  Sums over a subtree are the rest of
   the owner's chain (a running sum from its end) and the whole chains of the
   other members (a sum over their rows), so no job depends on the depth.
4. Ids of the conversations that end in a node are joined in runs of
   ``ID_RUN``, which one task a node hashes as they stream by.

Defined results: null role or text is empty; rows without a conversation id
belong to none and are left out; turns are ordered with null first, equal ones
by role and text; repeated rows are turns of their own; a conversation may have
no turn at all; an empty table gives no rows, not even a root; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import settle
from gaugeline.llm.scans import running

#: Base and modulus of the two halves of a fingerprint.
ROLLING = ((1_103_515_245, 2**31 - 1), (69_069_069, 2**31 - 19))
#: Ids that are joined to one text before they are hashed.
ID_RUN = 1024
#: Signs of a text by which ranges are cut; longer texts that agree so far stay together.
RANGE_SIGNS = 64

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text and rank (from 1) of every turn of a table of conv_id, turn, role and text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text")).where("conv_id IS NOT NULL")
    by = [F.col("turn").asc_nulls_first(), F.col("role")]
    return running(rows, "conv_id", [*by, F.substring("text", 1, RANGE_SIGNS)], [*by, F.col("text")], [], lambda part: [], ["role", "text"])


def _turn_codes(part: pa.RecordBatch, rolling) -> list[np.ndarray]:
    """A value from 1 under each modulus for role and text of each row."""
    roles, texts = (part.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text"))
    codes = np.fromiter((xxhash.xxh3_64_intdigest(len(r).to_bytes(8, "little") + r + t) for r, t in zip(roles, texts)), dtype=np.uint64, count=len(roles))
    return [(codes % np.uint64(p - 1) + np.uint64(1)).astype(np.int64) for _, p in rolling]


def prefixes(turns: DataFrame, order: list[str], rolling=ROLLING) -> DataFrame:
    """conv_id, role, text, depth, fp and parent (the fingerprints with and without the turn) of each turn.

    ``turns`` has conv_id, role and text (no nulls) and the columns of ``order``.
    """
    rows = running(turns, "conv_id", order, order, rolling, lambda part: _turn_codes(part, rolling), ["role", "text"])
    joined = lambda what: (F.col(f"{what}_0") * (1 << 31) + F.col(f"{what}_1")).alias
    return rows.select("conv_id", "role", "text", F.col("rank").alias("depth"), joined("sum")("fp"), joined("before")("parent"))


def _told_apart(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """The rows with fingerprints of their own for what differs from its group's representative."""
    keys, turn = ["depth", "fp"], ["depth", "fp", "parent", "role", "text"]
    seen = settle(rows.join(clash, keys, "left_semi"), "clashes")
    variants = seen.groupBy(*turn).agg(F.min("conv_id").alias("owner"))
    first = variants.groupBy(*keys).agg(F.min("owner").alias("representative"))
    others = variants.join(first, keys).where("owner <> representative").drop("representative")
    members = seen.join(others, turn).select("conv_id", F.struct(F.col("depth").alias("since"), "owner").alias("tag"))
    # the least depth: what lies deeper may only be its consequence, and is looked at again
    tags = members.groupBy("conv_id").agg(F.min("tag").alias("tag"))
    marked = lambda c, depth: F.when(depth >= F.col("tag.since"), F.xxhash64(c, F.col("tag.since"), F.col("tag.owner"))).otherwise(F.col(c)).alias(c)
    return rows.join(settle(tags, "tags", few=True), "conv_id", "left").select("conv_id", "role", "text", "depth", marked("fp", F.col("depth")), marked("parent", F.col("depth") - 1))


def _verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows and their nodes (depth, fp, parent, bytes, owner, n_convs), one a sequence of turns."""
    rows = settle(rows, "prefixes")
    while True:
        found = rows.groupBy("depth", "fp", "parent", "role", "text").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"))
        nodes = settle(found.select("depth", "fp", "parent", F.octet_length("text").cast("long").alias("bytes"), "owner", "n_convs"), "nodes")
        clash = settle(nodes.groupBy("depth", "fp").count().where("count > 1").select("depth", "fp"), "clash", few=True)
        if clash.isEmpty():
            return rows, nodes
        rows = settle(_told_apart(rows, clash), "prefixes")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """depth, fp and the digest of the ids of the conversations that end there."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            depth, fp, conv = (part.column(c).to_numpy() for c in ("depth", "fp", "conv_id"))
            cut = np.flatnonzero((depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])) + 1
            edges = np.concatenate([[0], cut, [len(conv)]])
            at = [k for a, b in zip(edges[:-1], edges[1:]) for k in range(a, b, ID_RUN)]
            joined = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(at, [*at[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays([pa.array(depth[at]), pa.array(fp[at]), pa.array(conv[at]), pa.array(joined, pa.string())], ["depth", "fp", "conv_id", "ids"])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for part in parts:
            done = []
            for depth, fp, ids in zip(*(part.column(c).to_pylist() for c in ("depth", "fp", "ids"))):
                if (depth, fp) == held:
                    digest.update(b"," + ids.encode())
                    continue
                if held:
                    done.append((*held, digest.hexdigest()))
                held, digest = (depth, fp), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], ["depth", "fp", "ends_sha256"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([digest.hexdigest()])], ["depth", "fp", "ends_sha256"])

    joined = ends.repartitionByRange(n, "depth", "fp", "conv_id").sortWithinPartitions("depth", "fp", "conv_id").mapInArrow(runs, "depth long, fp long, conv_id long, ids string")
    return joined.repartition(n, "depth", "fp").sortWithinPartitions("depth", "fp", "conv_id").mapInArrow(hashed, "depth long, fp long, ends_sha256 string")


def prefix_trie(turns: DataFrame, order: list[str], conversations: DataFrame, rolling=ROLLING) -> DataFrame:
    """A row (NODE) for each distinct sequence of first turns; the root has depth 0.

    ``turns`` as for ``prefixes``; ``conversations`` has the conv_id of all
    conversations, with turns or without.
    """
    spark = turns.sparkSession
    named = settle(conversations.select("conv_id").distinct(), "conversations", few=True)
    least, total = named.agg(F.min("conv_id"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], NODE)
    rows, nodes = _verified(prefixes(turns, order, rolling))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    chains = settle(nodes.groupBy("owner").agg(F.min("depth").alias("top"), F.min_by("parent", "depth").alias("parent"), F.sum(saved).alias("saved")), "chains")
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("fp", "depth").alias("fp"))
    ends = settle(named.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("fp", F.lit(0).cast("long")).alias("fp")), "ends")
    # a child continues the owner's chain or starts one of its own
    attached = chains.where("top > 1").groupBy((F.col("top") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count("*").alias("tops"))
    ended = ends.select(F.col("conv_id").alias("owner"), "depth", F.lit(1).cast("long").alias("ended"))
    known = nodes.join(ended, ["owner", "depth"], "left").join(attached, ["depth", "fp"], "left")
    children = F.coalesce("tops", F.lit(0).cast("long")) + 1 - F.coalesce("ended", F.lit(0).cast("long"))
    known = settle(known.select("depth", "fp", "owner", "n_convs", saved.alias("saved"), children.alias("n_children"), (-F.col("depth")).alias("above")), "known-nodes")
    leaves = known.where("n_children = 0").select("owner", F.lit(1).cast("long").alias("leaf"))
    whole = settle(chains.join(leaves, "owner", "left").select(F.col("owner").alias("conv_id"), "top", F.col("saved").alias("all_saved"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")).where("all_saved > 0 OR leaf > 0"), "whole-chains")
    others = rows.select("conv_id", "depth", "fp").join(whole, "conv_id").where("depth < top").groupBy("depth", "fp").agg(F.sum("all_saved").alias("others_saved"), F.sum("leaf").alias("others_leaves"))
    below = running(known, "owner", ["above"], ["above"], [None, None], lambda part: [part.column("saved").to_numpy(), (part.column("n_children").to_numpy() == 0)], ["depth", "fp", "n_convs", "n_children"])
    tops = chains.where("top > 1").select("owner", F.col("top").alias("depth"), (F.col("top") - 1).alias("up"), F.col("parent").alias("fp"))
    over = tops.join(nodes.select(F.col("depth").alias("up"), "fp", F.col("owner").alias("over")), ["up", "fp"]).select("owner", "depth", "over")
    digests = settle(_end_hashes(ends), "end-hashes")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias
    parent: Column = F.coalesce("over", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("owner")))
    deep = below.join(others, ["depth", "fp"], "left").join(digests, ["depth", "fp"], "left").join(over, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        plus("sum_1", "others_leaves")("n_leaves"), plus("sum_0", "others_saved")("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    zero = F.lit(0).cast("long")
    of_root = known.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    root = of_root.join(F.broadcast(digests.where("depth = 0").agg(F.max("ends_sha256").alias("ends_sha256")))).select(
        F.lit(least).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return deep.unionByName(root)


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of their group's first one, and the ids of all.

    Of a table of conv_id, turn, role and text: conversation c takes the first h
    turns of c - c mod ``group``, then its own after its first h, where h is the
    crc32 of the id in decimal modulo ``most``.  Gives conv_id, own (0 borrowed,
    1 own), rank, role and text, in the order of own and rank.
    """
    known = numbered(turns)
    ids = settle(known.select("conv_id").distinct(), "conversation-ids", few=True)
    borrows = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    own = known.where(F.col("rank") > borrows(F.col("conv_id"))).select("conv_id", F.lit(1).cast("long").alias("own"), "rank", "role", "text")
    first = known.where((F.pmod("conv_id", F.lit(group)) == 0) & (F.col("rank") < most))
    lent = first.withColumn("conv_id", F.explode(F.sequence("conv_id", F.col("conv_id") + group - 1))).where(F.col("rank") <= borrows(F.col("conv_id")))
    lent = lent.join(ids, "conv_id", "left_semi").select("conv_id", F.lit(0).cast("long").alias("own"), "rank", "role", "text")
    return settle(own.unionByName(lent), "rebuilt"), ids
