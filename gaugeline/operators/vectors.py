"""Nearest frames of a memory, their re-ranking, and calibration by leaving runs out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.functions.scalars import attention_weights, frame_progress, patch_scores, ratio, stage_of_progress, weighted_mean
from gaugeline.operators.catalog import need
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.operators.thresholds import lookup, visual_threshold
from gaugeline.sources.shared import settle

#: Rows of a block of queries and of a block of memory.
BLOCK = 2048
#: Cells that each stage's memory is cut into, by its nearest pivot, and rows a pivot is chosen from.
PIVOTS, SAMPLED = 48, 32
#: Bytes of memory vectors up to which all of them go to every task.
BROADCAST_BYTES = 32 << 20
#: Bounds are sums of rounded numbers; a cell is left out only if it is farther by more than this.
SLACK = 1e-6


def _sides(queries: DataFrame, memory: DataFrame, by_stage: bool, apart: bool) -> tuple[DataFrame, DataFrame]:
    stage = (F.col("stage") if by_stage else F.lit(0)).cast("int").alias("stage")
    group = lambda other: (F.col("group") if apart else F.lit(other)).cast("long").alias("group")
    q, m = queries.select("query_id", F.col("cls").alias("v"), stage, group(-1)), memory.select("item_id", F.col("cls").alias("v"), stage, group(-2))
    return q.where("v is not null and stage is not null"), m.where("v is not null and stage is not null")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _best(far: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least of each row that are finite; columns are in the order of their items."""
    # all that are no farther than the k-th; of equal ones the first k by item
    last = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if far.shape[1] > k else np.inf
    rows, cols = np.nonzero((far <= last) & np.isfinite(far))
    order = np.lexsort((items[cols], far[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], cols[kept]


NEAR = "query_id long, item_id long, distance double"


def _against_all(q: DataFrame, m: DataFrame, k: int) -> DataFrame:
    """Every query against a memory that is small enough to go to every task."""
    held = m.toArrow().combine_chunks()
    table = {c: held[c].to_numpy() for c in ("item_id", "stage", "group")} | {"v": _matrix(held["v"].combine_chunks())}
    shared = q.sparkSession.sparkContext.broadcast(table)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = shared.value
        for part in parts:
            ids, stages, groups = (part.column(c).to_numpy() for c in ("query_id", "stage", "group"))
            v = _matrix(part.column("v"))
            for stage in np.unique(stages):
                mine = np.flatnonzero(all_["stage"] == stage)
                asked = np.flatnonzero(stages == stage)
                for a in range(0, len(asked) if len(mine) else 0, 256):
                    some = asked[a : a + 256]
                    far = 1.0 - v[some] @ all_["v"][mine].T
                    far[groups[some][:, None] == all_["group"][mine]] = np.inf
                    rows, cols = _best(far, all_["item_id"][mine], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][rows]), pa.array(all_["item_id"][mine][cols]), pa.array(far[rows, cols])], ["query_id", "item_id", "distance"])

    return q.mapInArrow(run, NEAR)


def _spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the vectors, each the one farthest from those before it."""
    chosen, apart = [0], np.full(len(vectors), np.inf)
    while len(chosen) < n:
        apart = np.minimum(apart, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        if apart.max() <= 0:
            break
        chosen.append(int(apart.argmax()))
    return vectors[chosen]


def _held(blob: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind)


def _celled(df: DataFrame, pivots: dict[int, np.ndarray], base: dict[int, int], sample: dict | None = None, k: int = 0) -> DataFrame:
    """Rows of stages that have pivots, with cell (the nearest pivot, numbered over all stages), off (how far from it), length and bound.

    The k-th least distance to the sampled items of the stage bounds that to all items.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v, stages, groups = _matrix(part.column("v")), part.column("stage").to_numpy(), part.column("group").to_numpy()
            cell, off, bound = np.full(len(part), -1, dtype=np.int32), np.zeros(len(part)), np.full(len(part), np.inf)
            for stage in np.unique(stages):
                at, known = np.flatnonzero(stages == stage), pivots.get(int(stage))
                if known is None:
                    continue
                apart = np.sqrt(np.maximum((v[at] ** 2).sum(axis=1)[:, None] + (known**2).sum(axis=1) - 2 * v[at] @ known.T, 0))
                cell[at], off[at] = base[int(stage)] + apart.argmin(axis=1), apart.min(axis=1)
                if sample and len(sample[int(stage)][0]) >= k:
                    theirs, their_groups = sample[int(stage)]
                    for x in (at[i : i + 512] for i in range(0, len(at), 512)):
                        far = 1.0 - v[x] @ theirs.T
                        far[(groups[x][:, None] == their_groups) | ~np.isfinite(far)] = np.inf
                        bound[x] = np.partition(far, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(off), pa.array(np.sqrt((v**2).sum(axis=1))), pa.array(bound)], [*part.schema.names, "cell", "off", "length", "bound"])

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, cell int, off double, length double, bound double").where("cell >= 0")


def _blocks(rows: DataFrame, counts: dict[int, int], block: int, make, schema: str) -> DataFrame:
    """A row for each block of about ``block`` rows of one cell: ids, groups and vectors as bytes, and what ``make`` adds."""
    parts = {cell: -(-n // block) for cell, n in counts.items()}
    spark = rows.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(c, n) for c, n in parts.items()], "cell int, _parts int"))  # a row a cell
    id_col = rows.columns[0]
    spread = max(1, min(sum(parts.values()), max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(parts.values()) // 16)))
    dealt = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64(id_col), F.col("_parts"))).drop("_parts").repartition(spread, "cell", "part")

    def gather(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        held = [group.column(id_col).to_numpy().astype(np.int64).tobytes(), group.column("group").to_numpy().astype(np.int64).tobytes(), flat.tobytes()]
        cell, more = group.column("cell")[0].as_py(), make(group)
        names = ["cell", "n", "ids", "groups", "v", *more]
        return pa.table([pa.array([cell], pa.int32()), pa.array([len(group)], pa.int32()), *(pa.array([x], pa.binary()) for x in held), *more.values()], names)

    return dealt.groupBy("cell", "part").applyInArrow(gather, f"cell int, n int, ids binary, groups binary, v binary, {schema}")


def _merged(found: tuple[np.ndarray, np.ndarray], rows: np.ndarray, items: np.ndarray, far: np.ndarray, k: int) -> None:
    """Take candidates of some rows into the k best (distances, items) of a block."""
    distance, item = found
    some = np.unique(rows)
    at = np.concatenate([np.repeat(some, k), rows])
    d, i = np.concatenate([distance[some].ravel(), far]), np.concatenate([item[some].ravel(), items])
    order = np.lexsort((i, d, at))
    at, d, i = at[order], d[order], i[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    kept = rank < k
    distance[at[kept], rank[kept]], item[at[kept], rank[kept]] = d[kept], i[kept]


class _Screen:
    """Which pairs of two blocks may be within a distance, by products in single precision and a bound of their error."""

    def __init__(self, v: np.ndarray, w: np.ndarray):
        self.lengths = np.sqrt((v**2).sum(axis=1))
        with np.errstate(over="ignore"):
            longest = float(np.sqrt((w.astype(float) ** 2).sum(axis=1).max()))
            # numbers that single precision does not hold are multiplied as doubles
            kind = np.float32 if self.lengths.max() < 1e15 and longest < 1e15 else np.float64
            self.v, self.w = v.astype(kind), w.astype(kind).T
        # both roundings of the inputs and those of the sum, twice over
        self.error = (v.shape[1] + 4) * 2.0**-23 * self.lengths * longest

    def within(self, rows: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` and columns of the pairs that may be no farther than ``most``, none of those left out."""
        least = np.nextafter((1.0 - most - self.error[rows] - 2.0**-40).astype(self.v.dtype), -np.inf, dtype=self.v.dtype)
        product = self.v[rows] @ self.w
        some = np.flatnonzero(~(product.max(axis=1) < least))  # few rows, once k near ones are known
        at, cols = np.nonzero(~(product[some] < least[some, None]))
        return some[at], cols


def _pairs(asks: DataFrame, holds: DataFrame, pivots: list[np.ndarray], kind: np.dtype, kind_m: np.dtype, k: int) -> DataFrame:
    """The k nearest that the queries of each block find in the cells that it wants.

    Blocks are read where they lie: a task goes through pairs of a part of the
    queries' blocks and the memory's blocks one after the other, keeps the k best
    of its queries, and gives them once.  Vectors are not copied for the pairs.
    """
    spark = asks.sparkSession
    theirs = holds.select(F.col("cell").alias("mc"), F.col("ids").alias("items"), F.col("groups").alias("their_groups"), F.col("v").alias("theirs"), "radius")
    met = asks.join(theirs.hint("shuffle_replicate_nl"), F.array_contains("wants", F.col("mc")))
    left, right = asks.rdd.getNumPartitions(), theirs.rdd.getNumPartitions()
    # a part of the queries meets all memory in one task, or in a few where there are fewer parts than the session has slots
    met = met.coalesce(max(1, left) * max(1, min(right, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, left)))))
    met = met.select("cell", "ids", "groups", "v", "lengths", "bounds", "mc", "items", "their_groups", "theirs", "radius")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple] = {}
        for part in parts:
            for at in range(len(part)):
                own, blob, groups, v, lengths, bounds, cell, items, their_groups, theirs, radius = (c[at].as_py() for c in part.columns)
                ids, groups, length, bound = _held(blob, np.int64), _held(groups, np.int64), _held(lengths), _held(bounds)
                items, their_groups = _held(items, np.int64), _held(their_groups, np.int64)
                if (own, blob) not in best:
                    best[own, blob] = (ids, (np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)))
                found = best[own, blob][1]
                v = _held(v, kind).astype(float).reshape(len(ids), -1)
                # no item of the block is nearer than its pivot less the radius: queries that have k nearer ones are done
                least = 1.0 - v @ pivots[cell] - length * radius
                open_ = np.flatnonzero(~(least > np.minimum(bound, found[0][:, -1]) + SLACK))
                if not len(open_):
                    continue
                w = _held(theirs, kind_m).reshape(len(items), -1)
                screen = _Screen(v, w)
                for x in (open_[i : i + 512] for i in range(0, len(open_), 512)):
                    rows, cols = screen.within(x, np.minimum(bound[x] + SLACK, found[0][x, -1]))
                    other = groups[x[rows]] != their_groups[cols]
                    rows, cols = x[rows[other]], cols[other]
                    for a in range(0, len(rows), 1 << 16):
                        r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
                        # the same sum for the same vectors, wherever they lie: copies are equally far
                        far = 1.0 - np.einsum("ij,ij->i", v[r], w[c].astype(float))
                        near = np.isfinite(far)
                        if near.any():
                            _merged(found, r[near], items[c[near]], far[near], k)
        for ids, (distance, item) in best.values():
            rows, cols = np.nonzero(np.isfinite(distance))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(item[rows, cols]), pa.array(distance[rows, cols])], ["query_id", "item_id", "distance"])

    return met.mapInArrow(run, NEAR)


def _pruned(q: DataFrame, m: DataFrame, k: int, block: int, pivots_: int) -> tuple[DataFrame, DataFrame]:
    """Candidates of all queries, and the blocks of queries with the cells that they meet."""
    # pivots come from the rows of least hash of each stage, a bounded number of vectors
    order = W.partitionBy("stage").orderBy(F.xxhash64("item_id"), "item_id")
    sample = m.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLED * pivots_).select("stage", "_r", "v", "group").toPandas().sort_values("_r")
    sampled = {int(stage): (np.stack(rows["v"]).astype(float), rows["group"].to_numpy()) for stage, rows in sample.groupby("stage")}
    pivots = {stage: _spread(v, pivots_) for stage, (v, _) in sampled.items()}
    base = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())]).tolist()))
    all_pivots = [p for known in pivots.values() for p in known]
    kinds = [np.dtype("float32" if dict(side.dtypes)["v"] == "array<float>" else "float64") for side in (q, m)]
    q, m = (side.withColumn("v", F.col("v").cast(f"array<{'float' if kind == np.float32 else 'double'}>")) for side, kind in zip((q, m), kinds))
    q, m = settle(_celled(q, pivots, base, sampled, k), "query-cells"), settle(_celled(m, pivots, base), "memory-cells")
    of_q = {r["cell"]: r["n"] for r in q.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    of_m = {r["cell"]: (r["n"], r["radius"]) for r in m.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()}

    def wants(group: pa.Table) -> dict[str, pa.Array]:
        cell = group.column("cell")[0].as_py()
        reach, longest, farthest = (group.column(c).to_numpy().max() for c in ("off", "length", "bound"))
        stage = next(s for s, b in base.items() if b <= cell < b + len(pivots[s]))
        met = []
        for other in range(base[stage], base[stage] + len(pivots[stage])):
            if other in of_m:
                # dot(q, x) <= dot(p, r) + |q - p| |r| + |q| |x - r| for the pivots p and r of q and x
                p, r = all_pivots[cell], all_pivots[other]
                least = 1 - (p @ r + reach * np.linalg.norm(r) + longest * of_m[other][1])
                if not least > farthest + SLACK:
                    met.append(other)
        return {"lengths": pa.array([group.column("length").to_numpy().tobytes()], pa.binary()), "bounds": pa.array([group.column("bound").to_numpy().tobytes()], pa.binary()), "wants": pa.array([met], pa.list_(pa.int32()))}

    def radius(group: pa.Table) -> dict[str, pa.Array]:
        return {"radius": pa.array([group.column("off").to_numpy().max()], pa.float64())}

    asks = settle(_blocks(q, of_q, block, wants, "lengths binary, bounds binary, wants array<int>"), "query-blocks")
    holds = settle(_blocks(m, {c: n for c, (n, _) in of_m.items()}, block, radius, "radius double"), "memory-blocks")
    items = q.sparkSession.createDataFrame([(c, n) for c, (n, _) in of_m.items()], "cell int, items long")
    met = asks.select(F.col("n").alias("queries"), F.explode("wants").alias("cell")).join(F.broadcast(items), "cell")
    return _pairs(asks, holds, all_pivots, *kinds, k), met


def nearest(queries: DataFrame, memory: DataFrame, k: int = 5, by_stage: bool = False, apart: bool = False, block: int = BLOCK, pivots: int = PIVOTS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, item_id, distance and rank of the k nearest memory items of each query.

    Both have an id (query_id, item_id) and a vector ``cls`` of floats; the
    distance is 1 less their dot product, and with ``by_stage`` an equal
    ``stage``, with ``apart`` another ``group`` is asked for.  Equal distances
    go by item_id.  A memory of at most ``broadcast_bytes`` goes to every task,
    and queries are not shuffled.  A larger one is cut into blocks of cells
    around pivots: a block of queries meets the cells that can hold something
    nearer than the k-th of a bounded sample, by the cells' radii, and in a
    block that meets, queries that have found k nearer ones meanwhile are passed
    over.  The result is exact either way.  Rows without a vector have no
    neighbours; an empty memory gives no rows.
    """
    if k < 1:
        raise ValueError("k must be at least one")
    q, m = _sides(queries, memory, by_stage, apart)
    rows, width = m.agg(F.count("*"), F.max(F.size("v"))).first()
    if rows * (width or 0) * 8 <= broadcast_bytes:
        near = _against_all(q, m, k) if rows else q.limit(0).select("query_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("distance"))
        order = W.partitionBy("query_id").orderBy("distance", "item_id")
        return near.withColumn("rank", F.row_number().over(order))
    near, _ = _pruned(q, m, k, block, pivots)
    order = W.partitionBy("query_id").orderBy("distance", "item_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def compared_share(queries: DataFrame, memory: DataFrame, k: int = 5, by_stage: bool = False, apart: bool = False, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Of all pairs of a query and an item of its stage how many lie in cells that must meet: pairs, met, share."""
    q, m = _sides(queries, memory, by_stage, apart)
    all_ = q.groupBy("stage").agg(F.count("*").alias("a")).join(m.groupBy("stage").agg(F.count("*").alias("b")), "stage").agg(F.sum(F.col("a") * F.col("b")).alias("pairs"))
    met = _pruned(q, m, k, block, pivots)[1].agg(F.sum(F.col("queries") * F.col("items")).alias("met"))
    return all_.join(F.broadcast(met)).select("pairs", "met", (F.col("met") / F.col("pairs")).alias("share"))  # one row each


def frame_score(features: Column, attention: Column, nominal: Column, nominal_attention: Column, power: float = 1.5, least: float = 0.15) -> Column:
    """Patch differences of two frames, weighted by attention, as one number."""
    return weighted_mean(patch_scores(features, nominal), attention_weights(attention, nominal_attention, power, least))


def rerank(near: DataFrame, queries: DataFrame, memory: DataFrame, power: float = 1.5, least: float = 0.15) -> DataFrame:
    """Of the nearest items of each query the one of least frame score; of equal ones the nearest."""
    need(queries, "query_id", "features", "attention")
    need(memory, "item_id", "features", "attention")
    pairs = near.join(queries.select("query_id", F.col("features").alias("_f"), F.col("attention").alias("_a")), "query_id").join(memory.select("item_id", "features", "attention"), "item_id")
    scored = pairs.select("query_id", "item_id", "distance", "rank", frame_score(F.col("_f"), F.col("_a"), F.col("features"), F.col("attention"), power, least).alias("score"))
    best = scored.groupBy("query_id").agg(F.min_by(F.struct("item_id", "distance", "score"), F.struct("score", "rank")).alias("b"))
    return best.select("query_id", F.col("b.item_id").alias("item_id"), F.col("b.distance").alias("cls_distance"), F.col("b.score").alias("score"))


def compare(queries: DataFrame, memory: DataFrame, k: int = 5, by_stage: bool = False, apart: bool = False, power: float = 1.5, least: float = 0.15) -> DataFrame:
    """The best match of each query: query_id, item_id, cls_distance, score."""
    return rerank(nearest(queries, memory, k, by_stage, apart), queries, memory, power, least)


def missing_stages(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """Stages of queries that no memory item has: matching by stage would have no candidate."""
    return queries.select("stage").distinct().join(memory.select("stage").distinct(), "stage", "left_anti")


def with_progress(items: DataFrame) -> DataFrame:
    """progress and stage of frames (group, frame_id) by the last frame of their group."""
    last = F.max("frame_id").over(W.partitionBy("group"))
    return items.withColumn("progress", frame_progress(F.col("frame_id"), last)).withColumn("stage", stage_of_progress(F.col("progress")))


def _as_queries(memory: DataFrame) -> DataFrame:
    return memory.withColumnRenamed("item_id", "query_id")


def fixed_threshold(memory: DataFrame, quantile: float = 0.95, margin: float = 1.1, **options) -> DataFrame:
    """One threshold from scores of every frame against the other groups' frames."""
    scores = compare(_as_queries(memory), memory, apart=True, **options)
    found = exact_quantiles(settle(scores.select("score"), "scores"), "score", {"threshold": quantile})
    return found.agg((F.max("threshold") * margin).alias("threshold"), F.coalesce(F.max("n"), F.lit(0)).alias("scores"))


def calibrate(memory: DataFrame, by_stage: bool = False, k: int = 5, threshold: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Leave-one-group-out scores of a memory with progress, and the threshold curve from them."""
    need(memory, "item_id", "group", "frame_id", "progress", "stage", "timestamp_sec")
    found = compare(_as_queries(memory), memory, k, by_stage, apart=True)
    side = lambda p: [F.col(c).alias(f"{p}_{n}") for c, n in (("group", "video_id"), ("frame_id", "frame_id"), ("progress", "progress"), ("stage", "stage"), ("timestamp_sec", "timestamp_sec"))]
    rows = found.join(memory.select(F.col("item_id").alias("query_id"), *side("query")), "query_id").join(memory.select("item_id", *side("matched")), "item_id")
    rows = rows.select(F.col("query_video_id").alias("held_out_video_id"), "query_frame_id", "query_progress", "matched_video_id", "matched_frame_id", "matched_progress", "matched_timestamp_sec", "score", "cls_distance", "query_stage", "matched_stage")
    rows = settle(rows, "calibration")  # matched once for both
    return visual_threshold(rows, **(threshold or {})), rows


def judge(matches: DataFrame, curve: DataFrame | None = None, fixed: float | None = None) -> DataFrame:
    """Matches (score, matched_progress) with threshold, epsilon, alarm and threshold_mode."""
    if curve is not None:
        judged, mode = lookup(matches, "matched_progress", curve, "stage_center", "adaptive_threshold", "threshold"), "adaptive"
    else:
        judged, mode = matches.withColumn("threshold", F.lit(fixed).cast("double")), "fixed"
    judged = judged.withColumn("epsilon", F.when(F.col("threshold").isNotNull(), ratio(F.col("score"), F.col("threshold"))))
    return judged.withColumn("alarm", F.coalesce(F.col("epsilon") > 1, F.lit(False))).withColumn("threshold_mode", F.lit(mode))
