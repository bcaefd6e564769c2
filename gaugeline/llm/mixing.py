"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: a share of the mix by weight, at
most ``cap`` times its size, the excess reshared.  A document gets the whole
copies that its source's target makes certain; what is left is drawn without
replacement with unequal probabilities.  Each document has an inclusion
probability ``p`` that grows with its length class, scaled (and held at 1) so
that the expected words are what is left.  Its rank is

    q = (u / (1 - u)) / (p / (1 - p)),  u a fixed random number of the document,

and documents are taken in order of q until the words are reached.

How it runs: one pass for sizes; the rest are sums per (source, length class)
and per (source, rank bucket), combined before they are shuffled, so that a hot
source is never gathered.  The order inside a source is only needed in the one
bucket where its words run out.  What comes out is one small row a source with
the rank ``q`` to stop at; documents are judged by it where they lie.

Defined results: null text has size 0; the null source is a source of its own,
after all others; documents of size 0 get the certain copies only; rows with a
null id, or one that other rows have too, draw by id and number of the row, so
reruns agree as long as the table's files do; an empty table gives no rows;
other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import settle, with_rows, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def length_class(size: Column) -> Column:
    """Bits of the size: the inclusion weight of a document."""
    return F.length(F.bin(size)).cast("long")


def keyed(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A table with _row and its _key, a text that a row's random number is made from.

    It is the id if no other row has it, else the id and the number of the row.
    Null and shared ids are looked for once; where there are none, ids serve.
    """
    of = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    shared = settle(rows.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 OR _id IS NULL").select("_id", F.lit(True).alias("_shared")), "shared-ids", few=True)
    if shared.isEmpty():
        return rows.withColumn("_key", of)
    joined = rows.join(shared, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("_key", F.concat_ws("#", of, F.when(F.col("_shared"), F.col("_row").cast("string")))).drop("_id", "_shared")


def uniform(key: Column, seed: str) -> Column:
    """A fixed number in (0, 1) of each key, from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Targets of sources (columns source, source_size): a row a source, in one small task.

    Sources that meet their cap come first when ordered by cap over weight; the
    level at which the rest are filled follows from running sums.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    everything = W.partitionBy(F.lit(0))
    filled = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(0, W.unboundedFollowing)
    return (
        weighted.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("open", F.col("level") * F.col("weight") < cap * F.col("source_size"))
        .withColumn("filled", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"])
        .withColumn("target", F.least(F.coalesce(F.col("filled") * F.col("weight"), (cap * F.col("source_size")).cast("double")), (cap * F.col("source_size")).cast("double")))
        .select("source", "source_size", "target")
    )


def _rank(key: Column, p: Column, seed: str) -> Column:
    u = uniform(key, seed)
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def stops(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """A row a source: source, source_size, target, certain, rate, stop.

    ``sized`` has _key, doc_id, source, size.  A document's p is least(1, rate * class),
    and it is drawn if its rank is at most ``stop`` (null: none).
    """
    classes = sized.groupBy("source", length_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    targets = targets.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("left", F.col("target") - F.col("certain") * F.col("source_size"))
    long_first = W.partitionBy("source").orderBy(F.desc("class"))
    before, rest = long_first.rowsBetween(W.unboundedPreceding, -1), long_first.rowsBetween(0, W.unboundedFollowing)
    rates = (
        _by_source(classes, targets)
        .withColumn("held", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("mass", F.sum(F.col("class") * F.col("words")).over(rest))
        .withColumn("rate", F.when(F.col("mass") > 0, (F.col("left") - F.col("held")) / F.col("mass")).otherwise(0.0))
        .withColumn("fits", F.col("rate") * F.col("class") < 1)
        .groupBy("source", "source_size", "target", "certain", "left")
        .agg(F.coalesce(F.max(F.when(F.col("fits"), F.struct("class", "rate")))["rate"], F.lit(0.0)).alias("rate"))
    )
    rates = settle(rates, "mix-rates", few=True)
    ranked = _by_source(sized, rates).select("source", "_key", "size", "left", _rank(F.col("_key"), F.least(F.lit(1.0), F.col("rate") * length_class(F.col("size"))), seed).alias("q")).where("q is not null and size > 0")
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * buckets))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = ranked.groupBy("source", "left", "bucket").agg(F.sum("size").alias("words"), F.max("q").alias("last"))
    sums = sums.withColumn("upto", F.sum("words").over(upto))
    # the bucket where the words run out, and the last rank of the bucket before it
    crossing = sums.groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("at"),
        F.max(F.when(F.col("upto") <= F.col("left"), F.col("last"))).alias("whole"),
    )
    crossing = settle(crossing.select("source", "at.bucket", "at.before", "whole"), "mix-crossing", few=True)
    inside = _by_source(ranked, crossing.where("bucket is not null").withColumnRenamed("bucket", "at")).where("bucket = at")
    in_order = W.partitionBy("source").orderBy("q", "_key").rowsBetween(W.unboundedPreceding, -1)
    drawn = inside.withColumn("sofar", F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))).where(F.col("sofar") + F.col("size") / 2 <= F.col("left")).groupBy("source").agg(F.max("q").alias("inner"))
    ends = _by_source(_by_source(rates, crossing, "left"), drawn, "left")
    # written, so that its true size (a row a source) decides on broadcasting it
    return settle(ends.select("source", "source_size", "target", "certain", "rate", F.greatest("whole", "inner").alias("stop")), "mix-stops", few=True)


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null with null; the right side has a row a source."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def mix(df: DataFrame, sources: DataFrame, size: Column, key_col: str, source_col: str = "source", seed: str = "mix") -> DataFrame:
    """All rows and columns of ``df`` with ``_mix``: size, source_size, target, copies; ``key_col`` as in ``keyed``."""
    ends = sources.select(F.struct("source", "source_size", "target", "certain", "rate", "stop").alias("_end"))
    q = _rank(F.col(key_col), F.least(F.lit(1.0), F.col("_end.rate") * length_class(F.col("_size"))), seed)
    drawn = F.coalesce((q <= F.col("_end.stop")) & (F.col("_size") > 0), F.lit(False)).cast("int")
    joined = df.withColumn("_size", size).join(ends, F.col(source_col).eqNullSafe(F.col("_end.source")))
    return joined.withColumn("_mix", F.struct(F.col("_size").alias("size"), F.col("_end.source_size").alias("source_size"), F.col("_end.target").alias("target"), (F.col("_end.certain") + drawn).cast("int").alias("copies"))).drop("_size", "_end")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as it is taken."""
    rows = with_rows(df)
    sized = keyed(settle(rows.select("_row", "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes"))
    mixed = mix(rows.join(sized.select("_row", "_key"), "_row"), stops(sized, **options), word_count(F.col("text")), "_key", seed=options.get("seed", "mix"))
    copies = F.col("_mix.copies")
    return mixed.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(*df.columns)
