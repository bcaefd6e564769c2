"""Exact quantiles of very many values by radix selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.sources.shared import settle

#: Bits of a counting pass, and values under which what is left of a rank is put in order.
DIGIT_BITS, FEW = 16, 4096


def order_keys(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def key_values(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _mapped(df: DataFrame, column: str, kind: str, change) -> DataFrame:
    """The table with one column, which has no nulls, changed by a function on arrays."""
    at = df.columns.index(column)
    schema = ", ".join(f"`{c}` {kind if c == column else t}" for c, t in df.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.set_column(at, column, pa.array(change(part.column(at).to_numpy())))

    return df.mapInArrow(run, schema)


def _counted(keys: DataFrame, cell: list[str], shift: int) -> DataFrame:
    """Of each digit in each cell how many values it has (c) and how many are up to it (past)."""
    counts = keys.groupBy(*cell, F.shiftright("_key", shift).alias("digit")).agg(F.count("*").alias("c"))
    return counts.withColumn("past", F.sum("c").over(W.partitionBy(*cell).orderBy("digit")))


def exact_quantiles(rows: DataFrame, value: str, fractions: dict[str, float], by: str | None = None) -> DataFrame:
    """n and, under the given names, linearly interpolated quantiles: one row, or one for each group.

    Doubles become integers of the same order, written once.  A pass counts
    values by their first 16 bits, 65,536 counters a group at most, combined
    before the shuffle; the counters tell which digit holds a wanted rank.
    Further passes, three at most, count the next 16 bits of what has the digits
    found so far, until a rank's digits hold at most ``FEW`` values: these alone
    are put in order.  Nulls and NaN are no values, and a null group is none.
    """
    cells = rows.select((F.col(by) if by else F.lit(0)).alias("_by"), F.col(value).cast("double").alias("_key")).where("_by is not null and _key is not null and not isnan(_key)")
    keys = settle(_mapped(cells, "_key", "bigint", order_keys), "order-keys")
    shift = 64 - DIGIT_BITS
    first = _counted(keys, ["_by"], shift).withColumn("n", F.sum("c").over(W.partitionBy("_by")))
    # a wanted rank: which quantile it is for, whether it is the upper one, and how many values lie before its digits
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.floor(F.lit(f) * (F.col("n") - 1)) + up).alias("rank")) for k, f in enumerate(fractions.values()) for up in (0, 1)])
    holds = lambda rank: (F.col("past") - F.col("c") <= rank) & (rank < F.col("past"))
    picked = first.select("_by", "n", F.col("digit").alias("cell"), "c", "past", F.inline(F.filter(ranks, lambda r: holds(r["rank"]))))
    picked = settle(picked.withColumn("rank", F.col("rank") - (F.col("past") - F.col("c"))).drop("past"), "quantile-digits", few=True)
    while (most := picked.agg(F.max("c")).first()[0] or 0) > FEW and shift:
        shift -= DIGIT_BITS
        wanted = picked.select("_by", "cell").distinct()
        inside = keys.withColumn("cell", F.shiftright("_key", shift + DIGIT_BITS)).join(wanted, ["_by", "cell"])
        digits = _counted(inside, ["_by", "cell"], shift)
        narrowed = picked.drop("c").join(digits, ["_by", "cell"]).where(holds(F.col("rank")))
        picked = settle(narrowed.select("_by", "n", F.col("digit").alias("cell"), "c", "k", "up", (F.col("rank") - (F.col("past") - F.col("c"))).alias("rank")), "quantile-digits", few=True)
    if most and shift:
        inside = keys.withColumn("cell", F.shiftright("_key", shift)).join(picked.select("_by", "cell").distinct(), ["_by", "cell"])
        values = _counted(inside, ["_by", "cell"], 0)
        picked = picked.drop("c").join(values, ["_by", "cell"]).where(holds(F.col("rank"))).withColumn("cell", F.col("digit"))
    found = _mapped(picked.select("_by", "n", "k", "up", F.col("cell").alias("_key")), "_key", "double", key_values)
    at = lambda k, up: F.max(F.when((F.col("k") == k) & (F.col("up") == up), F.col("_key")))

    def quantile(k: int, f: float) -> Column:
        rank = f * (F.max("n") - 1)
        return at(k, 0) + (F.coalesce(at(k, 1), at(k, 0)) - at(k, 0)) * (rank - F.floor(rank))

    out = found.groupBy("_by").agg(F.max("n").alias("n"), *(quantile(k, f).alias(name) for k, (name, f) in enumerate(fractions.items())))
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")
