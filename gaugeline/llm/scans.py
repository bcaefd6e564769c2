"""Running counts and sums over rows in order, where one key may hold any share of them.

Rows are dealt out by ranges of (key, order), so a long key spreads over many
tasks.  Each task adds up its own sorted rows with numpy; what a key had in the
tasks before is a row a task, added afterwards.  Sums are plain, or polynomials
in a base taken modulo a prime: the sum of value * base^rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import settle

#: (base, modulus) of a polynomial sum, None for a plain one.
Kind = tuple[int, int] | None


def _powers(base: int, modulus: int, rank: np.ndarray) -> np.ndarray:
    """base^rank modulo a prime under 2^31, by squaring on whole arrays."""
    out, square, left = np.ones(len(rank), dtype=np.int64), base % modulus, rank.copy()
    while left.any():
        out = np.where(left & 1, out * square % modulus, out)
        square, left = square * square % modulus, left >> 1
    return out


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the key changes, and of each row the place where its key starts."""
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.flatnonzero(fresh), np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))


def running(df: DataFrame, key: str, ranges: Sequence[Column | str], order: Sequence[Column | str], kinds: Sequence[Kind], values: Callable[[pa.RecordBatch], list[np.ndarray]], keep: Sequence[str]) -> DataFrame:
    """``keep`` with rank (from 1), and sum_k and before_k (with and without the row itself) of each of ``kinds``.

    ``key`` is a long without nulls.  Tasks are cut by ``ranges``, columns that
    rise with ``order``; rows that agree in them stay together.  ``values`` gives
    one long array for each kind, under the modulus where there is one.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = ["rank", *(f"{what}_{k}" for k in range(len(kinds)) for what in ("sum", "before"))]
    types = dict(df.dtypes)
    schema = ", ".join([f"`{key}` long", *(f"`{c}` {types[c]}" for c in keep), *(f"{c} long" for c in added), "_part int"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, count, sums = TaskContext.get().partitionId(), None, 0, [0] * len(kinds)
        for part in parts:
            if not len(part):
                continue
            keys = part.column(key).to_numpy()
            begins, start = _starts(keys)
            if keys[0] != held:
                count, sums = 0, [0] * len(kinds)
            more = keys == keys[0]  # rows of the key that may have begun before
            rank = np.arange(len(keys)) - start + 1 + np.where(more, count, 0)
            columns = [rank]
            for k, (kind, value) in enumerate(zip(kinds, values(part))):
                value = np.asarray(value, dtype=np.int64)
                if kind:
                    value = value * _powers(*kind, rank - 1) % kind[1]
                total = np.cumsum(value)
                total += np.where(more, sums[k], 0) - (total - value)[start]
                before = total - value
                columns += [total % kind[1], before % kind[1]] if kind else [total, before]
                sums[k] = int(columns[-2][-1])
            held, count = keys[-1], int(rank[-1])
            kept = [part.column(c) for c in (key, *keep)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(len(keys), task, dtype=np.int32))], [key, *keep, *added, "_part"])

    sorted_ = df.repartitionByRange(n, F.col(key), *ranges).sortWithinPartitions(F.col(key), *order)
    local = settle(sorted_.mapInArrow(run, schema), "scan")
    # the first and last key of each task: as many rows as tasks
    last = F.max_by(F.struct(key, "rank", *(f"sum_{k}" for k in range(len(kinds)))), F.struct(key, "rank"))
    ends = sorted(local.groupBy("_part").agg(F.min(key).alias("first"), last.alias("last")).collect(), key=lambda r: r["_part"])
    carried, held = [], None
    for row in ends:
        if held and row["first"] == held[0]:
            carried.append((row["_part"], *held, *(pow(kind[0], held[1], kind[1]) if kind else 1 for kind in kinds)))
        at = list(row["last"])
        if held and at[0] == held[0]:
            for k, kind in enumerate(kinds):
                at[2 + k] = (held[2 + k] + at[2 + k] * pow(kind[0], held[1], kind[1])) % kind[1] if kind else held[2 + k] + at[2 + k]
            at[1] += held[1]
        held = at
    if not carried:
        return local.drop("_part")
    names = ["c_rank", *(f"c_{k}" for k in range(len(kinds))), *(f"m_{k}" for k in range(len(kinds)))]
    carry = spark.createDataFrame(carried, f"_part int, `{key}` long, " + ", ".join(f"{c} long" for c in names))
    joined = local.join(F.broadcast(carry), ["_part", key], "left")

    def whole(name: str, k: int) -> Column:
        total = F.coalesce(F.col(f"c_{k}"), F.lit(0)) + F.col(name) * F.coalesce(F.col(f"m_{k}"), F.lit(1))
        return (total % kinds[k][1] if kinds[k] else total).alias(name)

    return joined.select(key, *keep, (F.col("rank") + F.coalesce("c_rank", F.lit(0))).alias("rank"), *(whole(f"{what}_{k}", k) for k in range(len(kinds)) for what in ("sum", "before")))
