"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.sources.shared import finished, fresh_path, release, remember, scratch, settle

__all__ = ["WORD", "documents", "finished", "fresh_path", "release", "scratch", "settle", "small_batches", "with_rows", "words_of"]

#: Words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def with_rows(df: DataFrame) -> DataFrame:
    """The table written with a key of each row, _row, in buckets by that key.

    Ids may be null or shared; the key is not.  Texts are shuffled once, here:
    later joins by _row bring their small side to the buckets.  In a scratch the
    table, in the catalog and in the shared folder, goes with it.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "rows")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    keyed = df.withColumn("_row", F.monotonically_increasing_id()).repartition(n, "_row")
    keyed.write.format("parquet").option("compression", "zstd").bucketBy(n, "_row").option("path", path).saveAsTable(name)
    return remember(spark.table(name), path, name=name)


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


#: Rows of an Arrow batch of texts.  Spark's own default of 10,000 rows lets a
#: batch of long documents outgrow what an executor has beside its heap.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to ARROW_ROWS rows, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df
