"""A bounded sample of labelled documents, the only rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents a model is fitted on; all documents are scored.
MOST_LABELLED = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, grade, most: int = MOST_LABELLED) -> DataFrame:
    """text and grade of at most ``most`` labelled documents, the ones of least digest.

    The ids of the sample are the side that is broadcast: at most ``most`` rows,
    two numbers each.  Of an id with several labels the least counts; of several
    rows with one id the text of least digest is taken, so rows are no more than
    ids.  Rows without id, text or grade are left out.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("_id"), grade.cast("int").alias("grade")).where("_id is not null and grade is not null").groupBy("_id").agg(F.min("grade").alias("grade"))
    sample = wanted.orderBy(F.xxhash64("_id"), "_id").limit(most)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    # a text goes as a list, which Spark combines by hashing where a string would have it sort
    return found.groupBy("_id").agg(F.min_by(F.array("text"), F.xxhash64("text")).alias("text"), F.first("grade").alias("grade")).select(F.get("text", F.lit(0)).alias("text"), "grade")
