"""Votes on a stream against the same rows as a batch."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import thresholds
from gaugeline.streaming import votes

T0 = datetime(2024, 1, 1)


def drained(spark, df, folder, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()
    return spark.table(name)


@pytest.mark.parametrize(("smooth", "window", "least"), [(11, 8, 6), (4, 3, 2), (1, 1, 1)])
def test_stream_of_votes_is_the_batch(spark, tmp_path, smooth, window, least):
    rng = np.random.default_rng(smooth)
    rows = [(f"r{k % 3}", k // 3, T0 + timedelta(seconds=k), float(rng.gamma(3, 0.4))) for k in range(120)]
    # pieces in the order of time; a repeated and a late row; at last a run so late that the others are over
    pieces = [rows[:25], rows[25:30], [*rows[30:90], rows[10]], [*rows[90:], rows[3]], [("end", 0, T0 + timedelta(hours=1), 0.5)]]
    schema = "run_id string, index long, ts timestamp, epsilon_adaptive double"
    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    found = drained(spark, votes.vote_stream(stream, smooth, window, least), tmp_path / "state", f"votes_{smooth}")
    got = found.where("run_id <> 'end'").orderBy("run_id", "index").toPandas()
    batch = spark.createDataFrame(rows, schema).withColumnRenamed("epsilon_adaptive", "mahalanobis").withColumn("phase", F.lit(0.5))
    curve = spark.createDataFrame([(0.5, 1.0)], "phase_center double, threshold_mahalanobis double")
    want = thresholds.apply_phase_threshold(batch, curve, smooth, window, least).orderBy("run_id", "index").toPandas()
    assert len(got) == len(rows) and np.allclose(got["epsilon_smooth"], want["epsilon_smooth"])
    assert (got["alarm_raw"] == want["alarm_raw"]).all() and (got["alarm_filtered"] == want["alarm_filtered"]).all()


def test_votes_check_their_arguments(spark):
    rows = spark.createDataFrame([], "run_id string, index long, ts timestamp, epsilon_adaptive double")
    for bad in ({"smooth": 0}, {"votes": 9}, {"window": 0}):
        with pytest.raises(ValueError):
            votes.vote_stream(rows, **bad)
