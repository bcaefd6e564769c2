"""Whole plans on small made-up runs, and the streams."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import models
from gaugeline.plans import displays, settings, tasks, time_series, vision
from gaugeline.streaming import monitor


def wrench_runs(spark, runs, bad=()):
    rng = np.random.default_rng(9)
    rows = []
    for r in runs:
        t = np.arange(260) / 20
        push = np.where((t > 4) & (t < 10), 6 * np.sin((t - 4) / 6 * np.pi), 0)
        for k, (a, p) in enumerate(zip(t, push)):
            extra = 8.0 if r in bad and 7 < a < 8.5 else 0.0
            rows.append((r, k, float(a), *(float(p * f + rng.normal(0, 0.05) + extra) for f in (1, 0.5, 0.2, 0.1, 0.05, 0.02))))
    return spark.createDataFrame(rows, "run_id string, seq long, time double, force_x double, force_y double, force_z double, torque_x double, torque_y double, torque_z double")


def test_time_series(spark):
    nominal = wrench_runs(spark, ["n1", "n2", "n3", "n4"])
    out = time_series.run(nominal, wrench_runs(spark, ["good", "bad"], bad=["bad"]), length=120, rounds=12)
    alarms = {r["run_id"]: r["n"] for r in out.alarms.groupBy("run_id").agg(F.count_if("alarm_filtered").alias("n")).collect()}
    assert alarms["bad"] > 5 and alarms["good"] == 0
    assert out.threshold.count() == 50 and out.calibration.count() == 4 * 120
    assert {"index", "time", "phase", "mahalanobis", "component", "component_threshold", "epsilon", "anomaly"} <= set(out.scores.columns)
    assert displays.curves(out.alarms, "phase", "epsilon_smooth", "epsilon_adaptive").count() == 2 * 240


def embedded(spark, groups, odd=()):
    rng = np.random.default_rng(1)
    rows = []
    for g in groups:
        for k in range(12):
            base = np.array([np.cos(k / 8), np.sin(k / 8), 0.3, 0.1])
            cls = base + rng.normal(0, 0.01, 4)
            patch = np.tile(base, (3, 1)) + rng.normal(0, 0.02, (3, 4)) + (1.0 if g in odd and k in (5, 6) else 0)
            rows.append((g, k, k / 2, patch.tolist(), [0.2, 0.9, 0.4], (cls / np.linalg.norm(cls)).tolist()))
    return spark.createDataFrame(rows, "group int, frame_id int, timestamp_sec double, features array<array<double>>, attention array<double>, cls array<double>")


@pytest.mark.parametrize("by_stage", [False, True])
def test_vision(spark, by_stage):
    from gaugeline.operators import vectors

    events = spark.createDataFrame([(g, s, float(2 * s - 1.5), str(s)) for g in (1, 2, 3, 9) for s in (1, 2, 3)], "run_id int, seq long, time double, marker string")
    memory = vision.nominal_memory(embedded(spark, [1, 2, 3]), events if by_stage else None)
    curve, scores = vectors.calibrate(memory, by_stage)
    assert scores.count() == 36 and scores.where("held_out_video_id = matched_video_id").count() == 0
    test = embedded(spark, [9], odd=[9]).withColumnRenamed("group", "run_id").withColumn("stage", F.lit(2))
    found = vision.score_run(test if by_stage else test.drop("stage"), memory, curve, by_stage=by_stage)
    assert {5, 6} <= {r["frame_id"] for r in found.where("alarm").collect()}
    assert not by_stage or found.where("matched_stage <> 2").count() == 0
    whole = vision.with_recorded_stages(found, events).orderBy("frame_id").collect()
    assert [r["latest_recorded_marker"] for r in whole][:3] == [None, "1", "1"] and whole[0]["stage_source"] == "recorded"
    assert displays.panel(found).where("size(lines) = 5").count() == 12
    if by_stage:
        with pytest.raises(ValueError, match="7"):
            vision.score_run(test.withColumn("stage", F.lit(7)), memory, curve, by_stage=True)


def test_tasks_and_models(spark):
    inputs = spark.createDataFrame([("a",), ("b",)], "run_id string")

    class Model:
        calls = 0

    def answer(model, batch):
        long = "The gripper takes the red part and sets it into the holder until it clicks in place."
        for run in batch["run_id"]:
            model.calls += 1
            yield "Answer:" if run == "b" and model.calls < 3 else long

    done = tasks.descriptions(inputs, "toy", Model, answer).persist()
    assert done.count() == 2
    assert "Run a:" in tasks.merged(done).first()["prompt"]
    many = spark.createDataFrame([(f"t{k % 2}", k, f"text {k}", k != 4) for k in range(11)], "task string, run_id int, response string, ok boolean")
    parts = {(r["task"], r["part"]): [int(x) for x in re.findall(r"Run (\d+):", r["prompt"])] for r in tasks.merged(many, by="task", most=3).collect()}
    assert parts == {("t0", 0): [0, 2, 6], ("t0", 1): [8, 10], ("t1", 0): [1, 3, 5], ("t1", 1): [7, 9]}
    with pytest.raises(ValueError):
        tasks.merged(many, most=1)
    answered = spark.createDataFrame([("t1", "fail", "Decision: FAILURE\nConfidence: high"), ("t2", "normal", "no idea")], "test_bag string, ground_truth_label string, response string")
    got = [(r["decision"], r["confidence"]) for r in tasks.judgements(answered, "raw").orderBy("test_bag").collect()]
    assert got == [("failure", "high"), ("not_parsed", "not_parsed")]
    with pytest.raises(ValueError):
        tasks.judging_prompt("x", "sound")
    assert models.description_settings({"max_new_tokens": 300, "temperature": 1}) == {"max_new_tokens": 400, "temperature": 1, "do_sample": False, "repetition_penalty": 1.0, "no_repeat_ngram_size": 0}
    assert models.model_settings({"max_memory": {"0": "9GiB", "cpu": "48GiB"}})["max_memory"] == {0: "9GiB", "cpu": "48GiB"}
    frames = spark.createDataFrame([("a", bytearray(b"\x01\x02"))], "run_id string, image binary")
    row = models.embed(frames, "sum", lambda: 1, lambda m, batch: [([[float(sum(x))]], [1.0], [1.0], m) for x in batch["image"]]).first()
    assert row["features"] == [[3.0]] and "image" not in row.asDict()


def test_settings(spark, tmp_path):
    held = {"test_bag": "b", "nominal_bags": ["a"], "camera_topics": ["/c"]}
    settings.save(held, str(tmp_path / "deep" / "s.json"))
    assert settings.load(str(tmp_path / "deep" / "s.json"))["test_bag"] == "b" and (tmp_path / "deep" / "s.json").read_text().index("camera") < 10
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"nominal_bags": ["a"], "test_bag": "b", "camera_topics": ["/c"], "stage_count": 4}))
    assert settings.load(str(path))["stage_count"] == 4 and settings.load(str(path), stage_count=2)["stage_count"] == 2
    with pytest.raises(ValueError):
        settings.load()
    assert sorted(r["run_name"] for r in settings.run_grid(spark, ["x", "y"], 2).collect()) == ["x_01", "x_02", "y_01", "y_02"]
    assert settings.missing_paths([str(path), "/none"]) == ["/none"]


def test_sample_stream(spark, tmp_path):
    spark.range(200).select(F.lit("r").alias("run_id"), F.timestamp_millis(F.col("id") * 33).alias("ts"), F.col("id").alias("seq")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, ts timestamp, seq long").parquet(str(tmp_path / "in"))
    q = monitor.sample_stream(stream).writeStream.format("memory").queryName("sampled").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r["seq"] for r in spark.table("sampled").collect())
    assert got == [min(i for i in range(200) if i * 33 // 500 == b) for b in range(199 * 33 // 500 + 1)]


def test_command_line_scores_a_recording(spark, tmp_path, capsys, monkeypatch):
    """Recordings written as logs, scored from the command line."""
    import struct
    import sys

    from gaugeline import __main__ as command

    rec = lambda op, body: bytes([op]) + struct.pack("<Q", len(body)) + body
    s = lambda x: struct.pack("<I", len(x)) + x.encode()
    rows = wrench_runs(spark, ["n1", "n2", "n3", "bad"], bad=["bad"]).orderBy("run_id", "seq").collect()
    for run in ("n1", "n2", "n3", "bad"):
        out = b"\x89MCAP0\r\n" + rec(3, struct.pack("<H", 1) + s("geometry_msgs/msg/Wrench") + s("ros2msg") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", 1, 1) + s("/tcp_force") + s("cdr") + struct.pack("<I", 0))
        for r in rows:
            if r["run_id"] == run:
                ns = int(r["time"] * 1e9)
                out += rec(5, struct.pack("<HIQQ", 1, r["seq"], ns, ns) + b"\0\1\0\0" + struct.pack("<6d", *r[3:9]))
        (tmp_path / f"{run}.mcap").write_bytes(out + rec(0x0F, struct.pack("<I", 0)) + b"\x89MCAP0\r\n")
    nominal = [x for n in ("n1", "n2", "n3") for x in ("--nominal", str(tmp_path / f"{n}.mcap"))]
    monkeypatch.setattr(sys, "argv", ["gaugeline", "time-series", str(tmp_path / "bad.mcap"), *nominal, "--out", str(tmp_path / "out")])
    command.main()
    assert "alarm_ratio" in capsys.readouterr().out
    found = spark.read.option("header", True).csv(str(tmp_path / "out" / "summary")).first()
    assert found["run_id"] == "bad" and int(found["alarms"]) > 5
    monkeypatch.setattr(sys, "argv", ["gaugeline", "time-series", "nowhere.mcap", *nominal])
    with pytest.raises(SystemExit, match="nowhere"):
        command.main()
