"""Vision and judging from recordings and settings, with toy models."""

import json
import struct
import sys

import numpy as np
import pytest

from gaugeline import __main__ as command
from gaugeline.plans import launch
from gaugeline.sources import bags


def toy():
    """A class that workers get by value, as they cannot import this module."""

    class Toy:
        """Embeds an image by its pixels; answers by the mean of what it sees."""

        @staticmethod
        def load():
            return 1.0

        @staticmethod
        def extract(model, batch):
            for image in batch["image"]:
                x = np.frombuffer(image, np.uint8).astype(float)
                cls = np.array([x[0] + 1, x[3] + 1, 40.0])
                yield [[float(v)] * 2 for v in x[:6:3]], [0.5, 1.0], (cls / np.linalg.norm(cls)).tolist(), 1

        @staticmethod
        def answer(model, batch):
            for inputs, prompt in zip(batch["inputs"], batch["prompt"]):
                assert "A correct execution" in prompt and [i["label"] for i in inputs]
                bad = any(np.frombuffer(i["image"], np.uint8).max() > 200 for i in inputs)
                yield f"Decision: {'failure' if bad else 'success'}\nConfidence: high\nSeen {len(inputs)}."

    return Toy


Toy = toy()


def write_run(path, seed, odd=()):
    """Twelve seconds of images of two pixels at four frames a second, and three markers."""
    rng = np.random.default_rng(seed)
    rec = lambda op, body: bytes([op]) + struct.pack("<Q", len(body)) + body
    s = lambda x: struct.pack("<I", len(x)) + x.encode()
    out = b"\x89MCAP0\r\n"
    for i, (topic, kind) in enumerate((("/cam", "sensor_msgs/msg/Image"), ("/recording_stage", "std_msgs/msg/String")), 1):
        out += rec(3, struct.pack("<H", i) + s(kind) + s("ros2msg") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", i, i) + s(topic) + s("cdr") + struct.pack("<I", 0))
    for k in range(48):
        ns = k * 250_000_000
        left, right = 20 + 2 * k + int(rng.integers(0, 3)), 120 - 2 * k + int(rng.integers(0, 3))
        pixels = bytes([255 if k in odd else left] * 3 + [right] * 3)
        image = struct.pack("<iII2s2xII", 0, 0, 2, b"c\0", 1, 2) + struct.pack("<I", 5) + b"rgb8\0" + b"\0"
        image += b"\0" * (-len(image) % 4) + struct.pack("<II", 6, 6) + pixels
        out += rec(5, struct.pack("<HIQQ", 1, k, ns, ns) + b"\0\1\0\0" + image)
        if k in (1, 15, 31):
            mark = str({1: 1, 15: 2, 31: 3}[k]).encode() + b"\0"
            out += rec(5, struct.pack("<HIQQ", 2, 100 + k, ns, ns) + b"\0\1\0\0" + struct.pack("<I", 2) + mark)
    path.write_bytes(out + rec(0x0F, struct.pack("<I", 0)) + b"\x89MCAP0\r\n")


@pytest.fixture(scope="module")
def runs(tmp_path_factory, spark):
    bags.register(spark)
    folder = tmp_path_factory.mktemp("runs")
    for k in range(3):
        write_run(folder / f"n{k}.mcap", k)
    write_run(folder / "odd.mcap", 9, odd=(20, 21, 22, 23))
    return folder, {"nominal_bags": [str(folder / f"n{k}.mcap") for k in range(3)], "test_bag": str(folder / "odd.mcap"), "camera_topics": ["/cam"]}


def test_vision_from_settings(spark, runs, tmp_path):
    folder, given = runs
    given = {**given, "memory_path": str(tmp_path / "memory"), "stage_constrained_matching": True}
    found = launch.run_vision(spark, given, Toy, str(tmp_path / "out"))["/cam"].orderBy("frame_id").collect()
    assert len(found) == 24 and all(r["alarm"] for r in found[10:12])
    assert {r["frame_id"] for r in sorted(found, key=lambda r: -r["epsilon"])[:2]} == {10, 11}
    assert all(r["execution_stage"] == r["matched_stage"] and r["matched_run"] in ("n0", "n1", "n2") for r in found)
    assert found[0]["latest_recorded_marker"] is None and found[-1]["latest_recorded_marker"] == "3"
    table = spark.read.option("header", True).csv(str(tmp_path / "out/cam/results"))
    assert table.count() == 24 and spark.read.option("header", True).csv(str(tmp_path / "out/cam/threshold")).count() == 30
    assert json.loads((tmp_path / "out/settings.json").read_text())["sample_fps"] == 2.0

    class Untouched(Toy):
        @staticmethod
        def extract(model, batch):
            assert set(batch["run_id"]) == {"odd"}, "the memory was embedded again"
            return Toy.extract(model, batch)

    again = launch.run_vision(spark, {**given, "threshold_mode": "fixed"}, Untouched, str(tmp_path / "fixed"))["/cam"].collect()
    assert {r["threshold_mode"] for r in again} == {"fixed"} and {10, 11} <= {r["frame_id"] for r in again if r["alarm"]}
    with pytest.raises(ValueError):
        launch.run_vision(spark, {**given, "camera_topics": ["/cam", "cam"]}, Toy, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no such"):
        launch.run_vision(spark, {**given, "test_bag": "/nowhere.mcap"}, Toy, str(tmp_path / "x"))


def test_judging_from_settings(spark, runs, tmp_path):
    folder, given = runs
    heat = spark.createDataFrame([("odd", "/cam", k, bytearray([90] * 6)) for k in range(3)], "run_id string, topic string, position long, image binary")
    judged = launch.run_judging(spark, {**given, "input_modes": ["raw", "heatmap", "paired"], "ground_truth_label": "fail", "start_sec": 5.0, "end_sec": 6.0}, "parts are set down", Toy, str(tmp_path / "out"), heat)
    assert {r["input_mode"]: (r["decision"], r["confidence"], r["response"].split()[-1]) for r in judged.collect()} == {"raw": ("failure", "high", "4."), "heatmap": ("success", "high", "3."), "paired": ("failure", "high", "6.")}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/frames")).count() == 4 and spark.read.json(str(tmp_path / "out/responses")).count() == 3
    for bad in ({"input_modes": ["sound"]}, {"input_modes": ["paired"]}):
        with pytest.raises(ValueError):
            launch.run_judging(spark, {**given, **bad}, "d", Toy, str(tmp_path / "x"))


def test_command_line(spark, runs, tmp_path, monkeypatch):
    folder, given = runs
    (tmp_path / "s.json").write_text(json.dumps(given))
    (tmp_path / "d.txt").write_text("parts are set down")
    monkeypatch.setattr(launch, "named_model", lambda place: Toy)
    monkeypatch.setattr(sys, "argv", ["gaugeline", "judge", str(tmp_path / "s.json"), "--model", "m:toy", "--description", str(tmp_path / "d.txt"), "--out", str(tmp_path / "j")])
    command.main()
    assert spark.read.option("header", True).csv(str(tmp_path / "j/results")).first()["decision"] == "success"


def test_models_are_named_by_module():
    assert launch.named_model("json:loads") is json.loads
    with pytest.raises(ValueError):
        launch.named_model("json")
