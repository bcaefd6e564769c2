"""Recordings written by hand, read back through the data source."""

import sqlite3
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugeline import __main__ as main
from gaugeline.operators import catalog, series
from gaugeline.sources import bags, dispatch, messages, results

T0 = 1_700_000_000_000_000_000
WRENCH, TEXT, JOINTS, IMAGE = "geometry_msgs/msg/WrenchStamped", "std_msgs/msg/String", "sensor_msgs/msg/JointState", "sensor_msgs/msg/Image"


class Put:
    def __init__(self):
        self.b = bytearray(b"\x00\x01\x00\x00")

    def put(self, kind, *v):
        size = struct.calcsize(kind)
        self.b += bytes(-(len(self.b) - 4) % size) + struct.pack(f"<{len(v)}{kind}", *v)
        return self

    def text(self, s):
        raw = s.encode() + b"\x00"
        self.put("I", len(raw))
        self.b += raw
        return self

    def raw(self, data):
        self.put("I", len(data))
        self.b += data
        return self

    def header(self):
        return self.put("i", 1).put("I", 2).text("base")


def text(s):
    return bytes(Put().text(s).b)


def wrench(*v):
    return bytes(Put().header().put("d", *v).b)


def joints(names, pos, vel):
    p = Put().header().put("I", len(names))
    for n in names:
        p.text(n)
    p.put("I", len(pos)).put("d", *pos).put("I", len(vel))
    if vel:
        p.put("d", *vel)
    return bytes(p.put("I", 0).b)


def image(encoding, h, w, step, data):
    return bytes(Put().header().put("I", h, w).text(encoding).put("B", 0).put("I", step).raw(data).b)


LOG = [
    ("/force", WRENCH, 5, wrench(1, 2, 3, 4, 5, 6)),
    ("/recording_stage", TEXT, 0, text("1")),
    ("/recording_stage", TEXT, 2_000_000_000, text("Fehler é")),
    ("/joints", JOINTS, 1_000_000_000, joints(["Arm Joint-1"], [0.5, 0.25], [1.0])),
    ("/cam", IMAGE, 500_000_000, image("bgr8", 1, 2, 8, bytes([1, 2, 3, 4, 5, 6, 0, 0]))),
]


def write_db3(folder):
    folder.mkdir(parents=True)
    (folder / "metadata.yaml").write_text("rosbag2_bagfile_information: {}\n")
    with sqlite3.connect(folder / "part_0.db3") as db:
        db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        ids = {t: i for i, t in enumerate(dict.fromkeys(t for t, *_ in LOG))}
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(i, t, next(k for n, k, *_ in LOG if n == t)) for t, i in ids.items()])
        db.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (?, ?, ?)", [(ids[t], T0 + dt, data) for t, _, dt, data in LOG])


def packed(kind, data):
    import pyarrow as pa

    return {"zstd": zstandard.ZstdCompressor().compress, "lz4": lambda x: pa.Codec("lz4").compress(x).to_pybytes(), "": bytes}[kind](data)


def write_mcap(path, codec):
    rec = lambda op, body: bytes([op]) + struct.pack("<Q", len(body)) + body
    s = lambda x: struct.pack("<I", len(x)) + x.encode()
    inner = b""
    for i, (t, kind, dt, data) in enumerate(LOG, 1):
        inner += rec(3, struct.pack("<H", i) + s(kind) + s("ros2msg") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", i, i) + s(t) + s("cdr") + struct.pack("<I", 0))
        inner += rec(5, struct.pack("<HIQQ", i, i, T0 + dt, T0 + dt) + data)
    body = packed(codec, inner)
    chunk = struct.pack("<QQQI", T0, T0 + 2_000_000_000, len(inner), zlib.crc32(inner)) + s(codec) + struct.pack("<Q", len(body)) + body
    path.write_bytes(b"\x89MCAP0\r\n" + rec(1, s("ros2") + s("test")) + rec(6, chunk) + rec(0x0F, struct.pack("<I", 0)) + b"\x89MCAP0\r\n")


def write_indexed(path, rows=None, statistics=False):
    """One chunk a message, a message index behind it, and an index of the chunks at the end; gives their places and sizes."""
    rows, places = LOG if rows is None else rows, []
    number = {t: k for k, t in enumerate(dict.fromkeys(t for t, *_ in rows), 1)}
    rec = lambda op, body: bytes([op]) + struct.pack("<Q", len(body)) + body
    s = lambda x: struct.pack("<I", len(x)) + x.encode()
    out, summary = b"\x89MCAP0\r\n" + rec(1, s("ros2") + s("test")), b""
    for k, (t, kind, dt, data) in enumerate(rows, 1):
        i = number[t]
        known = rec(3, struct.pack("<H", i) + s(kind) + s("ros2msg") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", i, i) + s(t) + s("cdr") + struct.pack("<I", 0))
        inner = known + rec(5, struct.pack("<HIQQ", i, k, T0 + dt, T0 + dt) + data)
        body = packed("zstd", inner)
        chunk = rec(6, struct.pack("<QQQI", T0 + dt, T0 + dt, len(inner), zlib.crc32(inner)) + s("zstd") + struct.pack("<Q", len(body)) + body)
        index = rec(7, struct.pack("<HIQQ", i, 16, T0 + dt, len(known)))
        summary += known + rec(8, struct.pack("<QQQQI", T0 + dt, T0 + dt, len(out), len(chunk), 10) + struct.pack("<HQ", i, len(out) + len(chunk)) + struct.pack("<Q", len(index)) + s("zstd") + struct.pack("<QQ", len(body), len(inner)))
        places.append((len(out), len(chunk)))
        out += chunk + index
    if statistics:
        counts = b"".join(struct.pack("<HQ", i, sum(r[0] == t for r in rows)) for t, i in number.items())
        times = [T0 + r[2] for r in rows]
        summary += rec(0x0B, struct.pack("<QHIIII", len(rows), 0, 0, 0, 0, len(rows)) + struct.pack("<QQI", min(times), max(times), len(counts)) + counts)
    out += rec(0x0F, struct.pack("<I", 0))
    path.write_bytes(out + summary + rec(2, struct.pack("<QQI", len(out), 0, 0)) + b"\x89MCAP0\r\n")
    return places


@pytest.fixture(params=["db3", "mcap", "mcap zstd", "mcap lz4", "mcap indexed"])
def log(request, spark, tmp_path):
    bags.register(spark)
    if request.param == "db3":
        write_db3(tmp_path / "all" / "run_1")
        return spark.read.format("bag").load(str(tmp_path / "all"))
    if "indexed" in request.param:
        write_indexed(tmp_path / "run_1.mcap")
    else:
        write_mcap(tmp_path / "run_1.mcap", request.param[5:])
    return spark.read.format("bag").load(str(tmp_path / "run_1.mcap"))


def test_log(log):
    assert [(r["topic"], r["message_count"]) for r in catalog.topic_catalog(log).collect()] == [("/cam", 1), ("/force", 1), ("/joints", 1), ("/recording_stage", 2)]
    assert {r["run_id"] for r in log.select("run_id").collect()} == {"run_1"}
    assert catalog.durations(log).first()["duration_sec"] == 2.0
    marks = messages.stage_events(log).orderBy("time").collect()
    assert [(r["time"], r["marker"]) for r in marks] == [(0.0, "1"), (2.0, "Fehler é")]
    row = messages.numeric_topic(log, "/force", messages.WRENCH_FIELDS).first()
    assert [row[f] for f in messages.WRENCH_FIELDS] == [1, 2, 3, 4, 5, 6] and row["time"] == 5e-9
    got = {r["channel"]: r["value"] for r in messages.numeric_channels(log.where("topic = '/joints'")).collect()}
    assert got == {"arm_joint_1_position": 0.5, "joint_1_position": 0.25, "arm_joint_1_velocity": 1.0}
    pic = messages.frames(log, "/cam").first()
    assert (pic["height"], pic["width"], bytes(pic["image"])) == (1, 2, bytes([3, 2, 1, 6, 5, 4]))
    assert log.where(F.col("topic") == "/cam").count() == 1 and log.where(F.col("topic").isin("/cam", "/force")).count() == 2


def test_chunks_without_a_wanted_topic_stay_packed(tmp_path, monkeypatch):
    write_indexed(tmp_path / "run.mcap")
    opened, plain = [], bags._unpacked
    monkeypatch.setattr(bags, "_unpacked", lambda *a: opened.append(1) or plain(*a))
    assert bags._start(tmp_path / "run.mcap") == T0 and not opened
    assert [t for t, *_ in bags._read_log(tmp_path / "run.mcap", {"/cam"})] == ["/cam"] and len(opened) == 1
    assert len(list(bags._read_log(tmp_path / "run.mcap", None))) == len(LOG)


def bytes_asked(monkeypatch):
    asked, plain = [], bags._read_at
    monkeypatch.setattr(bags, "_read_at", lambda f, place, size: asked.append((place, size)) or plain(f, place, size))
    return asked


MANY = [(f"/t{k % 3}", WRENCH if k % 3 else TEXT, k * 1_000_000, wrench(k, 0, 0, 0, 0, k) if k % 3 else text(f"marker {k}" + "x" * 500)) for k in range(60)]


def test_times_choose_chunks(tmp_path, monkeypatch):
    places = write_indexed(tmp_path / "run.mcap", MANY)
    asked = bytes_asked(monkeypatch)
    span = bags.Span(T0 + 10_000_000, T0 + 19_000_000)
    found = list(bags._read_log(tmp_path / "run.mcap", {"/t0"}, span))
    assert [m[2] for m in found] == [13, 16, 19] and {a for a in asked if a in places} == {places[k] for k in (12, 15, 18)}
    assert len(list(bags._read_log(tmp_path / "run.mcap", None, bags.Span(None, T0 + 4_000_000)))) == 5
    assert bags.Span().meets(1, 2) and not bags.Span(3).meets(1, 2) and not bags.Span(None, 0).meets(1, 2)


def test_filters_of_one_frame_do_not_meet(spark, tmp_path):
    bags.register(spark)
    write_indexed(tmp_path / "run.mcap", MANY)
    log = spark.read.format("bag").load(str(tmp_path / "run.mcap"))
    one, two = log.where("topic = '/t0'"), log.where("topic = '/t1' AND time_ns > 0")
    assert {r["topic"]: r["count"] for r in one.union(two).groupBy("topic").count().collect()} == {"/t0": 20, "/t1": 20} and log.count() == 60


def test_wanted_topics_and_times_reach_the_file(spark, tmp_path):
    bags.register(spark)
    write_indexed(tmp_path / "run.mcap", MANY)
    write_db3(tmp_path / "all" / "run_1")
    path = str(tmp_path / "run.mcap")
    # a chunk outside the wanted times is damaged, and nobody notices
    raw = bytearray((tmp_path / "run.mcap").read_bytes())
    raw[bags._index(tmp_path / "run.mcap").chunks[50].place + 60] ^= 255
    (tmp_path / "run.mcap").write_bytes(raw)
    assert bags.read(spark, path, low=T0 + 10_000_000, high=T0 + 19_000_000).count() == 10
    assert bags.read(spark, path, ["/t1"], high=T0 + 7_000_000).count() == 3 and bags.read(spark, path, ["/t1", "/t0"]).count() == 40
    with pytest.raises(PySparkException):
        bags.read(spark, path, ["/t2"]).count()
    assert bags.read(spark, str(tmp_path / "all"), low=T0 + 500_000_001).count() == 2


@pytest.mark.parametrize("statistics", [True, False])
def test_index_tells_counts_and_times_without_payloads(spark, tmp_path, monkeypatch, statistics):
    bags.register(spark)
    places = write_indexed(tmp_path / "run.mcap", MANY, statistics)
    asked = bytes_asked(monkeypatch)
    origin, first, last, topics = bags._log_summary(tmp_path / "run.mcap", None)
    assert (origin, first, last) == ("statistics" if statistics else "message index", T0, T0 + 59_000_000) and set(topics.values()) == {20}
    chunk_bytes = [n for a, n in asked if any(p <= a < p + size for p, size in places)]
    assert chunk_bytes == [] and sum(n for _, n in asked) < (tmp_path / "run.mcap").stat().st_size / 2
    index = spark.read.format("bag_index").load(str(tmp_path / "run.mcap"))
    log = spark.read.format("bag").load(str(tmp_path / "run.mcap"))
    assert catalog.indexed_catalog(index).collect() == catalog.topic_catalog(log).collect()
    assert catalog.indexed_durations(index).collect() == catalog.durations(log).collect()


@pytest.mark.parametrize("kind", ["db3", "mcap", "lz4"])
def test_index_of_other_storage(spark, tmp_path, kind):
    bags.register(spark)
    if kind == "db3":
        write_db3(tmp_path / "run_1")
    else:
        write_mcap(tmp_path / "run_1.mcap", kind.replace("mcap", ""))
    path = str(tmp_path / ("run_1" if kind == "db3" else "run_1.mcap"))
    index, log = spark.read.format("bag_index").load(path), spark.read.format("bag").load(path)
    assert {r["origin"] for r in index.collect()} == {"sums" if kind == "db3" else "scan"}
    assert catalog.indexed_catalog(index).collect() == catalog.topic_catalog(log).collect() and catalog.indexed_durations(index).collect() == catalog.durations(log).collect()


def test_one_file_in_parts_gives_the_rows_of_one(spark, tmp_path):
    bags.register(spark)
    write_indexed(tmp_path / "run.mcap", MANY)
    write_db3(tmp_path / "run_1")
    for path, rows in ((tmp_path / "run.mcap", 60), (tmp_path / "run_1", len(LOG))):
        whole, parted = spark.read.format("bag").load(str(path)), spark.read.format("bag").option("maxPartitionBytes", 1500).load(str(path))
        assert parted.rdd.getNumPartitions() > 3 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(str, parted.collect())) == sorted(map(str, whole.collect())) and whole.count() == rows
    places = [c.place for c in bags._index(tmp_path / "run.mcap").chunks]
    parts = bags.file_parts(tmp_path / "run.mcap", 1500)
    assert [p for part in parts for p in part] == places
    sizes = {c.place: c.size for c in bags._index(tmp_path / "run.mcap").chunks}
    assert all(sum(sizes[p] for p in part) <= 1500 or len(part) == 1 for part in parts)


def test_damaged_recordings_stay_in_the_manifest(spark, tmp_path):
    bags.register(spark)
    for name in ("sound", "cut", "chunk", "page", "none"):
        write_db3(tmp_path / "all" / name)
        if name not in ("sound", "page"):
            (tmp_path / "all" / name / "part_0.db3").unlink()
    write_indexed(tmp_path / "all" / "chunk" / "a.mcap", [("/recording_stage", TEXT, k, text(f"m{k}")) for k in range(6)])
    place, size = [(c.place, c.size) for c in bags._index(tmp_path / "all" / "chunk" / "a.mcap").chunks][2]
    raw = bytearray((tmp_path / "all" / "chunk" / "a.mcap").read_bytes())
    raw[place + size - 5] ^= 255
    (tmp_path / "all" / "chunk" / "a.mcap").write_bytes(raw)
    write_mcap(tmp_path / "all" / "cut" / "a.mcap", "")
    whole = (tmp_path / "all" / "cut" / "a.mcap").read_bytes()
    (tmp_path / "all" / "cut" / "a.mcap").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "all" / "none" / "a.mcap").write_bytes(b"no log at all")
    (tmp_path / "all" / "page" / "part_0.db3").write_bytes(b"SQLite format 3\0" + bytes(5000))
    path = str(tmp_path / "all")
    log = spark.read.format("bag").option("mode", "PERMISSIVE").load(path)
    # the chunks around a bad one are read
    assert sorted(r["marker"] for r in messages.stage_events(log.where("run_id = 'chunk'")).collect()) == ["m0", "m1", "m3", "m4", "m5"]
    bad = {r["run_id"]: r["read_error"] for r in log.where("read_error is not null").collect()}
    assert set(bad) == {"cut", "chunk", "page", "none"} and f"chunk at {place}" in bad["chunk"] and "cut off" in bad["cut"]
    rows = {r["run_id"]: r for r in main.bag_manifest(spark, path, "/recording_stage", 1.0).collect()}
    assert set(rows) == {"sound", "cut", "chunk", "page", "none"}
    assert rows["sound"]["read_status"] == "ok" and rows["sound"]["label"] == "fail" and rows["sound"]["message_count"] == len(LOG)
    assert all(rows[r]["read_status"].startswith("error: ") and rows[r]["label"] == "unknown" for r in ("cut", "chunk", "page", "none"))
    assert rows["chunk"]["message_count"] == 6 and rows["none"]["message_count"] == 0
    with pytest.raises(PySparkException):
        spark.read.format("bag").load(path).count()


def test_numbers_of_any_layout_in_one_batch(spark):
    """Byte orders, frame names and joint lists that change from message to message."""
    big = lambda *v: b"\0\0\0\0" + struct.pack(">6d", *v)
    rows = [("/w", "geometry_msgs/msg/Wrench", big(*range(6))), ("/w", "geometry_msgs/msg/Wrench", b"\0\1\0\0" + struct.pack("<6d", *range(6, 12)))]
    rows += [("/w", WRENCH, bytes(Put().put("i", k).put("I", 2).text("f" * (k % 3)).put("d", *range(k, k + 6)).b)) for k in range(7)]
    rows += [("/j", JOINTS, joints(["A b", "c"], [k, k + 1], [k + 2])) for k in range(3)] + [("/j", JOINTS, joints(["c", "A b"], [5, 6], [])), ("/j", JOINTS, joints([], [7], [])), ("/j", JOINTS, joints([], [], []))]
    plain = spark.createDataFrame([("r", t, k, i, 10**9 * i, 0, bytes(p), None) for i, (t, k, p) in enumerate(rows)], "run_id string, topic string, message_type string, seq long, time_ns long, start_ns long, payload binary, read_error string")
    df = plain.repartition(2)
    df = df.unionByName(df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "topic" else F.lit("/w").alias("topic") for f in df.schema]))
    wide = messages.numeric_topic(df, "/w", messages.WRENCH_FIELDS)
    assert {r["seq"]: tuple(r[f] for f in messages.WRENCH_FIELDS) for r in wide.collect()} == {0: tuple(range(6)), 1: tuple(range(6, 12)), **{k + 2: tuple(range(k, k + 6)) for k in range(7)}}
    plan = messages.numeric_topic(plain, "/w", messages.WRENCH_FIELDS)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Sort ", "Generate", "Pivot"))
    got = {(r["seq"], r["channel"]): r["value"] for r in messages.numeric_channels(df.where("topic = '/j'")).collect()}
    want = {(9 + k, c): v for k in range(3) for c, v in (("a_b_position", k), ("c_position", k + 1), ("a_b_velocity", k + 2))}
    assert got == want | {(12, "c_position"): 5, (12, "a_b_position"): 6, (13, "joint_0_position"): 7}
    joint = messages.numeric_topic(df, "/j", ["c_position", "a_b_velocity"]).collect()
    assert {r["seq"]: (r["c_position"], r["a_b_velocity"]) for r in joint} == {9: (1, 2), 10: (2, 3), 11: (3, 4), 12: (5, None), 13: (None, None), 14: (None, None)}
    with pytest.raises(PySparkException):
        messages.numeric_topic(df.withColumn("payload", F.substring("payload", 1, 40)), "/w", messages.WRENCH_FIELDS).collect()


def test_sources_are_chosen_and_tried_in_turn(spark, tmp_path):
    bags.register(spark)
    write_mcap(tmp_path / "run_1.mcap", "")
    video = lambda s, path: s.createDataFrame([(path,)], "path string")
    assert dispatch.read_frames(spark, str(tmp_path / "run_1.mcap"), topic="/cam").count() == 1
    assert dispatch.read_frames(spark, "/somewhere/film.MP4", video=video).first()["path"] == "/somewhere/film.MP4"
    with pytest.raises(ValueError, match="video"):
        dispatch.read_frames(spark, "film.mp4")
    with pytest.raises(ValueError, match="topic"):
        dispatch.read_frames(spark, str(tmp_path / "run_1.mcap"))

    def broken(path):
        raise OSError("no such format")

    wrench = lambda path: messages.numeric_topic(spark.read.format("bag").load(path), "/force", messages.WRENCH_FIELDS)
    rows = dispatch.first_that_reads(str(tmp_path / "run_1.mcap"), {"other": broken, "own": wrench})
    assert rows.count() == 1 and series.first_sample_time(rows).first()["time"] == 0.0
    with pytest.raises(ValueError, match="other: no such format; more: no such format"):
        dispatch.first_that_reads("x", {"other": broken, "more": broken})


def test_paths(tmp_path):
    write_db3(tmp_path / "a" / "run")
    assert bags.resolve_bag(str(tmp_path / "a/run/part_0.db3")) == tmp_path / "a/run"
    assert [p.name for p in bags.discover_bags(str(tmp_path))] == ["run"] and bags.discover_bags(str(tmp_path), recursive=False) == []
    (tmp_path / "x.db3").write_bytes(b"")
    (tmp_path / "y.txt").write_bytes(b"")
    for bad, error in (("none", FileNotFoundError), ("x.db3", ValueError), ("y.txt", ValueError), ("a", ValueError)):
        with pytest.raises(error):
            bags.resolve_bag(str(tmp_path / bad))


@pytest.mark.parametrize("encoding", ["rgb8", "bgr8", "rgba8", "bgra8", "mono8"])
def test_encodings(encoding):
    depth = {"mono8": 1}.get(encoding, 4 if "a8" in encoding else 3)
    raw = np.arange(2 * (3 * depth + 2), dtype=np.uint8)
    out = np.frombuffer(messages.to_rgb(raw.tobytes(), encoding, 2, 3, 3 * depth + 2), np.uint8).reshape(2, 3, 3)
    first = raw[:depth]
    assert out[0, 0].tolist() == ([0, 0, 0] if depth == 1 else first[:3][::-1].tolist() if encoding.startswith("b") else first[:3].tolist())
    with pytest.raises(ValueError):
        messages.to_rgb(b"", "yuv422", 1, 1, 2)


def test_memory_signature(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "m")
    signature = {"fps": 2.0, "sources": [{"topic": "/cam"}], "more": 1}
    assert results.load_memory(spark, path, signature) is None
    results.save_memory(df, df, df, path, signature)
    assert results.load_memory(spark, path, {"fps": 2.0})[0].count() == 3
    assert results.load_memory(spark, path, {"fps": 3.0}) is None and results.load_memory(spark, path, {"new": 1}) is None
    asked = {**signature, "sources": [{"topic": "/other"}]}
    assert results.load_memory(spark, path, asked) is None and results.load_memory(spark, path, results.runtime_signature(asked)) is not None
    assert results.check_sources(signature["sources"], asked["sources"]) == ["('/other', None, None)"]
    results.write_csv(results.csv_ready(df.select("id", F.array("id").alias("a"))), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("id = 2").first()["a"] == "[2]"
