"""The sink of run artifacts, and videos whose containers the test writes byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugeline.operators import sampling
from gaugeline.sources import artifacts, videos


def test_artifacts_show_whole_jobs(spark, tmp_path):
    artifacts.register(spark)
    folder = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("run"), (F.col("id") % 5).cast("string")).alias("run_id"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("é"), "id").alias("content")).repartition(4)
    rows.write.format("artifacts").mode("append").save(folder)
    assert (tmp_path / "out/run2/7.txt").read_text() == "é7" and len(artifacts.committed(folder)) == 40
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".")] == []
    # overwriting replaces the runs that are written, no others
    rows.where("run_id = 'run1'").limit(1).withColumn("content", F.lit(b"new")).write.format("artifacts").mode("overwrite").save(folder)
    assert len(list((tmp_path / "out/run1").iterdir())) == 1 and len(artifacts.committed(folder)) == 33


@pytest.mark.parametrize("bad", ["fails", "twice", "name"])
def test_a_failed_job_shows_nothing(spark, tmp_path, bad):
    artifacts.register(spark)
    folder = str(tmp_path / "out")
    rows = spark.range(20).select(F.lit("r").alias("run_id"), F.col("id").cast("string").alias("name"), F.col("id").cast("string").alias("content")).repartition(4)
    if bad == "fails":
        rows = rows.withColumn("content", F.when(F.col("name") == "17", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    elif bad == "twice":
        rows = rows.withColumn("name", F.when(F.col("name") == "17", "3").otherwise(F.col("name")))
    else:
        rows = rows.withColumn("name", F.when(F.col("name") == "17", "../3").otherwise(F.col("name")))
    with pytest.raises(PySparkException):
        rows.write.format("artifacts").mode("append").save(folder)
    assert artifacts.committed(folder) == [] and (not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == [])
    with pytest.raises(PySparkException):
        rows.drop("content").write.format("artifacts").mode("append").save(folder)


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def table(kind, rows, form, before=b""):
    return box(kind, b"\0\0\0\0", before, struct.pack(">I", len(rows)), *(struct.pack(form, *r) for r in rows))


def write_video(path, sizes, chunks, keys, ctts=None, wide=False, same=None, scale=1000, step=40):
    """Frames of given sizes in chunks of given counts; a sound track comes first."""
    body, places = b"", []
    for n in chunks:
        places.append(len(body) + 8)
        for k in range(n):
            body += bytes([len(places)]) * (same or sizes[sum(chunks[: len(places) - 1]) + k])
        body += b"gap"
    runs = [(k + 1, n, 1) for k, n in enumerate(chunks) if k == 0 or chunks[k - 1] != n]
    stsz = box(b"stsz", b"\0\0\0\0", struct.pack(">II", same or 0, len(sizes)), *([] if same else [struct.pack(">I", s) for s in sizes]))
    offsets = table(b"co64", [(p,) for p in places], ">Q") if wide else table(b"stco", [(p,) for p in places], ">I")
    stbl = box(b"stbl", table(b"stts", [(len(sizes) - 1, step), (1, step)], ">II"), stsz, table(b"stsc", runs, ">III"), offsets, *([table(b"stss", [(k + 1,) for k in keys], ">I")] if keys else []), *([table(b"ctts", [(1, c) for c in ctts], ">Ii")] if ctts else []))
    mdhd = box(b"mdhd", b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", scale, 0)) if wide else box(b"mdhd", bytes(12), struct.pack(">II", scale, 0))
    track = lambda kind, *more: box(b"trak", box(b"mdia", mdhd, box(b"hdlr", bytes(8), kind, bytes(12)), *more))
    path.write_bytes(box(b"mdat", body) + box(b"free") + box(b"moov", box(b"mvhd", bytes(20)), track(b"soun"), track(b"vide", box(b"minf", stbl))))


def test_frames_of_a_container(spark, tmp_path):
    videos.register(spark)
    sizes = [10 + k for k in range(11)]
    write_video(tmp_path / "a.mp4", sizes, [3, 3, 4, 1], [0, 5])
    rows = spark.read.format("video_index").load(str(tmp_path / "a.mp4")).orderBy("frame_index").collect()
    raw = (tmp_path / "a.mp4").read_bytes()
    assert [r["byte_size"] for r in rows] == sizes and [r["key_frame"] for r in rows] == [k in (0, 5) for k in range(11)]
    assert np.allclose([r["timestamp_sec"] for r in rows], np.arange(11) * 0.04) and rows[0]["fps"] == pytest.approx(25) and rows[0]["frame_count"] == 11
    for k, r in enumerate(rows):  # the bytes are those of the frame's chunk
        assert set(raw[r["byte_offset"] : r["byte_offset"] + r["byte_size"]]) == {([1] * 3 + [2] * 3 + [3] * 4 + [4])[k]}


def test_order_of_showing_and_other_tables(spark, tmp_path):
    videos.register(spark)
    write_video(tmp_path / "b.mov", [5] * 4, [4], [], ctts=[40, 120, 40, 40], wide=True, same=5)
    rows = spark.read.format("video_index").load(str(tmp_path / "b.mov")).orderBy("frame_index").collect()
    # ticks of showing: 40, 160, 120, 160: the second sample is shown after the third
    assert np.allclose([r["timestamp_sec"] for r in rows], [0, 0.08, 0.12, 0.12]) and all(r["key_frame"] for r in rows)
    assert np.diff([r["byte_offset"] for r in rows]).tolist() == [10, -5, 10]
    (tmp_path / "none.mp4").write_bytes(box(b"moov", box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), b"soun")))))
    assert spark.read.format("video_index").load(str(tmp_path / "none.mp4")).count() == 0
    (tmp_path / "cut.mp4").write_bytes((tmp_path / "b.mov").read_bytes()[:-9])
    with pytest.raises(PySparkException):
        spark.read.format("video_index").load(str(tmp_path / "cut.mp4")).count()
    with pytest.raises(PySparkException):
        spark.read.format("video_index").load(str(tmp_path / "nowhere.mp4")).count()


def test_samplers_choose_before_anything_is_decoded(spark, tmp_path):
    videos.register(spark)
    for name in ("a", "b"):
        write_video(tmp_path / f"{name}.mp4", [7] * 60, [10] * 6, list(range(0, 60, 12)))
    index = spark.read.format("video_index").load(str(tmp_path))
    every = sampling.every_kth(index, 25.0, 5.0, start=2)
    assert sorted((r["run_id"], r["frame_index"]) for r in every.collect()) == [(n, k) for n in "ab" for k in range(2, 60, 5)]
    even = sampling.sample_evenly(index.withColumnsRenamed({"timestamp_sec": "time", "frame_index": "seq"}), 4)
    assert sorted((r["run_id"], r["seq"]) for r in even.collect()) == [(n, k) for n in "ab" for k in (0, 20, 39, 59)]
    ranges = {(r["run_id"], r["frame_index"]): (r["key_index"], r["key_offset"]) for r in videos.decoding_ranges(every, index).collect()}
    offsets = {(r["run_id"], r["frame_index"]): r["byte_offset"] for r in index.collect()}
    assert all(k == f // 12 * 12 and o == offsets[run, k] for (run, f), (k, o) in ranges.items()) and len(ranges) == 24


def test_due_times_are_summed_one_after_the_other(monkeypatch):
    monkeypatch.setattr(sampling, "DUE_BLOCK", 16)
    rng = np.random.default_rng(3)
    due = sampling.DueTimes(0.3, 1 / 30)
    sums = [0.3]
    while sums[-1] < 40:
        sums.append(sums[-1] + 1 / 30)
    for times in (rng.random(50) * 30, np.array(sums[:200]), np.array([0.0, 0.3, 0.29]), rng.random(7) * 5, np.array([])):
        assert due.upto(times).tolist() == [sum(s <= t for s in sums) for t in times]
