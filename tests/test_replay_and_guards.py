"""Replay, upload errors, and guards of injection, manifests and preprocessing."""

import glob
import json
import time

import pytest
from pyspark.sql import functions as F

from test_operators import S, frames, normal
from tracewright.operators import attacks, decode, model, windows
from tracewright.operators.store import written
from tracewright.sources import logs
from tracewright.streaming import replay, sinks


def outputs(spark):
    rows = [(f"cap{c:02d}_w{w:04d}", f"cap{c:02d}", w, w / 10) for c, n in ((2, 7), (1, 9), (3, 4)) for w in range(n)]
    return spark.createDataFrame(rows, "window_id string, capture_id string, w long, attack_score double")


def shown(path):
    """The windows of each batch, in the order of batches."""
    out = []
    for folder in sorted(glob.glob(f"{path}/batch=*"), key=lambda x: int(x.rpartition("=")[2])):
        out.append([json.loads(line) for f in sorted(glob.glob(f"{folder}/part-*")) for line in open(f)])
    return out


def test_positions_follow_captures_and_windows(spark):
    got = replay.positions(outputs(spark)).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(20)) and [(r["capture_id"], r["w"]) for r in got] == sorted((r["capture_id"], r["w"]) for r in got)
    assert replay.positions(outputs(spark).limit(0)).count() == 0


def test_replay_keeps_its_speed_and_goes_on_after_a_stop(spark, tmp_path):
    stored = written(replay.positions(outputs(spark)), "replay")
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: replay.replay(spark, stored, path, checkpoint, speed=6, tick="100 milliseconds")
    q = run()
    for _ in range(600):
        if q.lastProgress and q.lastProgress["batchId"] >= 0 and sum(map(len, shown(path))) >= 6:
            break
        time.sleep(0.1)
    q.stop()
    first = sum(map(len, shown(path)))
    assert 6 <= first
    q = run()
    for _ in range(600):
        if sum(map(len, shown(path))) == 20:
            break
        time.sleep(0.1)
    q.stop()
    batches = [b for b in shown(path) if b]
    assert [len(b) for b in batches] == [6, 6, 6, 2]
    assert [r["position"] for b in batches for r in b] == list(range(20))


def test_a_failed_upload_leaves_an_error_event(spark, tmp_path):
    train = normal(spark, "cap01", 6, 1)
    detector = model.Detector(model.fit_stage1(train, S), 0.9, "v1")
    folder = tmp_path / "in"
    normal(spark, "cap02", 4, 2).write.parquet(str(folder))
    frames(spark, [(0, "0D0", "00")]).write.mode("append").parquet(str(folder))
    stream = lambda f: spark.readStream.schema(train.schema).parquet(f)
    sinks.score_uploads(stream(str(folder)), detector, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    kinds = [json.loads(r["value"])["type"] for r in spark.read.text(f"{tmp_path}/out/batch=0").collect()]
    assert "done" in kinds and "error" not in kinds
    lone = tmp_path / "lone"
    frames(spark, [(0, "0D0", "00")]).write.parquet(str(lone))
    sinks.score_uploads(stream(str(lone)), detector, str(tmp_path / "out2"), str(tmp_path / "check2")).awaitTermination()
    said = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out2/batch=0").collect()]
    assert [x["type"] for x in said] == ["error"] and "no complete window" in said[0]["message"]


def test_injection_asks_for_raw_windows_and_overlapping_intervals(spark):
    placed = windows.assign(frames(spark, [(0, "0D0", "00"), (0.001, "0D0", "01"), (2, "0D0", "00")]), S)
    spec = lambda start, long: spark.createDataFrame([("cap01", 0, "freeze", "0D0", start, long, None, None)], "capture_id string, w long, family string, target_can_id string, start_offset_ms double, duration_ms double, byte_index int, offset int")
    assert attacks.inject(placed, spec(0.0, 1000.0), S).where("changed").count() == 1
    for start, long in ((1000.0, 5.0), (-1.0, 5.0), (0.0, 0.0)):
        with pytest.raises(Exception, match="does not overlap"):
            attacks.inject(placed, spec(start, long), S).collect()
    with pytest.raises(ValueError, match="raw frames"):
        attacks.inject(placed.withColumn("decoded_signals", F.lit(None)), spec(0.0, 1.0), S)


def test_preprocess_fills_signals_or_none(spark):
    placed = windows.assign(frames(spark, [(0, "0D0", "0A"), (0.001, "0D0", "0B"), (1, "0F4", "01"), (2, "0D0", "00")]), S)
    spine = windows.spine(frames(spark, [(0, "0D0", "0A"), (2, "0D0", "00")]), S)
    plain = {r["w"]: r["decoded_signals"] for r in decode.preprocess(placed, spine).collect()}
    assert plain == {0: {}, 1: {}}
    signals = logs.with_bits(spark.createDataFrame([("0D0", "x", 7, 8, False, False)], logs.SIGNALS))
    full = {r["w"]: r["decoded_signals"] for r in decode.preprocess(placed, spine, signals).collect()}
    assert full == {0: {"0D0:x": [10.0, 11.0]}, 1: {}}


def test_capture_lookup_and_metadata(spark):
    captures = spark.createDataFrame([("a", "cap01", "train", "ambient", None), ("b", "cap02", "train", "ambient", None)], "name string, capture_id string, `group` string, kind string, family string")
    assert logs.entry(captures, "a").first()["capture_id"] == "cap01"
    with pytest.raises(KeyError, match="no capture"):
        logs.entry(captures, "z")
    lines = spark.createDataFrame([("cap01", 2, "1.5", 1_500_000), ("cap01", 1, "1.25", 1_250_000), ("cap01", 3, None, None)], "capture string, line_no long, ts_text string, abs_us long")
    rules = spark.createDataFrame([("cap01", None, None, None), ("cap02", "0D0", 2_000_000, 3_000_000)], "capture_id string, target string, lo_us long, hi_us long")
    got = {r["capture_id"]: r for r in logs.capture_metadata(lines, captures, rules).collect()}
    assert (got["cap01"]["duration_s"], got["cap01"]["first_raw_timestamp"], got["cap01"]["injection_interval"]) == (0.25, "1.25", None)
    assert got["cap02"]["duration_s"] is None and got["cap02"]["injection_interval"] == [2.0, 3.0]
