"""Hand-checked cases of sources, windows, labels, models, calibration, attacks and evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.functions import ids as fn
from tracewright.operators import attacks, calibrate, clean, crossval, decode, evaluate, features, labels, ml, model, windows
from tracewright.sources import logs
from tracewright.sources.tables import mock_frames

S = 1_000_000


def frames(spark, rows, capture="cap01"):
    """rows: (seconds, id, payload)."""
    full = [(capture, i, round(t * S), c, p) for i, (t, c, p) in enumerate(rows)]
    return spark.createDataFrame(full, schema.FRAMES)


def at(spark, *times):
    return frames(spark, [(t, "0F4", "00") for t in times])


def counts(df):
    return {r["w"]: r["n_frames"] for r in windows.counted(df, S).collect()}


@pytest.mark.parametrize(
    "times,want",
    [((0.1, 0.9, 1.2, 2.5), {0: 2, 1: 1}), ((0.5, 1.0, 2.5), {0: 1, 1: 1}), ((0.999999, 1.0, 2.5), {0: 1, 1: 1}), ((0.5, 3.5, 4.5), {0: 1, 1: 0, 2: 0, 3: 1}), ((0.1, 0.5), {}), ((), {}), ((0.5, 1.0), {0: 1})],
)
def test_windows(spark, times, want):
    assert counts(at(spark, *times)) == want


def test_window_length_and_sampling(spark):
    assert windows.window_us(1.0) == S
    for bad in ((0,), (1.0, 0.5), (1e-7,)):
        with pytest.raises(ValueError):
            windows.window_us(*bad)
    assert [r["w"] for r in windows.spine(at(spark, 0, 10.5), S, 3).orderBy("w").collect()] == [0, 3, 6, 9]
    every = spark.range(1).select(windows.keep_every(F.lit(20 * S), S, 10).alias("a"), windows.keep_every(F.lit(5 * S), S, 10).alias("b")).first()
    assert tuple(every) == (2, 1)
    inside = windows.nested(at(spark, 0.25, 0.1, 1.5), S).first()
    assert [f["timestamp"] for f in inside["frames"]] == [0.1, 0.25] and inside["window_id"] == "cap01_w0000"


def test_cleaning(spark):
    f = frames(spark, [(0, "0F4", "00"), (0, "0F4", "00"), (0, "0F4", "01"), (1, "FFF", "")])
    kept = clean.dedup(f)
    assert sorted(r["line_no"] for r in kept.collect()) == [0, 2, 3]
    report = clean.report(f, kept, spark.createDataFrame([("cap01", 1), ("cap02", 2)], "capture_id string, skipped_lines long"))
    rows = {r["capture_id"]: r for r in report.collect()}
    assert (rows["cap01"]["duplicates"], rows["cap01"]["filler"], rows["cap01"]["removed_fraction"]) == (1, 1, 0.4) and rows["cap02"]["read"] == 0
    assert clean.gate(report).count() == 2
    with pytest.raises(ValueError):
        clean.cleaned(at(spark, 1.5, 0.5, 2.5))
    assert clean.report(f.limit(0), kept.limit(0)).count() == 0


LOG = """(1110000000.000000) can0 0f4#960C010204B10240
(1110000000.0199999) can0 000D0#

garbage
(1110000001.5) vcan1 1ABCD#ff \r
"""


def test_log(spark, tmp_path):
    (tmp_path / "drive one.log").write_text(LOG)
    parsed = logs.parse(logs.read_lines(spark, str(tmp_path / "drive one.log")))
    got = [(r["t_us"], r["can_id"], r["payload"]) for r in logs.frames(parsed).orderBy("line_no").collect()]
    assert got == [(0, "0F4", "960C010204B10240"), (19999, "0D0", ""), (1500000, "1ABCD", "FF")]
    assert logs.skipped(parsed).first()["skipped_lines"] == 1
    p = logs.profile(parsed).first()
    assert (p["frames"], p["unique_ids"], p["duration_s"], p["msg_per_sec"], p["first_raw_timestamp"]) == (3, 3, 1.5, 2.0, "1110000000.000000")
    assert logs.spans(parsed).first()["span_us"] == 1500000
    assert logs.seconds(logs.frames(parsed)).agg(F.max("timestamp")).first()[0] == 1.5


DBC = """BO_ 1 OLD: 8 X
 SG_ gone : 7|8@0+ (1,0) [0|0] "" X
 SG_ early : 0|1@1+ (1,0) [0|0] "" X
BO_ 208 A: 8 X
 SG_ byte0 : 7|8@0+ (1,0) [0|0] "" X
 SG_ byte5 : 40|8@1- (1,0) [0|0] "" X
BO_ 1 NEW: 8 X
 SG_ kept : 7|16@0- (1,0) [0|0] "" X
"""


def test_signals(spark, tmp_path):
    (tmp_path / "x.dbc").write_text(" SG_ before : 0|1@1+ (1,0)\n" + DBC)
    sig = logs.read_signals(spark, str(tmp_path / "x.dbc"))
    assert {(r["can_id"], r["name"], r["start"], r["width"], r["intel"], r["signed"]) for r in sig.collect()} == {("0D0", "byte0", 7, 8, False, False), ("0D0", "byte5", 40, 8, True, True), ("001", "kept", 7, 16, False, True)}
    f = frames(spark, [(0.1, "0D0", "FF00000000FE0000"), (0.2, "0D0", "01"), (0.3, "001", "FFFE"), (0.4, "0F4", "00"), (1.1, "001", "00")])
    d = decode.decode(windows.assign(f, S), logs.with_bits(sig))
    got = {(r["line_no"], r["signal"]): r["value"] for r in d.collect()}
    assert got[0, "0D0:byte0"] == 255 and got[0, "0D0:byte5"] == -2 and got[1, "0D0:byte0"] == 1 and math.isnan(got[1, "0D0:byte5"]) and got[2, "001:kept"] == -2
    assert {r["signal"]: r["value"] for r in decode.latest(d).collect()} == {"0D0:byte0": 1, "0D0:byte5": -2, "001:kept": -2}
    values = {r["signal"]: r["values"] for r in decode.decoded_windows(d).collect()}
    assert values["0D0:byte0"] == [255, 1]
    with pytest.raises(ValueError):
        decode.decode(f, logs.with_bits(sig), ["0F4"])
    (tmp_path / "x.csv").write_text("Label,Time,ID,Signal_a\n0,0,208,255\n0,1,208,7\n0,2,1,\n")
    table = logs.read_signal_csv(spark, str(tmp_path / "x.csv"))
    named = d.withColumn("signal", F.replace("signal", F.lit("byte0"), F.lit("Signal_a")))
    row = decode.check_csv(named, table).first()
    assert (row["compared"], row["unequal"], row["first_row"]) == (2, 1, 2)
    wide = spark.range(1).select(fn.decode_bits(F.lit("FFFFFFFFFFFFFFFF"), F.array(*map(F.lit, fn.bit_positions(7, 64, False))), F.lit(False)).alias("u"), fn.decode_bits(F.lit("FFFFFFFFFFFFFFFF"), F.array(*map(F.lit, fn.bit_positions(7, 64, False))), F.lit(True)).alias("s")).first()
    assert wide["u"] == float(2**64 - 1) and wide["s"] == -1.0


META = '{"ambient_a": {}, "speed_attack_1": {"injection_id": "0xd0", "injection_interval": [8.0, 11.99], "injection_data_str": "XXXXXXXXXXFFXXXX", "modified": false}, "speed_attack_1_masquerade": {"injection_id": "0xd0", "injection_interval": [8.0, 11.99], "modified": true}, "fuzzing_attack_1": {"injection_id": "XXX"}, "pedal_attack_drive": {}, "speed_attack_3": {"injection_id": "0xd0"}}'


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(META.replace("pedal_attack_drive", "pedal_attack_1"))
    meta = logs.read_metadata(spark, [str(tmp_path / "m.json")])
    got = logs.manifest(meta, spark.createDataFrame([("ambient_a", "train")], "name string, `group` string"))
    rows = {r["name"]: r for r in got.collect()}
    assert rows["ambient_a"]["capture_id"] == "cap01" and rows["ambient_a"]["group"] == "train"
    assert [rows[n]["kind"] for n in ("speed_attack_1", "speed_attack_1_masquerade", "fuzzing_attack_1", "pedal_attack_1")] == ["fabrication", "masquerade", "fuzzing", "accelerator"]
    assert rows["speed_attack_1"]["twin"] == "speed_attack_1_masquerade" and rows["speed_attack_3"]["twin"] is None and rows["speed_attack_3"]["group"] == "final_test"
    assert rows["speed_attack_1"]["fold"] == 1 and rows["pedal_attack_1"]["group"] == "separate" and rows["speed_attack_1"]["family"] == "speed"
    assert schema.violations(got, "captures").count() == 0 and schema.twin_violations(got).count() == 0
    assert {r["fold"]: r["names"] for r in logs.folds(got).collect()} == {1: ["fuzzing_attack_1", "speed_attack_1", "speed_attack_1_masquerade"]}
    rules = {r["capture_id"]: r for r in logs.rules(got, meta).collect()}[rows["speed_attack_1"]["capture_id"]]
    assert (rules["target"], rules["lo_us"], rules["hi_us"]) == ("0D0", 8 * S, 11_990_000)
    assert logs.allowed(got, ["train"]).count() == 1
    for bad, error in ((["final_test"], PermissionError), (["no"], ValueError)):
        with pytest.raises(error):
            logs.allowed(got, bad)
    assert [r["capture_id"] for r in logs.discover(spark.createDataFrame([("attacks", "b"), ("ambient", "z"), ("ambient", "a"), ("other", "c")], "folder string, name string")).orderBy("capture_id").select("capture_id", "name").collect()] == ["cap01", "cap02", "cap03"]


def test_ids(spark):
    r = spark.createDataFrame([("0F4",), ("0x6e0",), (" 0xd0",), ("XXX",), ("000D0",)], "x string").select(fn.canonical_can_id(F.col("x")).alias("a"), fn.normalize_can_id(F.col("x")).alias("b")).collect()
    assert [x["a"] for x in r] == ["0F4", "6E0", "0D0", "XXX", "0D0"] and [x["b"] for x in r] == ["0F4", "6E0", "0D0", None, "000D0"]
    assert spark.range(1).select(fn.canonical_can_id_of_number(F.lit(244))).first()[0] == "0F4"
    assert fn.bit_positions(7, 16, False) == [7, 6, 5, 4, 3, 2, 1, 0, 15, 14, 13, 12, 11, 10, 9, 8] and fn.bit_positions(8, 4, True) == [11, 10, 9, 8]
    assert abs(fn.binomial_upper_95(0, 50) - (1 - 0.05 ** (1 / 50))) < 1e-9 and fn.binomial_upper_95(3, 3) == 1 and fn.binomial_upper_95(0, 0) == 1
    answers = ['{"attack_probability": 1.7, "reason": "high"}', 'say {"attack_probability": 0.25} ok', "about 0.4 I think", "none", '{"x": 1}', "", "99 reasons"]
    got = [r["p"] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(fn.parse_probability(F.col("a")).alias("p")).collect()]
    assert [g["probability"] for g in got] == [1.0, 0.25, 0.4, 0.5, 0.5, 0.5, 0.5] and got[0]["reason"] == "high" and got[1]["reason"] == "no reason was stated" and got[5]["reason"] == "the answer was empty"
    e = spark.createDataFrame([("[Stage 1] Timing anomaly (unknown_ids): 1 unknown CAN ID(s), e.g. 7ff (10 frames)",), ("[Stage 2] Payload anomaly (frozen_break): ID 0D0 byte0: x",), ("nothing",)], "e string").select(fn.parse_evidence(F.col("e")).alias("p")).collect()
    assert [tuple(x["p"]) for x in e] == [("Stage 1", "7FF", "unknown_ids"), ("Stage 2", "0D0", "frozen_break"), (None, None, None)]


RULE = "capture_id string, kind string, family string, target string, lo_us long, hi_us long, mask string"


def test_labels(spark):
    f = frames(spark, [(0.5, "0D0", "FF"), (1.0, "0D0", "FF"), (1.2, "0D0", "00"), (1.9, "0F4", "FF"), (2.5, "0D0", "FF"), (4.5, "0D0", "00")])
    rule = spark.createDataFrame([("cap01", "fabrication", "speed", "0D0", S, 2_500_000, "FX")], RULE)
    got = {r["w"]: r for r in labels.window_labels(f, rule, S).collect()}
    assert [got[w]["injected_frames"] for w in range(4)] == [0, 1, 1, 0] and [got[w]["interval_overlap_s"] for w in range(4)] == [None, 1.0, 0.5, None]
    assert got[1]["injection_interval"]["start"] == 1.0 and got[0]["family"] is None
    fuzz = labels.injected(frames(spark, [(0, "123", "F" * 16), (1, "0D0", "F" * 14)]), spark.createDataFrame([("cap01", "fuzzing", "fuzzing", None, None, None, None)], RULE))
    assert [r["injected"] for r in fuzz.orderBy("line_no").collect()] == [True, False]


def test_invariants(spark):
    f = spark.createDataFrame([("c", 0, 0, "0G1", "00"), ("c", 1, 0, "0F1", "0"), ("c", 2, 0, "0F1", "00" * 9), ("c", 3, 0, "0F1", "")], schema.FRAMES)
    assert [r["rule"] for r in schema.violations(f, "frames").orderBy("line_no").collect()] == ["id is hex", "payload has whole bytes", "payload has 8 bytes at most"]
    with pytest.raises(Exception, match="id is hex"):
        schema.guard(f.where("line_no = 0"), "frames").collect()
    assert schema.guard(f.where("line_no = 3"), "frames").count() == 1
    out = [("a", 0.5, 0.5, "ATTACK", "", "v", None), ("b", 0.4, 0.5, "ATTACK", "", "v", None), ("c", float("nan"), 0.5, "ATTACK", "", "v", -1.0)]
    assert {(r["window_id"], r["rule"]) for r in schema.violations(spark.createDataFrame(out, schema.OUTPUTS), "outputs").collect()} >= {("b", "decision follows the score"), ("c", "score in 0..1"), ("c", "latency")}
    lab = [("a", True, None, None, None, 1, None), ("b", False, "x", None, None, 0, None), ("c", True, "x", None, (2.0, 1.0), 1, None), ("d", False, None, None, None, 0, None)]
    assert {(r["window_id"]) for r in schema.violations(spark.createDataFrame(lab, schema.LABELS), "labels").collect()} == {"a", "b", "c"}
    w = spark.createDataFrame([("x_attack", "c", 0, 1), ("x", "c", 2, 1), ("y", "c", 0, 1)], "window_id string, capture_id string, start_us long, end_us long")
    assert {r["window_id"] for r in schema.violations(w, "windows").collect()} == {"x_attack", "x"}


def test_fields(spark):
    f = frames(spark, [(0.1, "0D0", "0102"), (0.2, "0D0", ""), (0.3, "0D0", "05"), (1.5, "0D0", "00")])
    got = {(r["line_no"], r["field"]): r["value"] for r in features.fields(f).collect()}
    assert got[0, "pair0_be"] == 0x0102 and got[0, "pair0_le"] == 0x0201 and got[2, "byte0"] == 5 and (1, "byte0") not in got and (2, "byte1") not in got
    r = {x["field"]: (x["low"], x["high"], x["jump"]) for x in features.ranges(f).collect()}
    assert r["byte0"] == (0, 5, 5) and r["byte1"] == (2, 2, 0)


def normal(spark, capture="cap01", seconds=12, seed=0):
    rows = [(0.001 + k * 0.02 + ((seed * 7 + k * 3) % 5) * 0.0002, "0D0", f"{k % 200:02X}00000000000000") for k in range(seconds * 50)]
    rows += [(k * 0.05, "0F4", "0102030405060708") for k in range(seconds * 20)]
    return frames(spark, sorted(rows), capture)


@pytest.fixture(scope="module")
def detector(spark):
    train = normal(spark)
    return model.Detector(model.fit_stage1(train, S), 0.95, "v2", model.fit_stage2(train, S, ["0D0"]))


def test_stage1_and_stage2(spark, detector, tmp_path):
    base = [(r["t_us"] / S, r["can_id"], r["payload"]) for r in normal(spark, seconds=4, seed=3).collect()]
    foreign = frames(spark, sorted(base + [(1.1 + k * 0.05, "7FF", "FF") for k in range(10)]))
    got = {r["w"]: r for r in detector.score(foreign).collect()}
    assert got[1]["decision"] == "ATTACK" and "7FF" in got[1]["evidence"] and got[1]["evidence"].startswith("[Stage 1] unusual timing (unknown_ids)")
    assert got[1]["attack_score"] > max(got[0]["attack_score"], got[2]["attack_score"])
    wild = [(t, c, "FF" + p[2:] if c == "0D0" and 1 <= t < 2 else p) for t, c, p in base]
    one = {r["w"]: r["score_s1"] for r in model.score_stage1(frames(spark, wild), detector.stage1).collect()}
    assert one == {r["w"]: r["score_s1"] for r in model.score_stage1(frames(spark, base), detector.stage1).collect()}  # blind to payloads
    two = {r["w"]: r for r in model.score_stage2(frames(spark, wild), detector.stage2).collect()}
    assert two[1]["out_of_range"] > 0 and "0D0 byte0" in two[1]["range_at"] and two[1]["score_s2"] > 0.9
    held = [(t, c, "05" + p[2:] if c == "0D0" and 1 <= t < 2 else p) for t, c, p in base]
    two = {r["w"]: r for r in model.score_stage2(frames(spark, held), detector.stage2).collect()}
    assert two[1]["frozen_break"] > two[0]["frozen_break"] == 0 and two[1]["top_s2"] == "frozen_break"
    detector.save(str(tmp_path / "m"))
    again = model.load(spark, str(tmp_path / "m"), "v2")
    assert sorted(again.score(foreign).collect()) == sorted(detector.score(foreign).collect())
    with pytest.raises(ValueError):
        model.load(spark, str(tmp_path / "m"), "v1")
    with pytest.raises(Exception, match="exists"):
        detector.save(str(tmp_path / "m"))
    broken = model.Detector(detector.stage1, 0.1, "v9", model.Stage2(detector.stage2.fields.withColumn("low", F.raise_error(F.lit("lost")).cast("long")), detector.stage2.reference, 2, S))
    with pytest.raises(Exception, match="lost"):
        broken.save(str(tmp_path / "m"), overwrite=True)
    assert model.load(spark, str(tmp_path / "m")).version == "v2"  # a save that breaks off leaves the former model
    empty = {r["w"]: r["attack_score"] for r in detector.score(at(spark, 0.5, 2.5, 3.5)).collect()}
    assert set(empty) == {0, 1, 2}


def test_stage2_variants(spark):
    train = normal(spark)
    with pytest.raises(ValueError):
        model.fit_stage2(train, S, [])
    with pytest.raises(ValueError):
        model.fit_stage2(train, S, mode="other")
    with pytest.raises(ValueError):
        model.fit_stage1(at(spark, 0, 1.5), S)
    narrow = {r["field"]: r for r in model.fit_stage2(train, S, ["0D0"], "rate", 5.0).fields.collect()}
    assert narrow["byte0"]["bound_low"] > narrow["byte0"]["low"] and narrow["byte0"]["seen"] == 11 and narrow["byte1"]["constant"] == 11
    stats = features.ranges(train)
    a, b = model.fit_stage2(train, S, stats=stats), model.fit_stage2(train, S)
    assert sorted(a.fields.collect()) == sorted(b.fields.collect())


def scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "attack_score double")


def test_thresholds(spark):
    assert model.threshold_of(scores(spark, [0.1, 0.2, 0.3, 0.3]), 0.25) == math.nextafter(0.3, 1)
    assert model.threshold_of(scores(spark, [0.1, 0.2, 0.3, 0.4]), 0.25) == math.nextafter(0.3, 1)
    assert model.threshold_of(scores(spark, [0.1]), 1.0) == 0.0
    with pytest.raises(ValueError):
        model.threshold_of(scores(spark, [1.0, 1.0]), 0.0)
    with pytest.raises(ValueError):
        model.threshold_of(scores(spark, []), 0.1)
    b = calibrate.thresholds(scores(spark, [0.1, 0.2, 0.3, 0.3]).withColumn("g", F.lit(1)), ["g"], 0.25).first()
    assert b["boundary"] == 0.3


def test_band(spark):
    s = scores(spark, [0.1, 0.45, 0.5, 0.58, 0.9])
    assert calibrate.band_half_width(s, 0.5, 0.4) == pytest.approx(0.05) and calibrate.band_half_width(s, 0.5, 1.0) == 0.5
    with pytest.raises(ValueError):
        calibrate.band_half_width(s, 0.5, 0.1)
    assert calibrate.false_alarms(0, 0, 0.01, 1.0)["rate"] is None and calibrate.false_alarms(5, 763, 0.01, 1.0)["per_hour"] == 23.591


def outputs(spark, rows, t=0.5):
    return spark.createDataFrame([(f"w{i}", s, t, "ATTACK" if s >= t else "ACCEPT", "", "v", None) for i, (s, _) in enumerate(rows)], schema.OUTPUTS).withColumn("capture_id", F.lit("c"))


def truth(spark, rows):
    return spark.createDataFrame([(f"w{i}", a, "x" if a else None, None, None, int(a), None) for i, (_, a) in enumerate(rows)], schema.LABELS)


SIX = [(0.9, True), (0.1, False), (0.55, False), (0.45, True), (0.58, True), (0.2, True)]


def test_escalation_quality(spark):
    q = evaluate.escalation_quality(evaluate.evaluate(outputs(spark, SIX), truth(spark, SIX)), 0.1).first()
    assert (q["escalations"], q["escalated_errors"], q["local_errors"]) == (3, 2, 3)
    assert q["escalation_precision"] == pytest.approx(2 / 3) and q["escalation_recall"] == pytest.approx(2 / 3) and q["error_rate_outside_band"] == pytest.approx(1 / 3)
    assert [r["escalate"] for r in evaluate.escalations(outputs(spark, SIX), 0.1).orderBy("window_id").collect()] == [False, False, True, True, True, False]
    with pytest.raises(ValueError):
        evaluate.escalations(outputs(spark, SIX), 0.6)
    assert evaluate.sanitize(outputs(spark, SIX)).columns == list(evaluate.BUNDLE)


def test_metrics_without_denominator(spark):
    res = lambda rows: evaluate.metrics(evaluate.evaluate(outputs(spark, rows), truth(spark, rows))).first()
    none = evaluate.metrics(evaluate.evaluate(outputs(spark, SIX), truth(spark, SIX)).limit(0)).first()
    assert (none["tp"], none["recall"], none["f1"]) == (0, None, None)
    assert res([(0.1, False)])["recall"] is None and res([(0.9, True)])["false_alarm_rate"] is None
    missed = res([(0.1, True)])
    assert missed["recall"] == 0 and missed["precision"] is None


def test_strict_joins(spark):
    a, b = outputs(spark, SIX), truth(spark, SIX)
    with pytest.raises(ValueError, match="no label"):
        evaluate.evaluate(a, b.limit(5))
    with pytest.raises(ValueError, match="repeated"):
        evaluate.evaluate(a.union(a.limit(1)), b)
    with pytest.raises(ValueError, match="differ"):
        evaluate.compare_models(a, a, b)
    with pytest.raises(ValueError, match="trained"):
        evaluate.compare_models(a, a.withColumn("model_version", F.lit("u")), b, b.select("window_id").limit(1))


def test_delay(spark):
    rows = [(w, 0.9 if w in (2, 8) else 0.1, 8 <= w < 12) for w in range(14)]
    own = spark.createDataFrame([("c", w, "ATTACK" if s > 0.5 else "ACCEPT", a, "masquerade", w * S, (w + 1) * S, (8.0, 11.9) if a else None) for w, s, a in rows], "capture_id string, w long, decision string, is_attack boolean, kind string, start_us long, end_us long, injection_interval struct<start:double,end:double>")
    assert evaluate.detection_delay(own).first()["delay_s"] == 1.0
    miss = evaluate.detection_delay(own.withColumn("decision", F.lit("ACCEPT")))
    assert miss.first()["delay_s"] is None
    report = evaluate.delay_report(miss).first()
    assert (report["captures"], report["missed"], report["mean_delay_s"], report["p95_delay_s"]) == (1, 1, None, None)


def test_egress_and_actions(spark):
    rows = [("a", True, 10.0, True), ("b", True, 20.0, None), ("c", False, None, None), ("d", True, 30.0, False)]
    o = spark.createDataFrame(rows, "window_id string, escalated boolean, added_latency_ms double, corrected boolean")
    e = evaluate.egress(o).first()
    assert (e["escalations"], e["failed"], e["correction_rate"], e["mean_latency_ms"], e["p95_latency_ms"]) == (3, 1, 0.5, 20.0, 30.0)
    nothing = evaluate.egress(o.limit(0)).first()
    assert nothing["escalation_rate"] == 0.0 and nothing["correction_rate"] is None and nothing["p95_latency_ms"] is None
    assert schema.violations(o, "outcomes").count() == 0
    assert {r["action"]: r["n"] for r in evaluate.action_counts(evaluate.actions(outputs(spark, SIX), "SIMULATED_ISOLATION")).collect()} == {"SIMULATED_ALERT": 0, "SIMULATED_FORWARD": 3, "SIMULATED_ISOLATION": 3}
    said = evaluate.actions(outputs(spark, SIX)).where("window_id = 'w0'").first()["message"]
    assert said == "simulated, nothing was sent: SIMULATED_ALERT, window w0, score 0.90 against 0.50"
    assert evaluate.benchmark(spark.createDataFrame([], "latency_ms double")).first()["windows_per_s"] == 0.0
    show = spark.range(1).select(evaluate.display_outcome(F.lit("attack"), F.lit("ACCEPT")), evaluate.display_outcome(F.lit("normal"), F.lit("ATTACK")), evaluate.display_outcome(F.lit(None), F.lit("ATTACK"))).first()
    assert tuple(show) == ("missed", "false_alarm", None)


def test_attacks(spark):
    f = frames(spark, [(0.1, "0D0", "0100"), (0.2, "0D0", "0200"), (0.3, "0D0", "0100"), (0.4, "0F4", "FA"), (0.5, "0F4", "FA"), (1.5, "0D0", "00")])
    placed, spine = windows.assign(f, S), windows.spine(f, S)
    freeze, push = attacks.propose_freeze(placed, S), attacks.propose_offset(placed, S)
    assert freeze.first()["target_can_id"] == "0D0" and tuple(push.first()[c] for c in ("target_can_id", "byte_index", "offset")) == ("0D0", 1, 120)
    done = attacks.inject(placed, freeze, S).orderBy("line_no").collect()
    assert [r["payload"] for r in done] == ["0100", "0100", "0100", "FA", "FA"] and done[0]["attacked_window_id"] == "cap01_w0000_v01" and sum(r["changed"] for r in done) == 1
    done = attacks.inject(placed, push.withColumns({"target_can_id": F.lit("0F4"), "byte_index": F.lit(0)}), S).orderBy("line_no").collect()
    assert [r["payload"] for r in done] == ["0100", "0200", "0100", "FF", "FF"]
    check = lambda s, **k: tuple(attacks.validate(placed, spine, s, S, **k).first()[c] for c in ("valid", "reason", "matching", "changed"))
    assert check(freeze) == (True, "it changes frames", 3, 1)
    assert check(freeze, allowed=["0F4"])[1] == "this id may not be attacked"
    assert check(freeze.withColumn("target_can_id", F.lit("0F4"))) == (False, "all these payloads are equal already", 2, 0)
    assert check(freeze.withColumn("target_can_id", F.lit("123")))[1] == "no frame of the id in that time"
    assert check(freeze.withColumn("start_offset_ms", F.lit(1000.0)))[1] == "it would lie outside the window"
    assert check(push.withColumn("byte_index", F.lit(7)))[1].startswith("no byte there could move")
    assert check(freeze.withColumn("family", F.lit("other")))[1] == "no such kind of attack"
    assert schema.violations(push.withColumns({"attack_id": F.lit("a"), "reasoning": F.lit("")}), "specs").count() == 0
    assert {r["payload"] for r in attacks.freeze_id(f, "0D0", "AA").where("can_id = '0D0'").collect()} == {"AA"}
    ev = spark.createDataFrame([("a", "w1", "freeze", "0D0", 0.0, 1.0, 0.1, "v", "development"), ("b", "w1", "offset", "0F4", 0.0, 1.0, 0.1, "v", "development")], schema.EVASIONS)
    dev = spark.createDataFrame([("w1",)], "window_id string")
    assert [r[0] for r in attacks.hardening_set(ev, dev, "v").collect()] == ["w1"]
    with pytest.raises(ValueError):
        attacks.hardening_set(ev, dev, "other")
    assert {(r["target_can_id"], r["coverage_gap"]) for r in attacks.diagnose(ev, ["0d0"]).collect()} == {("0D0", 0), ("0F4", 1)}


def test_comparison_models(spark):
    import numpy as np

    f = mock_frames(spark, 40)
    assert windows.counted(f, S).where("w = 9").first()["n_ids"] == 4
    b = windows.bins(f, S, ["0D0"])
    assert b.count() == 390 and b.where("bin = 0").first()["log_watched"] > 0
    net = {"w1": np.ones((2, 3, 3)), "b1": np.zeros(2), "w2": np.ones((1, 2, 3)) * 0.1, "b2": np.zeros(1), "w3": np.ones(1) * 0.01, "b3": -1.0}
    got = ml.timing_net(b, net)
    assert got.count() == 39 and all(0 < r["attack_score"] < 1 for r in got.collect())
    x = np.random.default_rng(0).random((2, 3, 10))
    assert ml.convolve(x, net["w1"], net["b1"])[0, 0, 4] == pytest.approx(x[0, :, 3:6].sum())
    row = spark.createDataFrame([("w", *[0.123456] * 6)], "window_id string, " + ", ".join(f"{n} double" for n in ml.FEATURES))
    prompt = ml.prompts(row, spark.createDataFrame([("w", "b", 1.239), ("w", "a", 2.0)], "window_id string, signal string, value double"))
    text = prompt.first()["prompt"]
    assert "unknown_ids: 0.1235" in text and text.index("a: 2.0") < text.index("b: 1.24")
    said = ml.opinions(prompt, lambda p: ['{"attack_probability": 0.8, "reason": "r"}'] * len(p)).first()
    assert (said["attack_score"], said["evidence"]) == (0.8, "r")


def test_or_fusion(spark):
    a = outputs(spark, [(0.2, None), (0.6, None)])
    got = [r["attack_score"] for r in model.fused_or(a, outputs(spark, [(0.1, None), (0.1, None)], 0.0)).orderBy("window_id").collect()]
    assert got == [1.0, 1.0]
    got = [r["decision"] for r in model.fused_or(a, outputs(spark, [(0.1, None), (0.1, None)])).orderBy("window_id").collect()]
    assert got == ["ACCEPT", "ATTACK"]


def test_fingerprints(spark):
    f = frames(spark, [(0, "0D0", "00"), (1, "0D0", "01")])
    a = evaluate.fingerprint(f, ["capture_id"], "line_no")
    assert evaluate.fingerprint_changes(a, evaluate.fingerprint(f, ["capture_id"], "line_no")).count() == 0
    assert evaluate.fingerprint_changes(a, evaluate.fingerprint(attacks.freeze_id(f, "0D0", "FF"), ["capture_id"], "line_no")).count() == 1
