"""Shared sums, rank merge, selection, bands and cross-validation against plain Python and single fits."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from test_operators import S, normal
from testdata_folder import DATA
from tracewright.operators import calibrate, clean, crossval, evaluate, features, ml, model, ranks, sums, windows
from tracewright.operators.store import written
from tracewright.plans import queries

FRAMES = "capture_id string, line_no long, t_us long, can_id string, payload string"


def mixed(spark, n=2500, seed=2):
    """Frames whose payloads have 0 to 8 bytes."""
    r = random.Random(seed)
    return spark.createDataFrame([(f"c{r.randint(0, 2)}", i, r.randint(0, 9_000_000), r.choice(["0A1", "0B2"]), "".join("%02X" % r.choice([0, 5, 200, 255]) for _ in range(r.choice([0, 1, 2, 3, 3, 8])))) for i in range(n)], FRAMES)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sums_are_those_of_each_field_by_itself(spark):
    f = mixed(spark)
    placed = f.withColumn("w", F.expr(f"t_us div {S}"))
    each = features.fields(placed)
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("capture_id", "w", "can_id", "field").orderBy("t_us", "line_no")))
    want = each.withColumn("step", step).groupBy("capture_id", "w", "can_id", "field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("step").alias("jump"))
    table = written(sums.summed(placed), "sums")
    assert same(sums.per_field(table).select(*want.columns), want)
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("capture_id", "can_id", "field").orderBy("t_us", "line_no")))
    want = features.fields(f).withColumn("step", step).groupBy("capture_id", "can_id", "field").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.coalesce(F.max("step"), F.lit(0)).alias("jump"))
    assert same(sums.ranges(table), want)
    assert same(sums.per_id(table), features.per_id(placed).select(*sums.per_id(table).columns))
    gaps = features.gaps(placed).groupBy("capture_id", "w", "can_id", "gap_us").agg(F.count(F.lit(1)).alias("n"))
    assert same(sums.gaps(table), gaps)
    assert same(sums.spine(table, S), windows.spine(f, S)) and sums.of_frames(f.limit(0), S).count() == 0


def test_ranges_make_no_row_for_a_gap(spark):
    f = mixed(spark)
    whole, short = sums.of_frames(f, S), sums.of_frames(f, S, times=False)
    assert same(short, whole.where(F.col("field") != sums.GAP)) and sums.gaps(whole).count() > 0 == sums.gaps(short).count()
    # However long the parts are, and however many gaps differ, the ranges are the same.
    assert same(features.ranges(f, 9 * S), features.ranges(f, S // 10)) and same(features.ranges(f), sums.ranges(whole))


def test_frames_are_sorted_once(spark):
    plan = sums.of_frames(mixed(spark, 10), S)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "SortAggregate" not in plan


def test_medians_of_all_models_are_percentiles(spark):
    r = random.Random(6)
    counts = {}
    for _ in range(2000):
        k = (f"c{r.randrange(5)}", f"i{r.randrange(3)}", int(r.expovariate(1 / 10 ** r.randrange(1, 9))))
        counts[k] = counts.get(k, 0) + r.randrange(1, 4)
    counts |= {("c0", "z", 0): 1, ("c1", "z", 2**50): 1, ("c0", "y", 7): 5}
    values = spark.createDataFrame([(*k, n) for k, n in counts.items()], "unit string, id string, value long, n long")
    train = spark.createDataFrame([(f"m{i}", f"c{j}") for i in range(5) for j in range(5) if i != j], "model string, unit string")
    want = train.join(values, "unit").groupBy("model", "id").agg(F.percentile("value", 0.5, F.col("n")).alias("median"))
    assert same(ranks.medians(values, train, "unit", "id"), want) and ranks.medians(values.limit(0), train, "unit", "id").count() == 0


def test_rank_merge_counts_what_is_below(spark):
    r = random.Random(4)
    refs = [(g, float(r.choice([0, 0, 1, 1.5, r.random() * 9]))) for g in "ab" for _ in range(400)]
    values = [(g, float(x)) for g in "abc" for x in [-1, 0, 1, 1.5, 100, *[r.random() * 9 for _ in range(50)]]]
    got = ranks.below(spark.createDataFrame(values, "g string, value double"), ranks.counted(spark.createDataFrame(refs, "g string, value double"), ["g"]), ["g"]).collect()
    at = {(x["g"], x["value"]): (x["below"], x["n"], x["most"]) for x in got}
    for g, v in values:
        own = sorted(y for h, y in refs if h == g)
        assert at.get((g, v)) == ((bisect.bisect_left(own, v), len(own), own[-1]) if own else None)


def test_selection_is_the_kth_highest(spark):
    r = random.Random(6)
    for values in ([0.5], [0.1] * 9, [r.random() for _ in range(300)], [r.choice([0.1, 0.1 + 1e-16, math.nextafter(0.1, 1), 1.0, 0.0]) for _ in range(200)]):
        df = spark.createDataFrame([(x,) for x in values], "attack_score double")
        for k in {1, 2, len(values) // 2, len(values)} - {0}:
            if k <= len(values):
                assert calibrate.selected(df, k) == sorted(values, reverse=True)[k - 1]


def test_threshold_errors(spark):
    ones = spark.createDataFrame([(1.0,)] * 5, "attack_score double")
    assert calibrate.boundary(ones, 0.1) == 1.0
    with pytest.raises(ValueError, match="more alarms"):
        model.threshold_of(ones, 0.1)
    assert model.threshold_of(ones, 1.0) == 0.0
    with pytest.raises(ValueError, match="no normal"):
        model.threshold_of(ones.limit(0), 0.1)


def test_bands_are_counted_exactly_at_their_edges(spark):
    r = random.Random(8)
    scores = [r.choice([i / 20 for i in range(21)]) for _ in range(150)] + [0.3 - 0.05, 0.3 + 0.05, 0.1 + 0.2]
    for t in (0.3, 0.0, 1.0, 0.55):
        got = {x["width"]: x["m"] for x in calibrate.band_counts(spark.createDataFrame([(x,) for x in scores], "attack_score double"), t).collect()}
        widths = {0.0, 0.5} | {min(0.5, abs(s - t)) for s in scores}
        assert got == {w: sum(max(0.0, t - w) <= s <= min(1.0, t + w) for s in scores) for w in widths}


def test_order_is_checked_across_blocks(spark):
    r = random.Random(9)
    rows = [("c", i * 3, r.randint(0, 50) if i % 40 == 39 else i, "0A1", "") for i in range(400)]
    f = spark.createDataFrame(rows, FRAMES)
    want = {(b[1], b[2], a[2]) for a, b in zip(rows, rows[1:]) if b[2] < a[2]}
    for lines in (1, 7, 64, 100_000):
        assert {(x["line_no"], x["t_us"], x["previous_us"]) for x in clean.order_violations(f, lines).collect()} == want


def test_leave_one_out_is_that_of_single_fits(spark):
    f = normal(spark, "cap01", 8, 1).union(normal(spark, "cap02", 7, 2)).union(normal(spark, "cap03", 9, 3))
    got = {(x["outer"], x["version"]): (x["boundary"], x["alarms"], x["windows"]) for x in crossval.leave_one_out(f, S, 0.1).collect()}
    names, far = ["cap01", "cap02", "cap03"], 0.1

    def scored(train, test):
        own = lambda c: f.where(F.col("capture_id").isin(c))
        detector = model.Detector(model.fit_stage1(own(train), S), 1.0, "v", model.fit_stage2(own(train), S))
        raw = detector.raw(own([test])).select("score_s1", "attack_score").collect()
        return [x["score_s1"] for x in raw], [x["attack_score"] for x in raw]

    outer = "cap02"
    rest = [n for n in names if n != outer]
    inner = [scored([n for n in rest if n != i], i) for i in rest]
    held = scored(rest, outer)
    for k, v in enumerate(("v1", "v2")):
        oof = sorted((s for i in inner for s in i[k]), reverse=True)
        boundary = oof[math.floor(far * len(oof))]
        assert got[outer, v] == (pytest.approx(boundary), sum(s > boundary for s in held[k]), len(held[k]))
    summary = crossval.false_alarms(crossval.leave_one_out(f, S, far), far, S)
    assert summary["v1"]["windows"] == 21 and 0 <= summary["v2"]["upper_95"] <= 1
    with pytest.raises(ValueError, match="three captures"):
        crossval.leave_one_out(f.where("capture_id <> 'cap03'"), S, far)


def attack_case(spark):
    """Two train drives, a validation drive, and two folds whose attacks hold another id still."""
    f = None
    for i, c in enumerate(("cap01", "cap02", "cap03", "cap04", "cap05")):
        one = normal(spark, c, 9, i + 1)
        if c in ("cap04", "cap05"):
            target = "0D0" if c == "cap04" else "0F4"
            one = one.withColumn("payload", F.when((F.col("can_id") == target) & F.col("t_us").between(3 * S, 6 * S - 1), "FFFFFFFFFFFFFFFF").otherwise(F.col("payload")))
        f = one if f is None else f.union(one)
    rows = [("cap01", "train", None, None, "ambient", None), ("cap02", "train", None, None, "ambient", None), ("cap03", "validation", None, None, "ambient", None), ("cap04", "development", 1, "a", "fabrication", "0D0"), ("cap05", "development", 2, "b", "masquerade", "0F4")]
    captures = spark.createDataFrame(rows, "capture_id string, `group` string, fold int, family string, kind string, target string")
    table = written(sums.of_frames(f, S), "sums")
    labels = sums.spine(table, S).withColumn("is_attack", F.col("capture_id").isin("cap04", "cap05") & F.col("w").between(3, 5))
    return f, table, captures, labels


def test_attack_cv_fits_each_fold(spark):
    f, table, captures, labels = attack_case(spark)
    got = {(x["fold"], x["version"]): x for x in crossval.attack_cv(table, captures, labels, S, 0.1).collect()}
    assert {k: (x["attacked"], x["normal"]) for k, x in got.items()} == {(1, "v1"): (3, 5), (1, "v2"): (3, 5), (2, "v1"): (3, 0), (2, "v2"): (3, 0)}
    own = lambda *c: f.where(F.col("capture_id").isin(*c))
    one = model.fit_stage1(own("cap01", "cap02"), S)
    for fold, held, watch in ((1, "cap04", ["0F4"]), (2, "cap05", ["0D0"])):
        detector = model.Detector(one, 1.0, "v2", model.fit_stage2(own("cap01", "cap02"), S, watch))
        validation = sorted((x["attack_score"] for x in detector.raw(own("cap03")).collect()), reverse=True)
        boundary = validation[math.floor(0.1 * len(validation))]
        assert got[fold, "v2"]["boundary"] == pytest.approx(boundary)
        hits = [x["w"] for x in detector.raw(own(held)).where(F.col("attack_score") > boundary).collect()]
        assert got[fold, "v2"]["detected"] == sum(3 <= w <= 5 for w in hits)
    with pytest.raises(ValueError, match="two folds"):
        crossval.attack_cv(table, captures.where("fold is null or fold = 1"), labels, S, 0.1)


def plain_newton(x, y, rounds=200):
    """A single regression with balanced classes and penalty ||w||^2 / 2, the bias free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.array([1.0] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w) * 0.5
    return w


def test_folds_fitted_together_are_single_fits(spark):
    r = np.random.default_rng(3)
    data = {}
    for m in ("1", "2", "3"):
        x = r.random((120, 6)) * [1, 10, 1, 0.1, 3, 1]
        data[m] = x, (x @ [1, 0.3, -2, 4, 0, 1] + r.normal(0, 1, 120) > 1.5).astype(float)
    rows = [(m, bool(t), *map(float, v)) for m, (x, y) in data.items() for v, t in zip(x, y)]
    table = spark.createDataFrame(rows, "model string, is_attack boolean, " + ", ".join(f"{n} double" for n in ml.FEATURES))
    got = ml.fit_folds(table)
    for m, (x, y) in data.items():
        assert np.allclose(got[m], plain_newton(x, y), atol=1e-6)
    with pytest.raises(ValueError, match="both classes"):
        ml.fit_folds(table.where("is_attack"))


def test_logistic_cv_counts_each_capture(spark):
    _, table, captures, labels = attack_case(spark)
    detector = model.fit_stage2(None, S, table=table.where("capture_id in ('cap01', 'cap02')"))
    stage1 = model.fit_stage1(None, S, table=table.where("capture_id in ('cap01', 'cap02')"))
    own, spine = sums.complete(table), sums.spine(table, S)
    vectors = ml.vectors(features.timing(sums.per_id(own), spine, stage1.ids, 1.0), features.payload(sums.per_field(own), spine, detector.fields))
    got = {x["fold"]: x for x in ml.logistic_cv(vectors, labels, captures, 0.1).collect()}
    assert {k: (x["attacked"], x["normal"]) for k, x in got.items()} == {1: (3, 5), 2: (3, 0)} and all(x["detected"] >= 2 for x in got.values())
    with pytest.raises(ValueError, match="must be normal"):
        ml.logistic_cv(vectors, labels.withColumn("is_attack", F.lit(True)), captures, 0.1)


def test_fingerprint_trees(spark):
    f = mixed(spark, 600)
    leaf = F.expr(f"t_us div {S}")
    tree = lambda x: written(evaluate.fingerprint_tree(evaluate.fingerprint_leaves(x, ["capture_id"], leaf, "line_no"), ["capture_id"]), "tree")
    a, b = tree(f), tree(f.withColumn("payload", F.when(F.col("line_no").isin(5, 77), "00FF").otherwise(F.col("payload"))))
    changed = {(x["capture_id"], x["t_us"] // S) for x in f.where("line_no in (5, 77)").collect()}
    assert {(x["capture_id"], x["leaf"]) for x in evaluate.tree_changes(a, b, ["capture_id"]).collect()} == changed
    assert evaluate.tree_changes(a, a, ["capture_id"]).count() == 0
    tops = evaluate.fingerprint(f, ["capture_id"], "line_no", leaf)
    assert {x["capture_id"] for x in evaluate.fingerprint_changes(tops, evaluate.fingerprint(f.where("line_no <> 9"), ["capture_id"], "line_no", leaf)).collect()} == {x["capture_id"] for x in f.where("line_no = 9").collect()}
    assert evaluate.fingerprint(f.limit(0), ["capture_id"], "line_no").count() == 0


def test_tall_trees(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "FAN", 3)
    rows = spark.range(200).select(F.lit("c").alias("capture_id"), F.col("id").alias("line_no"))
    leaves = lambda x: evaluate.fingerprint_leaves(x, ["capture_id"], F.col("line_no"), "line_no")
    a, b = (written(evaluate.fingerprint_tree(leaves(x), ["capture_id"]), "tree") for x in (rows, rows.where("line_no not in (0, 121)")))
    assert a.agg(F.max("level")).first()[0] == 5 and {x["leaf"] for x in evaluate.tree_changes(a, b, ["capture_id"]).collect()} == {0, 121}


def test_quota_stops_reading(spark):
    f = normal(spark, "cap01", 5, 1).union(normal(spark, "cap02", 6, 2)).union(normal(spark, "cap03", 9, 3))
    assert windows.quota(f, S, ["cap02", "cap01", "cap03"], 7) == {"cap02": 5, "cap01": 2}
    got = windows.real(f, S, ["cap02", "cap01", "cap03"], 7).orderBy("place").collect()
    assert [(x["capture_id"], x["w"]) for x in got] == [("cap02", w) for w in range(5)] + [("cap01", 0), ("cap01", 1)]
    assert windows.real(f, S, ["cap03"]).count() == 8
    with pytest.raises(ValueError, match="no captures"):
        windows.real(f, S, [])
    with pytest.raises(ValueError, match="no window"):
        windows.real(f, S, ["cap99"])


def test_attack_folds_do_not_read_all_frames_for_their_captures(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(crossval, "attack_cv", lambda table, captures, *rest: seen.append(captures) or captures)
    queries._attack_rows(queries.Tables(spark, DATA))
    assert seen[0].count() > 0 and not [f for f in seen[0].inputFiles() if "events" in f]
