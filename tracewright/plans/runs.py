"""Whole runs: training, ordinary detection, red-team tests and the final comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tracewright.operators import attacks, calibrate, evaluate, labels, model, windows

#: Variants of the second detector: mode of the frozen check, percentile of the bounds.
VARIANTS = {"v2": ("width", None), "v3": ("rate", None), "v4": ("width", 1.0), "v5": ("width", None)}


def train(frames: DataFrame, validation: DataFrame, us: int, far: float, version: str = "v1", watch: list[str] | None = None, stage1: model.Stage1 | None = None, every: int = 1) -> model.Detector:
    """A detector from normal frames, its threshold from validation frames alone. v1 has Stage 1 only; the others reuse
    the Stage 1 they are given and add Stage 2 of their variant."""
    one = stage1 or model.fit_stage1(frames, us, every)
    two = None
    if version != "v1":
        mode, percent = VARIANTS[version]
        two = model.fit_stage2(frames, us, watch, mode, percent, every)
    detector = model.Detector(one, 1.0, version, two)
    detector.threshold = model.threshold_of(detector.raw(validation), far)
    return detector


def overlap(training: DataFrame, held_out: DataFrame) -> DataFrame:
    """Windows that are in both and must not be."""
    return training.select("window_id").intersect(held_out.select("window_id"))


@dataclass
class Ordinary:
    outputs: DataFrame
    actions: DataFrame
    action_counts: DataFrame
    escalations: DataFrame
    advice: DataFrame
    egress: DataFrame


def ordinary(frames: DataFrame, detector: model.Detector, half_width: float | None = None, validation: DataFrame | None = None, max_rate: float = 0.05) -> Ordinary:
    """Detection with responses and, for uncertain windows, a second opinion on a cut-down bundle.

    Without half_width the band comes from validation frames' scores, at most max_rate of which may escalate.
    """
    if half_width is None:
        half_width = calibrate.band_half_width(detector.raw(validation), detector.threshold, max_rate) if validation is not None else 0.0
    outputs = detector.score(frames)
    done = evaluate.actions(outputs)
    up = evaluate.escalations(outputs, half_width)
    advice = evaluate.second_opinion(evaluate.sanitize(up.where("escalate")))
    answered = up.join(advice, "window_id", "left").select("window_id", F.col("escalate").alias("escalated"), F.when(F.col("escalate"), 0.0).alias("added_latency_ms"), F.when(F.col("advice").isNotNull(), F.col("advice") != "confirm").alias("corrected"))
    return Ordinary(outputs, done, evaluate.action_counts(done), up, advice, evaluate.egress(answered))


@dataclass
class RedTeam:
    results: DataFrame
    proposed: DataFrame
    metrics: DataFrame
    by_family: DataFrame
    evasions: DataFrame
    quality: DataFrame


def attacked_frames(placed: DataFrame, specs: DataFrame, us: int, family: str, variant: int) -> DataFrame:
    """The attacked copies of windows as frames of captures of their own: the capture's id with the family's variant."""
    done = attacks.inject(placed, specs, us, variant)
    return done.select(F.format_string(f"%s_v{variant:02d}", "capture_id").alias("capture_id"), "line_no", "t_us", "can_id", "payload", F.lit(family).alias("family"))


def red_team(frames: DataFrame, detector: model.Detector, half_width: float, real_labels: DataFrame | None = None) -> RedTeam:
    """Every window of development frames as it is, and with each attack that can be proposed for it, scored and evaluated.

    The untouched windows count as normal, however they were recorded; real_labels (window_id, is_attack, family) gives
    them their own labels instead. A window in which nothing can be attacked has no attacked copy.
    """
    us = detector.stage1.window_us
    placed = windows.assign(frames, us)
    specs = {"freeze": attacks.propose_freeze(placed, us), "offset": attacks.propose_offset(placed, us)}
    out = detector.score(frames).select("window_id", "capture_id", "w", "attack_score", "threshold", "decision", "evidence", "model_version", "latency_ms")
    normal = out.select("window_id", F.lit(False).alias("is_attack"), F.lit(None).cast("string").alias("family")) if real_labels is None else real_labels.select("window_id", "is_attack", "family")
    proposed = None
    # A frame behind the last window keeps a copy's windows whole: a capture's last window is never scored.
    end = frames.groupBy("capture_id").agg(F.max("t_us").alias("t_us"), F.max("line_no").alias("line_no"))
    for variant, (family, spec) in enumerate(specs.items(), 1):
        valid = attacks.validate(placed, windows.spine(frames, us), spec, us).where("valid").select("window_id", F.lit(family).alias("family"))
        copies = attacked_frames(placed, spec, us, family, variant).drop("family")
        tail = end.select(F.format_string(f"%s_v{variant:02d}", "capture_id").alias("capture_id"), "line_no", "t_us", F.lit("000").alias("can_id"), F.lit("").alias("payload"))
        scored = detector.score(copies.unionByName(tail))
        # Windows of the copy that were not attacked are empty in it and are no cases.
        name = F.format_string(f"%s_w%04d_v{variant:02d}", F.regexp_replace("capture_id", "_v\\d\\d$", ""), "w")
        cases = scored.withColumns({"base": F.format_string("%s_w%04d", F.regexp_replace("capture_id", "_v\\d\\d$", ""), "w"), "window_id": name})
        cases = cases.join(valid.withColumnRenamed("window_id", "base"), "base")
        out = out.unionByName(cases.select(*out.columns))
        normal = normal.unionByName(cases.select("window_id", F.lit(True).alias("is_attack"), "family"))
        counts = spec.agg(F.lit(family).alias("family"), F.count(F.lit(1)).alias("proposed"))
        proposed = counts if proposed is None else proposed.union(counts)
    results = evaluate.evaluate(out, normal, strict=False)
    missed = results.where("outcome = 'FN'").select(F.concat(F.lit("atk_"), "window_id").alias("attack_id"), "window_id", "family", "attack_score", "model_version", F.lit("development").alias("split"))
    return RedTeam(results, proposed, evaluate.metrics(results), evaluate.metrics(results.where("is_attack"), ["family"]), missed, evaluate.escalation_quality(results, half_width))


def final_comparison(frames: DataFrame, rules: DataFrame, baseline: model.Detector, updated: model.Detector, training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rates of both, delays of both) on held-back frames; an error if their windows were trained on."""
    us = baseline.stage1.window_us
    marks = labels.window_labels(frames, rules, us)
    a, b = baseline.score(frames), updated.score(frames)
    rates = evaluate.compare_models(a, b, marks, training)
    spine = windows.spine(frames, us).select("window_id", "start_us", "end_us")
    both = a.unionByName(b).join(marks.select("window_id", "kind", "is_attack", "injection_interval"), "window_id").join(spine, "window_id")
    delays = None
    for d in (baseline, updated):
        one = evaluate.detection_delay(both.where(F.col("model_version") == d.version)).withColumn("model_version", F.lit(d.version))
        delays = one if delays is None else delays.union(one)
    return rates, delays


def check_development(frames: DataFrame, rules: DataFrame, detectors: list[model.Detector]) -> DataFrame:
    """Attacked, detected, normal and false alarms by capture and version, with totals where these are NULL."""
    us = detectors[0].stage1.window_us
    marks = labels.without_twins(labels.window_labels(frames, rules, us)).select("window_id", "is_attack")
    every = None
    for d in detectors:
        one = d.score(frames)
        every = one if every is None else every.unionByName(one)
    return development_totals(every, marks)


def development_totals(outputs: DataFrame, marks: DataFrame) -> DataFrame:
    """The counts of check_development() from outputs of any versions and labels (window_id, is_attack)."""
    alarm, attack = F.col("decision") == "ATTACK", F.col("is_attack")
    return outputs.join(marks.select("window_id", "is_attack"), "window_id").rollup("model_version", "capture_id").agg(F.count_if(attack).alias("attacked"), F.count_if(attack & alarm).alias("detected"), F.count_if(~attack).alias("normal"), F.count_if(~attack & alarm).alias("false_alarms"))


def firing(scored: DataFrame, stage: int, n: int, most: int = 5) -> DataFrame:
    """Of windows scored by a stage, those beyond all n training windows: how many by check, and the most frequent causes."""
    over = scored.where(F.col(f"score_s{stage}") > n / (n + 1))
    return over.groupBy(F.col(f"top_s{stage}").alias("check"), F.col(f"evidence_s{stage}").alias("evidence")).count().orderBy(F.desc("count"), F.desc("evidence")).limit(most)
