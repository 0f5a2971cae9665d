"""Registered queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright import schema
from tracewright.functions import ids as fn, quantiles
from tracewright.operators import attacks, calibrate, clean, crossval, decode, evaluate, features, labels, ml, model, ranks, sums, windows
from tracewright.operators.store import written
from tracewright.plans import runs
from tracewright.plans.oracle import ATTACK_CV, DETECTOR, LOCO, US, sql
from tracewright.sources import logs
from tracewright.sources.tables import EVENT_WINDOW_US, event_captures, event_frames, event_roles, mock_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
assert US == EVENT_WINDOW_US


@dataclass
class Tables:
    """The event table as frames, and what queries share, each built when it is first asked for."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def frames(self) -> DataFrame:
        return event_frames(self.spark, self.sf_dir)

    @cached_property
    def captures(self) -> DataFrame:
        return event_captures(self.frames)

    @cached_property
    def sums(self) -> DataFrame:
        """Every window's sums, from one sort of the frames, written once; all checks read them."""
        return written(sums.of_frames(self.frames, US), "sums")

    @cached_property
    def spine(self) -> DataFrame:
        return windows.spine(self.frames, US)

    @cached_property
    def all_windows(self) -> DataFrame:
        return sums.spine(self.sums, US)

    @cached_property
    def placed(self) -> DataFrame:
        return windows.assign(self.frames, US)

    def of(self, df: DataFrame, where: str) -> DataFrame:
        """The rows of the captures with a role. Roles follow from a capture's number, so no frame is read for them."""
        roles = {k: c for k, c in event_roles(F.col("capture_id")).items() if k not in df.columns}
        return df.withColumns(roles).where(where).drop(*roles)

    @cached_property
    def normal(self) -> DataFrame:
        """The timing model of the train captures without one id, so that scoring meets an unknown one."""
        n = self.of(self.all_windows, "`group` = 'train'").count()
        return model.normal_ids(self.of(sums.complete(self.sums), "`group` = 'train'").where("can_id <> '0A0'"), n, US)

    @cached_property
    def timing(self) -> DataFrame:
        return features.timing(sums.per_id(sums.complete(self.sums)), self.all_windows, self.normal, US / 1e6)

    @cached_property
    def fields2(self) -> DataFrame:
        some = self.of(self.sums, "`group` = 'train' and fold = 1")
        return model.field_model(sums.ranges(some), sums.per_field(sums.complete(some)))

    def payload(self, mode: str) -> DataFrame:
        return features.payload(sums.per_field(sums.complete(self.sums)), self.all_windows, self.fields2, mode)

    @cached_property
    def labels(self) -> DataFrame:
        return labels.window_labels(self.frames, self.captures, US)

    @cached_property
    def outputs(self) -> DataFrame:
        """A plain score, a window's share of errors, as outputs to evaluate."""
        share = self.placed.groupBy("capture_id", "w").agg((F.count_if(F.col("can_id") == "0E0") / F.count(F.lit(1))).alias("e"))
        own = self.spine.join(share, ["capture_id", "w"], "left").withColumn("attack_score", F.coalesce("e", F.lit(0.0))).withColumn("evidence", F.lit(""))
        return model.decide(own, 0.25, "plain").join(self.spine.select("window_id", "start_us", "end_us"), "window_id")

    @cached_property
    def results(self) -> DataFrame:
        return evaluate.evaluate(self.outputs, self.labels, strict=False)


def query(oracle: str | None = None, *tables: str):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *tables)
        return f

    return add


def r(c: str | Column, digits: int = 9) -> Column:
    """A rounded double under its own name, for comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(c if isinstance(c, str) else "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten windows in which a known sender is farthest above its normal rate."""
    top = Tables(spark, sf_dir).timing.select("window_id", r("rate_excess"), "rate_id")
    return top.orderBy(F.desc("rate_excess"), "window_id").limit(10)


# --- sources and cleaning ---


@query("SELECT capture_id, line_no, t_us, can_id, payload FROM frames", "frames")
def s1_frames(t):
    return t.frames


@query("SELECT capture_id, count(*) AS frames, 0 AS skipped_lines, round((max(t_us)) / 1e6, 6) AS duration_s, count(DISTINCT can_id) AS unique_ids, CASE WHEN max(t_us) > 0 THEN round(count(*) / (max(t_us) / 1e6), 1) ELSE 0.0 END AS msg_per_sec FROM frames GROUP BY capture_id", "frames")
def s6_profile(t):
    lines = t.frames.select(F.col("capture_id").alias("capture"), F.row_number().over(Window.partitionBy("capture_id").orderBy("t_us", "line_no")).alias("line_no"), F.lit("x").alias("value"), F.lit("").alias("ts_text"), F.col("t_us").alias("abs_us"), "can_id", "payload")
    return logs.profile(lines).select(F.col("capture").alias("capture_id"), "frames", F.lit(0).alias("skipped_lines"), "duration_s", "unique_ids", "msg_per_sec")


@query("SELECT capture_id, max(t_us) AS span_us FROM frames GROUP BY capture_id", "frames")
def s4_span(t):
    lines = t.frames.select(F.col("capture_id").alias("capture"), F.col("t_us").alias("line_no"), F.lit("").alias("ts_text"), F.col("t_us").alias("abs_us"))
    return logs.spans(lines).select(F.col("capture").alias("capture_id"), "span_us")


@query("""SELECT id AS w, sum(n)::BIGINT AS n_frames FROM (SELECT r.range AS id, CASE WHEN r.range % 10 = 9 THEN 180 ELSE 170 END AS n FROM range(200) r) GROUP BY id HAVING id < 199""")
def s12_mock_traffic(t):
    frames = mock_frames(t.spark, 200)
    return windows.counted(frames, 1_000_000).select("w", "n_frames")


@query("SELECT capture_id, min(line_no) AS line_no, t_us, can_id, payload FROM (SELECT * FROM frames UNION ALL SELECT capture_id, line_no + 1000000000, t_us, can_id, payload FROM frames WHERE line_no % 97 = 0) GROUP BY ALL", "frames")
def w1_dedup(t):
    return clean.dedup(_repeated(t.frames))


def _repeated(frames: DataFrame) -> DataFrame:
    again = frames.where("line_no % 97 = 0").withColumn("line_no", F.col("line_no") + 1_000_000_000)
    return frames.unionByName(again)


@query("SELECT capture_id, line_no, t_us, previous_us FROM (SELECT capture_id, o AS line_no, t_us, lag(t_us) OVER (PARTITION BY capture_id ORDER BY o) AS previous_us FROM (SELECT *, 2 * CASE WHEN line_no % 10 = 3 THEN line_no + 40 ELSE line_no END + line_no % 2 AS o FROM frames)) WHERE t_us < previous_us", "frames")
def w2_order_violations(t):
    line = F.expr("2 * case when line_no % 10 = 3 then line_no + 40 else line_no end + line_no % 2")
    return clean.order_violations(t.frames.withColumn("line_no", line))


@query("SELECT capture_id, count(*) + count(*) FILTER (line_no % 97 = 0) AS read, count(*) AS kept, count(*) FILTER (line_no % 97 = 0) AS duplicates, 0 AS skipped_lines, 0 AS filler, round(count(*) FILTER (line_no % 97 = 0) / (count(*) + count(*) FILTER (line_no % 97 = 0)), 8) AS removed_fraction FROM frames GROUP BY capture_id", "frames")
def w4_cleaning_report(t):
    many = _repeated(t.frames)
    return clean.report(many, clean.dedup(many))


@query("SELECT capture_id FROM frames GROUP BY capture_id HAVING count(*) FILTER (line_no % 97 = 0) > 0.001 * (count(*) + count(*) FILTER (line_no % 97 = 0))", "frames")
def w4_cleaning_gate(t):
    many = _repeated(t.frames)
    return clean.gate(clean.report(many, clean.dedup(many))).select("capture_id")


@query("SELECT s.capture_id, s.w, s.window_id, s.start_us, s.end_us, count(p.line_no) AS n_frames, count(DISTINCT p.can_id) AS n_ids FROM spine s LEFT JOIN placed p USING (capture_id, w) GROUP BY ALL", "spine", "placed")
def w5_windows_with_spine(t):
    return windows.counted(t.frames, US)


@query("SELECT window_id FROM spine WHERE w % 3 = 0", "spine")
def w6_keep_every(t):
    return windows.spine(t.frames, US, 3).select("window_id")


@query("SELECT capture_id, greatest(1, ceil((max(t_us) // 21600000000) / 50))::BIGINT AS every FROM frames GROUP BY capture_id", "frames")
def f9_keep_every(t):
    return t.frames.groupBy("capture_id").agg(windows.keep_every(F.max("t_us"), US, 50).alias("every"))


@query("SELECT s.window_id, b.range::INT AS bin, round(ln(1 + coalesce(n, 0)), 9) AS log_frames, round(ln(1 + coalesce(ids, 0)), 9) AS log_ids, round(ln(1 + coalesce(watched, 0)), 9) AS log_watched FROM spine s CROSS JOIN range(10) b LEFT JOIN (SELECT capture_id, w, least(9, (t_us - w * 21600000000) // 2160000000) AS bin, count(*) AS n, count(DISTINCT can_id) AS ids, count(*) FILTER (can_id IN ('0E0', '0B0')) AS watched FROM placed GROUP BY ALL) x ON x.capture_id = s.capture_id AND x.w = s.w AND x.bin = b.range", "spine", "placed")
def w12_bins(t):
    return windows.bins(t.frames, US, ["0E0", "0B0"]).select("window_id", "bin", r("log_frames"), r("log_ids"), r("log_watched"))


# --- labels ---


@query("SELECT capture_id, line_no, can_id = target AND t_us BETWEEN lo_us AND hi_us AS injected FROM frames JOIN captures USING (capture_id)", "frames", "captures")
def p5_injected_frames(t):
    return labels.injected(t.frames, t.captures).select("capture_id", "line_no", "injected")


@query("SELECT capture_id, line_no, regexp_matches(payload, '^..[0-9A-F]F..$') AS fits FROM frames", "frames")
def p6_mask_match(t):
    return t.frames.select("capture_id", "line_no", fn.mask_match(F.col("payload"), F.lit("XXXFXX")).alias("fits"))


@query("SELECT window_id, is_attack, family, injected_frames, start_s, interval_overlap_s FROM labels", "labels")
def a2_window_labels(t):
    return t.labels.select("window_id", "is_attack", "family", "injected_frames", F.col("injection_interval.start").alias("start_s"), "interval_overlap_s")


@query("SELECT window_id FROM labels WHERE is_attack", "labels")
def p12_without_twins(t):
    return labels.without_twins(t.labels).select("window_id")


# --- timing features and stage 1 ---


@query("SELECT capture_id, w, can_id, n, min_gap_us FROM perid", "perid")
def a1_frames_per_id(t):
    return features.per_id(t.placed).select("capture_id", "w", "can_id", "n", "min_gap_us")


@query("SELECT can_id, round(rate, 12) AS rate FROM normal", "normal")
def a3_normal_rate(t):
    return t.normal.select("can_id", r("rate", 12))


@query("SELECT can_id, round(median_gap, 6) AS median_gap FROM normal", "normal")
def a4_median_gap(t):
    return t.normal.select("can_id", r("median_gap", 6))


@query("SELECT DISTINCT can_id FROM frames", "frames")
def a5_known_ids(t):
    return t.frames.select("can_id").distinct()


@query("SELECT window_id, unknown_ids FROM timing", "timing")
def a6_unknown_ids(t):
    return t.timing.select("window_id", "unknown_ids")


@query("SELECT window_id, round(rate_excess, 9) AS rate_excess FROM timing", "timing")
def a7_rate_excess(t):
    return t.timing.select("window_id", r("rate_excess"))


@query("SELECT window_id, round(short_gaps, 6) AS short_gaps FROM timing", "timing")
def a8_short_gaps(t):
    return t.timing.select("window_id", r("short_gaps", 6))


@query("SELECT capture_id, line_no, t_us - lag(t_us) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS gap_us FROM placed QUALIFY gap_us IS NOT NULL", "placed")
def n1_gaps(t):
    return features.gaps(t.placed).select("capture_id", "line_no", "gap_us")


@query("SELECT window_id, arg_max(can_id, (n / rate, -(first[1]), -(first[2]))) AS rate_id FROM spine s JOIN perid p USING (capture_id, w) JOIN normal USING (can_id) GROUP BY ALL", "spine", "perid", "normal")
def n8_top_id(t):
    return t.timing.where("rate_id is not null").select("window_id", "rate_id")


@query("""SELECT window_id, round(CASE WHEN v <= m THEN below / (n + 1) ELSE (n + 1 - 1 / (1 + (v - m) / CASE WHEN m > 0 THEN m ELSE 1 END)) / (n + 1) END, 9) AS score FROM (
    SELECT t.window_id, t.rate_excess AS v, (SELECT count(*) FROM reference r WHERE r.v < t.rate_excess) AS below, (SELECT max(v) FROM reference) AS m, (SELECT count(*) FROM reference)::DOUBLE AS n FROM timing t)""", "timing", "reference")
def m3_reference_rank(t):
    rows = written(t.timing, "timing")
    reference = model.reference(t.of(rows, "`group` = 'train'"), ("rate_excess",))
    return ranks.scores(rows, reference, ("rate_excess",), []).select("window_id", F.round("rate_excess_score", 9).alias("score"))


# --- payload features and stage 2 ---


@query("SELECT capture_id, line_no, field_no, field, value FROM fields", "fields")
def f3_payload_fields(t):
    return features.fields(t.placed).select("capture_id", "line_no", "field_no", "field", "value")


@query("SELECT capture_id, can_id, field, low, high, jump FROM ranges", "ranges")
def a9_field_ranges(t):
    return features.ranges(t.frames, US)


@query("SELECT can_id, field, min(low) AS low, max(high) AS high, max(jump) AS jump FROM ranges GROUP BY ALL", "ranges")
def a10_merged_ranges(t):
    return features.merged(features.ranges(t.frames, US))


@query("SELECT can_id, field, low, high, max_jump FROM model2", "model2")
def a11_field_model(t):
    return t.fields2.select("can_id", "field", "low", "high", "max_jump")


@query("SELECT can_id, field, round(quantile_cont(value, 0.05), 6) AS bound_low, round(quantile_cont(value, 0.95), 6) AS bound_high FROM fields GROUP BY ALL", "fields")
def a12_percentile_bounds(t):
    own = sums.complete(t.sums)
    got = model.field_model(sums.ranges(own), sums.per_field(own), 5.0, features.fields(t.placed).select("can_id", "field", "value"))
    return got.select("can_id", "field", r("bound_low", 6), r("bound_high", 6))


@query("SELECT can_id, field, count(*) FILTER (low = high) AS constant, count(*) AS seen FROM perfield WHERE n >= 2 GROUP BY ALL", "perfield")
def a13_frozen_counts(t):
    return features.frozen(features.per_field(t.placed))


@query("SELECT window_id, round(out_of_range, 9) AS out_of_range FROM payloads", "payloads")
def a14_out_of_range(t):
    return t.payload("width").select("window_id", r("out_of_range"))


@query("SELECT window_id, frozen_width AS frozen_break FROM payloads", "payloads")
def a15_frozen_break(t):
    return t.payload("width").select("window_id", "frozen_break")


@query("SELECT window_id, round(frozen_rate, 9) AS frozen_break FROM payloads", "payloads")
def f17_frozen_surprise(t):
    return t.payload("rate").select("window_id", r("frozen_break"))


@query("SELECT window_id, round(large_jump, 9) AS large_jump FROM payloads", "payloads")
def a16_large_jump(t):
    return t.payload("width").select("window_id", r("large_jump"))


@query("SELECT window_id, t.unknown_ids, round(t.rate_excess, 9) AS rate_excess, round(t.short_gaps, 6) AS short_gaps, round(p.out_of_range, 9) AS out_of_range, p.frozen_width AS frozen_break, round(p.large_jump, 9) AS large_jump FROM timing t JOIN payloads p USING (window_id)", "timing", "payloads")
def m15_six_features(t):
    return ml.vectors(t.timing, t.payload("width")).select("window_id", "unknown_ids", r("rate_excess"), r("short_gaps", 6), r("out_of_range"), "frozen_break", r("large_jump"))


@query("SELECT window_id, CASE WHEN rate_excess >= out_of_range THEN 1 ELSE 2 END AS stage, round(greatest(rate_excess, out_of_range), 9) AS attack_score FROM timing JOIN payloads USING (window_id)", "timing", "payloads")
def m6_max_fusion(t):
    both = t.timing.select("window_id", F.col("rate_excess").alias("score_s1"), F.lit("").alias("evidence_s1")).join(t.payload("width").select("window_id", F.col("out_of_range").alias("score_s2"), F.lit("").alias("evidence_s2")), "window_id")
    return model.fuse(both).select("window_id", "stage", r("attack_score"))


@query()
def m7_detector(t):
    """Fit both stages on train captures, take the threshold from validation, score development."""
    train, rest = t.of(t.frames, "`group` = 'train'"), t.of(t.frames, "`group` = 'development'")
    detector = model.Detector(model.fit_stage1(train, US), 1.0, "v2", model.fit_stage2(train, US, mode="rate"))
    detector.threshold = model.threshold_of(detector.raw(t.of(t.frames, "`group` = 'validation'")), 0.05)
    return detector.score(rest).select("window_id", F.round("attack_score", 9).alias("attack_score"), "decision", "evidence", "model_version")


# --- calibration and response ---


@query("SELECT count(*) AS n, count(*) FILTER (attack_score > b) AS alarms FROM outputs, (SELECT attack_score AS b FROM outputs ORDER BY attack_score DESC LIMIT 1 OFFSET (SELECT floor(0.05::DOUBLE * count(*))::BIGINT FROM outputs))", "outputs")
def m8_threshold_check(t):
    outputs = written(t.outputs.select("attack_score"), "outputs")
    limit = calibrate.boundary(outputs, 0.05)
    return outputs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("attack_score") > limit).alias("alarms"))


@query("""SELECT max(width) AS width FROM (SELECT width, bool_and(m <= (SELECT floor(0.3::DOUBLE * count(*)) FROM outputs)) OVER (ORDER BY width) AS ok FROM (
    SELECT width, (SELECT count(*) FROM outputs o WHERE o.attack_score BETWEEN greatest(0.0, 0.25::DOUBLE - width) AND least(1.0, 0.25::DOUBLE + width)) AS m
    FROM (SELECT DISTINCT least(0.5, abs(attack_score - 0.25::DOUBLE)) AS width FROM outputs UNION SELECT 0.0 UNION SELECT 0.5))) WHERE ok""", "outputs")
def m9_band_width(t):
    width = calibrate.band_half_width(written(t.outputs.select("attack_score"), "outputs"), 0.25, 0.3)
    return t.spark.range(1).select(F.lit(width).alias("width"))


@query("SELECT window_id, decision FROM outputs", "outputs")
def p7_decisions(t):
    return t.outputs.select("window_id", "decision")


@query("SELECT window_id, attack_score BETWEEN 0.15::DOUBLE AND 0.35::DOUBLE AS escalate FROM outputs", "outputs")
def p8_band(t):
    return evaluate.escalations(t.outputs, 0.1).select("window_id", "escalate")


@query("SELECT window_id, attack_score, threshold, decision, '' AS evidence, 'plain' AS model_version FROM outputs", "outputs")
def p10_sanitize(t):
    return evaluate.sanitize(t.outputs)


@query("SELECT window_id, CASE WHEN (attack_score >= 0.6) = (decision = 'ATTACK') THEN 'confirm' WHEN attack_score >= 0.6 THEN 'override_to_attack' ELSE 'override_to_accept' END AS advice FROM outputs", "outputs")
def m14_second_opinion(t):
    return evaluate.second_opinion(evaluate.sanitize(t.outputs)).select("window_id", "advice")


@query("SELECT window_id, CASE decision WHEN 'ATTACK' THEN 'SIMULATED_ALERT' ELSE 'SIMULATED_FORWARD' END AS action FROM outputs", "outputs")
def p11_actions(t):
    return evaluate.actions(t.outputs).select("window_id", "action")


@query("SELECT a AS action, (SELECT count(*) FROM outputs WHERE (decision = 'ATTACK' AND a = 'SIMULATED_ALERT') OR (decision <> 'ATTACK' AND a = 'SIMULATED_FORWARD')) AS n FROM (VALUES ('SIMULATED_ALERT'), ('SIMULATED_FORWARD'), ('SIMULATED_ISOLATION')) v(a)", "outputs")
def a25_actions(t):
    return evaluate.action_counts(evaluate.actions(t.outputs))


# --- evaluation ---


@query("SELECT window_id, outcome, family FROM results", "results")
def j2_evaluate(t):
    return t.results.select("window_id", "outcome", "family")


@query("SELECT window_id, CASE WHEN w % 7 = 0 THEN 'no label' ELSE 'no output' END AS problem FROM spine WHERE (w % 7 = 0) <> (w % 5 = 0)", "spine")
def j3_mismatches(t):
    a, b = t.spine.where("w % 5 <> 0"), t.spine.where("w % 7 <> 0")
    return evaluate.mismatches(a, b)


@query("SELECT window_id, CASE WHEN w % 7 = 0 THEN 'left' ELSE 'right' END AS side FROM spine WHERE (w % 7 = 0) <> (w % 5 = 0)", "spine")
def u3_symmetric_difference(t):
    return evaluate.unmatched(t.spine.where("w % 5 <> 0"), t.spine.where("w % 7 <> 0"))


@query("SELECT window_id FROM spine WHERE w % 6 = 0", "spine")
def j4_overlap(t):
    return runs.overlap(t.spine.where("w % 2 = 0"), t.spine.where("w % 3 = 0"))


_RATES = "count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FN') AS fn"
_DERIVED = "tp, fp, tn, fn, round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS false_alarm_rate, round(tp / nullif(tp + fp, 0), 9) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "tp", "fp", "tn", "fn", r("recall"), r("false_alarm_rate"), r("precision"), r("f1"))


@query(f"SELECT {_DERIVED} FROM (SELECT {_RATES} FROM results)", "results")
def a17_metrics(t):
    return _rounded(evaluate.metrics(t.results))


@query(f"SELECT level, family, capture_id, {_DERIVED} FROM (SELECT CASE grouping(family, capture_id) WHEN 3 THEN 'all' WHEN 1 THEN 'family' ELSE 'capture' END AS level, family, capture_id, {_RATES} FROM results GROUP BY GROUPING SETS ((), (family), (capture_id)))", "results")
def a18_grouped_metrics(t):
    return _rounded(evaluate.grouped_metrics(t.results), "level", "family", "capture_id")


def _fold_rows(t: Tables) -> DataFrame:
    own = t.results.join(t.captures.select("capture_id", "kind", "fold", F.col("family").alias("recording_family")), "capture_id")
    return crossval.attack_folds(own.withColumn("alarm", F.col("decision") == "ATTACK"))


@query("SELECT fold, capture_id, recording_family AS family, kind AS condition, count(*) FILTER (is_attack) AS attacked, count(*) FILTER (is_attack AND decision = 'ATTACK') AS detected, 0 AS normal, 0 AS false_alarms FROM results WHERE is_attack GROUP BY ALL", "results")
def m12_attack_folds(t):
    return _fold_rows(t)


@query("SELECT condition, count(*) AS families, round(avg(recall), 4) AS macro_recall FROM (SELECT coalesce(kind, 'all') AS condition, recording_family, round(count(*) FILTER (decision = 'ATTACK') / count(*), 4) AS recall FROM results WHERE is_attack GROUP BY GROUPING SETS ((kind, recording_family), (recording_family))) GROUP BY condition", "results")
def a19_macro_recall(t):
    return evaluate.macro_recall(_fold_rows(t))


@query("SELECT capture_id, s.start_s AS start_s, round(min(CASE WHEN decision = 'ATTACK' AND end_us / 1e6 >= s.start_s THEN end_us / 1e6 - s.start_s END), 6) AS delay_s FROM results r JOIN (SELECT capture_id, min(start_s) AS start_s FROM results WHERE is_attack GROUP BY capture_id HAVING count(DISTINCT start_s) = 1) s USING (capture_id) GROUP BY ALL", "results")
def a22_detection_delay(t):
    return evaluate.detection_delay(_scored(t)).select("capture_id", "start_s", r("delay_s", 6))


def _scored(t: Tables) -> DataFrame:
    own = t.labels.select("window_id", "kind", "is_attack", "injection_interval")
    return t.outputs.join(own, "window_id")


@query("""SELECT count(*) AS captures, count(delay) AS detected, count(*) - count(delay) AS missed, round(avg(delay), 6) AS mean_delay_s, round(quantile_cont(delay, 0.5), 6) AS median_delay_s, round(max(delay), 6) AS max_delay_s,
    round(list_sort(list(delay) FILTER (delay IS NOT NULL))[round_even(0.95 * (count(delay) - 1), 0)::INT + 1], 6) AS p95_delay_s FROM (
    SELECT capture_id, min(CASE WHEN decision = 'ATTACK' AND end_us / 1e6 >= s.start_s THEN end_us / 1e6 - s.start_s END) AS delay FROM results r JOIN (SELECT capture_id, min(start_s) AS start_s FROM results WHERE is_attack GROUP BY capture_id HAVING count(DISTINCT start_s) = 1) s USING (capture_id) GROUP BY ALL)""", "results")
def a22_delay_report(t):
    report = evaluate.delay_report(evaluate.detection_delay(_scored(t)))
    return report.select("captures", "detected", "missed", *[r(c, 6) for c in ("mean_delay_s", "median_delay_s", "max_delay_s", "p95_delay_s")])


@query("""SELECT windows, escalations, local_errors, escalated_errors, round(escalations / windows, 9) AS escalation_rate, round(escalated_errors / nullif(escalations, 0), 9) AS escalation_precision, round(escalated_errors / nullif(local_errors, 0), 9) AS escalation_recall,
    round((local_errors - escalated_errors) / nullif(windows - escalations, 0), 9) AS error_rate_outside_band, round((windows - local_errors) / windows, 9) AS local_accuracy, round((windows - (local_errors - escalated_errors)) / windows, 9) AS local_plus_perfect_cloud_accuracy FROM (
    SELECT count(*) AS windows, count(*) FILTER (inside) AS escalations, count(*) FILTER (wrong) AS local_errors, count(*) FILTER (inside AND wrong) AS escalated_errors FROM (SELECT attack_score BETWEEN 0.15::DOUBLE AND 0.35::DOUBLE AS inside, outcome IN ('FP', 'FN') AS wrong FROM results))""", "results")
def a23_escalation_quality(t):
    q = evaluate.escalation_quality(t.results, 0.1)
    return q.select("windows", "escalations", "local_errors", "escalated_errors", *[r(c) for c in ("escalation_rate", "escalation_precision", "escalation_recall", "error_rate_outside_band", "local_accuracy", "local_plus_perfect_cloud_accuracy")])


@query("""SELECT count(*) AS windows, count(*) FILTER (e) AS escalations, round(count(*) FILTER (e) / count(*), 9) AS escalation_rate, count(*) FILTER (e AND w % 10 = 0) AS failed, round(count(*) FILTER (e AND w % 10 <> 0 AND w % 3 = 0) / count(*) FILTER (e AND w % 10 <> 0), 9) AS correction_rate,
    round(avg(CASE WHEN e THEN w * 1.5 END), 9) AS mean_latency_ms, round((list_sort(list(w * 1.5) FILTER (e)))[round_even(0.95 * (count(*) FILTER (e) - 1), 0)::INT + 1]::DOUBLE, 9) AS p95_latency_ms FROM (SELECT w, attack_score BETWEEN 0.15::DOUBLE AND 0.35::DOUBLE AS e FROM outputs)""", "outputs")
def a24_egress(t):
    own = t.outputs.withColumn("escalated", evaluate.in_band(0.1))
    answered = F.when(F.col("escalated") & (F.col("w") % 10 != 0), F.col("w") % 3 == 0)
    got = evaluate.egress(own.select("window_id", "escalated", F.when(F.col("escalated"), F.col("w") * 1.5).alias("added_latency_ms"), answered.alias("corrected")))
    return got.select("windows", "escalations", r("escalation_rate"), "failed", r("correction_rate"), r("mean_latency_ms"), r("p95_latency_ms"))


@query("SELECT count(*) AS windows, round(avg(x), 6) AS mean_ms, round(quantile_cont(x, 0.5), 6) AS median_ms, round(quantile_cont(x, 0.95), 6) AS p95_ms, max(x) AS max_ms, round(count(*) / (sum(x) / 1000), 6) AS windows_per_s FROM (SELECT (1 + w % 17)::DOUBLE / 4 AS x FROM spine)", "spine")
def a26_benchmark(t):
    got = evaluate.benchmark(t.spine.select(((1 + F.col("w") % 17) / 4.0).alias("latency_ms")))
    return got.select("windows", *[r(c, 6) for c in ("mean_ms", "median_ms", "p95_ms")], "max_ms", r("windows_per_s", 6))


@query("SELECT capture_id, list_sort(list(l))[least(count(*), floor(0.95 * count(*))::INT + 1)] AS p95 FROM (SELECT capture_id, (w % 41)::DOUBLE AS l FROM spine) GROUP BY capture_id", "spine")
def f14_floor_index(t):
    return quantiles.floor_index_p95(t.spine.select("capture_id", (F.col("w") % 41).cast("double").alias("l")), ["capture_id"], "l")


@query("SELECT capture_id, list_sort(list(l))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95 FROM (SELECT capture_id, (w % 41)::DOUBLE AS l FROM spine) GROUP BY capture_id", "spine")
def f12_nearest_rank(t):
    return quantiles.nearest_rank_p95(t.spine.select("capture_id", (F.col("w") % 41).cast("double").alias("l")), ["capture_id"], "l")


@query("SELECT capture_id, round(quantile_cont(w % 41, 0.95), 6) AS p95 FROM spine GROUP BY capture_id", "spine")
def f13_type7(t):
    return t.spine.groupBy("capture_id").agg(F.round(quantiles.interpolated(F.col("w") % 41, 0.95), 6).alias("p95"))


@query(f"SELECT model_version, {_DERIVED} FROM (SELECT v AS model_version, {_RATES} FROM (SELECT v, CASE WHEN attack_score >= t THEN CASE WHEN is_attack THEN 'TP' ELSE 'FP' END WHEN is_attack THEN 'FN' ELSE 'TN' END AS outcome FROM results, (VALUES ('plain', 0.25), ('wide', 0.1)) m(v, t)) GROUP BY v)", "results")
def j13_paired_models(t):
    wide = model.decide(t.outputs.select("window_id", "capture_id", "w", "attack_score", "evidence"), 0.1, "wide")
    got = evaluate.compare_models(t.outputs.select(*wide.columns), wide, t.labels)
    return _rounded(got, "model_version")


@query("SELECT window_id, round(least(greatest(attack_score / 0.25, attack_score / 0.1, CASE WHEN decision = 'ATTACK' THEN 1 ELSE 0 END, CASE WHEN attack_score >= 0.1 THEN 1 ELSE 0 END), 1.0), 9) AS attack_score, CASE WHEN attack_score >= 0.1 THEN 'ATTACK' ELSE 'ACCEPT' END AS decision FROM outputs", "outputs")
def m20_or_fusion(t):
    wide = model.decide(t.outputs.select("window_id", "capture_id", "w", "attack_score", "evidence"), 0.1, "wide")
    return model.fused_or(t.outputs, wide).select("window_id", r("attack_score"), "decision")


@query("SELECT capture_id, w, n, (sum(a) OVER o)::BIGINT AS attacks, round(avg(attack_score) OVER o, 9) AS mean_score, max(attack_score) OVER o AS peak_score, round(avg(attack_score) OVER (PARTITION BY capture_id ORDER BY w ROWS 59 PRECEDING), 9) AS recent_score, a = 1 AND coalesce(lag(a) OVER (PARTITION BY capture_id ORDER BY w), 0) = 0 AS new_alarm FROM (SELECT *, (decision = 'ATTACK')::BIGINT AS a, row_number() OVER (PARTITION BY capture_id ORDER BY w) AS n FROM outputs) WINDOW o AS (PARTITION BY capture_id ORDER BY w ROWS UNBOUNDED PRECEDING)", "outputs")
def a33_running(t):
    return evaluate.running(t.outputs).select("capture_id", "w", F.col("windows").cast("long").alias("n"), "attacks", r("mean_score"), "peak_score", r("recent_score"), "new_alarm")


@query("SELECT CASE WHEN can_id IS NULL THEN 'all' ELSE can_id END AS can_id, count(*) AS frames, count(DISTINCT capture_id) AS captures FROM frames GROUP BY ROLLUP (can_id)", "frames")
def a30_totals(t):
    return t.frames.rollup("can_id").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("capture_id").alias("captures")).withColumn("can_id", F.coalesce("can_id", F.lit("all")))


@query("SELECT rate_id, count(*) AS n FROM (SELECT window_id, arg_max(can_id, (n / rate, -(first[1]), -(first[2]))) AS rate_id FROM spine s JOIN perid p USING (capture_id, w) JOIN normal USING (can_id) GROUP BY window_id) GROUP BY rate_id", "spine", "perid", "normal")
def a31_firing_ids(t):
    return t.timing.where("rate_id is not null").groupBy("rate_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT window_id, round(attack_score, 9) AS attack_score FROM outputs ORDER BY attack_score DESC, window_id DESC LIMIT 5", "outputs")
def o3_top_evidence(t):
    return t.outputs.select("window_id", r("attack_score")).orderBy(F.desc("attack_score"), F.desc("window_id")).limit(5)


@query("SELECT capture_id, fold FROM captures WHERE grp = 'development'", "captures")
def p2_capture_selection(t):
    return logs.allowed(t.captures, ["development"]).select("capture_id", "fold")


@query("SELECT fold, string_agg(DISTINCT target, ',') AS watch FROM (SELECT a.fold, b.target FROM captures a JOIN captures b ON a.fold <> b.fold) GROUP BY fold", "captures")
def m12_fold_watch(t):
    return crossval.fold_watch(t.captures).select("fold", F.array_join("watch", ",").alias("watch"))


@query(LOCO)
def m11_leave_one_out(t):
    """Nested leave-one-capture-out of both detectors over the train captures, all folds in one plan."""
    got = crossval.leave_one_out(t.frames, US, 0.05, table=t.of(t.sums, "`group` = 'train'"))
    return got.select("outer", "version", r("boundary"), "alarms", "windows")


@query(f"SELECT version, sum(alarms)::BIGINT AS alarms, sum(windows)::BIGINT AS windows, round(sum(alarms) / sum(windows), 6) AS rate, round((sum(windows) * 6.0)::DOUBLE, 4) AS hours, round(sum(alarms) / (sum(windows) * 6.0), 3) AS per_hour, count(*) FILTER (alarms / windows > 0.05) AS captures_over_target FROM ({LOCO}) GROUP BY version")
def a21_false_alarms(t):
    """The false alarms of m11_leave_one_out in all; their exact upper bound is tested against the binomial distribution."""
    rows = crossval.leave_one_out(t.frames, US, 0.05, table=t.of(t.sums, "`group` = 'train'"))
    got = crossval.false_alarms(rows, 0.05, US)
    return t.spark.createDataFrame([(v, x["alarms"], x["windows"], x["rate"], x["hours"], x["per_hour"], x["captures_over_target"]) for v, x in got.items()], "version string, alarms long, windows long, rate double, hours double, per_hour double, captures_over_target long")


def _attack_rows(t: Tables) -> DataFrame:
    """Folds whose recordings have targets of their own, so that each fold's second stage watches another id."""
    # The captures come from all frames and are read in every step, so they are found once.
    captures = written(t.captures, "captures").withColumn("target", F.when(F.col("fold") == 1, "0E0").otherwise("0B0"))
    marked = labels.window_labels(t.frames, captures, US)
    own = captures.withColumn("kind", F.when(F.substring("capture_id", 4, 2) < "10", "fabrication").otherwise("masquerade"))
    return crossval.attack_cv(t.sums, own, marked, US, 0.05)


@query(f"SELECT * REPLACE (round(boundary, 9) AS boundary) FROM ({ATTACK_CV})")
def m12_attack_cv(t):
    """Both stages fitted for each fold of the development recordings, with thresholds from validation."""
    return _attack_rows(t).withColumn("boundary", F.round("boundary", 9))


@query(f"SELECT version, condition, count(*) AS families, round(avg(recall), 4) AS macro_recall FROM (SELECT version, coalesce(condition, 'all') AS condition, family, round(sum(detected) / sum(attacked), 4) AS recall FROM ({ATTACK_CV}) GROUP BY GROUPING SETS ((version, condition, family), (version, family)) HAVING sum(attacked) > 0) GROUP BY ALL")
def m12_macro_recall(t):
    rows = written(_attack_rows(t), "attack-folds")
    by = [evaluate.macro_recall(rows.where(F.col("version") == v)).select(F.lit(v).alias("version"), "condition", "families", "macro_recall") for v in ("v1", "v2")]
    return by[0].union(by[1])


@query(DETECTOR)
def m7_scores(t):
    """The detector of m7_detector, its scores and decisions."""
    train = t.of(t.frames, "`group` = 'train'")
    table = t.of(t.sums, "`group` = 'train'")
    detector = model.Detector(model.fit_stage1(train, US, table=table), 1.0, "v2", model.fit_stage2(train, US, mode="rate", table=table))
    detector.threshold = model.threshold_of(written(detector.raw(t.of(t.frames, "`group` = 'validation'")).select("attack_score"), "scores"), 0.05)
    return detector.score(t.of(t.frames, "`group` = 'development'")).select("window_id", F.round("attack_score", 9).alias("attack_score"), "decision")


@query()
def m16_logistic(t):
    both = ml.vectors(t.timing, t.payload("rate")).join(t.labels.select("window_id", "is_attack"), "window_id")
    return ml.logistic(both, ml.fit_logistic(both)).select("window_id", F.round("attack_score", 6).alias("attack_score"), "evidence")


# --- attacks ---


@query("""SELECT capture_id, w, arg_min(can_id, (-changes, v)) AS target_can_id FROM (SELECT capture_id, w, can_id, CAST('0x' || can_id AS BIGINT) AS v, count(*) FILTER (payload <> fp) AS changes FROM (
    SELECT *, first_value(payload) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS fp FROM placed) GROUP BY ALL) WHERE changes > 0 GROUP BY ALL""", "placed")
def o5_freeze_target(t):
    return attacks.propose_freeze(t.placed, US).select("capture_id", "w", "target_can_id")


_OFFSET = """SELECT capture_id, w, b.can_id AS target_can_id, b.byte_index::INT AS byte_index, CASE WHEN b.mean <= 127 THEN 120 ELSE -120 END AS off FROM (SELECT capture_id, w, min({'s': spread, 'v': v, 'byte_index': byte_index, 'can_id': can_id, 'mean': mean}) AS b FROM (
    SELECT capture_id, w, can_id, CAST('0x' || can_id AS BIGINT) AS v, field_no AS byte_index, max(value) - min(value) AS spread, avg(value) AS mean FROM fields WHERE field_no < 3 GROUP BY ALL) GROUP BY ALL)"""


@query(_OFFSET, "fields")
def o6_offset_target(t):
    return attacks.propose_offset(t.placed, US).select("capture_id", "w", "target_can_id", "byte_index", F.col("offset").alias("off"))


@query("""SELECT p.capture_id, p.w, line_no, CASE WHEN p.can_id = s.target THEN first_value(payload) OVER (PARTITION BY p.capture_id, p.w, p.can_id ORDER BY t_us, line_no) ELSE payload END AS payload FROM placed p JOIN (
    SELECT capture_id, w, arg_min(can_id, (-changes, v)) AS target FROM (SELECT capture_id, w, can_id, CAST('0x' || can_id AS BIGINT) AS v, count(*) FILTER (payload <> fp) AS changes FROM (
    SELECT *, first_value(payload) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS fp FROM placed) GROUP BY ALL) WHERE changes > 0 GROUP BY ALL) s USING (capture_id, w)""", "placed")
def x3_freeze(t):
    return attacks.inject(t.placed, attacks.propose_freeze(t.placed, US), US).select("capture_id", "w", "line_no", "payload")


@query(f"""SELECT p.capture_id, p.w, line_no, CASE WHEN p.can_id = s.target_can_id THEN substr(payload, 1, 2 * byte_index) || printf('%02X', greatest(0, least(255, CAST('0x' || substr(payload, 2 * byte_index + 1, 2) AS BIGINT) + off))) || substr(payload, 2 * byte_index + 3) ELSE payload END AS payload
    FROM placed p JOIN ({_OFFSET}) s USING (capture_id, w)""", "fields")
def x4_offset(t):
    return attacks.inject(t.placed, attacks.propose_offset(t.placed, US), US).select("capture_id", "w", "line_no", "payload")


@query("""SELECT printf('%s_w%04d', capture_id, w) AS window_id, count(*) AS matching, count(*) FILTER (payload <> fp) AS changed FROM (SELECT p.*, first_value(payload) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS fp, s.target FROM placed p JOIN (
    SELECT capture_id, w, arg_min(can_id, (-changes, v)) AS target FROM (SELECT capture_id, w, can_id, CAST('0x' || can_id AS BIGINT) AS v, count(*) FILTER (payload <> fp) AS changes FROM (
    SELECT *, first_value(payload) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS fp FROM placed) GROUP BY ALL) WHERE changes > 0 GROUP BY ALL) s USING (capture_id, w) WHERE can_id = target) GROUP BY ALL""", "placed")
def p14_validate(t):
    got = attacks.validate(t.placed, t.spine, attacks.propose_freeze(t.placed, US), US)
    return got.where("valid").select("window_id", "matching", "changed")


def _evasions(t: Tables) -> DataFrame:
    return t.results.where("outcome = 'FN'").select(F.concat(F.lit("a_"), "window_id").alias("attack_id"), "window_id", "family", F.when(F.col("w") % 2 == 0, "0E0").otherwise("0B0").alias("target_can_id"), F.lit(0.0).alias("start_offset_ms"), F.lit(1000.0).alias("duration_ms"), "attack_score", "model_version", F.lit("development").alias("split"))


@query("SELECT 'a_' || window_id AS attack_id, window_id, family, attack_score FROM results WHERE outcome = 'FN' AND w % 3 <> 1", "results")
def x8_evasions(t):
    specs = t.results.where("is_attack").select(F.concat(F.lit("a_"), "window_id").alias("attack_id"), "window_id", F.when(F.col("w") % 3 == 1, "other").otherwise(F.col("family")).alias("family"), F.lit("0E0").alias("target_can_id"), F.lit(0.0).alias("start_offset_ms"), F.lit(1000.0).alias("duration_ms"))
    return attacks.evasions(specs, t.results).select("attack_id", "window_id", "family", "attack_score")


@query("SELECT DISTINCT window_id FROM results WHERE outcome = 'FN'", "results")
def j5_hardening_set(t):
    return attacks.hardening_set(_evasions(t), t.spine, "plain")


@query("SELECT family, CASE WHEN w % 2 = 0 THEN '0E0' ELSE '0B0' END AS target_can_id, count(*) AS misses, count(*) AS windows, count(*) FILTER (w % 2 <> 0) AS coverage_gap, count(*) FILTER (w % 2 = 0) AS sensitivity_gap FROM results WHERE outcome = 'FN' GROUP BY ALL", "results")
def a29_diagnose(t):
    return attacks.diagnose(_evasions(t), ["0E0"])


# --- scalars, invariants, decoding, other tables ---


@query("SELECT line_no, can_id AS a, printf('%03X', CAST('0x' || can_id AS BIGINT)) AS b, 'ABCDE' AS c FROM frames", "frames")
def f1_can_ids(t):
    return t.frames.select("line_no", fn.normalize_can_id(F.lower("can_id")).alias("a"), fn.canonical_can_id(F.concat(F.lit(" 0x0"), F.lower("can_id"))).alias("b"), fn.canonical_can_id(F.lit("abcde")).alias("c"))


@query("SELECT window_id FROM spine", "spine")
def f6_window_ids(t):
    return t.spine.select("window_id")


@query("SELECT window_id, printf('%02d:%02d:%02d', (w + 1) // 3600, ((w + 1) // 60) % 60, (w + 1) % 60) AS clock FROM spine", "spine")
def f23_drive_clock(t):
    return t.spine.select("window_id", fn.drive_clock(F.col("window_id")).alias("clock"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_discount - l_tax) * 10)), 9) AS p FROM lineitem")
def f16_sigmoid(t):
    line = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
    return line.select("l_orderkey", "l_linenumber", F.round(fn.sigmoid((F.col("l_discount") - F.col("l_tax")) * 10), 9).alias("p"))


@query("SELECT c_nationkey, round(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING') / nullif(count(*) FILTER (c_mktsegment = 'BUILDING'), 0), 4) AS mean_balance FROM customer GROUP BY c_nationkey")
def f19_safe_ratio(t):
    c, b = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet"), F.col("c_mktsegment") == "BUILDING"
    return c.groupBy("c_nationkey").agg(F.round(fn.ratio(F.sum(F.when(b, F.col("c_acctbal"))), F.count_if(b)), 4).alias("mean_balance"))


@query("SELECT line_no, CAST('0x' || substr(payload, 1, 4) AS BIGINT)::DOUBLE AS big, (CAST('0x' || substr(payload, 5, 2) AS BIGINT) - CASE WHEN CAST('0x' || substr(payload, 5, 2) AS BIGINT) >= 128 THEN 256 ELSE 0 END)::DOUBLE AS small, (CAST('0x' || substr(payload, 3, 2) AS BIGINT) * 256 + CAST('0x' || substr(payload, 1, 2) AS BIGINT))::DOUBLE AS little FROM frames", "frames")
def f5_decode(t):
    bits = lambda *a: F.array(*map(F.lit, fn.bit_positions(*a)))
    p = F.col("payload")
    return t.frames.select("line_no", fn.decode_bits(p, bits(7, 16, False), F.lit(False)).alias("big"), fn.decode_bits(p, bits(16, 8, True), F.lit(True)).alias("small"), fn.decode_bits(p, bits(0, 16, True), F.lit(False)).alias("little"))


@query("SELECT window_id, can_id || ':amount' AS signal, CAST('0x' || substr(arg_max(payload, (t_us, line_no)), 1, 4) AS BIGINT)::DOUBLE AS value FROM placed JOIN spine USING (capture_id, w) GROUP BY window_id, can_id", "placed", "spine")
def n9_latest_value(t):
    ids = t.spark.createDataFrame([(i, "amount", 7, 16, False, False) for i in ("0C1", "0E0", "0B0", "0A0", "0F4")], logs.SIGNALS)
    got = decode.latest(decode.decode(t.placed, logs.with_bits(ids)))
    return got.join(t.spine, ["capture_id", "w"]).select("window_id", "signal", "value")


@query("SELECT line_no, CASE WHEN line_no % 2 = 0 THEN 'payload has whole bytes' ELSE 'id is hex' END AS rule FROM frames WHERE line_no % 5 = 0", "frames")
def i1_violations(t):
    # Every fifth frame is spoilt, in one of two ways; all frames are checked.
    way = F.when(F.col("line_no") % 5 == 0, F.col("line_no") % 2)
    bad = t.frames.withColumns({"payload": F.when(way == 0, F.substring("payload", 1, 5)).otherwise(F.col("payload")), "can_id": F.when(way == 1, "XYZ").otherwise(F.col("can_id"))})
    return schema.violations(bad, "frames").select("line_no", "rule")


@query("SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS opening FROM conversations")
def n5_ordered_turns(t):
    c, w = t.spark.read.parquet(f"{t.sf_dir}/conversations.parquet"), Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "role", F.coalesce(F.lag("role").over(w), F.lit("")).alias("before"), F.first("text").over(w).alias("opening"))


@query(f"SELECT {_DERIVED} FROM (SELECT {_RATES} FROM (SELECT CASE WHEN n_chars > 1500 THEN CASE WHEN quality = 1 THEN 'TP' ELSE 'FP' END WHEN quality = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM documents JOIN labels USING (doc_id)))")
def a17_document_rule(t):
    docs, marks = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet"), t.spark.read.parquet(f"{t.sf_dir}/labels.parquet")
    out = docs.select(F.col("doc_id").alias("window_id"), F.when(F.col("n_chars") > 1500, "ATTACK").otherwise("ACCEPT").alias("decision"), F.lit(None).cast("double").alias("latency_ms"))
    own = marks.select(F.col("doc_id").alias("window_id"), (F.col("quality") == 1).alias("is_attack"), F.lit(None).cast("string").alias("family"))
    return _rounded(evaluate.metrics(evaluate.evaluate(out, own, strict=False)))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def o1_top_lines(t):
    line, orders = (t.spark.read.parquet(f"{t.sf_dir}/{x}.parquet") for x in ("lineitem", "orders"))
    own = line.join(orders.where("o_orderstatus = 'F'"), line["l_orderkey"] == orders["o_orderkey"])
    return own.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"))


def _leaves(frames: str) -> str:
    return """SELECT capture_id, t_us // 21600000000 AS leaf, count(*) AS n, sha256(string_agg(sha256(printf('{"capture_id":"%s","line_no":%d,"t_us":%d,"can_id":"%s","payload":"%s"}', capture_id, line_no, t_us, can_id, payload)), '' ORDER BY line_no)) AS h FROM """ + frames + " GROUP BY ALL"


_CHANGED = "(SELECT capture_id, line_no, t_us, can_id, CASE WHEN line_no % 977 = 5 THEN '000000' ELSE payload END AS payload FROM frames)"


@query(f"SELECT capture_id, sum(n)::BIGINT AS n, sha256(string_agg(leaf || ':' || h || ';', '' ORDER BY leaf)) AS sha256 FROM ({_leaves('frames')}) GROUP BY capture_id", "frames")
def a20_fingerprint(t):
    """A hash of every window, and of these one of every capture."""
    return evaluate.fingerprint(t.frames, ["capture_id"], "line_no", F.expr(f"t_us div {US}"))


@query(f"SELECT capture_id, leaf FROM ({_leaves('frames')}) a JOIN ({_leaves(_CHANGED)}) b USING (capture_id, leaf) WHERE a.h <> b.h", "frames")
def a20_changed_windows(t):
    """Which windows differ once some payloads are changed, found from the top of two trees."""
    changed = t.frames.withColumn("payload", F.when(F.col("line_no") % 977 == 5, "000000").otherwise(F.col("payload")))
    trees = [written(evaluate.fingerprint_tree(evaluate.fingerprint_leaves(x, ["capture_id"], F.expr(f"t_us div {US}"), "line_no"), ["capture_id"]), "tree") for x in (t.frames, changed)]
    return evaluate.tree_changes(*trees, ["capture_id"])


@query("SELECT model_version, capture_id, count(*) FILTER (is_attack) AS attacked, count(*) FILTER (is_attack AND attack_score >= t) AS detected, count(*) FILTER (NOT is_attack) AS normal, count(*) FILTER (NOT is_attack AND attack_score >= t) AS false_alarms FROM results, (VALUES ('plain', 0.25), ('wide', 0.1)) m(model_version, t) GROUP BY ROLLUP (model_version, capture_id)", "results")
def a30_dev_totals(t):
    wide = model.decide(t.outputs.select("window_id", "capture_id", "w", "attack_score", "evidence"), 0.1, "wide")
    return runs.development_totals(t.outputs.select(*wide.columns).unionByName(wide), t.labels)


@query("""SELECT 'rate_excess' AS "check", 'unusual timing (rate_excess): ' || rate_id AS evidence, count(*) AS count FROM (SELECT window_id, arg_max(can_id, (n / rate, -(first[1]), -(first[2]))) AS rate_id, max(n / 21600.0 / rate) AS v FROM spine s JOIN perid p USING (capture_id, w) JOIN normal USING (can_id) GROUP BY window_id)
    WHERE v > (SELECT max(rate_excess) FROM timing JOIN captures USING (capture_id) WHERE grp = 'train' AND fold = 1) GROUP BY ALL ORDER BY count DESC, evidence DESC LIMIT 5""", "spine", "perid", "normal", "timing", "captures")
def a31_firing(t):
    """Which senders set the rates beyond all of one fold's train captures."""
    rows = written(t.timing, "timing")
    train = t.of(rows, "`group` = 'train' and fold = 1")
    n = train.count()
    scored = model.ranked(rows, model.reference(train, ("rate_excess",)), ("rate_excess",), n, 1, F.col("rate_id"))
    return runs.firing(scored, 1, n)


@query("""SELECT window_id, place, n_frames, n_ids FROM (SELECT s.capture_id, w, window_id, row_number() OVER (ORDER BY s.capture_id, w) - 1 AS place, count(p.line_no) AS n_frames, count(DISTINCT p.can_id) AS n_ids FROM spine s JOIN captures c USING (capture_id) LEFT JOIN placed p USING (capture_id, w) WHERE grp = 'development' GROUP BY s.capture_id, w, window_id) WHERE place < 300""", "spine", "captures", "placed")
def s13_real_windows(t):
    """The first 300 windows of the development captures; captures beyond them are not read."""
    names = [r["capture_id"] for r in logs.allowed(t.captures, ["development"]).collect()]  # a row a capture
    return windows.real(t.frames, US, names, 300).select("window_id", "place", "n_frames", "n_ids")


@query("""SELECT capture_id, grp AS "group", kind, family, target, lo_us / 1e6 AS from_s, hi_us / 1e6 AS to_s, (f.b - f.a) / 1e6 AS duration_s, f.first AS first_raw_timestamp FROM captures JOIN (SELECT capture_id, arg_min(t_us, line_no) AS a, arg_max(t_us, line_no) AS b, arg_min(t_us::VARCHAR, line_no) AS first FROM frames GROUP BY capture_id) f USING (capture_id)""", "captures", "frames")
def a35_capture_metadata(t):
    lines = t.frames.select(F.col("capture_id").alias("capture"), "line_no", F.col("t_us").cast("string").alias("ts_text"), F.col("t_us").alias("abs_us"))
    got = logs.capture_metadata(lines, t.captures, t.captures)
    return got.select("capture_id", "group", "kind", "family", "target", F.get("injection_interval", F.lit(0)).alias("from_s"), F.get("injection_interval", F.lit(1)).alias("to_s"), "duration_s", "first_raw_timestamp")


@query("""SELECT s.window_id, p.can_id || ':amount' AS signal, count(*) AS n, arg_max(v, (t_us, line_no)) AS last FROM (SELECT p.*, CAST('0x' || substr(CASE WHEN p.can_id = s.target THEN first_value(payload) OVER (PARTITION BY p.capture_id, p.w, p.can_id ORDER BY t_us, line_no) ELSE payload END, 1, 4) AS BIGINT)::DOUBLE AS v FROM placed p JOIN (
    SELECT capture_id, w, arg_min(can_id, (-changes, v)) AS target FROM (SELECT capture_id, w, can_id, CAST('0x' || can_id AS BIGINT) AS v, count(*) FILTER (payload <> fp) AS changes FROM (
    SELECT *, first_value(payload) OVER (PARTITION BY capture_id, w, can_id ORDER BY t_us, line_no) AS fp FROM placed) GROUP BY ALL) WHERE changes > 0 GROUP BY ALL) s USING (capture_id, w)) p JOIN spine s USING (capture_id, w) GROUP BY ALL""", "placed", "spine")
def w10_preprocess(t):
    """Signals of the windows that a frozen sender was injected into, decoded afterwards."""
    ids = t.spark.createDataFrame([(i, "amount", 7, 16, False, False) for i in ("0C1", "0E0", "0B0", "0A0", "0F4")], logs.SIGNALS)
    hit = attacks.inject(t.placed, attacks.propose_freeze(t.placed, US), US)
    got = decode.preprocess(hit.select("capture_id", "w", "line_no", "t_us", "can_id", "payload"), t.spine, logs.with_bits(ids))
    each = got.select("window_id", F.explode("decoded_signals").alias("signal", "values"))
    return each.select("window_id", "signal", F.size("values").cast("long").alias("n"), F.element_at("values", -1).alias("last"))


@query()
def m17_logistic_cv(t):
    """Logistic regression on the six features over the development recordings' folds, fitted together."""
    captures = t.captures.withColumn("kind", F.when(F.substring("capture_id", 4, 2) < "10", "fabrication").otherwise("masquerade"))
    own = t.of(t.labels.select("window_id", "capture_id", "is_attack"), "`group` = 'development'").unionByName(t.of(t.labels.select("window_id", "capture_id", F.lit(False).alias("is_attack")), "`group` <> 'development'"))
    return ml.logistic_cv(ml.vectors(t.timing, t.payload("width")), own, captures, 0.05).withColumn("boundary", F.round("boundary", 9))
