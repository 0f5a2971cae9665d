"""Detectors as tables: fitting is a set of sums, scoring a join with a small model and a sum by window."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.operators import calibrate, features, ranks, sums
from tracewright.operators.features import PAYLOAD, TIMING
from tracewright.operators.store import written


@dataclass
class Stage1:
    """ids: can_id, rate, median_gap. reference: check, value, m, the training windows' values and how many have them."""

    ids: DataFrame
    reference: DataFrame
    n: int
    window_us: int


@dataclass
class Stage2:
    """fields: can_id, field, low, high, bound_low, bound_high, max_jump, constant, seen. watch: ids, or None for all."""

    fields: DataFrame
    reference: DataFrame
    n: int
    window_us: int
    mode: str = "width"
    watch: list[str] | None = None


def normal_ids(table: DataFrame, n_windows: Column | int, window_us: int) -> DataFrame:
    """can_id, rate (frames a second of all windows, not only of those it is in), median_gap (seconds; NULL without one),
    from the sums of complete windows."""
    ids = sums.per_id(table).groupBy("can_id").agg(F.sum("n").alias("frames"))
    gap = sums.gaps(table).groupBy("can_id").agg(F.percentile("gap_us", 0.5, F.col("n")).alias("gap"))
    seconds = (F.lit(n_windows) if isinstance(n_windows, int) else n_windows) * F.lit(window_us / 1e6)
    return ids.join(gap, "can_id", "left").select("can_id", (F.col("frames") / seconds).alias("rate"), F.greatest(F.col("gap") / 1e6, F.when(F.col("gap").isNotNull(), F.lit(1e-6))).alias("median_gap"))


def reference(checks: DataFrame, names: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """(by, check, value, m): how many training windows have each value."""
    keys = by or []
    rows = checks.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in names])))
    return ranks.counted(rows, [*keys, "check"])


def _training(frames: DataFrame, us: int, every: int, table: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """All sums, those of the windows that train, their spine, and its length."""
    table = written(sums.of_frames(frames, us), "sums") if table is None else table
    spine = sums.spine(table, us, every)
    n = spine.count()
    if n < 2:
        raise ValueError("training needs two windows or more")
    return table, sums.complete(table, every), spine, n


def fit_stage1(frames: DataFrame, us: int, every: int = 1, table: DataFrame | None = None) -> Stage1:
    """table: sums.of_frames() of the frames, if they are there already."""
    _, own, spine, n = _training(frames.drop("payload").withColumn("payload", F.lit("")) if table is None else frames, us, every, table)
    # A model is small and every scoring reads it, so it is written rather than fitted again each time.
    ids = written(normal_ids(own, n, us), "stage1")
    checks = features.timing(sums.per_id(own), spine, ids, us / 1e6)
    return Stage1(ids, written(reference(checks, TIMING), "reference1"), n, us)


def field_model(stats: DataFrame, window_fields: DataFrame, percent: float | None = None, raw: DataFrame | None = None) -> DataFrame:
    """The Stage 2 table from ranges (captures' and windows') and the windows' fields.

    With percent the bounds are that percentile of the raw values and 100 less it (interpolated), else the full range.
    """
    own = window_fields.select("can_id", "field", "low", "high", F.coalesce("jump", F.lit(0)).alias("jump"))
    range_ = features.merged(stats.select("can_id", "field", "low", "high", "jump").union(own))
    held = features.frozen(window_fields)
    table = range_.join(held, ["can_id", "field"], "left").fillna(0, ["constant", "seen"]).withColumnRenamed("jump", "max_jump")
    if percent is None:
        return table.withColumns({"bound_low": F.col("low").cast("double"), "bound_high": F.col("high").cast("double")})
    bounds = raw.groupBy("can_id", "field").agg(F.percentile("value", percent / 100).alias("bound_low"), F.percentile("value", 1 - percent / 100).alias("bound_high"))
    return table.join(bounds, ["can_id", "field"], "left").withColumns({"bound_low": F.coalesce("bound_low", F.col("low").cast("double")), "bound_high": F.coalesce("bound_high", F.col("high").cast("double"))})


def fit_stage2(frames: DataFrame, us: int, watch: list[str] | None = None, mode: str = "width", percent: float | None = None, every: int = 1, stats: DataFrame | None = None, table: DataFrame | None = None) -> Stage2:
    """stats: ranges of whole captures (features.ranges), and table: sums.of_frames() of the frames, if they are there
    already. All frames decide which window is the last, so windows are cut before the watch-list."""
    if mode not in ("width", "rate"):
        raise ValueError(f"unknown frozen mode {mode}")
    whole, own, spine, n = _training(frames, us, every, table)
    window_fields = sums.per_field(features.watched(own, watch))
    raw = None
    if percent is not None:
        values = features.turns(features.watched(frames, watch)).select("can_id", "field", "value")
        inside = frames.withColumn("w", F.expr(f"t_us div {us}")).join(spine.select("capture_id", "w"), ["capture_id", "w"], "left_semi")
        raw = values.union(features.fields(features.watched(inside, watch)).select("can_id", "field", "value"))
    model = written(field_model(stats if stats is not None else sums.ranges(features.watched(whole, watch)), window_fields, percent, raw), "stage2")
    checks = features.payload(window_fields, spine, model, mode)
    return Stage2(model, written(reference(checks, PAYLOAD), "reference2"), n, us, mode, watch)


def ranked(checks: DataFrame, reference_: DataFrame, names: tuple[str, ...], n: int, stage: int, said: Column) -> DataFrame:
    """checks with a score for each check, score_s<stage> (the largest), top_s<stage> (its check; of equal ones the first
    in order) and evidence_s<stage>, said if the score is beyond all training windows'."""
    own = ranks.scores(written(checks, "checks"), reference_, names, [])
    score = F.array_max(F.array(*[F.col(f"{c}_score") for c in names]))
    top = F.coalesce(*[F.when(F.col(f"{c}_score") == score, F.lit(c)) for c in names])
    kind = "timing" if stage == 1 else "payload"
    own = own.withColumns({f"score_s{stage}": score, f"top_s{stage}": top})
    told = (F.col(f"score_s{stage}") > n / (n + 1)) & said.isNotNull()
    text = F.when(told, F.concat(F.lit(f"unusual {kind} ("), F.col(f"top_s{stage}"), F.lit("): "), said)).otherwise(f"{kind} as in training")
    return own.withColumn(f"evidence_s{stage}", text)


def score_stage1(frames: DataFrame, m: Stage1, table: DataFrame | None = None) -> DataFrame:
    """Every complete window of frames. table: sums.of_frames() of the frames, if they are there already."""
    us = m.window_us
    table = written(sums.of_frames(frames.drop("payload").withColumn("payload", F.lit("")), us), "sums") if table is None else table
    own = sums.complete(table)
    checks = features.timing(sums.per_id(own), sums.spine(table, us), m.ids, us / 1e6)
    said = (
        F.when(F.col("top_s1") == "unknown_ids", F.when(F.col("unknown_kinds") > 0, F.format_string("ids never seen in training: %d, e.g. %s with %d frames", "unknown_kinds", "unknown_id", "unknown_n")))
        .when(F.col("top_s1") == "rate_excess", F.when(F.col("rate_id").isNotNull(), F.format_string("ID %s sends %.1f times as often as it did", "rate_id", "rate_excess")))
        .otherwise(F.when(F.col("gap_id").isNotNull(), F.format_string("ID %s leaves gaps %.1f times as short", "gap_id", "short_gaps")))
    )
    return ranked(checks, m.reference, TIMING, m.n, 1, said)


def score_stage2(frames: DataFrame, m: Stage2, table: DataFrame | None = None) -> DataFrame:
    """Every complete window of frames. table: sums.of_frames() of the frames, if they are there already."""
    us = m.window_us
    table = written(sums.of_frames(frames, us), "sums") if table is None else table
    own = features.watched(sums.complete(table), m.watch)
    checks = features.payload(sums.per_field(own), sums.spine(table, us), m.fields, m.mode)
    at = F.when(F.col("top_s2") == "out_of_range", F.col("range_at")).when(F.col("top_s2") == "frozen_break", F.col("frozen_at")).otherwise(F.col("jump_at"))
    what = F.when(F.col("top_s2") == "out_of_range", "value out of normal range").when(F.col("top_s2") == "frozen_break", "frozen for the whole window").otherwise("jump beyond the normal largest")
    return ranked(checks, m.reference, PAYLOAD, m.n, 2, F.when(at.isNotNull(), F.concat(F.lit("ID "), at, F.lit(": "), what)))


def fuse(scored: DataFrame) -> DataFrame:
    """attack_score, stage and evidence: the higher stage's; Stage 1's if they are equal or there is no other."""
    two = F.coalesce(F.col("score_s2") > F.col("score_s1"), F.lit(False)) if "score_s2" in scored.columns else F.lit(False)
    other = (F.col("score_s2"), F.col("evidence_s2")) if "score_s2" in scored.columns else (F.col("score_s1"), F.col("evidence_s1"))
    return scored.withColumns(
        {
            "attack_score": F.when(two, other[0]).otherwise(F.col("score_s1")), "stage": F.when(two, 2).otherwise(1),
            "evidence": F.when(two, F.concat(F.lit("[Stage 2] "), other[1])).otherwise(F.concat(F.lit("[Stage 1] "), F.col("evidence_s1"))),
        }
    )


def decide(scored: DataFrame, threshold: float | Column, version: str) -> DataFrame:
    """The outputs table: a window attacks if its score reaches the threshold."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return scored.select(
        "window_id", "capture_id", "w", "attack_score", t.alias("threshold"), F.when(F.col("attack_score") >= t, "ATTACK").otherwise("ACCEPT").alias("decision"), "evidence", F.lit(version).alias("model_version"),
        F.lit(None).cast("double").alias("latency_ms"),
    )


@dataclass
class Detector:
    stage1: Stage1
    threshold: float
    version: str
    stage2: Stage2 | None = None

    def raw(self, frames: DataFrame) -> DataFrame:
        if self.stage2 is None:
            return fuse(score_stage1(frames, self.stage1))
        if self.stage2.window_us != self.stage1.window_us:
            raise ValueError("the stages were fitted on windows of different lengths")
        table = written(sums.of_frames(frames, self.stage1.window_us), "sums")
        one, two = score_stage1(frames, self.stage1, table), score_stage2(frames, self.stage2, table)
        return fuse(one.join(two.drop("window_id", "start_us", "end_us"), ["capture_id", "w"]))

    def score(self, frames: DataFrame) -> DataFrame:
        """The outputs of every window of frames."""
        return decide(self.raw(frames), self.threshold, self.version)

    def save(self, path: str, overwrite: bool = False) -> None:
        """The model's tables below a folder; an error if there is a model, unless it may be replaced.

        The tables go to a folder of their own, and the one small file that names it is written last, so a save that breaks
        off leaves no half of a model, and the former one as it was.
        """
        spark = self.stage1.ids.sparkSession
        meta_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        if not overwrite and meta_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta_path):
            raise FileExistsError(f"a model exists in {path}")
        at = f"tables-{uuid.uuid4().hex}"
        meta = {"version": self.version, "threshold": self.threshold, "n": self.stage1.n, "window_us": self.stage1.window_us, "at": at}
        tables = {"ids": self.stage1.ids, "reference1": self.stage1.reference}
        if self.stage2 is not None:
            meta |= {"mode": self.stage2.mode, "watch": self.stage2.watch, "n2": self.stage2.n}
            tables |= {"fields": self.stage2.fields, "reference2": self.stage2.reference}
        for name, df in tables.items():
            df.write.parquet(f"{path}/{at}/{name}")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str, version: str | None = None) -> Detector:
    """A saved detector; an error if it is of another version than asked for."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if version is not None and meta["version"] != version:
        raise ValueError(f"{path} holds {meta['version']}, not {version}")
    read = lambda name: spark.read.parquet(f"{path}/{meta['at']}/{name}")
    two = None
    if "mode" in meta:
        two = Stage2(read("fields"), read("reference2"), meta["n2"], meta["window_us"], meta["mode"], meta["watch"])
    return Detector(Stage1(read("ids"), read("reference1"), meta["n"], meta["window_us"]), meta["threshold"], meta["version"], two)


def fused_or(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two detectors' outputs as one that attacks if either does: the larger score against its threshold, at most 1."""
    right = b.select("window_id", F.col("attack_score").alias("sb"), F.col("threshold").alias("tb"), F.col("decision").alias("db"))
    r = lambda s, t: F.when(F.col(t) > 0, F.col(s) / F.col(t)).otherwise(1.0)
    alarm = lambda d: F.when(F.col(d) == "ATTACK", 1.0).otherwise(0.0)
    score = F.least(F.greatest(r("attack_score", "threshold"), r("sb", "tb"), alarm("decision"), alarm("db")), F.lit(1.0))
    return a.join(right, "window_id").select("window_id", score.alias("attack_score"), F.lit(1.0).alias("threshold"), F.when(score >= 1.0, "ATTACK").otherwise("ACCEPT").alias("decision"))


def threshold_of(scores: DataFrame, far: float) -> float:
    """The lowest threshold at which at most floor(far n) of the normal scores (attack_score) raise an alarm: the next double
    above calibrate.boundary(); 0 if all may. An error if that is above 1."""
    boundary = calibrate.boundary(scores, far)
    if boundary is None:
        return 0.0
    t = math.nextafter(boundary, math.inf)
    if t > 1:
        raise ValueError("every threshold in 0..1 raises more alarms than allowed")
    return t
