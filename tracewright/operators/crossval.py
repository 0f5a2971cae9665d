"""Cross-validation of both detectors with every fold in one plan.

Captures are summed once (sums.of_frames). A model is named by a number; models of all folds are those sums joined with the
captures they train and summed again, all models score their captures in one join, and their references are ranked in one
merge. Nothing loops over folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators import calibrate, features, model, ranks, sums
from tracewright.operators.features import PAYLOAD, TIMING
from tracewright.operators.store import small, written


@dataclass
class Folds:
    """train: (model, capture_id), which captures train each model. cases: (model, capture_id, role), which it scores for what.
    watch: (model, can_id), what its second stage looks at; None for all."""

    train: DataFrame
    cases: DataFrame
    watch: DataFrame | None = None


def leave_out(captures: DataFrame) -> DataFrame:
    """(model, outer, inner): the models of a nested leave-one-out. outer is held out, and inner as well where it is not NULL.
    A row a pair of captures, of which there are tens."""
    c = captures.select("capture_id").distinct()
    outer, inner = c.withColumnRenamed("capture_id", "outer"), c.withColumnRenamed("capture_id", "inner")
    pairs = outer.crossJoin(inner).where("outer <> inner").union(outer.withColumn("inner", F.lit(None).cast("string")))
    return pairs.withColumn("model", F.concat_ws("|", "outer", F.coalesce("inner", F.lit("")))).select("model", "outer", "inner")


def leave_out_folds(captures: DataFrame) -> Folds:
    """Each model is trained by the captures it leaves; it scores inner for outer's threshold, or outer itself."""
    models, c = leave_out(captures), captures.select("capture_id").distinct()
    train = models.crossJoin(F.broadcast(c)).where((F.col("capture_id") != F.col("outer")) & (F.col("inner").isNull() | (F.col("capture_id") != F.col("inner")))).select("model", "capture_id")
    cases = models.select("model", F.coalesce("inner", "outer").alias("capture_id"), F.when(F.col("inner").isNull(), "test").otherwise("threshold").alias("role"))
    return Folds(train, cases)


@dataclass
class Models:
    """ids: model, can_id, rate, median_gap. fields: model, can_id, field and the columns of the Stage 2 table."""

    ids: DataFrame
    fields: DataFrame


def fit(table: DataFrame, folds: Folds, us: int) -> Models:
    """Both stages of every model. A capture's sums are made first, so each model adds a row a capture and sender or field."""
    own, train = sums.complete(table), folds.train
    windows = sums.spine(table, us).groupBy("capture_id").agg(F.count(F.lit(1)).alias("windows"))
    total = train.join(windows, "capture_id").groupBy("model").agg(F.sum("windows").alias("windows"))
    frames = sums.per_id(own).groupBy("capture_id", "can_id").agg(F.sum("n").alias("frames"))
    rate = train.join(frames, "capture_id").groupBy("model", "can_id").agg(F.sum("frames").alias("frames"))
    # There may be as many gaps as frames, so they don't meet the models; their medians are found by counts.
    gaps = written(sums.gaps(own).groupBy("capture_id", "can_id", F.col("gap_us").alias("value")).agg(F.sum("n").alias("n")), "fold-gaps")
    median = ranks.medians(gaps, train, "capture_id", "can_id").withColumnRenamed("median", "gap")
    known = rate.join(median, ["model", "can_id"], "left").join(total, "model")
    ids = known.select("model", "can_id", (F.col("frames") / (F.col("windows") * (us / 1e6))).alias("rate"), F.greatest(F.col("gap") / 1e6, F.when(F.col("gap").isNotNull(), F.lit(1e-6))).alias("median_gap"))

    fields = sums.per_field(own)
    stats = sums.ranges(table).union(features.merged(fields.select("capture_id", "can_id", "field", "low", "high", F.coalesce("jump", F.lit(0)).alias("jump")), ["capture_id"]))
    held = features.frozen(fields, ["capture_id"])
    watched = train.join(folds.watch, "model") if folds.watch is not None else train
    on = ["capture_id", "can_id"] if folds.watch is not None else ["capture_id"]
    ranges = watched.join(features.merged(stats, ["capture_id"]), on).groupBy("model", "can_id", "field").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("jump").alias("max_jump"))
    still = train.join(held, "capture_id").groupBy("model", "can_id", "field").agg(F.sum("constant").alias("constant"), F.sum("seen").alias("seen"))
    both = ranges.join(still, ["model", "can_id", "field"], "left").fillna(0, ["constant", "seen"])
    return Models(written(ids, "fold-stage1"), written(both.withColumns({"bound_low": F.col("low").cast("double"), "bound_high": F.col("high").cast("double")}), "fold-stage2"))


def checks(table: DataFrame, folds: Folds, models: Models, us: int, mode: str = "width") -> DataFrame:
    """model, capture_id, w and the six checks of every window that a model was trained on or scores, 0 where nothing fires."""
    own, met = sums.complete(table), folds.train.union(folds.cases.select("model", "capture_id")).distinct()
    met = small(met, 128)
    ids = sums.per_id(own).drop("first").join(met, "capture_id").join(small(models.ids, 128), ["model", "can_id"], "left")
    foreign, excess, short = features.timing_scores(us / 1e6)
    one = ids.groupBy("model", "capture_id", "w").agg(F.sum(F.when(foreign, F.col("n"))).cast("double").alias("unknown_ids"), F.max(excess).alias("rate_excess"), F.max(short).alias("short_gaps"))
    fields = sums.per_field(own).withColumnsRenamed({"low": "v_low", "high": "v_high"}).join(met, "capture_id").join(small(models.fields, 192), ["model", "can_id", "field"])
    out, frozen, jump = features.payload_scores(mode)
    two = fields.groupBy("model", "capture_id", "w").agg(F.max(out).alias("out_of_range"), F.max(frozen).alias("frozen_break"), F.max(jump).alias("large_jump"))
    every = sums.spine(table, us).select("capture_id", "w", "window_id").join(met, "capture_id")
    key = ["model", "capture_id", "w"]
    return every.join(one, key, "left").join(two, key, "left").fillna(0.0, [*TIMING, *PAYLOAD])


def scores(table: DataFrame, folds: Folds, us: int, mode: str = "width") -> DataFrame:
    """model, capture_id, w, window_id, role, v1 (Stage 1's score), v2 (the higher of both stages') of all cases."""
    rows = written(checks(table, folds, fit(table, folds, us), us, mode), "fold-checks")
    names = (*TIMING, *PAYLOAD)
    reference = model.reference(rows.join(small(folds.train, 128), ["model", "capture_id"], "left_semi"), names, ["model"])
    own = written(rows.join(small(folds.cases, 128), ["model", "capture_id"]), "fold-cases")
    ranked = ranks.scores(own, reference, names, ["model"])
    first = F.greatest(*[F.col(f"{c}_score") for c in TIMING])
    return ranked.select("model", "capture_id", "w", "window_id", "role", first.alias("v1"), F.greatest(first, *[F.col(f"{c}_score") for c in PAYLOAD]).alias("v2"))


def versions(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, version, attack_score): v1 and v2 as rows."""
    return scored.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.col(v).alias("attack_score")) for v in ("v1", "v2")])))


def alarm() -> Column:
    """Whether a score reaches the threshold above a boundary; without one every score does."""
    return F.col("boundary").isNull() | (F.col("attack_score") > F.col("boundary"))


def leave_one_out(frames: DataFrame, us: int, far: float, mode: str = "width", table: DataFrame | None = None) -> DataFrame:
    """Nested leave-one-capture-out of both detectors: (outer, version, boundary, alarms, windows).

    The threshold for a held-out capture is the next double above boundary, the (floor(far n) + 1)-th highest of the scores
    of the others' windows, each by a model that has seen neither of the two captures; NULL lets every score alarm. The
    held-out one is then scored by the model of all others. table: sums.of_frames() of the frames, if they are there
    already. An error with fewer than three captures.
    """
    table = written(sums.of_frames(frames, us), "sums") if table is None else table
    captures = table.select("capture_id").distinct()
    if captures.count() < 3:
        raise ValueError("leave-one-out needs three captures or more")
    folds = leave_out_folds(captures)
    own = written(versions(scores(table, folds, us, mode).withColumn("outer", F.split_part("model", F.lit("|"), F.lit(1))), "outer", "role"), "fold-scores")
    boundary = calibrate.thresholds(own.where("role = 'threshold'"), ["outer", "version"], far)
    held = own.where("role = 'test'").join(boundary, ["outer", "version"])
    return held.groupBy("outer", "version", "boundary").agg(F.count_if(alarm()).alias("alarms"), F.count(F.lit(1)).alias("windows"))


def false_alarms(rows: DataFrame, far: float, us: int) -> dict[str, dict]:
    """calibrate.false_alarms() of each version over all held-out captures, and captures_over_target."""
    out = {}
    for r in rows.groupBy("version").agg(F.sum("alarms").alias("a"), F.sum("windows").alias("n"), F.count_if(F.col("alarms") / F.col("windows") > far).alias("over")).collect():
        out[r["version"]] = calibrate.false_alarms(r["a"], r["n"], far, us / 1e6) | {"captures_over_target": r["over"]}
    return out


def fold_watch(rules: DataFrame) -> DataFrame:
    """(fold, watch): for each fold the targets of the other folds' captures, in order; rules has fold and target."""
    targets = rules.where("fold is not null").select("fold", "target")
    other = targets.where("target is not null").distinct().withColumnRenamed("fold", "from")
    pairs = targets.select("fold").distinct().join(other, F.col("fold") != F.col("from"))
    return pairs.groupBy("fold").agg(F.array_sort(F.collect_set("target")).alias("watch"))


def attack_cv(table: DataFrame, captures: DataFrame, labels: DataFrame, us: int, far: float, mode: str = "width") -> DataFrame:
    """(fold, version, boundary, capture_id, family, condition, attacked, detected, normal, false_alarms).

    For each fold of the development captures both stages are fitted on the train captures, the second one watching the
    targets of the other folds' attacks only; the threshold comes from the validation captures; the fold's own captures are
    scored. table: sums.of_frames() of all of them. captures: capture_id, group, fold, family, kind, target. labels: those of
    the windows. An error with fewer than two folds, or if a fold has nothing to watch.
    """
    dev = captures.where("`group` = 'development' and fold is not null")
    watch = fold_watch(dev)
    n, watched = dev.select("fold").distinct().count(), watch.count()
    if n < 2 or watched < n:
        raise ValueError("attack cross-validation needs two folds or more, each with targets in the others")
    m = F.col("fold").cast("string").alias("model")
    names = dev.select("fold").distinct()
    of = lambda group, role: names.crossJoin(F.broadcast(captures.where(F.col("group") == group).select("capture_id"))).select(m, "capture_id", F.lit(role).alias("role"))  # noqa: E731  folds x captures
    folds = Folds(of("train", "train").drop("role"), of("validation", "threshold").union(dev.select(m, "capture_id", F.lit("test").alias("role"))), watch.select(m, F.explode("watch").alias("can_id")))
    own = written(versions(scores(table, folds, us, mode), "model", "role", "window_id"), "fold-scores")
    boundary = calibrate.thresholds(own.where("role = 'threshold'"), ["model", "version"], far)
    held = own.where("role = 'test'").join(boundary, ["model", "version"]).withColumn("alarm", alarm())
    marked = held.join(labels.select("window_id", "capture_id", "is_attack"), "window_id").join(captures.select("capture_id", "fold", "kind", F.col("family").alias("recording_family")), "capture_id")
    return attack_folds(marked, "version", "boundary")


def attack_folds(scored: DataFrame, *keys: str) -> DataFrame:
    """(fold, keys, capture_id, family, condition, attacked, detected, normal, false_alarms) of scored, labelled windows with
    alarm. A masquerade recording's normal windows are its twin's and are left out."""
    own = scored.where(~((F.col("kind") == "masquerade") & ~F.col("is_attack")))
    a, hit = F.col("is_attack"), F.col("alarm")
    return own.groupBy("fold", *keys, "capture_id", "recording_family", "kind").agg(F.count_if(a).alias("attacked"), F.count_if(a & hit).alias("detected"), F.count_if(~a).alias("normal"), F.count_if(~a & hit).alias("false_alarms")).withColumnsRenamed({"recording_family": "family", "kind": "condition"})
