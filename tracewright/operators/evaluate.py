"""Outcomes, rates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.ids import ratio
from tracewright.functions.quantiles import nearest_rank_p95


def mismatches(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(window_id, problem): ids that repeat on either side or are on one side only."""
    a = outputs.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_a"))
    b = labels.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_b"))
    both = a.join(b, "window_id", "full")
    problem = F.when(F.col("n_b").isNull(), "no label").when(F.col("n_a").isNull(), "no output").when(F.col("n_a") > 1, "repeated output").when(F.col("n_b") > 1, "repeated label")
    return both.select("window_id", problem.alias("problem")).where("problem is not null")


def evaluate(outputs: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """outputs with is_attack, family and outcome (TP, FP, TN, FN). strict: an error if ids don't match one to one."""
    if strict and (bad := mismatches(outputs, labels).limit(1).collect()):
        raise ValueError(f"window {bad[0]['window_id']}: {bad[0]['problem']}")
    alarm, attack = F.col("decision") == "ATTACK", F.col("is_attack")
    outcome = F.when(alarm & attack, "TP").when(alarm, "FP").when(attack, "FN").otherwise("TN")
    return outputs.join(labels.select("window_id", "is_attack", "family"), "window_id").withColumn("outcome", outcome)


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == x).alias(x.lower()) for x in ("TP", "FP", "TN", "FN")]


def _rates(df: DataFrame, *keys: str) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return df.select(*keys, "tp", "fp", "tn", "fn", ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("false_alarm_rate"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "mean_latency_ms")


def metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and recall, false_alarm_rate, precision, f1 (NULL over 0), mean latency; one row, or one a group."""
    keys = by or []
    return _rates(results.groupBy(*keys).agg(*_counts(), F.avg("latency_ms").alias("mean_latency_ms")), *keys)


def grouped_metrics(results: DataFrame) -> DataFrame:
    """metrics() in all, by family and by capture from one pass; level says which."""
    sets = results.groupingSets([[], ["family"], ["capture_id"]], "family", "capture_id").agg(*_counts(), F.avg("latency_ms").alias("mean_latency_ms"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "family").otherwise("capture")
    return _rates(sets.withColumn("level", level), "level", "family", "capture_id")


def macro_recall(rows: DataFrame) -> DataFrame:
    """Recall by condition and family, and its mean over families, from (condition, family, attacked, detected).

    Each condition and all of them together; families without an attack are left out; 4 digits, the mean is of the
    rounded values and rounded again.
    """
    sums = rows.groupingSets([["condition", "family"], ["family"]], "condition", "family").agg(F.sum("attacked").alias("attacked"), F.sum("detected").alias("detected")).where("attacked > 0")
    each = sums.select(F.coalesce("condition", F.lit("all")).alias("condition"), "family", F.round(F.col("detected") / F.col("attacked"), 4).alias("recall"))
    return each.groupBy("condition").agg(F.count(F.lit(1)).alias("families"), F.round(F.avg("recall"), 4).alias("macro_recall"))


def detection_delay(scored: DataFrame, strict_end: bool = False, exclude_fuzzing: bool = False) -> DataFrame:
    """One row a capture whose attack labels have one interval start: delay_s from it to the end of the first window that
    ends at or after it and attacks; NULL for a miss. scored: outputs with labels and start_us, end_us.

    Later alarms count however late and whether or not that window is an attack; strict_end asks for one that is.
    """
    own = scored.where("kind <> 'fuzzing'") if exclude_fuzzing else scored
    starts = own.where("is_attack and injection_interval is not null").groupBy("capture_id").agg(F.min("injection_interval.start").alias("start_s"), F.count_distinct("injection_interval.start").alias("n")).where("n = 1")
    alarm = (F.col("decision") == "ATTACK") & (F.col("end_us") / 1e6 >= F.col("start_s"))
    alarm = alarm & F.col("is_attack") if strict_end else alarm
    return own.join(starts, "capture_id").groupBy("capture_id", "start_s").agg(F.min(F.when(alarm, F.col("end_us") / 1e6 - F.col("start_s"))).alias("delay_s"))


def delay_report(delays: DataFrame) -> DataFrame:
    """captures, detected, missed, mean, median, p95 (nearest rank) and largest delay, of those detected."""
    p95 = nearest_rank_p95(delays, [], "delay_s", "p95_delay_s")
    main = delays.agg(F.count(F.lit(1)).alias("captures"), F.count("delay_s").alias("detected"), F.count_if(F.col("delay_s").isNull()).alias("missed"), F.avg("delay_s").alias("mean_delay_s"), F.percentile("delay_s", 0.5).alias("median_delay_s"), F.max("delay_s").alias("max_delay_s"))
    return main.join(p95, how="left")


def in_band(half_width: float | Column) -> Column:
    """Whether a score is as near to its threshold as half_width; the band is closed and ends at 0 and 1."""
    h = F.lit(half_width) if isinstance(half_width, (int, float)) else half_width
    return F.col("attack_score").between(F.greatest(F.lit(0.0), F.col("threshold") - h), F.least(F.lit(1.0), F.col("threshold") + h))


def escalations(outputs: DataFrame, half_width: float) -> DataFrame:
    """outputs with escalate, band_low, band_high and reason."""
    if isinstance(half_width, bool) or not 0 <= half_width <= 0.5:
        raise ValueError("a band's half width is 0 to 0.5")
    low, high = F.greatest(F.lit(0.0), F.col("threshold") - half_width), F.least(F.lit(1.0), F.col("threshold") + half_width)
    own = outputs.withColumns({"band_low": low, "band_high": high, "escalate": F.col("attack_score").between(low, high)})
    inside = F.format_string("%.3f lies in the band %.3f to %.3f about the threshold %.3f: ask", "attack_score", "band_low", "band_high", "threshold")
    outside = F.format_string("%.3f lies beyond the band %.3f to %.3f: decided here", "attack_score", "band_low", "band_high")
    return own.withColumn("reason", F.when(F.col("escalate"), inside).otherwise(outside))


BUNDLE = ("window_id", "attack_score", "threshold", "decision", "evidence", "model_version")


def sanitize(outputs: DataFrame) -> DataFrame:
    """What may leave the vehicle, and nothing else."""
    return outputs.select(*BUNDLE)


def second_opinion(bundle: DataFrame, other_threshold: float = 0.6) -> DataFrame:
    """A simulated second opinion by a fixed threshold of its own: confirm, override_to_attack or override_to_accept."""
    attack = F.col("attack_score") >= other_threshold
    advice = F.when(attack == (F.col("decision") == "ATTACK"), "confirm").when(attack, "override_to_attack").otherwise("override_to_accept")
    return bundle.select("window_id", advice.alias("advice"), F.format_string("opinion of the stand-in on a score of %.3f", "attack_score").alias("note"))


ACTIONS = ("SIMULATED_ALERT", "SIMULATED_FORWARD", "SIMULATED_ISOLATION")


def actions(outputs: DataFrame, on_attack: str = "SIMULATED_ALERT") -> DataFrame:
    """The simulated response to each output."""
    action = F.when(F.col("decision") == "ATTACK", on_attack).otherwise("SIMULATED_FORWARD")
    message = F.format_string("simulated, nothing was sent: %s, window %s, score %.2f against %.2f", action, "window_id", "attack_score", "threshold")
    return outputs.select("window_id", "attack_score", "decision", action.alias("action"), message.alias("message"))


def action_counts(done: DataFrame) -> DataFrame:
    """Each action's count, 0 included."""
    every = done.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    return every.join(done.groupBy("action").agg(F.count(F.lit(1)).alias("n")), "action", "left").fillna(0, ["n"])


def escalation_quality(results: DataFrame, half_width: float) -> DataFrame:
    """How well a band picks the local errors, of evaluated outputs: one row. Bytes are of a bundle's JSON, as UTF-8."""
    wrong, inside = F.col("outcome").isin("FP", "FN"), in_band(half_width)
    size = F.octet_length(F.to_json(F.struct(*BUNDLE)))
    c = lambda x: F.count_if(x)
    n = results.agg(
        F.count(F.lit(1)).alias("windows"), c(inside).alias("escalations"), c(wrong).alias("local_errors"), c(F.col("outcome") == "FP").alias("local_false_positives"), c(F.col("outcome") == "FN").alias("local_false_negatives"),
        c(inside & wrong).alias("escalated_errors"), c(inside & (F.col("outcome") == "FP")).alias("escalated_false_positives"), c(inside & (F.col("outcome") == "FN")).alias("escalated_false_negatives"), c(~inside & wrong).alias("_out"),
        F.avg(F.when(inside, size)).alias("bundle_bytes_mean"), F.max(F.when(inside, size)).alias("bundle_bytes_max"), F.coalesce(F.sum(F.when(inside, size)), F.lit(0)).alias("bundle_bytes_total"),
    )
    col = F.col
    return n.withColumns(
        {
            "escalation_rate": ratio(col("escalations"), col("windows")), "escalation_precision": ratio(col("escalated_errors"), col("escalations")), "escalation_recall": ratio(col("escalated_errors"), col("local_errors")),
            "error_rate_outside_band": ratio(col("_out"), col("windows") - col("escalations")), "local_accuracy": ratio(col("windows") - col("local_errors"), col("windows")),
            "local_plus_perfect_cloud_accuracy": ratio(col("windows") - col("_out"), col("windows")),
        }
    ).drop("_out")


def egress(outcomes: DataFrame) -> DataFrame:
    """One row: escalation_rate (0 of nothing), failed (no answer), correction_rate over answers, latency mean and p95."""
    up = F.col("escalated")
    main = outcomes.agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(up).alias("escalations"), F.count_if(up & F.col("corrected").isNull()).alias("failed"), F.count_if(up & F.col("corrected")).alias("corrected"),
        F.count_if(up & F.col("corrected").isNotNull()).alias("answered"), F.avg(F.when(up, F.col("added_latency_ms"))).alias("mean_latency_ms"),
    )
    p95 = nearest_rank_p95(outcomes.where("escalated"), [], "added_latency_ms", "p95_latency_ms")
    both = main.join(p95, how="left")
    return both.select("windows", "escalations", F.coalesce(ratio(F.col("escalations"), F.col("windows")), F.lit(0.0)).alias("escalation_rate"), "failed", ratio(F.col("corrected"), F.col("answered")).alias("correction_rate"), "mean_latency_ms", "p95_latency_ms")


def benchmark(latencies: DataFrame) -> DataFrame:
    """One row of (latency_ms): windows, mean, median, p95 (interpolated), max and windows_per_s (0 of nothing)."""
    n, total = F.count("latency_ms"), F.sum("latency_ms")
    return latencies.agg(
        n.alias("windows"), F.avg("latency_ms").alias("mean_ms"), F.percentile("latency_ms", 0.5).alias("median_ms"), F.percentile("latency_ms", 0.95).alias("p95_ms"), F.max("latency_ms").alias("max_ms"),
        F.coalesce(F.try_divide(n.cast("double"), total / 1000), F.lit(0.0)).alias("windows_per_s"),
    )


def compare_models(baseline: DataFrame, updated: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """metrics of two models on the same windows, a row each; an error if their windows, versions or training don't allow it."""
    for a, b in ((baseline, labels), (updated, labels)):
        if bad := mismatches(a, b).limit(1).collect():
            raise ValueError(f"window {bad[0]['window_id']}: {bad[0]['problem']}")
    versions = [df.select("model_version").distinct().limit(2).collect() for df in (baseline, updated)]
    if [len(v) for v in versions] != [1, 1] or versions[0] == versions[1]:
        raise ValueError("each side needs one version, and they must differ")
    if training is not None and labels.join(training, "window_id", "left_semi").limit(1).count():
        raise ValueError("windows were trained on")
    both = evaluate(baseline, labels, False).unionByName(evaluate(updated, labels, False))
    return metrics(both, ["model_version"])


def unmatched(a: DataFrame, b: DataFrame, key: str = "window_id") -> DataFrame:
    """Ids on one side only: (key, side)."""
    left = a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return left.union(b.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right")))


#: Leaves that one node of a fingerprint tree covers.
FAN = 1024


def fingerprint_leaves(df: DataFrame, by: list[str], leaf: Column, order: str) -> DataFrame:
    """(by, leaf, n, sha256): a hash of the rows of each leaf, as JSON, in order. leaf numbers parts of a bounded size in which
    a group's order goes on, such as windows."""
    # Text sorts as its order does, so a leaf is one array of fixed-length texts and numbers.
    one = F.struct(F.col(order).alias("o"), F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("h"))
    return df.groupBy(*by, leaf.cast("long").alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["h"]), ""), 256).alias("sha256"))


def fingerprint_tree(leaves: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, node, n, sha256): leaves at level 0, and above them nodes that hash FAN nodes each, up to one a group.

    A node's hash covers its children's numbers and hashes in order; no group is gathered in one row.
    """
    level, every = 0, leaves.select(*by, F.lit(0).alias("level"), F.col("leaf").alias("node"), "n", "sha256")
    below = every
    most = leaves.agg(F.max("leaf")).first()[0] or 0
    while most > 0 or level == 0:
        level, most = level + 1, most // FAN
        child = F.struct("node", F.concat(F.col("node").cast("string"), F.lit(":"), "sha256", F.lit(";")).alias("h"))
        below = below.groupBy(*by, F.floor(F.col("node") / FAN).alias("parent")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["h"]), ""), 256).alias("sha256"))
        below = below.select(*by, F.lit(level).alias("level"), F.col("parent").alias("node"), "n", "sha256")
        every = every.union(below)
    return every


def fingerprint(df: DataFrame, by: list[str], order: str, leaf: Column | None = None) -> DataFrame:
    """(by, n, sha256): the top of each group's tree. Leaves are runs of FAN numbers of order, or as leaf says."""
    tree = fingerprint_tree(fingerprint_leaves(df, by, F.floor(F.col(order) / FAN) if leaf is None else leaf, order), by)
    top = tree.agg(F.max("level")).first()[0]
    return tree.where(F.col("level") == (top if top is not None else 0)).select(*by, "n", "sha256")


def fingerprint_changes(a: DataFrame, b: DataFrame, key: str = "capture_id") -> DataFrame:
    """Keys whose fingerprint differs or is on one side only."""
    both = a.select(key, F.col("sha256").alias("was")).join(b.select(key, F.col("sha256").alias("is")), key, "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is")))


def tree_changes(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, leaf) of the leaves that differ between two written trees. From the top down, only the children of nodes that
    differ are looked at. Trees of different heights are compared from the lower one's top."""
    tops = [x.agg(F.max("level")).first()[0] for x in (a, b)]
    if None in tops:
        return a.union(b).where("level = 0").select(*by, F.col("node").alias("leaf"))
    at: DataFrame | None = None
    for level in range(min(tops), -1, -1):
        mine, other = (x.where(F.col("level") == level).select(*by, "node", F.col("sha256").alias(n)) for x, n in ((a, "was"), (b, "is")))
        if at is not None:
            mine, other = (x.withColumn("parent", F.floor(F.col("node") / FAN)).join(at, [*by, "parent"], "left_semi").drop("parent") for x in (mine, other))
        at = mine.join(other, [*by, "node"], "full").where(~F.col("was").eqNullSafe(F.col("is"))).select(*by, F.col("node").alias("parent"))
    return at.withColumnRenamed("parent", "leaf")


def running(outputs: DataFrame) -> DataFrame:
    """outputs with running totals of a capture so far: windows, attacks, mean and peak score, new alarms (ACCEPT to ATTACK),
    and the mean score of the last 60 windows."""
    w = Window.partitionBy("capture_id").orderBy("w")
    so_far, recent = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-59, 0)
    alarm = F.col("decision") == "ATTACK"
    edge = alarm & (F.coalesce(F.lag("decision").over(w), F.lit("ACCEPT")) == "ACCEPT")
    return outputs.withColumn("new_alarm", edge).withColumns(
        {"windows": F.count(F.lit(1)).over(so_far), "attacks": F.count_if(alarm).over(so_far), "mean_score": F.avg("attack_score").over(so_far), "peak_score": F.max("attack_score").over(so_far), "recent_score": F.avg("attack_score").over(recent)}
    )


def display_outcome(truth: Column, decision: Column) -> Column:
    """missed, false_alarm or NULL, from truth (attack, normal or NULL)."""
    return F.when((truth == "attack") & (decision == "ACCEPT"), "missed").when((truth == "normal") & (decision == "ATTACK"), "false_alarm")
