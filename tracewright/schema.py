"""Table schemas and the invariants that rows must keep.

violations() lists broken rules as rows; guard() makes a job fail on the first broken row instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FRAMES = "capture_id string, line_no long, t_us long, can_id string, payload string"
OUTPUTS = "window_id string, attack_score double, threshold double, decision string, evidence string, model_version string, latency_ms double"
LABELS = "window_id string, is_attack boolean, family string, target string, injection_interval struct<start:double,end:double>, injected_frames int, interval_overlap_s double"
CAPTURES = "name string, capture_id string, folder string, `group` string, kind string, family string, twin string, fold int"
SPECS = "attack_id string, family string, target_can_id string, start_offset_ms double, duration_ms double, reasoning string, byte_index int, offset int"
EVASIONS = "attack_id string, window_id string, family string, target_can_id string, start_offset_ms double, duration_ms double, attack_score double, model_version string, split string"

GROUPS = ("train", "validation", "development", "final_test", "separate")
KINDS = ("ambient", "fabrication", "masquerade", "fuzzing", "accelerator")


def _is_unit(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(0.0, 1.0)


def _neutral(c: str) -> Column:
    """An id must not give away what kind of recording it is from."""
    return ~F.lower(F.coalesce(F.col(c), F.lit(""))).rlike("ambient|attack")


def _label_rules() -> dict[str, Column]:
    at = F.col("injection_interval")
    finite = ~F.isnan(at["start"]) & ~F.isnan(at["end"]) & (F.abs(at["end"]) < float("inf"))
    bare = F.col("family").isNull() & F.col("target").isNull() & at.isNull() & (F.col("injected_frames") == 0) & F.col("interval_overlap_s").isNull()
    return {
        "attack needs a family": ~F.col("is_attack") | F.col("family").isNotNull(),
        "normal must be bare": F.col("is_attack") | bare,
        "interval": at.isNull() | (finite & (at["start"] >= 0) & (at["end"] > at["start"])),
    }


RULES = {
    "frames": lambda: {
        "id is hex": F.col("can_id").rlike("^[0-9A-Fa-f]+$"),
        "payload is hex": F.col("payload").rlike("^[0-9A-Fa-f]*$"),
        "payload has whole bytes": F.length("payload") % 2 == 0,
        "payload has 8 bytes at most": F.length("payload") <= 16,
    },
    "windows": lambda: {
        "ids are neutral": _neutral("window_id") & _neutral("capture_id"),
        "end is not before start": F.col("end_us") >= F.col("start_us"),
    },
    "outputs": lambda: {
        "score in 0..1": _is_unit("attack_score"),
        "threshold in 0..1": _is_unit("threshold"),
        "decision follows the score": (F.col("decision") == "ATTACK") == (F.col("attack_score") >= F.col("threshold")),
        "decision is known": F.col("decision").isin("ATTACK", "ACCEPT"),
        "latency": F.col("latency_ms").isNull() | (F.col("latency_ms") >= 0),
    },
    "labels": _label_rules,
    "specs": lambda: {
        "offset has byte and offset": (F.col("family") != "offset") | (F.col("byte_index").between(0, 7) & F.col("offset").between(-128, 127) & (F.col("offset") != 0)),
        "freeze has neither": (F.col("family") != "freeze") | (F.col("byte_index").isNull() & F.col("offset").isNull()),
        "interval": (F.col("start_offset_ms") >= 0) & (F.col("duration_ms") > 0),
    },
    "outcomes": lambda: {
        "local outcome is bare": F.col("escalated") | (F.col("added_latency_ms").isNull() & F.col("corrected").isNull()),
        "escalation has latency": ~F.col("escalated") | F.coalesce(F.col("added_latency_ms") >= 0, F.lit(False)),
    },
    "captures": lambda: {
        "id form": F.col("capture_id").rlike(r"^cap\d{2,}$"),
        "fold marks development": F.col("fold").isNotNull() == ((F.col("group") == "development") & (F.col("kind") != "ambient")),
        "group is known": F.col("group").isin(*GROUPS),
        "kind is known": F.col("kind").isin(*KINDS),
    },
}


def violations(df: DataFrame, kind: str) -> DataFrame:
    """df's rows that break a rule, once for each, with the rule's name; a rule that can't be told counts as broken."""
    rules = RULES[kind]()
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def guard(df: DataFrame, kind: str) -> DataFrame:
    """df, whose evaluation fails on a row that breaks a rule."""
    ok = F.lit(True)
    for name, rule in RULES[kind]().items():
        ok = ok & F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"{kind}: {name}")).cast("boolean"))
    return df.where(ok)


def twin_violations(captures: DataFrame) -> DataFrame:
    """Captures whose twin is missing or in another group, and names and ids that repeat: (name, rule)."""
    other = captures.select(F.col("name").alias("twin"), F.col("group").alias("twin_group"), F.lit(True).alias("found"))
    pairs = captures.where("twin is not null").join(other, "twin", "left")
    bad = pairs.where("found is null").select("name", F.lit("twin is missing").alias("rule")).union(pairs.where("`group` <> twin_group").select("name", F.lit("twin is in another group").alias("rule")))
    for c in ("name", "capture_id"):
        again = captures.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first")).where("n > 1")
        bad = bad.union(again.select("first", F.lit(f"{c} repeats").alias("rule")))
    return bad


def within_window(frames: DataFrame) -> DataFrame:
    """Frames (t_us, start_us, end_us) outside their window, which is closed at both ends here."""
    return frames.where(~F.col("t_us").between(F.col("start_us"), F.col("end_us")))
