"""Text logs of bus frames, and the files that come with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tracewright.functions.ids import bit_positions, canonical_can_id, canonical_can_id_of_number

#: (seconds[.fraction]) bus id#payload. A fixed format.
LINE = r"^\((\d+)(?:\.(\d+))?\)\s+(\S+)\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]*)\s*$"
#: How much of its lines a capture may lose to repeats and unreadable ones.
MAX_REMOVED = 0.001


def _micros(seconds: Column, fraction: Column) -> Column:
    """Whole microseconds, cut, not rounded, in integers."""
    return seconds.cast("long") * 1_000_000 + F.substring(F.rpad(F.coalesce(fraction, F.lit("")), 9, "0"), 1, 6).cast("long")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(capture, line_no, value): capture is the file's name without its ending; line_no rises in file order.

    A large file is read in splits; where a split begins and the running number inside it give the order.
    """
    lines = spark.read.text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    numbered = lines.select(F.url_decode(name).alias("capture"), order.alias("at"), "value")
    # The row number inside a split is below 2^33, and a split begins at a byte below 2^63 / 2^33 of the largest files here.
    return numbered.select("capture", (F.col("at.block") * 1024 + F.pmod(F.col("at.row"), F.lit(1 << 33))).alias("line_no"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """lines with ts_text, abs_us, can_id, payload; NULL where a line isn't a frame. Upper case."""
    part = lambda k: F.regexp_extract("value", LINE, k)
    good = F.col("value").rlike(LINE)
    fraction = part(2)
    text = F.concat(part(1), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))
    return lines.select(
        "capture", "line_no", "value", F.when(good, text).alias("ts_text"), F.when(good, _micros(part(1), fraction)).alias("abs_us"),
        F.when(good, canonical_can_id(part(4))).alias("can_id"), F.when(good, F.upper(part(5))).alias("payload"),
    )


def frames(parsed: DataFrame) -> DataFrame:
    """(capture, line_no, t_us, can_id, payload): time counts from each file's first frame in file order."""
    good = parsed.where("abs_us is not null")
    zero = good.groupBy("capture").agg(F.min_by("abs_us", "line_no").alias("zero"))
    return good.join(zero, "capture").select("capture", "line_no", (F.col("abs_us") - F.col("zero")).alias("t_us"), "can_id", "payload")


def seconds(frames_: DataFrame) -> DataFrame:
    """Frames with their time in seconds, derived last."""
    return frames_.withColumn("timestamp", F.col("t_us") / F.lit(1e6))


def skipped(parsed: DataFrame) -> DataFrame:
    """(capture, skipped_lines): lines that hold something but no frame. Blank ones don't count."""
    bad = F.col("abs_us").isNull() & (F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    return parsed.groupBy("capture").agg(F.count_if(bad).alias("skipped_lines"))


def spans(parsed: DataFrame) -> DataFrame:
    """(capture, span_us, first_raw_timestamp): from the first to the last frame in file order."""
    good = parsed.where("abs_us is not null")
    return good.groupBy("capture").agg((F.max_by("abs_us", "line_no") - F.min_by("abs_us", "line_no")).alias("span_us"), F.min_by("ts_text", "line_no").alias("first_raw_timestamp"))


def profile(parsed: DataFrame) -> DataFrame:
    """One row a file: frames, skipped_lines, duration_s, unique_ids, first_raw_timestamp, msg_per_sec.

    A file without frames has duration 0; a rate over no time is 0.
    """
    bad = F.col("abs_us").isNull() & (F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    got = parsed.groupBy("capture").agg(
        F.count("abs_us").alias("frames"), F.count_if(bad).alias("skipped_lines"), F.countDistinct("can_id").alias("unique_ids"), F.min_by("ts_text", F.when(F.col("abs_us").isNotNull(), F.col("line_no"))).alias("first_raw_timestamp"),
        ((F.max_by("abs_us", F.when(F.col("abs_us").isNotNull(), F.col("line_no"))) - F.min_by("abs_us", F.when(F.col("abs_us").isNotNull(), F.col("line_no")))) / 1e6).alias("d"),
    )
    d = F.coalesce("d", F.lit(0.0))
    return got.select("capture", "frames", "skipped_lines", F.round(d, 6).alias("duration_s"), "unique_ids", "first_raw_timestamp", F.when(d > 0, F.round(F.col("frames") / d, 1)).otherwise(0.0).alias("msg_per_sec"))


def discover(files: DataFrame) -> DataFrame:
    """(folder, name, capture_id) of files (folder, name): ambient before attacks, names in order, cap01 onwards.

    There are as many rows as files, so one task numbers them.
    """
    known = files.where(F.col("folder").isin("ambient", "attacks"))
    number = F.row_number().over(Window.orderBy(F.col("folder") != "ambient", "name"))
    return known.select("folder", "name", F.format_string("cap%02d", number).alias("capture_id"))


SIGNALS = T.StructType(
    [T.StructField(n, t) for n, t in (("can_id", T.StringType()), ("name", T.StringType()), ("start", T.IntegerType()), ("width", T.IntegerType()), ("intel", T.BooleanType()), ("signed", T.BooleanType()))]
)
_MESSAGE = r"^BO_\s+(\d+)\s"
_SIGNAL = r"^\s*SG_\s+(\S+)[^:]*:\s*(\d+)\|(\d+)@([01])([+-])"


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """The signals of a DBC file: can_id, name, start, width, intel, signed.

    A signal belongs to the last message above it; those before any message are ignored, and a message that comes
    again starts anew, so only its last block counts. The file is one small text; its lines are ordered by one task.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    by_line = Window.orderBy("line_no")
    marked = lines.withColumn("block", F.when(F.col("value").rlike(_MESSAGE), F.struct("line_no", F.regexp_extract("value", _MESSAGE, 1).cast("long").alias("number"))))
    carried = marked.withColumn("block", F.last("block", True).over(by_line))
    newest = carried.where("block is not null").groupBy("block.number").agg(F.max("block.line_no").alias("newest"))
    g = lambda k: F.regexp_extract("value", _SIGNAL, k)
    found = carried.where(F.col("value").rlike(_SIGNAL) & F.col("block").isNotNull()).select(
        F.col("block.number").alias("number"), F.col("block.line_no").alias("newest"), g(1).alias("name"), g(2).cast("int").alias("start"), g(3).cast("int").alias("width"), (g(4) == "1").alias("intel"), (g(5) == "-").alias("signed")
    )
    return found.join(newest, ["number", "newest"]).select(canonical_can_id_of_number(F.col("number")).alias("can_id"), "name", "start", "width", "intel", "signed")


def with_bits(signals: DataFrame) -> DataFrame:
    """signals with bits, most significant first. A signal table is a small dimension that the driver reads."""
    rows = [(*r, bit_positions(r["start"], r["width"], r["intel"])) for r in signals.collect()]
    return signals.sparkSession.createDataFrame(rows, signals.schema.add("bits", T.ArrayType(T.IntegerType()))) if rows else signals.withColumn("bits", F.array().cast("array<int>"))


def read_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Injection metadata of captures by name, from JSON files of which later ones override earlier ones."""
    entry = "struct<injection_id:string,injection_interval:array<double>,injection_data_str:string,modified:boolean>"
    found = None
    for rank, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("name", "meta")).withColumn("rank", F.lit(rank))
        found = one if found is None else found.union(one)
    return found.groupBy("name").agg(F.max_by("meta", "rank").alias("meta")).select("name", "meta.*")


def classify(metadata: DataFrame) -> DataFrame:
    """metadata with kind, family, index and twin from the capture's name and metadata.

    ambient_...: ambient. Else the family is the name without _attack and what follows, a masquerade's without its
    ending first. No target: accelerator; target XXX: fuzzing; modified: masquerade, whose twin lacks the ending;
    else fabrication, whose twin has it.
    """
    name = F.col("name")
    masked = name.endswith("_masquerade")
    base = F.when(masked, F.regexp_replace(name, "_masquerade$", "")).otherwise(name)
    suffix = r"_attack(?:_(\d+))?$"
    family = F.when(name.startswith("ambient_"), None).otherwise(F.regexp_replace(base, suffix, ""))
    digits = F.regexp_extract(base, suffix, 1)
    kind = (
        F.when(name.startswith("ambient_"), "ambient").when(F.col("injection_id").isNull(), "accelerator").when(F.upper("injection_id") == "XXX", "fuzzing").when(F.coalesce("modified", F.lit(False)), "masquerade").otherwise("fabrication")
    )
    twin = F.when(kind == "masquerade", base).when(kind == "fabrication", F.concat(name, F.lit("_masquerade")))
    return metadata.select("*", kind.alias("kind"), family.alias("family"), F.when(digits != "", digits.cast("int")).alias("index"), twin.alias("twin"))


def manifest(metadata: DataFrame, ambient_groups: DataFrame) -> DataFrame:
    """The captures table from metadata and (name, group) of the ambient ones.

    Numbered over ambient captures by name, then the others. Index 1 and 2: development, with that fold; accelerator:
    separate; other attacks: final_test. A twin that is not there is NULL. A row a recording: one task numbers them.
    """
    known = classify(metadata)
    number = F.row_number().over(Window.orderBy(F.col("kind") != "ambient", "name"))
    ambient, dev = F.col("kind") == "ambient", F.col("index").isin(1, 2) & ~F.col("kind").isin("ambient", "accelerator")
    group = F.when(ambient, F.coalesce("ambient_group", F.raise_error(F.concat(F.lit("no group for "), "name")).cast("string"))).when(F.col("kind") == "accelerator", "separate").when(dev, "development").otherwise("final_test")
    named = known.join(ambient_groups.select("name", F.col("group").alias("ambient_group")), "name", "left")
    named = named.join(metadata.select(F.col("name").alias("twin"), F.lit(True).alias("has_twin")), "twin", "left")
    return named.select(
        "name", F.format_string("cap%02d", number).alias("capture_id"), F.when(ambient, "ambient").otherwise("attacks").alias("folder"), group.alias("group"), "kind", "family",
        F.when(F.col("has_twin"), F.col("twin")).alias("twin"), F.when(dev, F.col("index")).alias("fold"),
    )


def allowed(captures: DataFrame, groups: list[str] | None = None, folder: str | None = None, kinds: list[str] | None = None, final_evaluation: bool = False) -> DataFrame:
    """The captures of some groups, a folder or some kinds, in manifest order. Held-back groups need final_evaluation."""
    closed = {"final_test", "separate"}
    if groups and (unknown := set(groups) - {"train", "validation", "development", *closed}):
        raise ValueError(f"unknown groups {sorted(unknown)}")
    if not final_evaluation and closed & set(groups or closed):
        raise PermissionError("final_test and separate captures are only for the final evaluation")
    found = captures
    for column, values in (("group", groups), ("kind", kinds), ("folder", [folder] if folder else None)):
        if values:
            found = found.where(F.col(column).isin(*values))
    return found.orderBy("capture_id")


def entry(captures: DataFrame, name: str) -> DataFrame:
    """The one capture of a name; an error if there is none."""
    found = captures.where(F.col("name") == name)
    if not found.limit(1).count():
        raise KeyError(f"no capture is called {name}")
    return found


def capture_metadata(parsed: DataFrame, captures: DataFrame, rules_: DataFrame) -> DataFrame:
    """One row a capture: what the manifest and its injection rule say, duration_s, and its first timestamp as text.

    parsed: lines by capture, as spans() takes them; a capture without frames has neither duration nor timestamp.
    """
    rule = rules_.select("capture_id", "target", F.when(F.col("lo_us").isNotNull(), F.array(F.col("lo_us") / 1e6, F.col("hi_us") / 1e6)).alias("injection_interval"))
    own = spans(parsed).select(F.col("capture").alias("capture_id"), (F.col("span_us") / 1e6).alias("duration_s"), "first_raw_timestamp")
    return captures.select("capture_id", "group", "kind", "family").join(rule, "capture_id", "left").join(own, "capture_id", "left")


def folds(captures: DataFrame) -> DataFrame:
    """(fold, names) of the development captures, names in order."""
    return captures.where("fold is not null").groupBy("fold").agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy("fold")


def rules(captures: DataFrame, metadata: DataFrame) -> DataFrame:
    """Injection rules: capture_id, kind, family, target, lo_us, hi_us, mask."""
    meta = metadata.select("name", "injection_id", "injection_interval", "injection_data_str")
    target = F.when(F.col("injection_id").isNotNull() & (F.upper("injection_id") != "XXX"), canonical_can_id(F.col("injection_id")))
    micros = lambda i: F.round(F.get("injection_interval", F.lit(i)) * 1e6).cast("long")
    return captures.join(meta, "name", "left").select("capture_id", "kind", "family", target.alias("target"), micros(0).alias("lo_us"), micros(1).alias("hi_us"), F.upper("injection_data_str").alias("mask"))


def read_evasions(spark: SparkSession, path: str) -> DataFrame:
    from tracewright.schema import EVASIONS

    return spark.read.schema(EVASIONS).json(path)


def read_signal_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row, can_id, values) of a CSV of decoded signals with columns ID (decimal) and Signal_...; empty cells are NULL."""
    raw = spark.read.option("header", True).csv(path)
    names = [c for c in raw.columns if c.startswith("Signal_")]
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in names])
    row = F.col("_metadata.file_block_start") * 1024 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    return raw.select(row.alias("row"), canonical_can_id_of_number(F.col("ID")).alias("can_id"), F.filter(cells, lambda x: x["value"].isNotNull()).alias("values"))
