"""Where results of a stream go."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators.model import Detector
from tracewright.operators.store import written


def events(outputs: DataFrame, every: int = 10) -> DataFrame:
    """(place, value) JSON lines of outputs: meta, a window each (score 4 digits, latency 3), progress every so many, done."""
    n = F.struct("capture_id", "w", F.lit(1).alias("k"))
    line = F.struct(F.lit("window").alias("type"), "window_id", F.round("attack_score", 4).alias("attack_score"), "decision", "evidence", F.round("latency_ms", 3).alias("latency_ms"))
    rows = outputs.select(n.alias("place"), F.to_json(line).alias("value"))
    done = outputs.where(F.col("w") % every == every - 1).select(F.struct("capture_id", "w", F.lit(2).alias("k")).alias("place"), F.to_json(F.struct(F.lit("progress").alias("type"), "capture_id", (F.col("w") + 1).alias("windows"))).alias("value"))
    end = outputs.groupBy("capture_id").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("windows"), F.count_if(F.col("decision") == "ATTACK").alias("attacks"))
    end = end.select(F.struct("capture_id", "w", F.lit(3).alias("k")).alias("place"), F.to_json(F.struct(F.lit("done").alias("type"), "capture_id", "windows", "attacks")).alias("value"))
    meta = outputs.groupBy("capture_id").agg(F.first("model_version").alias("v"), F.first("threshold").alias("threshold"))
    meta = meta.select(F.struct("capture_id", F.lit(-1).cast("long").alias("w"), F.lit(0).alias("k")).alias("place"), F.to_json(F.struct(F.lit("meta").alias("type"), "capture_id", F.col("v").alias("model_version"), "threshold")).alias("value"))
    return meta.unionByName(rows).unionByName(done).unionByName(end)


def error_event(frames: DataFrame, message: str) -> DataFrame:
    """The line that takes the place of done where scoring failed."""
    return frames.sparkSession.createDataFrame([(json.dumps({"type": "error", "message": message}),)], "value string")


def score_uploads(frames: DataFrame, detector: Detector, path: str, checkpoint: str) -> StreamingQuery:
    """Scores each batch of whole captures that arrives and writes its events as JSON lines below path.

    frames: a stream of (capture_id, line_no, t_us, can_id, payload). A batch is one micro-batch's files; a batch that is
    run again after a failure replaces its own output. A batch that can't be scored, or has no complete window, leaves one
    error event in its place, and the stream goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        to = f"{path}/batch={number}"
        try:
            outputs = written(detector.score(batch), "upload")
            if outputs.isEmpty():
                raise ValueError("no complete window was uploaded")
            events(outputs).repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(to)
        except Exception as e:  # of any kind: the sender is told, whatever it is
            error_event(batch, str(e).splitlines()[0] if str(e) else type(e).__name__).write.mode("overwrite").text(to)

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_evasions(evasions: DataFrame, path: str) -> None:
    """Adds misses to a log of JSON lines; only development ones."""
    if evasions.where("split <> 'development'").limit(1).count():
        raise ValueError("only misses of development captures are kept")
    evasions.select(*sorted(evasions.columns)).write.mode("append").json(path)


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """A report of a few rows as JSON; an error if there is one, unless it may be replaced."""
    report.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def replay_file(outputs: DataFrame, labels: DataFrame, path: str) -> None:
    """Outputs with their truth as JSON, for display."""
    truth = labels.select("window_id", F.when(F.col("is_attack"), "attack").otherwise("normal").alias("truth"))
    outputs.join(truth, "window_id").write.mode("overwrite").json(path)


def ask(bundles: DataFrame, post: Callable[[dict], str | None]) -> DataFrame:
    """(window_id, advice, elapsed_ms) of a service that post() reaches from the tasks; NULL where it fails, never an error."""
    import time
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                began = time.perf_counter()
                try:
                    advice = post(r)
                except Exception:  # a service that is away must not stop the vehicle
                    advice = None
                rows.append((r["window_id"], advice, (time.perf_counter() - began) * 1000))
            yield pd.DataFrame(rows, columns=["window_id", "advice", "elapsed_ms"])

    return bundles.mapInPandas(run, "window_id string, advice string, elapsed_ms double")
