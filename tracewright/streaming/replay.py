"""Stored results shown again, window by window, at a chosen speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def positions(outputs: DataFrame) -> DataFrame:
    """outputs with position, from 0: captures in order, each one's windows in order.

    Captures are counted, and their counts added up, so only a row a capture is ordered as a whole.
    """
    sizes = outputs.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("capture_id", F.coalesce(F.sum("n").over(Window.orderBy("capture_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("capture_id").orderBy("w")) - 1
    return outputs.withColumn("inside", inside).join(F.broadcast(starts), "capture_id").withColumn("position", (F.col("start") + F.col("inside")).cast("long")).drop("start", "inside")  # a row a capture


def replay(spark: SparkSession, stored: DataFrame, path: str, checkpoint: str, speed: int = 1, tick: str = "1 second") -> StreamingQuery:
    """Appends speed windows a tick to JSON lines below path, in the order of stored (positions() as a table).

    A source that gives speed numbers a batch is joined with the stored results on their position. The checkpoint keeps the
    number that comes next, so a replay that was stopped goes on where it ended, however long it stood still.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", speed).option("numPartitions", 1).load()
    shown = ticks.select(F.col("value").alias("position")).join(stored, "position")

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).sortWithinPartitions("position").write.mode("overwrite").json(f"{path}/batch={number}")  # speed rows

    return shown.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=tick).start()
