"""A stream gives what the batch gives."""

import pytest

from tracewright import schema
from tracewright.operators import model, windows
from tracewright.sources.tables import mock_frames
from tracewright.streaming import sinks, windows as streaming

S = 1_000_000


@pytest.fixture()
def arriving(spark, tmp_path):
    rows = [("c1", t) for t in (0.1, 0.9, 1.2, 4.5, 5.5)] + [("c2", t) for t in (0.5, 2.0, 2.1)]
    for k, part in enumerate((rows[:3] + rows[5:6], rows[3:5] + rows[6:])):
        spark.createDataFrame([(c, i, round(t * S), "0F4", "00") for i, (c, t) in enumerate(part)], schema.FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema.FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in"))


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return df.sparkSession.table(name)


def test_tumbling(arriving, tmp_path):
    stream, batch = arriving
    got = {(r["capture_id"], r["w"]): r["n_frames"] for r in run(streaming.tumbling(stream, S), "tumbling", tmp_path).collect()}
    assert got == {(r["capture_id"], r["w"]): r["n_frames"] for r in windows.counted(batch, S).collect()} == {("c1", 0): 2, ("c1", 1): 1, ("c1", 2): 0, ("c1", 3): 0, ("c1", 4): 1, ("c2", 0): 1, ("c2", 1): 0}


def test_dedup(arriving, tmp_path):
    stream, batch = arriving
    assert run(streaming.dedup(stream.union(stream), "1 minute"), "dedup", tmp_path).count() == batch.count()


def test_score_uploads(spark, tmp_path):
    frames = mock_frames(spark, 12)
    detector = model.Detector(model.fit_stage1(mock_frames(spark, 9), S), 0.9, "mock")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    sinks.score_uploads(stream, detector, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "out"))
    assert {r["type"]: r["count"] for r in rows.groupBy("type").count().collect()} == {"meta": 1, "window": 11, "progress": 1, "done": 1}
    assert [r["window_id"] for r in rows.where("decision = 'ATTACK'").collect()] == ["cap90_w0009"]


def test_sinks(spark, tmp_path):
    ev = spark.createDataFrame([("a", "w1", "freeze", "0D0", 0.0, 1.0, 0.1, "v", "development")], schema.EVASIONS)
    from tracewright.sources.logs import read_evasions

    for _ in range(2):
        sinks.append_evasions(ev, str(tmp_path / "e"))
    assert read_evasions(spark, str(tmp_path / "e")).count() == 2
    with pytest.raises(ValueError):
        sinks.append_evasions(ev.replace("development", "final_test", "split"), str(tmp_path / "e"))
    sinks.write_report(ev, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_report(ev, str(tmp_path / "r"))
    got = {r["window_id"]: r["advice"] for r in sinks.ask(spark.createDataFrame([("a",), ("b",)], "window_id string"), lambda r: "confirm" if r["window_id"] == "a" else 1 / 0).collect()}
    assert got == {"a": "confirm", "b": None}
