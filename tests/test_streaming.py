from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans.statistics import Bins, flatten
from tidemark.streaming import statistics as streaming


def test_stream_equals_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [("m", base + timedelta(minutes=11 * i), f"e{i % 2}", "ok" if i % 3 else "ng", (i % 10) / 10, 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "modelName string, ts timestamp, equipment string, class string, confidence double, threshold double")
    source = str(tmp_path / "in")
    df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    target = str(tmp_path / "out")
    streaming.run(stream, ["modelName"], "daily", target, str(tmp_path / "cp"), Bins(), "30 days").awaitTermination(120)
    got = streaming.latest(spark, target, ["modelName"])
    want = streaming.additive(df, ["modelName"], "daily")
    columns = ["modelName", "startDate", "equipment", "class", "count", "histogram", "below"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    closed = streaming.finalise(df.withColumns({"elapsed": F.lit(1.0), "backend": F.lit("x"), "inspection": F.lit(1)}), ["modelName"], "daily",
                                F.lit(datetime(2024, 1, 3)))
    assert closed.count() == 2


def test_weeks_start_on_monday(spark):
    w = spark.createDataFrame([(datetime(2024, 1, 7, 23),)], "ts timestamp").select(streaming.window(F.col("ts"), "weekly").alias("w")).first()["w"]
    assert w["start"] == datetime(2024, 1, 1)


def test_flatten(spark):
    doc = {"_id": "1", "isDeleted": False, "metadata": {"gbm": "g", "equipmentId": "e"}, "inspectionResult": {"aiResults": [
        {"aiModel": "net/1/b", "task": "cls", "backend": "x", "classes": ["a"], "predictions": [
            {"predictionId": 1, "threshold": 0.5, "elapsedTime": 0.1, "prediction": "a", "confidence": "[0.2, 0.7]", "detections": None}]},
        {"aiModel": "det/2", "task": "det", "backend": "x", "classes": ["b"], "predictions": [
            {"predictionId": 1, "threshold": None, "elapsedTime": 0.2, "prediction": None, "confidence": None,
             "detections": [{"prediction": "b", "confidence": 0.9, "threshold": 0.5}]},
            {"predictionId": 2, "threshold": None, "elapsedTime": 0.2, "prediction": None, "confidence": None, "detections": []}]}]}}
    schema = """_id string, isDeleted boolean, metadata struct<gbm: string, equipmentId: string>, inspectionResult struct<aiResults: array<struct<
        aiModel: string, task: string, backend: string, classes: array<string>, predictions: array<struct<predictionId: int, threshold: double,
        elapsedTime: double, prediction: string, confidence: string, detections: array<struct<prediction: string, confidence: double, threshold: double>>>>>>>"""
    rows = flatten(spark.createDataFrame([doc], schema)).orderBy("task", "predictionId").collect()
    assert [(r["modelName"], r["modelVersion"], r["class"], r["confidence"]) for r in rows] == [
        ("net", "1/b", "a", 0.7), ("det", "2", "b", 0.9), ("det", "2", None, None)]


def test_config(tmp_path):
    import pytest

    from tidemark import config

    (tmp_path / "c").write_text("psi_moderate: 0.2\nname: x\n# note: y\n")
    found = config.load(str(tmp_path / "c"), ("name",), {"TIDEMARK_NAME": "z"})
    assert found["name"] == "z" and config.drift_config(found).psi_moderate == 0.2
    with pytest.raises(ValueError):
        config.load(None, ("name",), {})
