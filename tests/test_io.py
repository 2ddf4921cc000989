"""Round trips of readers and writers."""

import shutil

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from roadlens.functions.text import compile_pattern
from roadlens.sources import readers, writers


def test_svmlight(spark, tmp_path):
    text = "# head\n1 qid:3 cost:0.5 1:0.5 4:2 # note\n-1 2:1\n1 3:1 2:1\nx 1:1\n1 0:1\n1 sid:-1 1:1\n"
    (tmp_path / "f.txt").write_text(text)
    rows = readers.read_svmlight(spark, str(tmp_path / "f.txt")).collect()
    assert [r["_corrupt"] is None for r in rows] == [True, True, False, False, False, False]
    assert rows[0]["qid"] == 3 and rows[0]["cost"] == 0.5 and rows[0]["features"] == {1: 0.5, 4: 2.0} and rows[0]["comment"] == " note"
    keep = spark.createDataFrame([(1,)], "row long")
    kept = readers.read_svmlight(spark, str(tmp_path / "f.txt"), keep=keep, positive=-1).collect()
    assert [(r["label"], r["features"]) for r in kept] == [(1.0, {2: 1.0})]
    df = spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 0.5])], "label int, features array<double>")
    writers.write_svmlight(df, str(tmp_path / "out"))
    back = readers.read_svmlight(spark, str(tmp_path / "out"))
    assert sorted((r["label"], tuple(r["features"].items())) for r in back.collect()) == [(1.0, ((2, 2.0),)), (2.0, ((1, 1.0), (2, 0.5)))]


def test_events(spark, tmp_path):
    e = spark.sql("select 'cam1' device_id, timestamp'2024-01-02 03:04:05' ts, 'lane' violation, 'car' vehicle, 'AB12' plate, 0.5d confidence, '/v/1.avi' video_url, 1L x, 2L y, 3L w, 4L h")
    for fmt in ("xml", "json", "parquet"):
        writers.write_events(e, str(tmp_path / fmt), fmt)
    back = readers.read_events_xml(spark, str(tmp_path / "xml"))
    row = back.first()
    assert row["Rectangle"] == "1,2,3,4" and row["device_id"] == "cam1" and str(row["event_date"]) == "20240102"


def test_patterns_dimensions_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("base @@##\nus #@?\nbase [AB]#\n")
    got = sorted(map(tuple, readers.read_patterns(spark, str(tmp_path / "p.txt")).select("region", "rule_no", "pattern").collect()))
    assert got == [("base", 0, "@@##"), ("base", 1, "[AB]#"), ("us", 0, "#@?")]
    assert compile_pattern("@#?[AB]-") == ("[A-Z][0-9].[AB]\\-", [2])
    (tmp_path / "d.json").write_text('[{"camera_id": 1, "lines": [{"x1": 0, "y1": 1, "x2": 2, "y2": 3}], "parameters": {"scale": "0.5"}}]')
    row = readers.read_dimensions(spark, str(tmp_path / "d.json")).first()
    assert row["camera_id"] == 1 and row["lines"][0]["y2"] == 3 and row["parameters"] == {"scale": "0.5"}
    for label, name in (("A", "1.JPG"), ("B", "2.png"), ("B", "3.txt")):
        (tmp_path / "img" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / label / name).write_bytes(b"x")
    files = readers.list_labelled_files(spark, str(tmp_path / "img")).select("label").collect()
    assert sorted(r[0] for r in files) == ["A", "B"]


def test_other_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("v1", 0, 1, 2), ("v1", 1, 1, 3)], "video string, frame_idx long, cars long, bikes long")
    writers.write_count_log(counts, str(tmp_path / "log"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).select("value").collect()) == ["0 1 2", "1 1 3"]
    models = spark.createDataFrame([(0, [1.0, 2.0], 0.5)], "class long, w array<double>, b double")
    writers.save_model(models, str(tmp_path / "m"))
    assert readers.load_model(spark, str(tmp_path / "m")).first()["w"] == [1.0, 2.0]
    writers.write_metrics(models.select("class", "b"), str(tmp_path / "metrics"))
    writers.export_by_class(models, str(tmp_path / "by"), "class")
    writers.write_predictions(spark.createDataFrame([(1.5,), (-2.0,)], "score double"), str(tmp_path / "pred"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "pred")).collect())
    assert lines == ["1.5000:+1 -1.5000:-1", "2.0000:-1 -2.0000:+1"]
    name = spark.createDataFrame([("20240102_030405_cam7_z3_25.jpg",), ("bad.jpg",)], "n string").select(readers.parse_capture_name(F.col("n")).alias("p")).collect()
    assert name[0]["p"]["cam"] == "cam7" and name[0]["p"]["ext"] == "jpg" and name[1]["p"] is None


def test_models_are_checked_on_load(spark, tmp_path):
    models = spark.createDataFrame([(k, [1.0 * k, 2.0], 0.5) for k in range(3)], "class long, w array<double>, b double")
    writers.save_model(models, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.load_model(spark, str(tmp_path / "m")).collect())) == [(k, [1.0 * k, 2.0], 0.5) for k in range(3)]
    writers.save_model(models.withColumn("b", F.lit(0.75)), str(tmp_path / "other"))
    shutil.copytree(tmp_path / "m", tmp_path / "mixed")
    shutil.rmtree(tmp_path / "mixed" / "models" / "class=2")
    with pytest.raises(ValueError, match=r"\[2\]"):
        readers.load_model(spark, str(tmp_path / "mixed"))
    shutil.copytree(tmp_path / "other" / "models" / "class=2", tmp_path / "mixed" / "models" / "class=2")
    with pytest.raises(ValueError, match=r"\[2\]"):
        readers.load_model(spark, str(tmp_path / "mixed"))
    shutil.rmtree(tmp_path / "other" / "manifest")
    with pytest.raises(Exception, match="(?i)path"):
        readers.load_model(spark, str(tmp_path / "other"))


def test_samples_reports_and_exports_hold_what_was_given(spark, tmp_path):
    det = spark.createDataFrame([("a", k, 10 * k) for k in range(1, 101)] + [("b", 0, 7)], "camera string, k long, area long")
    writers.write_area_samples(det, str(tmp_path / "area"), ("camera",))
    assert spark.read.csv(str(tmp_path / "area" / "samples"), header=True).count() == 101
    summary = {r["camera"]: r for r in spark.read.csv(str(tmp_path / "area" / "summary"), header=True).collect()}
    assert (summary["a"]["n"], summary["a"]["p05"], summary["a"]["p50"], summary["a"]["p95"]) == ("100", "50.0", "500.0", "950.0") and summary["b"]["p50"] == "7.0"
    report = spark.createDataFrame([("v1", (1, 2), [3, 4], {"ocr": 0.5})], "video string, rect struct<x:long,y:long>, medians array<long>, times map<string,double>")
    writers.write_plate_report(report, str(tmp_path / "report"))
    assert spark.read.schema(report.schema).json(str(tmp_path / "report")).collect() == report.collect()
    writers.export_by_class(det, str(tmp_path / "classes"), "camera")
    assert sorted(p.name for p in (tmp_path / "classes").glob("camera=*")) == ["camera=a", "camera=b"]
    assert spark.read.parquet(str(tmp_path / "classes" / "camera=b")).collect() == [Row(k=0, area=7)]
    writers.write_metrics(det.groupBy("camera").count(), str(tmp_path / "metrics"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "metrics"), header=True).collect()} == {("a", "100"), ("b", "1")}
    (tmp_path / "d.json").write_text('[{"camera_id": 1, "roi": [{"name": "lane", "path": "/roi.png", "points": [{"x": 1, "y": 2}, {"x": 3, "y": 4}]}]}]')
    assert readers.read_dimensions(spark, str(tmp_path / "d.json")).first()["roi"][0]["points"][1]["x"] == 3.0
