"""Streams give what the batch operators give; files are small so that state crosses batches."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from roadlens.operators import pipelines, tracker, windows
from roadlens.sources import adapters as src
from roadlens.streaming import jobs

from .conftest import DATA

P = tracker.Params(distance=300.0)


def as_stream(spark, df, folder, by):
    """df written as three files in order of `by`, read one file a micro-batch."""
    top = df.agg(F.max(by)).first()[0] + 1
    for i in range(3):
        part = df.where((F.col(by) >= top * i // 3) & (F.col(by) < top * (i + 1) // 3))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(name).toPandas()


def same(a: pd.DataFrame, b: pd.DataFrame, keys):
    a, b = (x.sort_values(keys).reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-3)


def test_track(spark, tmp_path):
    det = src.detections(spark, DATA).select("camera_id", "frame_id", "det_id", "cx", "cy")
    got = drain(jobs.track_stream(as_stream(spark, det, tmp_path / "in", "frame_id"), P), "tracks", tmp_path)
    same(got, tracker.track(det, ["camera_id"], P).toPandas(), ["camera_id", "frame_id", "det_id"])


def test_signal_state(spark, tmp_path):
    sig = src.signals(spark, DATA)
    got = drain(jobs.signal_stream(as_stream(spark, sig, tmp_path / "in", "frame_idx")), "states", tmp_path)
    want = windows.red_phase(windows.signal_state(sig)).select("camera_id", "frame_idx", "is_red", "phase").toPandas()
    same(got, want, ["camera_id", "frame_idx"])


def test_density(spark, tmp_path):
    det = src.detections(spark, DATA).select("camera_id", "frame_id", "area")
    for n in (1, 10):
        got = drain(jobs.density_stream(as_stream(spark, det, tmp_path / f"in{n}", "frame_id"), 16000, n), f"density{n}", tmp_path / f"{n}")
        want = pipelines.density(det, 16000, n).toPandas()
        assert want["level"].nunique() > 1
        same(got, want, ["camera_id", "frame_id"])


def test_density_ring_is_bounded():
    class Kept:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    for n, most in ((1, 0), (4, 3)):
        p = jobs.DensityProcessor(100, n)
        p.ring = Kept()
        for k in range(5):
            list(p.handleInputRows((1,), iter([pd.DataFrame({"frame_id": [3 * k, 3 * k + 1, 3 * k + 2], "area": [1, 2, 3]})]), None))
        assert len(p.ring.value[1]) == most


def test_attach_plates(spark, tmp_path):
    e = src.table(spark, DATA, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    plates = e.where("event_id % 3 = 0").select("event_id", (F.col("ts") + F.expr("interval 5 seconds")).alias("plate_ts"), F.lit("AB12").alias("plate"), F.lit(0.9).alias("confidence"))
    streams = []
    for name, df in (("e", e), ("p", plates)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    got = drain(jobs.attach_plates_stream(*streams), "attached", tmp_path)
    want = e.join(plates, "event_id").toPandas()
    same(got, want, ["event_id"])


def timed(spark):
    det = src.detections(spark, DATA)
    return det.select("camera_id", "frame_idx", "frame_id", "det_id", "cx", "cy", "w", "h", "area", F.col("ts").cast("timestamp").alias("ts"))


LATE = "60 days"  # cameras of the test table are months apart at equal frame numbers


def test_red_light_over_two_streams(spark, tmp_path):
    det, sig = timed(spark), src.signals(spark, DATA)
    sig = sig.join(det.select("camera_id", "frame_idx", "ts"), ["camera_id", "frame_idx"])
    want = pipelines.red_light(det, src.signals(spark, DATA), 60.0, P).toPandas()
    # the two tables are cut at different frames
    streams = as_stream(spark, det, tmp_path / "det", "frame_id"), as_stream(spark, sig, tmp_path / "sig", "frame_idx")
    got = drain(jobs.red_light_stream(*streams, 60.0, P, LATE, 3_600_000), "red", tmp_path)
    assert len(want) and not got.duplicated(["camera_id", "phase", "track_no"]).any()
    same(got.drop(columns="ts"), want, ["camera_id", "phase", "frame_id", "det_id"])


def test_lane_violations(spark, tmp_path):
    det = timed(spark)
    want = pipelines.lane_violations(det, 60.0, P).toPandas()
    got = drain(jobs.lane_violations_stream(as_stream(spark, det, tmp_path / "in", "frame_id"), 60.0, P, LATE), "lanes", tmp_path)
    assert len(want)
    same(got.drop(columns="ts"), want, ["camera_id", "vehicle", "frame_id", "det_id"])


def test_lane_violations_region_and_plate_scans(spark, tmp_path):
    det, cells = timed(spark), src.roi_cells(spark)
    want = pipelines.lane_violations_region(det, cells, (99, 900), (899, 5000), P).toPandas()
    got = drain(jobs.lane_violations_region_stream(as_stream(spark, det, tmp_path / "in", "frame_id"), cells, (99, 900), (899, 5000), P, LATE), "regions", tmp_path / "a")
    assert len(want)
    same(got.drop(columns="ts"), want, ["camera_id", "vehicle", "frame_id", "det_id"])
    want = pipelines.plate_scans(det, cells, 99, 5000, P).toPandas()
    got = drain(jobs.plate_scans_stream(as_stream(spark, det, tmp_path / "again", "frame_id"), cells, 99, 5000, P, LATE), "scans", tmp_path / "b")
    assert len(want)
    same(got.drop(columns="ts"), want, ["camera_id", "frame_id", "det_id"])


def last_counts(rows: pd.DataFrame) -> pd.DataFrame:
    assert not rows.duplicated(["camera_id", "vehicle", "n"]).any()
    return rows.groupby(["camera_id", "vehicle"], as_index=False)["n"].max()


def test_vehicle_counts(spark, tmp_path):
    det = timed(spark)
    want = pipelines.vehicle_counts(det, 60.0, 3, P).toPandas()
    got = drain(jobs.vehicle_counts_stream(as_stream(spark, det, tmp_path / "in", "frame_id"), 60.0, 3, P, LATE), "counts", tmp_path)
    assert len(want)
    same(last_counts(got), want, ["camera_id", "vehicle"])


def test_night_counts(spark, tmp_path):
    lights, params = src.lights(spark, DATA), tracker.Params(distance=300.0, cos=-0.5)
    matrix = [1.0, 0.1, 5.0, 0.0, 1.2, -10.0, 0.0, 0.0005, 1.0]
    want = pipelines.night_counts(lights, matrix, 120.0, params).toPandas()
    got = drain(jobs.night_counts_stream(as_stream(spark, lights, tmp_path / "in", "frame_id"), matrix, 120.0, params, delay=LATE), "night", tmp_path)
    assert set(want["vehicle"]) == {"bike", "car"}
    same(last_counts(got), want, ["camera_id", "vehicle"])


def test_idle_cameras_keep_their_numbers(spark, tmp_path):
    """Tracks go by event time; what comes after the gap continues the numbers, late frames stay out."""
    start = datetime(2024, 5, 1)

    def rows(camera, frames, shift=0):
        return [(camera, f, 10 * f + k, 50.0 + 3 * (f % 100) + 400 * k, 80.0, start + timedelta(seconds=f + shift)) for f in frames for k in range(2)]

    files = [rows(1, range(10)), rows(2, range(1000, 1003)), rows(2, range(1003, 1005)), rows(1, range(1200, 1206)) + rows(1, [5], 1300)]
    schema = "camera_id long, frame_id long, det_id long, cx double, cy double, ts timestamp"
    det = spark.createDataFrame([r for f in files for r in f if not (r[1] == 5 and r[5] > start + timedelta(seconds=1000))], schema)
    for params in (tracker.Params(), tracker.Params(max_skip=100_000)):
        folder = tmp_path / str(params.max_skip)
        for f in files:
            spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "in")).withWatermark("ts", "1 second")
        got = drain(jobs.track_stream(stream, params, 20_000), f"idle{params.max_skip}", folder).drop(columns="ts")
        want = tracker.track(det, ["camera_id"], tracker.Params()).toPandas()
        same(got, want, ["camera_id", "frame_id", "det_id"])  # also where frames alone would have kept the tracks
