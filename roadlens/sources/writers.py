"""Sinks: events, logs, reports, feature files, models and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import box_text


def event_rows(events: DataFrame) -> DataFrame:
    """Text fields of event records: the box as x,y,w,h and the video as time;url."""
    return events.select(
        F.col("device_id"), F.date_format("ts", "yyyyMMdd").alias("event_date"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("VTime"),
        F.col("violation").alias("VType"), F.col("vehicle").alias("VehicleType"), F.coalesce("plate", F.lit("")).alias("PlateNumber"),
        F.format_string("%f", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).alias("PConfident"),
        F.concat_ws(";", F.date_format("ts", "HHmmss"), "video_url").alias("Video"), box_text("x", "y", "w", "h").alias("Rectangle"),
    )


def write_events(events: DataFrame, path: str, fmt: str = "xml") -> None:
    """Events by device and day, as xml, json or parquet."""
    writer = event_rows(events).write.partitionBy("device_id", "event_date")
    if fmt == "xml":
        writer = writer.option("rowTag", "ViolationEvent").option("rootTag", "ViolationEvents")
    writer.format(fmt).save(path)


def write_count_log(counts: DataFrame, path: str) -> None:
    """frame, cars and bikes of each frame, a folder for each video."""
    counts.select("video", F.concat_ws(" ", "frame_idx", "cars", "bikes").alias("value")).write.partitionBy("video").text(path)


def write_area_samples(df: DataFrame, path: str, by: tuple[str, ...] = (), shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> None:
    """Areas of accepted detections for choosing thresholds: path/samples has them all, path/summary their number and percentiles (p05 ...) by group."""
    df.select(*by, "area").write.csv(f"{path}/samples", header=True)
    parts = [F.expr(f"percentile_disc({s}) within group (order by area)").alias(f"p{round(100 * s):02d}") for s in shares]
    df.groupBy(*by).agg(F.count("area").alias("n"), *parts).write.csv(f"{path}/summary", header=True)


def write_plate_report(reports: DataFrame, path: str) -> None:
    """Nested plate reports as JSON lines."""
    reports.write.json(path)


def export_by_class(df: DataFrame, path: str, label: str = "letter") -> None:
    df.write.partitionBy(label).parquet(path)


def svmlight_line(label: Column, features: Column) -> Column:
    """label index:value ... of a dense array, without zeros."""
    pairs = F.transform(features, lambda x, i: F.when(x != 0, F.concat_ws(":", (i + 1).cast("string"), x.cast("string"))))
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.array_compact(pairs), " "))


def write_svmlight(df: DataFrame, path: str, positive: int | None = None) -> None:
    """Feature text; with `positive` its rows are +1 and come first, all others -1."""
    if positive is None:
        lines = df.select(svmlight_line(F.col("label"), F.col("features")).alias("value"))
    else:
        sign = F.when(F.col("label") == positive, 1).otherwise(-1)
        lines = df.select(sign.alias("s"), svmlight_line(sign, F.col("features")).alias("value")).orderBy(F.col("s").desc()).select("value")
    lines.write.text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def save_model(models: DataFrame, path: str) -> None:
    """A folder of models: files by class, and a manifest with the size and a hash of each class's model.

    The manifest is written last, so a folder without one is not whole.
    """
    own = models.select("class", "w", "b")
    own.write.partitionBy("class").parquet(f"{path}/models")
    own.select("class", F.size("w").alias("features"), F.xxhash64("w", "b").alias("hash")).coalesce(1).write.json(f"{path}/manifest")


def prediction_line(score: Column) -> Column:
    """Both signs with their scores, the winning side first."""
    text = F.format_string("%.4f:+1 %.4f:-1", score, -score)
    back = F.format_string("%.4f:-1 %.4f:+1", -score, score)
    return F.when(score >= 0, text).otherwise(back)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select(prediction_line(F.col("score")).alias("value")).write.text(path)
