"""Detections, signals, letters, profiles and samples derived from the driver's tables.

Integer arithmetic only; SQL_VIEWS has the same views for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Counting line y = 60 and the area from which a vehicle is a car.
LINE_Y, CAR_AREA = 60, 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with frame_idx: their number in their camera by ts and det_id, from 0.

    In two levels: rows are numbered within an hour, and only the hours' counts meet in one window
    by camera, so that no task sorts a camera's whole history.
    """
    hour = F.coalesce(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600), F.lit(-(1 << 40)))
    own = rows.withColumn("_hour", hour)
    counts = own.groupBy("camera_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("camera_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("camera_id").alias("_camera"), F.col("_hour").alias("_h"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("camera_id", "_hour").orderBy("ts", "det_id"))
    own = own.withColumn("_i", inside).join(starts, F.col("camera_id").eqNullSafe(F.col("_camera")) & (F.col("_hour") == F.col("_h")))
    return own.withColumn("frame_idx", F.col("_start") + F.col("_i") - 1).drop("_hour", "_i", "_camera", "_h", "_start")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        (F.col("user_id") % 10).alias("camera_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("det_id"), "ts",
        k.alias("occ"), F.floor("value").cast("long").alias("v"), F.col("event_type").alias("label"),
    )
    rows = numbered(rows).withColumns({
        "cx": F.col("occ") * 10, "cy": F.least("v", F.lit(490)).cast("long"),
        "w": 10 + F.col("det_id") % 50, "h": 10 + F.col("occ") % 60,
    })
    return rows.selectExpr(
        "*", "frame_idx div 8 as frame_id", "w * h as area", "cx - w div 2 as x", "cy - h div 2 as y",
    )


def lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each camera and frame: lights are the centres of its detections, ts the last one's."""
    of = F.sort_array(F.collect_list(F.struct("det_id", "cx", "cy")))
    return detections(spark, sf_dir).groupBy("camera_id", "frame_id").agg(of.alias("lights"), F.max(F.col("ts").cast("timestamp")).alias("ts"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.select("camera_id", "frame_idx", (F.col("label") == "error").alias("red"), (F.col("label") == "purchase").alias("yellow"), (F.col("label") == "signup").alias("green"))


def roi_cells(spark: SparkSession) -> DataFrame:
    """A grid of 10-pixel cells inside the region (200..700, 0..150) of every camera."""
    cells = spark.range(10).select(F.col("id").alias("camera_id")).withColumn("gx", F.explode(F.sequence(F.lit(20), F.lit(69)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(14))))
    return cells.select("camera_id", F.lit(0).cast("long").alias("roi"), F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"))


def counting_lines(spark: SparkSession) -> DataFrame:
    """Three line segments for each camera."""
    return spark.range(30).selectExpr(
        "id div 3 as camera_id", "id % 3 as line_id", "cast(0 as bigint) as x1", "30 + (id % 3) * 40 as y1", "cast(1000 as bigint) as x2", "30 + (id % 3) * 60 as y2"
    )


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as plate_id", "cast(l_linenumber - 1 as bigint) as pos", "chr(65 + l_partkey % 8) as letter", "cast(40 + l_quantity as bigint) as score"
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key"), F.col("p_size").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, all components in thousandths, and the features themselves."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long")).alias("q"), F.col("embedding").alias("features"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, class and an integer score of each sample for each of ten classes: the sum of every tenth component from the class's own on."""
    s = samples(spark, sf_dir)
    own = F.aggregate(F.filter("q", lambda x, i: F.pmod(i, F.lit(10)) == F.col("class")), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("class"), "q").select(
        "id", "label", "class", (own + F.when(F.col("class") == F.col("label"), 60).otherwise(0)).cast("long").alias("score")
    )


SQL_VIEWS: dict[str, tuple[str, str]] = {
    "det": ("", """SELECT *, frame_idx // 8 AS frame_id, w * h AS area, cx - w // 2 AS x, cy - h // 2 AS y FROM (
        SELECT user_id % 10 AS camera_id, user_id AS track_id, event_id AS det_id, ts, event_type AS label, k AS occ, v,
          row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS frame_idx,
          k * 10 AS cx, least(v, 490) AS cy, 10 + event_id % 50 AS w, 10 + k % 60 AS h
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events))"""),
    "sig": ("det", "SELECT camera_id, frame_idx, label = 'error' AS red, label = 'purchase' AS yellow, label = 'signup' AS green FROM det"),
    "roi": ("", "SELECT c AS camera_id, CAST(0 AS BIGINT) AS roi, gx, gy FROM range(10) a(c), range(20, 70) b(gx), range(0, 15) d(gy)"),
    "lin": ("", "SELECT i // 3 AS camera_id, i % 3 AS line_id, 0 AS x1, 30 + (i % 3) * 40 AS y1, 1000 AS x2, 30 + (i % 3) * 60 AS y2 FROM range(30) t(i)"),
    "let": ("", "SELECT l_orderkey AS plate_id, CAST(l_linenumber - 1 AS BIGINT) AS pos, chr(CAST(65 + l_partkey % 8 AS INTEGER)) AS letter, CAST(40 + l_quantity AS BIGINT) AS score FROM lineitem"),
    "prof": ("", "SELECT p_brand AS key, CAST(p_size AS BIGINT) AS bin, count(*) AS cnt FROM part GROUP BY 1, 2"),
    "smp": ("", "SELECT vec_id AS id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda z: CAST(floor(CAST(z AS DOUBLE) * 1000) AS BIGINT)) AS q, embedding AS features FROM embeddings"),
    "scr": ("smp", "SELECT id, label, c AS class, CAST(coalesce(list_sum(list_transform(range(0, len(q)), lambda i: CASE WHEN i % 10 = c THEN q[i + 1] ELSE 0 END)), 0) AS BIGINT) + CASE WHEN c = label THEN 60 ELSE 0 END AS score FROM smp, range(10) t(c)"),
}


def with_views(names: str, body: str) -> str:
    """body behind the WITH clause of the views named and those that they use."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL_VIEWS[name][0].split():
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    views = ", ".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in order)
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"WITH {views} {body}"
