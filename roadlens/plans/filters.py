"""Queries of projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as op
from ..sources import adapters as src
from .base import query

XYWH = ["det_id", "x", "y", "w", "h"]


@query("s3_read_detections", "SELECT camera_id, frame_idx, det_id, cx, cy, w, h, area FROM det", "det")
def s3(spark, d):
    return src.detections(spark, d).select("camera_id", "frame_idx", "det_id", "cx", "cy", "w", "h", "area")


@query("p1_components", "SELECT det_id, x + w // 2 AS cx, y + h // 2 AS cy, area FROM det", "det")
def p1(spark, d):
    return op.centres(src.detections(spark, d)).select("det_id", "cx", "cy", "area")


@query("p2_min_area", "SELECT det_id, area FROM det WHERE area >= 600", "det")
def p2(spark, d):
    return op.min_area(src.detections(spark, d), 600, 2000).select("det_id", "area")


@query("p3_drop_junk", "SELECT det_id, w, h FROM det WHERE NOT (w > 55 OR h > 60 OR h // w > 3.5)", "det")
def p3(spark, d):
    return op.drop_junk(src.detections(spark, d), 55, 60, 3.5).select("det_id", "w", "h")


@query("p4_classify_by_area", """SELECT det_id, CASE WHEN area > 99 AND area < 900 THEN 'bike' WHEN area > 899 AND area < 3000 THEN 'car' END AS counting,
  CASE WHEN area > 99 AND area <= 900 THEN 'bike' WHEN area > 899 AND area <= 3000 THEN 'car' END AS lane FROM det""", "det")  # fmt: skip
def p4(spark, d):
    a = F.col("area")
    return src.detections(spark, d).select("det_id", op.class_of_area(a, (99, 900), (899, 3000)).alias("counting"), op.class_of_area(a, (99, 900), (899, 3000), True).alias("lane"))


@query("p5_lane_region_filter", """SELECT det_id, area FROM det WHERE EXISTS (SELECT 1 FROM roi WHERE roi.camera_id = det.camera_id AND gx = cx // 10 AND gy = cy // 10)
  AND area > 300 AND area <= 3000 AND area > (w * h) // 2 AND h / w >= 0.9""", "det roi")  # fmt: skip
def p5(spark, d):
    return op.lane_region(src.detections(spark, d), src.roi_cells(spark), 300, 3000, True).select("det_id", "area")


@query("p6_scale_thresholds", """SELECT camera_id, CASE WHEN camera_id % 3 = 0 THEN 100 + camera_id * 37
  ELSE CAST(trunc((100 + camera_id * 37) * ((camera_id % 4 + 1) * 0.25::DOUBLE) * ((camera_id % 4 + 1) * 0.25::DOUBLE)) AS BIGINT) END AS threshold
  FROM (SELECT DISTINCT camera_id FROM det)""", "det")  # fmt: skip
def p6(spark, d):
    c = F.col("camera_id")
    cameras = src.detections(spark, d).select("camera_id").distinct()
    return cameras.select(c, op.scaled_threshold(100 + c * 37, (c % 4 + 1) * 0.25, c % 3 == 0).alias("threshold"))


@query("p7_to_original_coords", """SELECT det_id, CAST(trunc((x + 30) / 0.5::DOUBLE) AS BIGINT) AS x, CAST(trunc((y + 20) / 0.5::DOUBLE) AS BIGINT) AS y,
  CAST(trunc(w / 0.5::DOUBLE) AS BIGINT) AS w, CAST(trunc(h / 0.5::DOUBLE) AS BIGINT) AS h FROM det""", "det")  # fmt: skip
def p7(spark, d):
    return op.original_coords(src.detections(spark, d), 30, 20, 0.5).select(*XYWH)


@query("p8_valid_boxes", "SELECT det_id, x, y, w, h FROM det WHERE w * h <> 0 AND x >= 0 AND y >= 0 AND x + w < 900 AND y + h < 300", "det")
def p8(spark, d):
    return op.valid_boxes(src.detections(spark, d), 900, 300).select(*XYWH)


@query("p9_vehicle_box_from_plate", "SELECT det_id, x - w // 2 AS x, y - 3 * h AS y, CAST(trunc(w * 2.5::DOUBLE) AS BIGINT) AS w, h * 5 AS h FROM det", "det")
def p9(spark, d):
    return op.vehicle_box(src.detections(spark, d))


@query("p10_box_tests", "SELECT det_id FROM det WHERE area BETWEEN 50 AND 10800 AND h / w BETWEEN 0.6 AND 10 AND h / 100 >= 0.25", "det")
def p10(spark, d):
    return op.box_tests(src.detections(spark, d), 100).select("det_id")


@query("p11_density_filter", "SELECT det_id FROM det WHERE occ BETWEEN 10 AND 80 AND area BETWEEN 200 AND 2500 AND h / w BETWEEN 0.5 AND 3 AND occ / area BETWEEN 0.01 AND 0.2", "det")
def p11(spark, d):
    return op.density_filter(src.detections(spark, d), (10, 80), (200, 2500), (0.5, 3), (0.01, 0.2)).select("det_id")


@query("p12_blob_filter", """SELECT det_id FROM det WHERE area >= 200 AND area < 3000 AND h / w >= 0.5 AND h / w < 5 AND h / 500 >= 0.04
  AND 12.566370614359172::DOUBLE * area / (4 * (w + h) * (w + h)) >= 0.5 AND 12.566370614359172::DOUBLE * area / (4 * (w + h) * (w + h)) < 1.01
  AND least(w, h) * least(w, h) / (greatest(w, h) * greatest(w, h)) >= 0.1 AND occ / 100 >= 0.1 AND occ / 100 < 1.01""", "det")  # fmt: skip
def p12(spark, d):
    return op.blob_filter(src.detections(spark, d), 500).select("det_id")


@query("p13_in_x_range", """SELECT det_id, x >= 200 AND x + w <= 700 AS strict FROM det
  WHERE NOT ((200 - x) / w > 0.5 OR (x + w - 700) / w > 0.5)""", "det")  # fmt: skip
def p13(spark, d):
    soft = op.in_x_range(src.detections(spark, d), 200, 700, True)
    inside = op.in_x_range(src.detections(spark, d), 200, 700, False).select("det_id", F.lit(True).alias("strict"))
    return soft.join(inside, "det_id", "left").select("det_id", F.coalesce("strict", F.lit(False)).alias("strict"))


@query("p14_split_by_status", """SELECT det_id, CASE det_id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'edge_saved' WHEN 2 THEN 'removed' ELSE 'blank' END AS status, det_id % 4 <= 1 AS kept FROM det""", "det")
def p14(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("candidate", "edge_saved", "removed", "blank"))), (F.col("det_id") % 4 + 1).cast("int"))
    return src.detections(spark, d).select("det_id", status.alias("status")).withColumn("kept", op.is_kept(F.col("status")))


@query("p15_warmup", "SELECT camera_id, frame_idx FROM det WHERE frame_idx > 20", "det")
def p15(spark, d):
    return src.detections(spark, d).where("frame_idx > 20").select("camera_id", "frame_idx")


@query("p16_edge_state", """WITH m AS (SELECT camera_id, frame_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS mh FROM det GROUP BY 1, 2),
  e AS (SELECT det.*, row_number() OVER o = 1 OR lead(x) OVER o IS NULL AS edge FROM det WINDOW o AS (PARTITION BY camera_id, frame_id ORDER BY x, det_id))
  SELECT det_id, CASE WHEN occ * 2.55::DOUBLE < 0.30::DOUBLE * 255 THEN 'empty' WHEN occ * 2.55::DOUBLE > 0.95::DOUBLE * 255 THEN 'full'
    WHEN edge AND occ * 2.55::DOUBLE > 0.90::DOUBLE * 255 THEN 'edge_full' WHEN h < 0.7::DOUBLE * mh THEN 'short' ELSE 'ok' END AS state
  FROM e JOIN m USING (camera_id, frame_id)""", "det")  # fmt: skip
def p16(spark, d):
    return op.edge_state(src.detections(spark, d), ["camera_id", "frame_id"]).select("det_id", "state")


@query("p17_chop_edges", """WITH m AS (SELECT camera_id, frame_id, list_sort(list(w))[len(list(w)) // 2 + 1] AS mw FROM det GROUP BY 1, 2),
  e AS (SELECT det.*, row_number() OVER o = 1 AS f, lead(x) OVER o IS NULL AS l FROM det WINDOW o AS (PARTITION BY camera_id, frame_id ORDER BY x, det_id))
  SELECT det_id, CASE WHEN f AND w > mw THEN x + w - mw ELSE x END AS x, CASE WHEN (f OR l) AND w > mw THEN mw ELSE w END AS w
  FROM e JOIN m USING (camera_id, frame_id)""", "det")  # fmt: skip
def p17(spark, d):
    return op.chop_edges(src.detections(spark, d), ["camera_id", "frame_id"]).select("det_id", "x", "w")


@query("p18_result_filter", "SELECT p_partkey, p_name FROM part WHERE length(p_name) BETWEEN 9 AND 11")
def p18(spark, d):
    return src.table(spark, d, "part").where(F.length("p_name").between(9, 11)).select("p_partkey", "p_name")


BOXES_ON_PROFILE = "SELECT det_id, 'Brand#' || CAST(1 + det_id % 25 AS VARCHAR) AS key, 1 + det_id % 40 AS lo, 1 + det_id % 40 + det_id % 7 AS hi FROM det"


def boxes_on_profile(spark, d):
    key = F.concat(F.lit("Brand#"), (1 + F.col("det_id") % 25).cast("string"))
    return src.detections(spark, d).select("det_id", key.alias("key"), (1 + F.col("det_id") % 40).alias("lo"), (1 + F.col("det_id") % 40 + F.col("det_id") % 7).alias("hi"))


def peaks(boxes, prof):
    """Highest profile value over each box's bins; both sides meet on key and bin."""
    spread = boxes.withColumn("bin", F.explode(F.sequence("lo", "hi")))
    return spread.join(prof, ["key", "bin"], "left").groupBy("det_id").agg(F.coalesce(F.max("cnt"), F.lit(0)).alias("peak"))


@query("p19_drop_zombies", f"""WITH b AS ({BOXES_ON_PROFILE}), p AS (SELECT det_id, coalesce(max(cnt), 0) AS peak FROM b LEFT JOIN prof ON b.key = prof.key AND bin BETWEEN lo AND hi GROUP BY 1)
  SELECT det_id, peak FROM p WHERE NOT (peak < 0.35 * 3)""", "det prof")  # fmt: skip
def p19(spark, d):
    return peaks(boxes_on_profile(spark, d), src.profile(spark, d)).where(~(F.col("peak") < 0.35 * 3))


@query("p20_stretch_to_lines", """SELECT det_id, least(y, CAST(floor(20 + x * 0.125::DOUBLE) AS BIGINT)) AS y, greatest(y + h, CAST(ceil(40 + x * 0.125::DOUBLE) AS BIGINT)) AS bottom FROM det""", "det")
def p20(spark, d):
    top, bottom = F.floor(20 + F.col("x") * 0.125).cast("long"), F.ceil(40 + F.col("x") * 0.125).cast("long")
    return src.detections(spark, d).select("det_id", F.least("y", top).alias("y"), F.greatest(F.col("y") + F.col("h"), bottom).alias("bottom"))
