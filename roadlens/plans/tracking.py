"""Queries of assignment, the tracker and the event pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pipelines as op
from ..operators import tracker
from ..operators.assignment import assign
from ..operators.joins import pairs_within
from ..sources import adapters as src
from .base import query
from .joins import FRAME

C = F.col
PARAMS = tracker.Params(distance=300.0, max_skip=5)


def cost_rows(spark, d):
    """Boxes of the first four places of a frame against those of the last four."""
    det = src.detections(spark, d)
    apart = pairs_within(det, lambda a, b: (a["frame_idx"] % 8 < 4) & (b["frame_idx"] % 8 >= 4), FRAME)
    cost = F.abs(C("_a.cx") - C("_b.cx")) + F.abs(C("_a.cy") - C("_b.cy"))
    return apart.select(*FRAME, C("_a.det_id").alias("l"), C("_b.det_id").alias("r"), cost.cast("double").alias("cost"))


@query("j1_assign_greedy", """WITH RECURSIVE cr AS (SELECT a.camera_id, a.frame_id, a.det_id AS l, b.det_id AS r, CAST(abs(a.cx - b.cx) + abs(a.cy - b.cy) AS DOUBLE) AS cost FROM det a JOIN det b ON a.camera_id = b.camera_id AND a.frame_id = b.frame_id
    AND a.det_id < b.det_id AND a.frame_idx % 8 < 4 AND b.frame_idx % 8 >= 4),
  ch AS (SELECT camera_id, frame_id, l, r, cost, [l] AS ls, [r] AS rs FROM cr QUALIFY row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY cost, l, r) = 1
    UNION ALL SELECT * FROM (SELECT ch.camera_id, ch.frame_id, cr.l, cr.r, cr.cost, list_append(ls, cr.l) AS ls, list_append(rs, cr.r) AS rs FROM ch JOIN cr ON ch.camera_id = cr.camera_id AND ch.frame_id = cr.frame_id
      AND NOT list_contains(ls, cr.l) AND NOT list_contains(rs, cr.r) QUALIFY row_number() OVER (PARTITION BY ch.camera_id, ch.frame_id ORDER BY cr.cost, cr.l, cr.r) = 1))
  SELECT camera_id, frame_id, l, r, cost FROM ch""", "det")  # fmt: skip
def j1(spark, d):
    return assign(cost_rows(spark, d), FRAME, "l", "r", "cost")


@query("j2_assign_optimal")
def j2(spark, d):
    return assign(cost_rows(spark, d), FRAME, "l", "r", "cost", "optimal")


@query("x1_track")
def x1(spark, d):
    return tracker.track(src.detections(spark, d), ["camera_id"], PARAMS)


@query("x4_red_light_violations")
def x4(spark, d):
    return op.red_light(src.detections(spark, d), src.signals(spark, d), 60.0, PARAMS)


@query("x5_lane_violations")
def x5(spark, d):
    return op.lane_violations(src.detections(spark, d), 60.0, PARAMS)


@query("x6_lane_violations_region")
def x6(spark, d):
    return op.lane_violations_region(src.detections(spark, d), src.roi_cells(spark), (99, 900), (899, 5000), PARAMS)


@query("x7_plate_scans")
def x7(spark, d):
    return op.plate_scans(src.detections(spark, d), src.roi_cells(spark), 99, 5000, PARAMS)


@query("x8_vehicle_counts")
def x8(spark, d):
    return op.vehicle_counts(src.detections(spark, d), 60.0, 3, PARAMS)


#: Camera plane to ground plane.
GROUND = [1.0, 0.1, 5.0, 0.0, 1.2, -10.0, 0.0, 0.0005, 1.0]


@query("x8_night_counts")
def x8_night(spark, d):
    return op.night_counts(src.lights(spark, d), GROUND, 120.0, tracker.Params(distance=300.0, cos=-0.5))


@query("x9_density", """WITH p AS (SELECT camera_id, frame_id, round(100.0::DOUBLE * sum(area) / 20000, 4) AS percent FROM det GROUP BY 1, 2),
  m AS (SELECT *, round(avg(percent) OVER (PARTITION BY camera_id ORDER BY frame_id ROWS 9 PRECEDING), 4) AS mean_percent FROM p)
  SELECT *, CASE WHEN mean_percent < 25 THEN 'Free' WHEN mean_percent < 65 THEN 'Uncrowded' WHEN mean_percent < 80 THEN 'Crowded' ELSE 'Too crowded' END AS level FROM m""", "det")  # fmt: skip
def x9(spark, d):
    return op.density(src.detections(spark, d), 20000, 10)
