"""Event pipelines over detections: red light, lanes, plates, counts, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import density_level
from . import tracker, windows
from .cluster import cluster_items
from .filters import lane_region
from .joins import near


def red_light(det: DataFrame, signals: DataFrame, line_y: float, p: tracker.Params = tracker.Params()) -> DataFrame:
    """First frame in which a track of a red phase crosses the line; tracks live within one phase.

    Detections outside red phases are dropped before tracking, and (camera, phase) is the key, so
    a camera's history spreads over tasks.
    """
    phases = windows.red_phase(windows.signal_state(signals)).where("is_red").select("camera_id", "frame_idx", "phase")
    seen = det.join(phases, ["camera_id", "frame_idx"])
    tracked = tracker.track_short(seen, ["camera_id", "phase"], p)
    crossed = tracked.where(((F.col("first_y") - line_y) * (F.col("py") - line_y) <= 0) & (F.col("n_points") > 1))
    return windows.first_event(crossed, ["camera_id", "phase", "track_no"], ["frame_id", "det_id"])


def confirmed_tracks(det: DataFrame, key: list[str], p: tracker.Params) -> DataFrame:
    """The second matched point of each track."""
    own = tracker.track(det, key, p).withColumn("_n", F.row_number().over(Window.partitionBy(*key, "track_no").orderBy("frame_id", "det_id")))
    return own.where("_n = 2").drop("_n")


def lane_violations(det: DataFrame, line_y: float, p: tracker.Params = tracker.Params()) -> DataFrame:
    """Tracks of three points or more that cross the line; then a tracker per vehicle class confirms."""
    crossed = tracker.track(det, ["camera_id"], p).where(((F.col("first_y") - line_y) * (F.col("py") - line_y) <= 0) & (F.col("n_points") >= 3))
    kind = F.when(F.col("area") < 900, "bike").otherwise("car")
    again = crossed.select("camera_id", "det_id").join(det.withColumn("vehicle", kind), ["camera_id", "det_id"])
    return confirmed_tracks(again, ["camera_id", "vehicle"], p)


def lane_violations_region(det: DataFrame, cells: DataFrame, bike: tuple[int, int], car: tuple[int, int], p: tracker.Params = tracker.Params()) -> DataFrame:
    """Detections of each class inside its region, tracked by class and confirmed."""
    bikes = lane_region(det, cells, *bike, tall=True).withColumn("vehicle", F.lit("bike"))
    cars = lane_region(det, cells, *car, tall=False).withColumn("vehicle", F.lit("car"))
    return confirmed_tracks(bikes.unionByName(cars), ["camera_id", "vehicle"], p)


def plate_scans(det: DataFrame, cells: DataFrame, least: int, most: int, p: tracker.Params = tracker.Params()) -> DataFrame:
    return confirmed_tracks(lane_region(det, cells, least, most, tall=False), ["camera_id"], p)


def vehicle_counts(det: DataFrame, line_y: float, least_points: int = 3, p: tracker.Params = tracker.Params()) -> DataFrame:
    """Vehicles counted once, by class, when their tracker trace crosses the line."""
    tracked = tracker.track(det, ["camera_id"], p)
    crossed = tracked.where((F.col("n_points") > least_points) & ((F.col("first_y") - line_y) * (F.col("py") - line_y) <= 0))
    kind = F.when(F.col("area") < 900, "bike").otherwise("car")
    own = crossed.join(det.select("det_id", kind.alias("vehicle")), "det_id")
    once = windows.first_event(own, ["camera_id", "track_no"], ["frame_id", "det_id"])
    return once.groupBy("camera_id", "vehicle").agg(F.count("*").alias("n"))


def night_vehicles(lights: DataFrame, matrix: list[float], dx: int = 160, dy: int = 60) -> DataFrame:
    """camera_id, frame_id, det_id, cx, cy and vehicle of groups of lights, on the ground plane.

    lights: a row for each frame, with lights, an array of (det_id, cx, cy). Points are mapped by the
    homography; lights nearer than dx and dy to one another are one vehicle, at their mean. Several
    lights over 20 wide are a car, all else a bike. det_id is the smallest of the lights. Other columns pass through.
    """

    def mapped(light: Column) -> Column:
        x, y = geo.homography(light["cx"].cast("double"), light["cy"].cast("double"), matrix)
        return F.struct(light["det_id"].alias("det_id"), x.alias("cx"), y.alias("cy"))

    def mean(c: str) -> Column:
        return F.aggregate("_c", F.lit(0.0), lambda a, m: a + m[c]) / F.size("_c")

    groups = cluster_items(F.sort_array(F.transform("lights", mapped)), near(dx, dy))
    own = lights.withColumn("_c", F.explode(groups)).drop("lights")
    xs = F.transform("_c", lambda m: m["cx"])
    car = (F.size("_c") > 1) & (F.array_max(xs) - F.array_min(xs) > 20)
    return own.withColumns({
        "det_id": F.array_min(F.transform("_c", lambda m: m["det_id"])), "cx": mean("cx"), "cy": mean("cy"), "vehicle": F.when(car, "car").otherwise("bike"),
    }).drop("_c")


#: The night counter's tracker and crossing rule but for the line.
NIGHT = tracker.Params(distance=30.0, cos=-0.5)
NIGHT_POINTS = 5


def night_counts(lights: DataFrame, matrix: list[float], line_y: float, p: tracker.Params = NIGHT, least_points: int = NIGHT_POINTS) -> DataFrame:
    """Vehicles counted at night by class; lights as in night_vehicles.

    A track that crosses while no group of lights is matched with it is never counted.
    """
    vehicles = night_vehicles(lights, matrix)
    counted = tracker.track(vehicles, ["camera_id"], p, tracker.Crossing(line_y, least_points, unmatched_ends=True))
    own = counted.select("camera_id", "frame_id", "det_id").join(vehicles.select("camera_id", "frame_id", "det_id", "vehicle"), ["camera_id", "frame_id", "det_id"])
    return own.groupBy("camera_id", "vehicle").agg(F.count("*").alias("n"))


def density(det: DataFrame, roi_area: int, n: int) -> DataFrame:
    """Percent of the region covered in each frame, its mean over the last n frames and the level."""
    percent = det.groupBy("camera_id", "frame_id").agg(F.round(100.0 * F.sum("area") / roi_area, 4).alias("percent"))
    mean = F.round(windows.moving_mean("percent", n, ["camera_id"], "frame_id"), 4)
    return percent.withColumn("mean_percent", mean).withColumn("level", density_level(F.col("mean_percent")))
