"""Projections, filters and predicates over detections and boxes (x, y, w, h, area)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """Towards zero, as an integer."""
    return x.cast("long")



def centres(df: DataFrame) -> DataFrame:
    """Centre of each box, halves rounded down."""
    return df.withColumns({"cx": F.expr("x + w div 2"), "cy": F.expr("y + h div 2")})


def min_area(df: DataFrame, least: int, most: int | None = None, enforce_max: bool = False) -> DataFrame:
    """Boxes from an area on; the upper limit only counts where enforce_max says so."""
    out = df.where(F.col("area") >= least)
    return out.where(F.col("area") <= most) if enforce_max and most is not None else out


def drop_junk(df: DataFrame, max_w: int, max_h: int, max_ratio: float) -> DataFrame:
    """Drops boxes too wide, too high or too slender; the ratio is a whole number."""
    return df.where(~((F.col("w") > max_w) | (F.col("h") > max_h) | (F.expr("h div w") > max_ratio)))


def class_of_area(area: Column, bike: tuple[int, int], car: tuple[int, int], closed: bool = False) -> Column:
    """bike or car by open intervals (closed at the upper end if asked); bikes are tested first."""

    def within(lo: int, hi: int) -> Column:
        return (area > lo) & ((area <= hi) if closed else (area < hi))

    return F.when(within(*bike), "bike").when(within(*car), "car")


def in_region(df: DataFrame, cells: DataFrame, size: int = 10) -> DataFrame:
    """Detections whose centre lies in a cell of the region; the cells are a small dimension."""
    own = df.withColumns({"_gx": F.floor(F.col("cx") / size).cast("long"), "_gy": F.floor(F.col("cy") / size).cast("long")})
    cells = cells.select("camera_id", F.col("gx").alias("_gx"), F.col("gy").alias("_gy"))
    return own.join(cells, ["camera_id", "_gx", "_gy"], "left_semi").drop("_gx", "_gy")


def lane_region(df: DataFrame, cells: DataFrame, least: int, most: int, tall: bool) -> DataFrame:
    out = in_region(df, cells).where((F.col("area") > least) & (F.col("area") <= most) & (F.col("area") > F.expr("(w * h) div 2")))
    return out.where(F.col("h") / F.col("w") >= 0.9) if tall else out


def scaled_threshold(t: Column, scale: Column, hard: Column) -> Column:
    return F.when(hard, t).otherwise(whole(t * scale * scale))


def original_coords(df: DataFrame, roi_x: int, roi_y: int, scale: float) -> DataFrame:
    return df.withColumns({
        "x": whole((F.col("x") + roi_x) / scale), "y": whole((F.col("y") + roi_y) / scale),
        "w": whole(F.col("w") / scale), "h": whole(F.col("h") / scale),
    })


def valid_boxes(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes with an area whose corners both lie inside the frame."""
    return df.where((F.col("w") * F.col("h") != 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") < width) & (F.col("y") + F.col("h") < height))


def vehicle_box(df: DataFrame) -> DataFrame:
    """The vehicle's box around a plate's."""
    return df.select("det_id", F.expr("x - w div 2 as x"), F.expr("y - 3 * h as y"), whole(F.col("w") * 2.5).alias("w"), (F.col("h") * 5).alias("h"))


def box_tests(df: DataFrame, plate_h: int) -> DataFrame:
    """Sizes that a letter's box can have within a plate."""
    ratio = F.col("h") / F.col("w")
    return df.where(F.col("area").between(50, 10800) & ratio.between(0.6, 10) & (F.col("h") / plate_h >= 0.25))


def density_filter(df: DataFrame, density, area, ratio, per_area) -> DataFrame:
    d = F.col("occ")
    return df.where(d.between(*density) & F.col("area").between(*area) & (F.col("h") / F.col("w")).between(*ratio) & (d / F.col("area")).between(*per_area))


def half_open(x: Column, lo: float, hi: float | None) -> Column:
    return (x >= lo) if hi is None else (x >= lo) & (x < hi)


def blob_filter(df: DataFrame, frame_h: int) -> DataFrame:
    """Half-open ranges of area, ratio, relative height, circularity, inertia and convexity."""
    perimeter, small, large = 2 * (F.col("w") + F.col("h")), F.least("w", "h"), F.greatest("w", "h")
    return df.where(
        half_open(F.col("area"), 200, 3000) & half_open(F.col("h") / F.col("w"), 0.5, 5) & half_open(F.col("h") / frame_h, 0.04, None)
        & half_open(12.566370614359172 * F.col("area") / (perimeter * perimeter), 0.5, 1.01)
        & half_open(small * small / (large * large), 0.1, 1.01) & half_open(F.col("occ") / 100, 0.1, 1.01)
    )


def in_x_range(df: DataFrame, lo: int, hi: int, soft: bool) -> DataFrame:
    """Boxes fully inside, or (soft) those with at most half of their width outside on one side."""
    left, right = F.col("x"), F.col("x") + F.col("w")
    if not soft:
        return df.where((left >= lo) & (right <= hi))
    return df.where(~(((lo - left) / F.col("w") > 0.5) | ((right - hi) / F.col("w") > 0.5)))


def is_kept(status: Column) -> Column:
    return status.isin("candidate", "edge_saved")


def median_high(x: str) -> Column:
    """The upper of the two middle values of a group, for groups that fit an array."""
    s = F.sort_array(F.collect_list(x))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def median_low(x: str) -> Column:
    s = F.sort_array(F.collect_list(x))
    return F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int"))


def edge_state(df: DataFrame, by: list[str]) -> DataFrame:
    """empty, full, edge_full, short or ok from a letter's mean, its place and its height."""
    order = Window.partitionBy(*by).orderBy("x", "det_id")
    medians = df.groupBy(*by).agg(median_high("h").alias("_h"))
    edge = (F.row_number().over(order) == 1) | (F.lead("x").over(order).isNull())
    mean = F.col("occ") * 2.55
    state = (
        F.when(mean < 0.30 * 255, "empty").when(mean > 0.95 * 255, "full").when(F.col("_edge") & (mean > 0.90 * 255), "edge_full")
        .when(F.col("h") < 0.7 * F.col("_h"), "short").otherwise("ok")
    )
    return df.withColumn("_edge", edge).join(medians, by).withColumn("state", state)


def chop_edges(df: DataFrame, by: list[str]) -> DataFrame:
    """First and last box of a group in x order cut to the high median width."""
    order = Window.partitionBy(*by).orderBy("x", "det_id")
    own = df.withColumns({"_first": F.row_number().over(order) == 1, "_last": F.lead("x").over(order).isNull()})
    own = own.join(df.groupBy(*by).agg(median_high("w").alias("_m")), by)
    cut = F.col("w") > F.col("_m")
    return own.withColumns({
        "x": F.when(F.col("_first") & cut, F.col("x") + F.col("w") - F.col("_m")).otherwise(F.col("x")),
        "w": F.when((F.col("_first") | F.col("_last")) & cut, F.col("_m")).otherwise(F.col("w")),
    }).drop("_first", "_last", "_m")
