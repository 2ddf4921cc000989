"""Window operators over frames, tracks and profiles; every window has a partition key."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_mean(x: str, n: int, by: list[str], order: str) -> Column:
    return F.avg(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0))


#: Rows of a partition of `spread`, about.
SPREAD_ROWS = 200_000


def spread(df: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """df hashed by its keys into partitions of about `rows` rows, so that a task's memory does not grow with the table.

    There are never fewer partitions than the session's for shuffles. df is counted for it.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, ceil(df.count() / (rows or SPREAD_ROWS))), *by)


def same_keys(keys: list[str], prefix: str) -> Column:
    """Whether each key equals the one of the other side, named with the prefix; nulls are equal."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def prefix_sums(df: DataFrame, value: str, by: list[str], order: str, width: int, out: str) -> DataFrame:
    """df with out: the sum of value over the earlier rows of by, in the order of a whole-number column.

    In two levels: rows are summed within `width` values of the order, and only one row of each such
    bucket meets the others of its group, so that no task sorts a whole group.
    """
    own = df.withColumn("_bucket", F.floor(F.col(order) / width))
    sums = own.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_at_{k}") for k in [*by, "_bucket"]], before.alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, same_keys([*by, "_bucket"], "_at_"))
    return own.withColumn(out, F.col("_before") + F.col("_inside")).select(*df.columns, out)


def trace(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """First and last point of the last n + 1, and how many there are."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, 0)
    return df.withColumns({
        "n_points": F.count(F.lit(1)).over(w), "first_x": F.first("cx").over(w), "first_y": F.first("cy").over(w),
        "last_x": F.col("cx"), "last_y": F.col("cy"),
    })


def signal_state(df: DataFrame, by: str = "camera_id", order: str = "frame_idx") -> DataFrame:
    """is_red with hysteresis: only a clear red or green changes it; it starts as not red."""
    clear = F.when(F.col("red") & ~F.col("yellow") & ~F.col("green"), True).when(F.col("green") & ~F.col("red") & ~F.col("yellow"), False)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("is_red", F.coalesce(F.last(clear, ignorenulls=True).over(w), F.lit(False)))


def red_phase(df: DataFrame, by: str = "camera_id", order: str = "frame_idx") -> DataFrame:
    """Number of the state's stretch: tracks live within one."""
    w = Window.partitionBy(by).orderBy(order)
    change = (F.col("is_red") != F.lag("is_red", 1, False).over(w)).cast("long")
    return df.withColumn("phase", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_event(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def running(x: Column, by: list[str], order: list[str]) -> Column:
    return F.sum(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def gaps(df: DataFrame, by: list[str]) -> DataFrame:
    """Gap to the next box in x order; null after the last."""
    w = Window.partitionBy(*by).orderBy("x", "det_id")
    return df.withColumn("gap", F.lead("x").over(w) - (F.col("x") + F.col("w")))


def trim_around_middle(df: DataFrame, middle: int, n: int, by: list[str]) -> DataFrame:
    """At most n boxes on each side of the middle, those nearest to it."""
    right = F.col("x") + F.expr("w div 2") >= middle
    near = Window.partitionBy(*by, "_right").orderBy(F.abs(F.col("x") + F.expr("w div 2") - middle), "det_id")
    return df.withColumn("_right", right).withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= n).drop("_n", "_right")


def neighbour_diffs(df: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the height steps to both neighbours in x order, and its rank in the group."""
    w = Window.partitionBy(*by).orderBy("x", "det_id")
    step = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)), F.lit(0)) + F.coalesce(F.abs(F.lead("y").over(w) - F.col("y")), F.lit(0))
    own = df.withColumn("diff", step)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("diff", "x", "det_id")))


def line_inliers(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Points (x, y) of groups of more than three with weight and inlier: do they lie along one line?

    Of the points in x order that have two more after them, the two where the heights of these three change least
    fix the line's direction (level, if none changes at all). A point's weight is the gaussian of its
    distance from the mean along the normal, with a standard deviation of 1.5 at least, over the largest
    weight; it is an inlier above the threshold. Smaller groups have no rows.
    """
    order, whole = Window.partitionBy(*by).orderBy("x", "det_id"), Window.partitionBy(*by)
    y1, y2 = F.lead("y").over(order), F.lead("y", 2).over(order)
    own = df.withColumns({"_i": F.row_number().over(order), "_bend": F.abs(y1 - F.col("y")) + F.abs(y1 - y2)})
    bent = F.filter(F.collect_list(F.struct("_bend", "_i", "x", "y")).over(whole), lambda p: p["_bend"].isNotNull())
    own = own.withColumns({"_p": F.sort_array(bent), "_most": F.max("_bend").over(whole)}).where(F.size("_p") >= 2)
    moved = F.col("_most") > 0
    vx, vy = (F.when(moved, F.col("_p")[1][c] - F.col("_p")[0][c]).otherwise(0).cast("double") for c in "xy")
    own = own.withColumns({"_vx": vx, "_vy": vy}).withColumn("_v", F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy")))
    still = F.col("_v") == 0
    ux, uy = F.when(still, 1.0).otherwise(F.try_divide("_vx", "_v")), F.when(still, 0.0).otherwise(F.try_divide("_vy", "_v"))
    own = own.withColumn("_z", ux * F.col("y") - uy * F.col("x"))
    own = own.withColumns({"_z": F.col("_z") - F.avg("_z").over(whole), "_s": F.greatest(F.lit(1.5), F.stddev_pop("_z").over(whole))})
    own = own.withColumn("_w", F.exp(-0.5 * F.col("_z") * F.col("_z") / (F.col("_s") * F.col("_s"))))
    weight = F.round(F.col("_w") / F.max("_w").over(whole), 6)
    return own.withColumn("weight", weight).withColumn("inlier", F.col("weight") > threshold).select(*df.columns, "weight", "inlier")


def smoothed(x: str, k: int, by: list[str], order: str) -> tuple[Column, Column, Column]:
    """Prefix sum, centred window sum, and left minus right half sums, zero padded."""
    w = Window.partitionBy(*by).orderBy(order)
    zero = F.lit(0)
    left, right = F.coalesce(F.sum(x).over(w.rowsBetween(-k, -1)), zero), F.coalesce(F.sum(x).over(w.rowsBetween(1, k)), zero)
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(x).over(w.rowsBetween(-k, k)), left - right


def search(x: str, place: str, above: bool, threshold: int, by: list[str]) -> tuple[Column, Column]:
    """Nearest places to the left and to the right where x is above (or below) a threshold, else -1."""
    hit = F.when(F.col(x) > threshold if above else F.col(x) < threshold, F.col(place))
    w = Window.partitionBy(*by).orderBy(place)
    left = F.max(hit).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(hit).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(left, F.lit(-1)), F.coalesce(right, F.lit(-1))


def slope_class(df: DataFrame, x: str, place: str, by: list[str], n: int = 3) -> DataFrame:
    """RISING, FALLING or FLAT: forward against trailing mean, with a tenth of the range as limit."""
    w, whole = Window.partitionBy(*by).orderBy(place), Window.partitionBy(*by)
    diff = F.avg(x).over(w.rowsBetween(1, n)) - F.avg(x).over(w.rowsBetween(-n, -1))
    limit = (F.max(x).over(whole) - F.min(x).over(whole)) * 0.1
    return df.withColumn("slope", F.when(diff > limit, "RISING").when(diff < -limit, "FALLING").otherwise("FLAT"))


def runs(df: DataFrame, on: Column, place: str, by: list[str]) -> DataFrame:
    """Maximal runs of consecutive places that are on, as closed intervals."""
    lit = df.where(on)
    island = F.col(place) - F.row_number().over(Window.partitionBy(*by).orderBy(place))
    return lit.withColumn("_g", island).groupBy(*by, "_g").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).drop("_g")


def folds(df: DataFrame, k: int, label: str = "label", order: str = "id") -> DataFrame:
    """fold 0 .. k - 1 of equal size within a class; rows past the last whole fold have none."""
    w = Window.partitionBy(label)
    step = F.floor(F.count(F.lit(1)).over(w) / k)
    fold = F.floor((F.row_number().over(w.orderBy(order)) - 1) / step).cast("long")
    return df.withColumn("fold", F.when((step > 0) & (fold < k), fold))


def split(df: DataFrame, share: float, label: str = "label", order: str = "id") -> DataFrame:
    """is_train for the first whole share of each class."""
    w = Window.partitionBy(label)
    return df.withColumn("is_train", F.row_number().over(w.orderBy(order)) <= (F.count(F.lit(1)).over(w) * share).cast("long"))


def local_extreme(df: DataFrame, x: str, place: str, lo: int, hi: int, by: list[str]) -> DataFrame:
    """First places of the smallest and of the largest value in a closed range."""
    inside = df.where(F.col(place).between(lo, hi))
    return inside.groupBy(*by).agg(
        F.min_by(place, F.struct(F.col(x), F.col(place))).alias("argmin"), F.min_by(place, F.struct(-F.col(x), F.col(place))).alias("argmax")
    )


def confirmed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The second row of each track, if matched there."""
    own = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return own.where("_n = 2 and matched").drop("_n")


def latch(x: Column, by: list[str], order: list[str]) -> Column:
    return F.max(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
