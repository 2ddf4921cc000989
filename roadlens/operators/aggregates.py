"""Aggregations of boxes, profiles, votes and scores."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .joins import contained_groups


def letter_votes(df: DataFrame, least: int, skip: int) -> DataFrame:
    """Votes of a place: letters from a score on, with the score above it and their number; a letter
    below the skip score also votes for leaving the place out, by what it lacks."""
    kept = df.where(F.col("score") >= least)
    vote = F.struct("letter", (F.col("score") - least).alias("s"))
    leave = F.struct(F.lit("~").alias("letter"), F.abs(skip - F.col("score")).alias("s"))
    votes = F.when(F.col("score") < skip, F.array(vote, leave)).otherwise(F.array(vote))
    return kept.select("plate_id", "pos", F.explode(votes).alias("v")).groupBy("plate_id", "pos", F.col("v.letter").alias("letter")).agg(
        F.sum("v.s").alias("total"), F.count(F.lit(1)).alias("n")
    )


def nth(df: DataFrame, x: str, by: list[str], rank: Column) -> DataFrame:
    """Order statistic of each group (rank from 0 as a Column of _n, the group's size), without arrays."""
    w = Window.partitionBy(*by)
    own = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(x)) - 1})
    return own.where(F.col("_r") == rank).select(*by, x)


def confusion(df: DataFrame, score: str = "score") -> list[Column]:
    """tp, tn, fp, fn with score > 0 as the positive verdict and target +-1."""
    yes, real = F.col(score) > 0, F.col("target") > 0
    cells = {"tp": yes & real, "tn": ~yes & ~real, "fp": yes & ~real, "fn": ~yes & real}
    return [F.count_if(v).alias(k) for k, v in cells.items()]


def rates(df: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return df.withColumns({
        "error": F.round((fp + fn) / (tp + tn + fp + fn), 6), "precision": F.round(F.try_divide(tp, tp + fp), 6), "recall": F.round(F.try_divide(tp, tp + fn), 6),
    })


def otsu(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Threshold with the largest between-class variance of a histogram (x, cnt), the first on ties."""
    w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    own = df.withColumns({
        "_n0": F.sum("cnt").over(w), "_s0": F.sum(F.col("cnt") * F.col(x)).over(w), "_n": F.sum("cnt").over(whole), "_s": F.sum(F.col("cnt") * F.col(x)).over(whole),
    })
    n, n0, s, s0 = (F.col(c).cast("decimal(19,0)") for c in ("_n", "_n0", "_s", "_s0"))
    # products of sums outgrow a long: they are exact as decimals, and the square is taken of a double
    lead, weight = (s0 * n - s * n0).cast("double"), (n0 * (n - n0)).cast("double")
    between = F.when(F.col("_n") > F.col("_n0"), F.round(lead * lead / weight, 6))
    own = own.withColumn("_b", between).where("_b > 0")
    return own.groupBy(*by).agg(F.max_by(x, F.struct("_b", -F.col(x))).alias("threshold"))


def outliers(df: DataFrame, x: str) -> DataFrame:
    """df with flag: hard over 70 from the mean of n values with the sum s and the sum of squares q, soft over 30 and over three deviations.

    Whole numbers multiplied by n, so a value at a limit does not depend on how a deviation is rounded.
    """
    n, s = F.col("n"), F.col("s")
    far = F.abs(n * F.col(x) - s)
    return df.withColumn("flag", F.when(far > 70 * n, "hard").when((far > 30 * n) & (far * far > 9 * (n * F.col("q") - s * s)), "soft").otherwise("ok"))


def axes() -> list[Column]:
    """Larger and smaller singular value of centred points (cx, cy), from their covariance."""
    n, sxx, syy, sxy = F.count(F.lit(1)), F.var_pop("cx"), F.var_pop("cy"), F.covar_pop("cx", "cy")
    mean, spread = (sxx + syy) / 2, F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)
    single = n <= 1
    major = F.when(single, 1.0).otherwise(F.sqrt(n * (mean + spread)))
    minor = F.when(single, 0.0).otherwise(F.sqrt(n * F.greatest(F.lit(0.0), mean - spread)))
    return [F.round(major, 3).alias("major"), F.round(minor, 3).alias("minor")]


def group_boxes(members: DataFrame, by: list[str], mode: str, threshold: int, eps: float = 0.2) -> DataFrame:
    """by, gid, x, y, w, h, n and score of the groups of more than `threshold` boxes that no stronger group holds.

    members: by, cluster, node, x, y, w, h and v, the score. mode max takes a group's best box and
    its score, the smaller node on ties; avg the score-weighted mean box, halves to even, and the sum of scores.
    A group inside another one's box, enlarged by eps, goes if the other has more boxes and more than three, or it has fewer than three itself.
    """
    own = members.groupBy(*by, F.col("cluster").alias("gid"))
    n, total = F.count(F.lit(1)).alias("n"), F.sum("v")
    if mode == "max":
        best = F.max_by(F.struct("x", "y", "w", "h", F.col("v").alias("score")), F.struct("v", -F.col("node")))
        groups = own.agg(n, best.alias("_b")).select(*by, "gid", "n", "_b.*")
    else:
        mean = [F.bround(F.sum(F.col(c) * F.col("v")) / F.greatest(total, F.lit(1)), 0).cast("long").alias(c) for c in "xywh"]
        groups = own.agg(n, *mean, total.alias("score"))
    return contained_groups(groups.where(F.col("n") > threshold), by, eps)


def guarded_extent(df: DataFrame, by: list[str], limit: int, least: int, top, bottom) -> DataFrame:
    """lo and hi of each group's boxes between the lines top and bottom (functions of x), with 2 to spare, within 0 and limit.

    Boxes count in groups of `least` or more, if their middle is no further than half of the half height from the
    middle of the lines there, and if they are no taller than 1.5 times what lies between. Where what they
    span is below 65 % of the full width, that is taken.
    """
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    upper, lower = top(cx), bottom(cx)
    half = (lower - upper) / 2
    central = F.try_divide(F.abs(cy - (upper + half)), half) <= 0.5
    own = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    counts = (F.col("_n") >= least) & F.coalesce(central, F.lit(False)) & (F.col("h") <= 1.5 * (lower - upper))
    found = own.groupBy(*by).agg(F.min(F.when(counts, F.col("x"))).alias("_lo"), F.max(F.when(counts, F.col("x") + F.col("w"))).alias("_hi"))
    wide = F.coalesce(F.col("_hi") - F.col("_lo") >= ceil(0.65 * (limit + 1)), F.lit(False))
    lo, hi = F.greatest(F.col("_lo") - 2, F.lit(0)), F.least(F.col("_hi") + 2, F.lit(limit))
    return found.select(*by, F.when(wide, lo).otherwise(0).alias("lo"), F.when(wide, hi).otherwise(limit).alias("hi"))


def coverage(df: DataFrame, lo: str, hi: str, by: list[str]) -> DataFrame:
    """How many closed intervals cover each place where the number changes: a sweep over deltas."""
    deltas = df.select(*by, F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(1).alias("d")), F.struct((F.col(hi) + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = deltas.groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("depth", F.sum("d").over(w)).drop("d")


def _level_runs(df: DataFrame, lo: str, hi: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Spans of places of one depth (at, _width, depth), and the runs (level, lo, _w, median) of every level that occurs."""
    median = df.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) within group (order by `{hi}` - `{lo}` + 1)").cast("long").alias("median"))
    depth = coverage(df, lo, hi, by).withColumn("_width", F.lead("at").over(Window.partitionBy(*by).orderBy("at")) - F.col("at"))
    spans = depth.where("depth > 0")
    levels = spans.select(*by, F.col("depth").alias("level")).distinct()
    rows = spans.join(levels, by).where("depth >= level")
    own = Window.partitionBy(*by, "level").orderBy("at")
    island = F.col("at") - F.coalesce(F.sum("_width").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = rows.withColumn("_g", island).groupBy(*by, "level", "_g").agg(F.min("at").alias("lo"), F.sum("_width").alias("_w"))
    return depth.where("_width is not null"), runs.join(median, by).drop("_g")


def _best_level(runs: DataFrame, by: list[str], least: int) -> DataFrame:
    """level, median and _points of the best level of each group."""
    off = F.abs(F.col("_w") - F.col("median"))
    # in medians, so that scores stay whole numbers until the best is found
    points = (F.col("median") - off) * F.when(off * 4 < F.col("median"), 18).otherwise(10)
    points = F.when((F.col("_w") >= least) & (F.col("_w") * 100 <= F.col("median") * 155), points).otherwise(0)
    scored = runs.groupBy(*by, "level", "median").agg(F.sum(points).alias("_points"))
    best = scored.groupBy(*by).agg(F.max_by(F.struct("level", "median", "_points"), F.struct("_points", -F.col("level"))).alias("_b"))
    return best.select(*by, "_b.*")


def consensus_level(df: DataFrame, lo: str, hi: str, by: list[str], least: int = 3) -> DataFrame:
    """For each group of closed intervals the level of coverage whose runs are most like the median interval, with median and score.

    A run of a width w from `least` to 1.55 medians scores 10 times its closeness 1 - |w - median| / median,
    and 8 times that more if it is off by less than a quarter. Levels between two depths that occur
    have the same runs, so only those that occur are scored; the lowest is taken on ties, and where
    no run scores. Work is bounded by the square of the places where coverage changes.
    """
    best = _best_level(_level_runs(df, lo, hi, by)[1], by, least)
    return best.select(*by, "level", "median", F.round(F.col("_points") / F.col("median"), 4).alias("score"))


def _cut(wide: DataFrame, curve: DataFrame, by: list[str]) -> DataFrame:
    """wide (lo, _w) with _at, the first lowest place between 40 and 60 percent of the run, _low, its height,
    and _left and _right, the greatest heights up to and from there (the place after the run included).

    curve: at, _width and depth of spans of one height; a run meets those of its group in its range.
    """
    left, right = F.col("lo") + (F.col("_w") * 0.4).cast("long"), F.col("lo") + (F.col("_w") * 0.6).cast("long")
    own = wide.select(*by, F.struct("lo", "_w", left.alias("l"), right.alias("r"), *[c for c in wide.columns if c not in (*by, "lo", "_w")]).alias("_run"))
    met = own.join(curve, by).where((F.col("at") <= F.col("_run.lo") + F.col("_run._w")) & (F.col("at") + F.col("_width") > F.col("_run.lo")))
    inside = (F.col("at") <= F.col("_run.r")) & (F.col("at") + F.col("_width") > F.col("_run.l"))
    lowest = F.min(F.when(inside, F.struct("depth", F.greatest("at", "_run.l").alias("at"))))
    of = met.groupBy(*by, "_run").agg(lowest.alias("_m"), F.collect_list(F.struct("at", (F.col("at") + F.col("_width")).alias("end"), "depth")).alias("_spans"))
    # spans of a run are as few as the places where it changes

    def peak(test) -> Column:
        return F.array_max(F.transform(F.filter("_spans", test), lambda s: s["depth"]))

    at = F.col("_m.at")
    return of.select(*by, "_run.*", at.alias("_at"), F.col("_m.depth").alias("_low"), peak(lambda s: s["at"] <= at).alias("_left"), peak(lambda s: s["end"] > at).alias("_right")).drop("l", "r")


def consensus_intervals(df: DataFrame, lo: str, hi: str, by: list[str], least: int = 3) -> DataFrame:
    """lo and hi (closed) of the intervals of each group's best level of coverage (see consensus_level).

    Runs from `least` to 1.55 medians wide stay. Those up to twice as wide are cut at their lowest place near the
    middle: where coverage there is below a quarter of that to the left, the left part stays, else the
    right part by the same test, else the whole run. Wider runs go.
    """
    curve, runs = _level_runs(df, lo, hi, by)
    best = _best_level(runs, by, least).drop("_points", "median")
    own = runs.join(best, [*by, "level"]).drop("level")
    narrow = own.where(f"_w >= {least} and _w * 100 <= median * 155").select(*by, "lo", (F.col("lo") + F.col("_w") - 1).alias("hi"))
    cut = _cut(own.where("_w * 100 > median * 155 and _w * 100 <= median * 310"), curve, by)
    left, right = F.col("_low") * 4 < F.col("_left"), F.col("_low") * 4 < F.col("_right")
    parts = cut.select(
        *by, F.when(~left & right, F.col("_at") + 1).otherwise(F.col("lo")).alias("lo"), F.when(left, F.col("_at") - 2).otherwise(F.col("lo") + F.col("_w") - 1).alias("hi")
    )
    return narrow.unionByName(parts)


def segment_profile(df: DataFrame, place: str, height: str, by: list[str], width: int, tall: int, least: int = 3) -> DataFrame:
    """lo and hi (closed) of the runs of places with a positive height that can be letters of a median width and height.

    Runs whose peak is below 0.35 of the height go. Those from `least` to 1.55 widths stay; those below twice
    that are cut at their lowest place near the middle, and each part stays if its peak is above the same limit and
    more than twice the height at the cut. Wider runs go.
    """
    rows = df.select(*by, F.col(place).alias("at"), F.col(height).alias("depth"), F.lit(1).alias("_width")).where("depth >= 1")
    island = F.col("at") - F.row_number().over(Window.partitionBy(*by).orderBy("at"))
    runs = rows.withColumn("_g", island).groupBy(*by, "_g").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("_w"), F.max("depth").alias("_peak"))
    own = runs.where(F.col("_peak") * 100 >= 35 * tall).select(*by, "lo", "_w")
    narrow = own.where(f"_w >= {least} and _w * 100 <= {155 * width}").select(*by, "lo", (F.col("lo") + F.col("_w") - 1).alias("hi"))
    cut = _cut(own.where(f"_w * 100 > {155 * width} and _w * 100 < {310 * width}"), rows, by)

    def high(peak: str) -> Column:
        return (F.col(peak) * 100 > 35 * tall) & (F.col("_low") * 2 < F.col(peak))

    left = cut.where(high("_left")).select(*by, "lo", (F.col("_at") - 2).alias("hi"))
    right = cut.where(high("_right")).select(*by, (F.col("_at") + 1).alias("lo"), (F.col("lo") + F.col("_w") - 1).alias("hi"))
    return narrow.unionByName(left).unionByName(right)


def split_boxes(boxes: DataFrame, profile: DataFrame, place: str, height: str, by: list[str], width: float, tall: float, key: str = "det_id") -> DataFrame:
    """key, lo and hi (closed) of boxes, with those of about two letters cut where the profile of their group is lowest.

    A box over 2.5 and below 2.7 median widths is cut at its first lowest place between 40 and 60
    percent; a part stays if its peak is over 0.3 of the median height and over twice the height at the
    cut. Where neither part does, and for all other boxes, the box stays. Places without a profile have the height 0.
    """
    own = boxes.withColumn("_w", F.col("hi") - F.col("lo") + 1)
    two = (F.col("_w") > 2.5 * width) & (F.col("_w") < 2.7 * width)
    wide = own.where(two).withColumn("_at", F.explode(F.sequence(F.col("lo"), F.col("hi") + 1)))
    heights = profile.select(*by, F.col(place).alias("_at"), F.col(height).alias("_h"))
    of = wide.join(heights, [*by, "_at"], "left").groupBy(key, "lo", "hi", "_w").agg(F.collect_list(F.struct(F.coalesce("_h", F.lit(0)).alias("h"), F.col("_at").alias("at"))).alias("_p"))
    first, last = F.col("lo") + (F.col("_w") * 0.4).cast("long"), F.col("lo") + (F.col("_w") * 0.6).cast("long")
    of = of.withColumn("_cut", F.array_min(F.filter("_p", lambda p: (p["at"] >= first) & (p["at"] <= last))))

    def peak(test) -> Column:
        return F.array_max(F.transform(F.filter("_p", test), lambda p: p["h"]))

    of = of.withColumns({"_left": peak(lambda p: p["at"] <= F.col("_cut.at")), "_right": peak(lambda p: p["at"] >= F.col("_cut.at"))})
    left, right = ((F.col(c) > 0.3 * tall) & (F.col("_cut.h") * 2 < F.col(c)) for c in ("_left", "_right"))
    parts = F.array_compact(F.array(
        F.when(left, F.struct("lo", (F.col("_cut.at") - 2).alias("hi"))), F.when(right, F.struct((F.col("_cut.at") + 1).alias("lo"), "hi")),
        F.when(~left & ~right, F.struct("lo", "hi")),
    ))
    return own.where(~two).select(key, "lo", "hi").unionByName(of.select(key, F.explode(parts).alias("_b")).select(key, "_b.lo", "_b.hi"))


def fit_angle(x: str, y: str, over=None) -> Column:
    """Angle of the total least squares line through points, of a group or of a window."""
    parts = [F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)]
    c, vx, vy = [p.over(over) for p in parts] if over is not None else parts
    return 0.5 * F.atan2(2 * c, vx - vy)


def merge_overlaps(df: DataFrame, by: list[str]) -> DataFrame:
    """Intervals of a group in x order, each merged with the later ones that it reaches as it grows.

    A running maximum of right ends and islands, so groups of any size work without arrays.
    """
    w = Window.partitionBy(*by).orderBy("x", "right", "det_id")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = df.withColumn("_new", (F.coalesce(F.col("x") >= reach, F.lit(True))).cast("int"))
    own = own.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*by, "_g").agg(F.min("x").alias("x"), F.max("right").alias("right"), F.count(F.lit(1)).alias("n")).drop("_g")


def merge_adjacent(boxes: Column, median: Column) -> Column:
    """Sorted boxes (x, y, w, h) folded from the left: a box joins the one before, as it has grown, where

    1.3 times the distance of their union's width from the median is below that of either width, or
    both overlaps are over half of the smaller side, or what of the smaller side lies outside is under half of the larger one.
    """

    def step(done: Column, box: Column) -> Column:
        last = F.element_at(done, -1)
        joined = geo.union_box(last, box)
        wide, tall = geo.overlap(last["x"], last["x"] + last["w"], box["x"], box["x"] + box["w"]), geo.overlap(last["y"], last["y"] + last["h"], box["y"], box["y"] + box["h"])
        met = (wide > 0) & (tall > 0)
        iw, ih = F.when(met, wide).otherwise(0), F.when(met, tall).otherwise(0)
        off = F.abs(joined["w"] - median) * 13
        fits = (off < F.abs(last["w"] - median) * 10) & (off < F.abs(box["w"] - median) * 10)
        small_w, small_h = F.least(last["w"], box["w"]), F.least(last["h"], box["h"])
        over = (iw * 2 > small_w) & (ih * 2 > small_h)
        within = ((small_w - iw) * 2 < F.greatest(last["w"], box["w"])) & ((small_h - ih) * 2 < F.greatest(last["h"], box["h"]))
        return F.when(fits | over | within, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(box)))

    return F.aggregate(F.slice(boxes, F.lit(2), F.greatest(F.size(boxes) - 1, F.lit(0))), F.slice(boxes, 1, 1), step)
