"""Queries of window operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text
from ..operators import windows as op
from ..operators.aggregates import fit_angle
from ..sources import adapters as src
from .base import query
from .filters import BOXES_ON_PROFILE, boxes_on_profile

TRACK, FRAME = ["camera_id", "track_id"], ["camera_id", "frame_id"]


@query("w1_moving_mean", "SELECT det_id, round(avg(occ) OVER (PARTITION BY camera_id ORDER BY frame_idx ROWS 29 PRECEDING), 4) AS mean_occ FROM det", "det")
def w1(spark, d):
    return src.detections(spark, d).select("det_id", F.round(op.moving_mean("occ", 30, ["camera_id"], "frame_idx"), 4).alias("mean_occ"))


@query("w2_trace", """SELECT det_id, count(*) OVER t AS n_points, first(cx) OVER t AS first_x, first(cy) OVER t AS first_y, cx AS last_x, cy AS last_y FROM det
  WINDOW t AS (PARTITION BY camera_id, track_id ORDER BY frame_idx ROWS 10 PRECEDING)""", "det")  # fmt: skip
def w2(spark, d):
    return op.trace(src.detections(spark, d), 10, TRACK, ["frame_idx"]).select("det_id", "n_points", "first_x", "first_y", "last_x", "last_y")


STATE = """st AS (SELECT camera_id, frame_idx, coalesce(last_value(CASE WHEN red AND NOT yellow AND NOT green THEN true WHEN green AND NOT red AND NOT yellow THEN false END IGNORE NULLS)
  OVER (PARTITION BY camera_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), false) AS is_red FROM sig)"""  # fmt: skip


@query("w3_signal_state", f"WITH {STATE} SELECT camera_id, frame_idx, is_red FROM st", "sig")
def w3(spark, d):
    return op.signal_state(src.signals(spark, d)).select("camera_id", "frame_idx", "is_red")


CLASS = "CASE WHEN area > 99 AND area < 900 THEN 'bike' WHEN area > 899 THEN 'car' END"
CROSSED = f"""cr AS (SELECT det.*, {CLASS} AS vehicle, (first(cy) OVER t - 60) * (cy - 60) <= 0 AND count(*) OVER t > 5 AS crossed FROM det
  WINDOW t AS (PARTITION BY camera_id, track_id ORDER BY frame_idx ROWS 10 PRECEDING)),
  fe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS n FROM cr WHERE crossed AND vehicle IS NOT NULL) WHERE n = 1)"""  # fmt: skip


def crossings(spark, d, least: int = 5):
    """First crossing of the counting line by each track, with its class."""
    t = op.trace(src.detections(spark, d), 10, TRACK, ["frame_idx"])
    crossed = t.where(((F.col("first_y") - src.LINE_Y) * (F.col("last_y") - src.LINE_Y) <= 0) & (F.col("n_points") > least))
    vehicle = F.when((F.col("area") > 99) & (F.col("area") < src.CAR_AREA), "bike").when(F.col("area") > src.CAR_AREA - 1, "car")
    return op.first_event(crossed.withColumn("vehicle", vehicle).where("vehicle is not null"), TRACK, ["frame_idx"])


@query("w4_first_event", f"WITH {CROSSED} SELECT camera_id, track_id, frame_idx, vehicle FROM fe", "det")
def w4(spark, d):
    return crossings(spark, d).select("camera_id", "track_id", "frame_idx", "vehicle")


@query("w5_running_counts", f"""WITH {CROSSED} SELECT camera_id, frame_idx, CAST(sum(CASE WHEN vehicle = 'car' THEN 1 ELSE 0 END) OVER r AS BIGINT) AS cars,
  CAST(sum(CASE WHEN vehicle = 'bike' THEN 1 ELSE 0 END) OVER r AS BIGINT) AS bikes FROM fe WINDOW r AS (PARTITION BY camera_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""", "det")  # fmt: skip
def w5(spark, d):
    c = crossings(spark, d)
    total = lambda v: op.running((F.col("vehicle") == v).cast("long"), ["camera_id"], ["frame_idx"])
    return c.select("camera_id", "frame_idx", total("car").alias("cars"), total("bike").alias("bikes"))


@query("w6_red_phase", f"""WITH {STATE} SELECT camera_id, frame_idx, CAST(sum(CASE WHEN is_red <> p THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS phase
  FROM (SELECT *, lag(is_red, 1, false) OVER (PARTITION BY camera_id ORDER BY frame_idx) AS p FROM st)""", "sig")  # fmt: skip
def w6(spark, d):
    return op.red_phase(op.signal_state(src.signals(spark, d))).select("camera_id", "frame_idx", "phase")


@query("w7_gaps", "SELECT det_id, lead(x) OVER (PARTITION BY camera_id, frame_id ORDER BY x, det_id) - (x + w) AS gap FROM det", "det")
def w7(spark, d):
    return op.gaps(src.detections(spark, d), FRAME).select("det_id", "gap")


@query("w7_largest_gap", """SELECT camera_id, frame_id, det_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY gap DESC, x, det_id) AS n FROM (
  SELECT camera_id, frame_id, det_id, x, lead(x) OVER (PARTITION BY camera_id, frame_id ORDER BY x, det_id) - (x + w) AS gap FROM det) WHERE gap IS NOT NULL) WHERE n = 1""", "det")  # fmt: skip
def w7_largest(spark, d):
    """The box before each frame's largest gap, the first one on ties."""
    own = op.gaps(src.detections(spark, d), FRAME).where("gap is not null")
    best = own.groupBy(*FRAME).agg(F.max_by(F.struct("det_id", "gap"), F.struct("gap", -F.col("x"), -F.col("det_id"))).alias("b"))
    return best.select(*FRAME, "b.det_id", "b.gap")


@query("w8_trim_around_middle", """SELECT det_id FROM (SELECT det_id, row_number() OVER (PARTITION BY camera_id, frame_id, x + w // 2 >= 400 ORDER BY abs(x + w // 2 - 400), det_id) AS n FROM det) WHERE n <= 2""", "det")
def w8(spark, d):
    return op.trim_around_middle(src.detections(spark, d), 400, 2, FRAME).select("det_id")


@query("w9_neighbour_diffs", """WITH s AS (SELECT camera_id, frame_id, x, det_id, coalesce(abs(y - lag(y) OVER o), 0) + coalesce(abs(lead(y) OVER o - y), 0) AS diff FROM det
  WINDOW o AS (PARTITION BY camera_id, frame_id ORDER BY x, det_id)) SELECT det_id, diff, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY diff, x, det_id) AS rank FROM s""", "det")  # fmt: skip
def w9(spark, d):
    return op.neighbour_diffs(src.detections(spark, d), FRAME).select("det_id", "diff", F.col("rank").cast("long").alias("rank"))


@query("w9_line_inliers", """WITH s AS (SELECT camera_id, frame_id, x, y, det_id, row_number() OVER o AS i, abs(lead(y) OVER o - y) + abs(lead(y) OVER o - lead(y, 2) OVER o) AS bend FROM det WINDOW o AS (PARTITION BY camera_id, frame_id ORDER BY x, det_id)),
  c AS (SELECT camera_id, frame_id, list([x, y] ORDER BY bend, i) AS p, max(bend) AS most FROM s WHERE bend IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
  v AS (SELECT camera_id, frame_id, CAST(CASE WHEN most = 0 THEN 0 ELSE p[2][1] - p[1][1] END AS DOUBLE) AS vx, CAST(CASE WHEN most = 0 THEN 0 ELSE p[2][2] - p[1][2] END AS DOUBLE) AS vy FROM c),
  u AS (SELECT camera_id, frame_id, CASE WHEN vx = 0 AND vy = 0 THEN 1.0 ELSE vx / sqrt(vx * vx + vy * vy) END AS ux, CASE WHEN vx = 0 AND vy = 0 THEN 0.0 ELSE vy / sqrt(vx * vx + vy * vy) END AS uy FROM v),
  z AS (SELECT det_id, s.camera_id, s.frame_id, ux * y - uy * x AS pr FROM s JOIN u ON u.camera_id = s.camera_id AND u.frame_id = s.frame_id),
  w AS (SELECT det_id, camera_id, frame_id, pr - avg(pr) OVER g AS z, greatest(1.5, stddev_pop(pr) OVER g) AS sd FROM z WINDOW g AS (PARTITION BY camera_id, frame_id)),
  e AS (SELECT *, exp(-0.5::DOUBLE * z * z / (sd * sd)) AS weight FROM w)
  SELECT det_id, round(weight / max(weight) OVER (PARTITION BY camera_id, frame_id), 6) AS weight, round(weight / max(weight) OVER (PARTITION BY camera_id, frame_id), 6) > 0.5 AS inlier FROM e""", "det")  # fmt: skip
def w9_inliers(spark, d):
    return op.line_inliers(src.detections(spark, d), FRAME, 0.5).select("det_id", "weight", "inlier")


@query("w10_running_sum", """SELECT key, bin, CAST(sum(cnt) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix, CAST(sum(cnt) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS smooth,
  CAST(coalesce(sum(cnt) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) - coalesce(sum(cnt) OVER (o ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS BIGINT) AS step
  FROM prof WINDOW o AS (PARTITION BY key ORDER BY bin)""", "prof")  # fmt: skip
def w10(spark, d):
    prefix, smooth, step = op.smoothed("cnt", 2, ["key"], "bin")
    return src.profile(spark, d).select("key", "bin", prefix.alias("prefix"), smooth.alias("smooth"), step.alias("step"))


@query("w11_search", """SELECT key, bin, coalesce(max(CASE WHEN cnt > 1 THEN bin END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS left_place,
  coalesce(min(CASE WHEN cnt > 1 THEN bin END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS right_place FROM prof WINDOW o AS (PARTITION BY key ORDER BY bin)""", "prof")  # fmt: skip
def w11(spark, d):
    left, right = op.search("cnt", "bin", True, 1, ["key"])
    return src.profile(spark, d).select("key", "bin", left.alias("left_place"), right.alias("right_place"))


@query("w12_slope_class", """SELECT key, bin, CASE WHEN df > lim THEN 'RISING' WHEN df < -lim THEN 'FALLING' ELSE 'FLAT' END AS slope FROM (SELECT key, bin,
  avg(cnt) OVER (o ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - avg(cnt) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS df,
  (max(cnt) OVER (PARTITION BY key) - min(cnt) OVER (PARTITION BY key)) * 0.1::DOUBLE AS lim FROM prof WINDOW o AS (PARTITION BY key ORDER BY bin))""", "prof")  # fmt: skip
def w12(spark, d):
    return op.slope_class(src.profile(spark, d), "cnt", "bin", ["key"]).select("key", "bin", "slope")


RUNS = "ru AS (SELECT key, min(bin) AS lo, max(bin) AS hi FROM (SELECT key, bin, bin - row_number() OVER (PARTITION BY key ORDER BY bin) AS g FROM prof WHERE cnt >= 1) GROUP BY key, g)"


@query("w13_runs", f"WITH {RUNS} SELECT key, lo, hi FROM ru", "prof")
def w13(spark, d):
    return op.runs(src.profile(spark, d), F.col("cnt") >= 1, "bin", ["key"])


@query("w14_folds", """SELECT id, CASE WHEN s > 0 AND (n - 1) // s < 5 THEN (n - 1) // s END AS fold FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) AS n, count(*) OVER (PARTITION BY label) // 5 AS s FROM smp)""", "smp")
def w14(spark, d):
    return op.folds(src.samples(spark, d), 5).select("id", "fold")


@query("w15_split", "SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) <= CAST(trunc(count(*) OVER (PARTITION BY label) * 0.75::DOUBLE) AS BIGINT) AS is_train FROM smp", "smp")
def w15(spark, d):
    return op.split(src.samples(spark, d), 0.75).select("id", "is_train")


@query("w16_local_extreme", """SELECT DISTINCT key, first(bin) OVER (PARTITION BY key ORDER BY cnt, bin) AS argmin, first(bin) OVER (PARTITION BY key ORDER BY cnt DESC, bin) AS argmax FROM prof WHERE bin BETWEEN 10 AND 40""", "prof")
def w16(spark, d):
    return op.local_extreme(src.profile(spark, d), "cnt", "bin", 10, 40, ["key"])


@query("w17_split_boxes", f"""WITH b AS ({BOXES_ON_PROFILE}), c AS (SELECT * FROM b WHERE hi - lo >= 3),
  m AS (SELECT det_id, lo, hi, bin, row_number() OVER (PARTITION BY det_id ORDER BY cnt, bin) AS n FROM c JOIN prof ON c.key = prof.key AND bin BETWEEN lo + (hi - lo) * 4 // 10 AND lo + (hi - lo) * 6 // 10),
  s AS (SELECT c.det_id, c.lo, c.hi, m.bin FROM c LEFT JOIN m ON c.det_id = m.det_id AND m.n = 1)
  SELECT det_id, lo, coalesce(bin, hi) AS hi FROM s UNION ALL SELECT det_id, bin AS lo, hi FROM s WHERE bin IS NOT NULL""", "det prof")  # fmt: skip
def w17(spark, d):
    """Wide boxes are cut at the lowest place of their middle fifth."""
    wide = boxes_on_profile(spark, d).where("hi - lo >= 3")
    middle = wide.withColumn("bin", F.explode(F.expr("sequence(lo + (hi - lo) * 4 div 10, lo + (hi - lo) * 6 div 10)")))
    lowest = middle.join(src.profile(spark, d), ["key", "bin"]).groupBy("det_id").agg(F.min_by("bin", F.struct("cnt", "bin")).alias("cut"))
    cut = wide.join(lowest, "det_id", "left")
    parts = F.when(F.col("cut").isNull(), F.array(F.struct("lo", "hi"))).otherwise(
        F.array(F.struct("lo", F.col("cut").alias("hi")), F.struct(F.col("cut").alias("lo"), "hi"))
    )
    return cut.select("det_id", F.explode(parts).alias("p")).select("det_id", "p.lo", "p.hi")


@query("w18_resolve_overlap", f"""WITH b AS ({BOXES_ON_PROFILE}), n AS (SELECT *, lead(det_id) OVER o AS nid, lead(lo) OVER o AS nlo, lead(hi) OVER o AS nhi FROM b WINDOW o AS (PARTITION BY key ORDER BY lo, det_id)),
  c AS (SELECT n.det_id, bin, row_number() OVER (PARTITION BY n.det_id ORDER BY cnt, bin) AS r FROM n JOIN prof ON n.key = prof.key AND bin BETWEEN lo AND greatest(hi, nhi) WHERE nlo < hi)
  SELECT det_id, bin AS cut FROM c WHERE r = 1""", "det prof")  # fmt: skip
def w18(spark, d):
    """Where a box reaches into the next one, the lowest place of both."""
    o = Window.partitionBy("key").orderBy("lo", "det_id")
    own = boxes_on_profile(spark, d).withColumns({"nlo": F.lead("lo").over(o), "nhi": F.lead("hi").over(o)}).where("nlo < hi")
    spread = own.withColumn("bin", F.explode(F.sequence("lo", F.greatest("hi", "nhi"))))
    return spread.join(src.profile(spark, d), ["key", "bin"]).groupBy("det_id").agg(F.min_by("bin", F.struct("cnt", "bin")).alias("cut"))


@query("w19_confirmed", "SELECT camera_id, track_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS n FROM det) WHERE n = 2 AND occ >= 50", "det")
def w19(spark, d):
    return op.confirmed(src.detections(spark, d).withColumn("matched", F.col("occ") >= 50), TRACK, ["frame_idx"]).select("camera_id", "track_id", "frame_idx")


@query("w20_in_out_latch", """SELECT det_id, max(CASE WHEN (fy - 40) * (cy - 40) < 0 THEN 1 ELSE 0 END) OVER r AS was_in, max(CASE WHEN (fy - 80) * (cy - 80) < 0 THEN 1 ELSE 0 END) OVER r AS was_out
  FROM (SELECT *, first(cy) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx ROWS 10 PRECEDING) AS fy FROM det) WINDOW r AS (PARTITION BY camera_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""", "det")  # fmt: skip
def w20(spark, d):
    t = op.trace(src.detections(spark, d), 10, TRACK, ["frame_idx"])
    passed = lambda y: F.when((F.col("first_y") - y) * (F.col("cy") - y) < 0, 1).otherwise(0)
    return t.select("det_id", op.latch(passed(40), TRACK, ["frame_idx"]).alias("was_in"), op.latch(passed(80), TRACK, ["frame_idx"]).alias("was_out"))


@query("f1_codes", "SELECT det_id, CASE WHEN area < 300 THEN '' WHEN area < 900 THEN 'XMA' ELSE 'OTO' END AS vehicle, CASE WHEN occ < 50 THEN 'SLD' ELSE 'VDD' END AS violation FROM det", "det")
def f1(spark, d):
    kind = F.when(F.col("area") < 300, "undecided").when(F.col("area") < 900, "bike").otherwise("car")
    what = F.when(F.col("occ") < 50, "lane").otherwise("red_light")
    return src.detections(spark, d).select("det_id", text.code(kind, text.VEHICLE_CODES).alias("vehicle"), text.code(what, text.VIOLATION_CODES).alias("violation"))


@query("f2_strings", """SELECT p_partkey, replace(p_name, ' ', '_') AS replaced, ends_with(p_name, 'ring') AS ends, lower(p_type) AS low, regexp_full_match(CAST(p_size AS VARCHAR), '[0-9]+') AS digits,
  regexp_extract('/video/' || p_name || '.avi', '([^/]+)\\.[^.]*$', 1) AS base, printf('%04d', p_size) AS padded FROM part""")  # fmt: skip
def f2(spark, d):
    p = src.table(spark, d, "part")
    path = F.concat(F.lit("/video/"), "p_name", F.lit(".avi"))
    return p.select(
        "p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("replaced"), F.endswith("p_name", F.lit("ring")).alias("ends"), F.lower("p_type").alias("low"),
        F.col("p_size").cast("string").rlike("^[0-9]+$").alias("digits"), F.regexp_extract(path, r"([^/]+)\.[^.]*$", 1).alias("base"), F.format_string("%04d", "p_size").alias("padded"),
    )


@query("f3_tokenize", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(p_name, '[ #]'), lambda t: t <> ''), '|') AS parts, len(list_filter(string_split_regex(p_name, '[ #]'), lambda t: t <> '')) AS n FROM part")
def f3(spark, d):
    t = text.tokens(F.col("p_name"), " #")
    return src.table(spark, d, "part").select("p_partkey", F.array_join(t, "|").alias("parts"), F.size(t).cast("long").alias("n"))


@query("f4_pattern", "SELECT p_partkey, regexp_full_match(upper(substr(p_brand, 1, 5)) || p_size, '[A-Z][A-Z].[A-Z][A-Z][0-9][0-9]') AS matches, substr(p_brand, 1, 2) || substr(p_brand, 4) AS kept FROM part")
def f4(spark, d):
    regex, skips = text.compile_pattern("@@?@@##")
    name = F.concat(F.upper(F.substring("p_brand", 1, 5)), F.col("p_size").cast("string"))
    return src.table(spark, d, "part").select("p_partkey", name.rlike(f"^{regex}$").alias("matches"), text.drop_places(F.col("p_brand"), skips).alias("kept"))


@query("f5_times", "SELECT det_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CAST(frame_idx AS VARCHAR) AS frame, lpad(CAST(v * 37 // 3600 AS VARCHAR), 2, '0') || lpad(CAST(v * 37 // 60 % 60 AS VARCHAR), 2, '0') || lpad(CAST(v * 37 % 60 AS VARCHAR), 2, '0') AS clock FROM det", "det")
def f5(spark, d):
    return src.detections(spark, d).select("det_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.col("frame_idx").cast("string").alias("frame"), text.hhmmss(F.col("v") * 37).alias("clock"))


@query("f6_density_level", "SELECT det_id, CASE WHEN occ < 25 THEN 'Free' WHEN occ < 65 THEN 'Uncrowded' WHEN occ < 80 THEN 'Crowded' ELSE 'Too crowded' END AS level FROM det", "det")
def f6(spark, d):
    return src.detections(spark, d).select("det_id", text.density_level(F.col("occ")).alias("level"))


@query("f7_learning_rate", "SELECT det_id, round(0.01::DOUBLE * exp(-((occ - 25) / 55.0::DOUBLE) * ((occ - 25) / 55.0::DOUBLE) / 2) / sqrt(2 * pi()), 8) AS rate FROM det", "det")
def f7(spark, d):
    return src.detections(spark, d).select("det_id", F.round(text.learning_rate(F.col("occ"), 25.0, 80.0, 0.01), 8).alias("rate"))


@query("f8_line_side", """SELECT det_id, 600 * (cy - 30) - 90 * (cx - 100) AS side, 600 * (y - 30) - 90 * (x - 100) > 0 AND 600 * (y + h - 30) - 90 * (x + w - 100) < 0
  OR 600 * (y - 30) - 90 * (x - 100) < 0 AND 600 * (y + h - 30) - 90 * (x + w - 100) > 0 AS changes FROM det""", "det")  # fmt: skip
def f8(spark, d):
    c = F.col
    line = [F.lit(v) for v in (100, 30, 700, 120)]
    a, b = geo.side(c("x"), c("y"), *line), geo.side(c("x") + c("w"), c("y") + c("h"), *line)
    return src.detections(spark, d).select("det_id", geo.side(c("cx"), c("cy"), *line).alias("side"), geo.sign_change(a, b).alias("changes"))


OUT_LINE, IN_LINE = (100.0, 30.0, 700.0, 120.0), (0.0, 200.0, 1000.0, 90.0)


def _meet_sql(line: tuple, name: str) -> str:
    x1, y1, x2, y2 = (f"{v}::DOUBLE" for v in line)
    return f"({x2} - {x1}) * (cy - fy) - ({y2} - {y1}) * (cx - fx) AS {name}c, (fx - {x1}) * (cy - fy) - (fy - {y1}) * (cx - fx) AS {name}1, (fx - {x1}) * ({y2} - {y1}) - (fy - {y1}) * ({x2} - {x1}) AS {name}2"


@query("f9_line_rules", f"""WITH p AS (SELECT det_id, frame_idx, camera_id, track_id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy FROM det),
  t AS (SELECT det_id, cx, cy, first(cx) OVER o AS fx, first(cy) OVER o AS fy, count(*) OVER o AS n, cx - lag(cx) OVER q AS ex, cy - lag(cy) OVER q AS ey, 0.5::DOUBLE * atan2(2 * covar_pop(cx, cy) OVER o, var_pop(cx) OVER o - var_pop(cy) OVER o) AS a
    FROM p WINDOW o AS (PARTITION BY camera_id, track_id ORDER BY frame_idx ROWS 10 PRECEDING), q AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
  m AS (SELECT *, {_meet_sql(OUT_LINE, "o")}, {_meet_sql(IN_LINE, "i")} FROM t WHERE n >= 3),
  r AS (SELECT *, abs(oc) >= 0.01 AND o1 / oc BETWEEN 0 AND 1 AND o2 / oc BETWEEN 0 AND 1 AS crossed, abs(ic) >= 0.01 AND i1 / ic BETWEEN 0 AND 1 AND i2 / ic <= 0 AS came FROM m)
  SELECT det_id, crossed AS single_rule, crossed AND (CASE WHEN cos(a) * ex + sin(a) * ey < -1e-9 THEN -1 ELSE 1 END) * sin(a) < -1e-9 AS direction_rule, crossed AND came AS double_rule FROM r""", "det")  # fmt: skip
def f9(spark, d):
    """Rules on a track's last eleven points, three at least: it crosses a line; upwards, by its fitted direction; coming through a second line."""
    det = src.detections(spark, d).withColumns({"cx": F.col("cx").cast("double"), "cy": F.col("cy").cast("double")})
    own, last = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(-10, 0), Window.partitionBy(*TRACK).orderBy("frame_idx")
    det = det.withColumns({"_a": fit_angle("cx", "cy", own), "ex": F.col("cx") - F.lag("cx").over(last), "ey": F.col("cy") - F.lag("cy").over(last)})
    t = op.trace(det, 10, TRACK, ["frame_idx"]).where("n_points >= 3")
    ends = [F.col(c) for c in ("first_x", "first_y", "last_x", "last_y")]
    lines = [[F.lit(v) for v in line] for line in (OUT_LINE, IN_LINE)]
    crossed = geo.intersects(*lines[0], *ends)
    _, dy = geo.turned(F.cos("_a"), F.sin("_a"), F.col("ex"), F.col("ey"))
    return t.select("det_id", crossed.alias("single_rule"), (crossed & (dy < -1e-9)).alias("direction_rule"), geo.double_line(*ends, *lines).alias("double_rule"))


@query("f10_boxes", """SELECT det_id, least(x, 100) AS ux, greatest(x + w, 400) - least(x, 100) AS uw, greatest(0, least(x + w, 400) - greatest(x, 100)) * greatest(0, least(y + h, 90) - greatest(y, 10)) AS shared,
  greatest(0, least(x, 900)) AS clip_x, greatest(greatest(0, least(x, 900)), least(x + w, 900)) - greatest(0, least(x, 900)) AS clip_w FROM det""", "det")  # fmt: skip
def f10(spark, d):
    c = F.col
    a = F.struct("x", "y", "w", "h")
    b = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("xywh", (100, 10, 300, 80), strict=True)])
    cx, _, cw, _ = geo.clip_box(c("x"), c("y"), c("w"), c("h"), 900, 500)
    u = geo.union_box(a, b)
    return src.detections(spark, d).select("det_id", u["x"].alias("ux"), u["w"].alias("uw"), geo.intersection_area(a, b).alias("shared"), cx.alias("clip_x"), cw.alias("clip_w"))


@query("f11_vectors", "SELECT det_id, round(sqrt(CAST((cx - 300) * (cx - 300) + (cy - 100) * (cy - 100) AS DOUBLE)), 6) AS distance, round(degrees(atan2(CAST(cy - 100 AS DOUBLE), CAST(cx - 300 AS DOUBLE))), 6) AS angle, w * 3 + h * 4 AS dot FROM det", "det")
def f11(spark, d):
    dx, dy = F.col("cx") - 300, F.col("cy") - 100
    return src.detections(spark, d).select("det_id", F.round(F.hypot(dx, dy), 6).alias("distance"), F.round(geo.angle(dx, dy), 6).alias("angle"), (F.col("w") * 3 + F.col("h") * 4).alias("dot"))


@query("f10_box_sizes", """SELECT det_id, greatest(x + w, 400) - least(x, 100) + 1 AS union_w, greatest(y + h, 90) - least(y, 10) + 1 AS union_h, least(x + w, 400) - greatest(x, 100) + 1 AS shared_w, least(y + h, 90) - greatest(y, 10) + 1 AS shared_h,
  greatest(0, least(x - 7, 900)) AS wide_x, greatest(greatest(0, least(x - 7, 900)), least(x + w + 7, 900)) - greatest(0, least(x - 7, 900)) AS wide_w,
  greatest(0, least(x - CAST(trunc((sw - w) / 2.0::DOUBLE) AS BIGINT), 900)) AS big_x, greatest(greatest(0, least(x - CAST(trunc((sw - w) / 2.0::DOUBLE) AS BIGINT), 900)), least(x - CAST(trunc((sw - w) / 2.0::DOUBLE) AS BIGINT) + sw, 900)) - greatest(0, least(x - CAST(trunc((sw - w) / 2.0::DOUBLE) AS BIGINT), 900)) AS big_w
  FROM (SELECT *, CAST(trunc(w * 1.5::DOUBLE) AS BIGINT) AS sw FROM det)""", "det")  # fmt: skip
def f10_sizes(spark, d):
    """Inclusive sizes, and boxes expanded by 7 and enlarged by half."""
    own = [F.col(c) for c in "xywh"]
    b = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("xywh", (100, 10, 300, 80), strict=True)])
    wide, big = geo.expanded_box(*own, 7, 5, 900, 500), geo.scaled_box(*own, 1.5, 900, 500)
    sizes = geo.inclusive_sizes(F.struct("x", "y", "w", "h"), b)
    return src.detections(spark, d).select("det_id", sizes.alias("s"), wide[0].alias("wide_x"), wide[2].alias("wide_w"), big[0].alias("big_x"), big[2].alias("big_w")).select("det_id", "s.*", "wide_x", "wide_w", "big_x", "big_w")


@query("f11_turns", """SELECT det_id, round(cx * cos(0.3::DOUBLE) - cy * sin(0.3::DOUBLE), 5) AS rx, round(cx * sin(0.3::DOUBLE) + cy * cos(0.3::DOUBLE), 5) AS ry,
  round(((cx - 300) * (cx - 700) + (cy - 100) * (cy - 90)) / sqrt(((cx - 300) * (cx - 300) + (cy - 100) * (cy - 100)) * ((cx - 700) * (cx - 700) + (cy - 90) * (cy - 90)) + 1e-10), 6) + 0.0 AS cosine, cx > 200 AND cx < 700 AND cy > 20 AND cy < 90 AS inside FROM det""", "det")  # fmt: skip
def f11_turns(spark, d):
    """Points turned by 0.3 radians, the cosine at them between two others, and whether they lie inside a box."""
    x, y = F.col("cx").cast("double"), F.col("cy").cast("double")
    rx, ry = geo.rotated(x, y, F.lit(0.3))
    cosine = geo.cosine_at(x, y, F.lit(300.0), F.lit(100.0), F.lit(700.0), F.lit(90.0))
    return src.detections(spark, d).select("det_id", F.round(rx, 5).alias("rx"), F.round(ry, 5).alias("ry"), (F.round(cosine, 6) + 0.0).alias("cosine"), geo.strictly_inside(x, y, 200, 20, 500, 70).alias("inside"))


@query("f12_meetings", """WITH p AS (SELECT det_id, CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(cx AS DOUBLE) AS x2, CAST(cy + det_id % 7 AS DOUBLE) AS y2, ((cx - 100) * 800 + (cy - 10) * 50) / 642500.0::DOUBLE AS u FROM det),
  s AS (SELECT *, CASE WHEN x1 = x2 THEN 1e-11 ELSE (y2 - y1) / (x2 - x1) END AS a, 50 / 800.0::DOUBLE AS b FROM p),
  m AS (SELECT *, CASE WHEN a = b THEN -1 WHEN x1 = x2 THEN x1 ELSE (60 - b * 900 - (y1 - a * x1)) / (a - b) END AS mx FROM s)
  SELECT det_id, round(100 + u * 800, 4) AS foot_x, round(10 + u * 50, 4) AS foot_y, round(mx, 2) + 0.0 AS meet_x, round(CASE WHEN a = b THEN -1 WHEN x1 = x2 THEN 60 + b * (x1 - 900) ELSE a * mx + (y1 - a * x1) END, 2) + 0.0 AS meet_y,
    x1 + round(12 * cos(atan2(x2 - x1, y2 - y1))) + 0.0 AS side_x, y1 + round(-12 * sin(atan2(x2 - x1, y2 - y1))) + 0.0 AS side_y FROM m""", "det")  # fmt: skip
def f12_meetings(spark, d):
    """The foot of a point on a line, where each box's diagonal meets that line, and the diagonal moved aside by 12."""
    line = [F.lit(v) for v in (100.0, 10.0, 900.0, 60.0)]
    fx, fy = geo.closest_point(F.col("cx").cast("double"), F.col("cy").cast("double"), *line)
    own = [c.cast("double") for c in (F.col("x"), F.col("y"), F.col("cx"), F.col("cy") + F.col("det_id") % 7)]
    mx, my = geo.meeting_point(*own, *line)
    sx, sy, _, _ = geo.parallel_line(*own, 12.0)
    return src.detections(spark, d).select(
        "det_id", F.round(fx, 4).alias("foot_x"), F.round(fy, 4).alias("foot_y"), (F.round(mx, 2) + 0.0).alias("meet_x"), (F.round(my, 2) + 0.0).alias("meet_y"), (sx + 0.0).alias("side_x"), (sy + 0.0).alias("side_y")
    )


@query("f12_segment", "SELECT det_id, round(10 + (50 / 800.0::DOUBLE) * (cx - 100), 6) AS y_at, cy > 10 + (50 / 800.0::DOUBLE) * (cx - 100) AS below, (cx + 100) / 2.0::DOUBLE AS mid_x FROM det", "det")
def f12(spark, d):
    y = geo.y_at(F.col("cx"), F.lit(100), F.lit(10), F.lit(900), F.lit(60))
    return src.detections(spark, d).select("det_id", F.round(y, 6).alias("y_at"), (F.col("cy") > y).alias("below"), ((F.col("cx") + 100) / 2).alias("mid_x"))


@query("f13_homography", "SELECT det_id, round((1.5::DOUBLE * cx + 0.25::DOUBLE * cy + 10) / (0.001::DOUBLE * cx + 0.002::DOUBLE * cy + 1), 4) AS px, round((0.5::DOUBLE * cx + 2 * cy - 5) / (0.001::DOUBLE * cx + 0.002::DOUBLE * cy + 1), 4) AS py FROM det", "det")
def f13(spark, d):
    px, py = geo.homography(F.col("cx"), F.col("cy"), [1.5, 0.25, 10.0, 0.5, 2.0, -5.0, 0.001, 0.002, 1.0])
    return src.detections(spark, d).select("det_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query("f14_rounding", "SELECT det_id, CASE WHEN w % 2 = 0 THEN w + 1 ELSE w END AS odd, CASE WHEN w % 2 = 1 THEN w + 1 ELSE w END AS even, least(greatest(v, 20), 120) AS clipped, (v + 15) // 16 * 16 AS multiple FROM det", "det")
def f14(spark, d):
    w, v = F.col("w"), F.col("v")
    return src.detections(spark, d).select(
        "det_id", F.when(w % 2 == 0, w + 1).otherwise(w).alias("odd"), F.when(w % 2 == 1, w + 1).otherwise(w).alias("even"),
        F.least(F.greatest(v, F.lit(20)), F.lit(120)).alias("clipped"), F.expr("(v + 15) div 16 * 16").alias("multiple"),
    )


@query("f14_extremes", "SELECT id, list_position(q, list_max(q)) - 1 AS largest, list_position(q, list_min(q)) - 1 AS smallest FROM smp", "smp")
def f14_extremes(spark, d):
    """Places, from 0, of a vector's first largest and first smallest component."""
    place = lambda of: (F.array_position("q", of("q")) - 1).cast("long")
    return src.samples(spark, d).select("id", place(F.array_max).alias("largest"), place(F.array_min).alias("smallest"))


@query("f15_vector_ops", """SELECT id, CAST(list_sum(list_transform(list_zip(q, list_reverse(q)), lambda p: p[1] * p[2])) AS BIGINT) AS dot, CAST(list_sum(list_transform(q, lambda z: z * z)) AS BIGINT) AS norm2,
  CAST(list_sum(list_transform(list_zip(q, list_reverse(q)), lambda p: abs(p[1] - p[2]))) AS BIGINT) AS l1 FROM smp""", "smp")  # fmt: skip
def f15(spark, d):
    q, r = F.col("q"), F.reverse("q")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return src.samples(spark, d).select(
        "id", total(F.zip_with(q, r, lambda a, b: a * b)).alias("dot"), total(F.transform(q, lambda a: a * a)).alias("norm2"), total(F.zip_with(q, r, lambda a, b: F.abs(a - b))).alias("l1")
    )


@query("f16_tracker_cost", """WITH p AS (SELECT det_id, CAST(cx - lag(cx) OVER o AS DOUBLE) AS dx, CAST(cy - lag(cy) OVER o AS DOUBLE) AS dy, CAST(lag(cx) OVER o - lag(cx, 2) OVER o AS DOUBLE) AS vx, CAST(lag(cy) OVER o - lag(cy, 2) OVER o AS DOUBLE) AS vy FROM det WINDOW o AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
  q AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, sqrt(vx * vx + vy * vy) AS s FROM p WHERE dx IS NOT NULL),
  r AS (SELECT *, CASE WHEN d = 0 OR s = 0 THEN NULL ELSE (dx * vx + dy * vy) / (d * s) END AS c FROM q)
  SELECT det_id, round(CASE WHEN d > 400 THEN 1e6 WHEN vx IS NULL THEN d WHEN c IS NULL THEN -1 WHEN abs(c) < 0 OR d > 200 AND c < -0.3 THEN 1e6 ELSE d * exp((1 - abs(c)) / 2) END, 4) AS cost FROM r""", "det")  # fmt: skip
def f16(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy(*TRACK).orderBy("frame_idx")
    x, y = F.col("cx").cast("double"), F.col("cy").cast("double")
    step = src.detections(spark, d).select(
        "det_id", (x - F.lag(x).over(o)).alias("dx"), (y - F.lag(y).over(o)).alias("dy"), (F.lag(x).over(o) - F.lag(x, 2).over(o)).alias("vx"), (F.lag(y).over(o) - F.lag(y, 2).over(o)).alias("vy")
    )
    cost = geo.track_cost(F.col("dx"), F.col("dy"), F.col("vx"), F.col("vy"), F.col("vx").isNotNull(), 400.0, 0.0)
    return step.where("dx is not null").select("det_id", F.round(F.when(F.isnan(cost), F.lit(-1.0)).otherwise(cost), 4).alias("cost"))


@query("f17_light_on", "SELECT det_id, v > 90 AS is_on FROM det", "det")
def f17(spark, d):
    return src.detections(spark, d).select("det_id", (F.col("v").cast("long") > 90).alias("is_on"))


@query("f18_box_text", "SELECT det_id, x || ',' || y || ',' || w || ',' || h AS box, x + y + w + h AS total FROM det", "det")
def f18(spark, d):
    box = text.box_text(*map(F.col, "xywh"))
    back = text.box_of_text(box)
    return src.detections(spark, d).select("det_id", box.alias("box"), (back["x"] + back["y"] + back["w"] + back["h"]).alias("total"))


@query("f19_pair_decision", "SELECT id, class, CASE WHEN score > 0 THEN class ELSE label END AS winner, abs(score) AS strength FROM scr", "scr")
def f19(spark, d):
    return src.scores(spark, d).select("id", "class", F.when(F.col("score") > 0, F.col("class")).otherwise(F.col("label")).alias("winner"), F.abs("score").alias("strength"))
