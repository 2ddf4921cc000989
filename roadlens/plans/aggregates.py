"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kernels
from ..operators import aggregates as op
from ..operators import ml
from ..operators.cluster import cluster_groups
from ..operators.filters import median_high, median_low
from ..operators.joins import near
from ..sources import adapters as src
from .base import query
from .filters import BOXES_ON_PROFILE, boxes_on_profile
from .joins import CONTAINED, FRAME, NEAR, SUPPORT, dot, support
from .windows import CROSSED, RUNS, TRACK, crossings

C = F.col


@query("a1_count_crossings", f"WITH {CROSSED} SELECT camera_id, vehicle, count(*) AS n FROM fe GROUP BY 1, 2", "det")
def a1(spark, d):
    return crossings(spark, d).groupBy("camera_id", "vehicle").agg(F.count("*").alias("n"))


CLUSTERS = f"""{NEAR}, sy AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
  wk AS (SELECT node, min(label) AS cluster FROM (WITH RECURSIVE r(node, label) AS (SELECT det_id, det_id FROM det UNION SELECT sy.b, r.label FROM r JOIN sy ON sy.a = r.node WHERE r.label < sy.b) SELECT * FROM r) GROUP BY 1)"""


def clusters(spark, d):
    return cluster_groups(src.detections(spark, d).select(*FRAME, "det_id", "cx", "cy"), FRAME, near(160, 60))


@query("a2_cluster", f"WITH {CLUSTERS} SELECT node, cluster FROM wk", "det")
def a2(spark, d):
    return clusters(spark, d)


@query("a3_cluster_mean", f"""WITH {CLUSTERS} SELECT cluster, round(avg(cx), 4) AS mx, round(avg(cy), 4) AS my, count(*) AS n, CASE WHEN count(*) > 1 AND max(cx) - min(cx) > 20 THEN 'car' ELSE 'bike' END AS kind
  FROM wk JOIN det ON det_id = node GROUP BY 1""", "det")  # fmt: skip
def a3(spark, d):
    own = clusters(spark, d).join(src.detections(spark, d).select(C("det_id").alias("node"), "cx", "cy"), "node")
    wide = (F.count("*") > 1) & (F.max("cx") - F.min("cx") > 20)
    return own.groupBy("cluster").agg(F.round(F.avg("cx"), 4).alias("mx"), F.round(F.avg("cy"), 4).alias("my"), F.count("*").alias("n"), F.when(wide, "car").otherwise("bike").alias("kind"))


@query("a4_group_boxes", f"""WITH {CLUSTERS} SELECT cluster, count(*) AS n, max_by(det_id, v * 1000000 - det_id) AS best, CAST(trunc(sum(x * v) / greatest(sum(v), 1)) AS BIGINT) AS ax, CAST(trunc(sum(w * v) / greatest(sum(v), 1)) AS BIGINT) AS aw
  FROM wk JOIN det ON det_id = node GROUP BY 1 HAVING count(*) > 1""", "det")  # fmt: skip
def a4(spark, d):
    """Best box and score-weighted mean box of each cluster of more than one."""
    own = clusters(spark, d).join(src.detections(spark, d).withColumnRenamed("det_id", "node"), "node")
    mean = lambda x: (F.sum(C(x) * C("v")) / F.greatest(F.sum("v"), F.lit(1))).cast("long")
    return own.groupBy("cluster").agg(F.count("*").alias("n"), F.max_by("node", F.struct("v", -C("node"))).alias("best"), mean("x").alias("ax"), mean("w").alias("aw")).where("n > 1")


@query("a4_grouped_boxes", f"""WITH {CLUSTERS}, cm AS (SELECT camera_id, frame_id, cluster, node, x, y, w, h, v FROM wk JOIN det ON det_id = node),
  bx AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY v DESC, node) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM cm),
  gm AS (SELECT 'max' AS mode, camera_id, frame_id, cluster AS gid, x, y, w, h, n, v AS score FROM bx WHERE k = 1 AND n > 1),
  ga AS (SELECT 'avg' AS mode, camera_id, frame_id, cluster AS gid, CAST(round_even(sum(x * v) / greatest(sum(v), 1), 0) AS BIGINT) AS x, CAST(round_even(sum(y * v) / greatest(sum(v), 1), 0) AS BIGINT) AS y, CAST(round_even(sum(w * v) / greatest(sum(v), 1), 0) AS BIGINT) AS w,
    CAST(round_even(sum(h * v) / greatest(sum(v), 1), 0) AS BIGINT) AS h, count(*) AS n, CAST(sum(v) AS BIGINT) AS score FROM cm GROUP BY camera_id, frame_id, cluster HAVING count(*) > 1),
  gr AS (SELECT * FROM gm UNION ALL SELECT * FROM ga)
  {CONTAINED.replace("a.gid <> b.gid", "a.mode = b.mode AND a.gid <> b.gid")}""", "det")  # fmt: skip
def a4_grouped(spark, d):
    """Groups of two boxes or more by both modes, without those that a stronger one holds."""
    det = src.detections(spark, d).select(*FRAME, C("det_id").alias("node"), "x", "y", "w", "h", "v")
    members = det.join(clusters(spark, d), "node")
    both = [op.group_boxes(members, FRAME, mode, 1).withColumn("mode", F.lit(mode)) for mode in ("max", "avg")]
    return both[0].unionByName(both[1])


@query("a5_group_boxes_unweighted", f"WITH {CLUSTERS} SELECT cluster, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(w), 4) AS w, max(v) AS weight FROM wk JOIN det ON det_id = node GROUP BY 1", "det")
def a5(spark, d):
    own = clusters(spark, d).join(src.detections(spark, d).withColumnRenamed("det_id", "node"), "node")
    return own.groupBy("cluster").agg(*[F.round(F.avg(c), 4).alias(c) for c in "xyw"], F.max("v").alias("weight"))


@query("a6_largest_cluster", f"""WITH {CLUSTERS}, s AS (SELECT d.camera_id, d.frame_id, d.det_id, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM wk JOIN det d ON det_id = node),
  t AS (SELECT *, max(n) OVER (PARTITION BY camera_id, frame_id) AS most, min(cluster * 1000 + 999 - least(n, 999)) OVER (PARTITION BY camera_id, frame_id) AS k, first(cluster) OVER (PARTITION BY camera_id, frame_id ORDER BY n DESC, cluster) AS top FROM s)
  SELECT det_id, most = 1 OR cluster = top AS kept FROM t""", "det")  # fmt: skip
def a6(spark, d):
    own = clusters(spark, d).join(src.detections(spark, d).select(*FRAME, C("det_id").alias("node")), "node")
    own = own.withColumn("n", F.count("*").over(Window.partitionBy("cluster")))
    top = own.groupBy(*FRAME).agg(F.max(F.struct("n", (-C("cluster")).alias("c"))).alias("t"))
    kept = (C("t.n") == 1) | (C("cluster") == -C("t.c"))
    return own.join(top, FRAME).select(C("node").alias("det_id"), kept.alias("kept"))


@query("a7_largest_box", "SELECT camera_id, frame_id, max_by(det_id, area * 1000000000 - det_id) AS det_id FROM det GROUP BY 1, 2", "det")
def a7(spark, d):
    return src.detections(spark, d).groupBy(*FRAME).agg(F.max_by("det_id", F.struct("area", -C("det_id"))).alias("det_id"))


VOTES = """vo AS (SELECT plate_id, pos, letter, CAST(sum(s) AS BIGINT) AS total, count(*) AS n FROM (
  SELECT plate_id, pos, letter, score - 45 AS s FROM let WHERE score >= 45 UNION ALL SELECT plate_id, pos, '~', 60 - score FROM let WHERE score >= 45 AND score < 60) GROUP BY 1, 2, 3)"""  # fmt: skip


#: Score from which a letter votes, and below which it also votes for leaving the place out.
LEAST, SKIP = 45, 60


def votes(spark, d):
    return op.letter_votes(src.letters(spark, d), LEAST, SKIP)


@query("a8_letter_votes", f"WITH {VOTES} SELECT plate_id, pos, letter, total, n FROM vo", "let")
def a8(spark, d):
    return votes(spark, d)


@query("a9_medians", """SELECT camera_id, frame_id, list_sort(list(w))[(len(list(w)) - 1) // 2 + 1] AS low, list_sort(list(w))[len(list(w)) // 2 + 1] AS high FROM det GROUP BY 1, 2""", "det")
def a9(spark, d):
    return src.detections(spark, d).groupBy(*FRAME).agg(median_low("w").alias("low"), median_high("w").alias("high"))


@query("a9_nth_large_groups", "SELECT camera_id, w FROM (SELECT camera_id, w, row_number() OVER (PARTITION BY camera_id ORDER BY w) - 1 AS r, count(*) OVER (PARTITION BY camera_id) AS n FROM det) WHERE r = (n - 1) // 2", "det")
def a9b(spark, d):
    return op.nth(src.detections(spark, d), "w", ["camera_id"], F.floor((C("_n") - 1) / 2))


@query("a10_median_where", """SELECT camera_id, frame_id, greatest(20, coalesce(list_sort(list(w) FILTER (w / h BETWEEN 0.5 AND 1.0))[len(list(w) FILTER (w / h BETWEEN 0.5 AND 1.0)) // 2 + 1], list_sort(list(w))[len(list(w)) // 2 + 1])) AS width FROM det GROUP BY 1, 2""", "det")
def a10(spark, d):
    own = src.detections(spark, d).withColumn("_w", F.when((C("w") / C("h")).between(0.5, 1.0), C("w")))
    some = F.when(F.count("_w") > 0, F.element_at(F.sort_array(F.collect_list("_w")), (F.floor(F.count("_w") / 2) + 1).cast("int")))
    return own.groupBy(*FRAME).agg(F.greatest(F.lit(20), F.coalesce(some, median_high("w"))).alias("width"))


@query("a11_robust_outliers", """WITH m AS (SELECT camera_id, frame_id, list_sort(list(occ))[len(list(occ)) // 2 + 1] AS med FROM det GROUP BY 1, 2), s AS (SELECT camera_id, frame_id, count(*) AS n, sum(occ) AS s, sum(occ * occ) AS q FROM det JOIN m USING (camera_id, frame_id) WHERE abs(occ - med) <= 15 GROUP BY 1, 2)
  SELECT det_id, CASE WHEN abs(n * occ - s) > 70 * n THEN 'hard' WHEN abs(n * occ - s) > 30 * n AND (n * occ - s) * (n * occ - s) > 9 * (n * q - s * s) THEN 'soft' ELSE 'ok' END AS flag FROM det JOIN s USING (camera_id, frame_id)""", "det")  # fmt: skip
def a11(spark, d):
    det = src.detections(spark, d)
    med = det.groupBy(*FRAME).agg(median_high("occ").alias("med"))
    kept = det.join(med, FRAME).where(F.abs(C("occ") - C("med")) <= 15).groupBy(*FRAME)
    return op.outliers(det.join(kept.agg(F.count(F.lit(1)).alias("n"), F.sum("occ").alias("s"), F.sum(C("occ") * C("occ")).alias("q")), FRAME), "occ").select("det_id", "flag")


CONFUSION = """cf AS (SELECT class, {0}count(*) FILTER (score > 0 AND label = class) AS tp, count(*) FILTER (score <= 0 AND label <> class) AS tn, count(*) FILTER (score > 0 AND label <> class) AS fp, count(*) FILTER (score <= 0 AND label = class) AS fn FROM scr GROUP BY ALL),
  ra AS (SELECT *, round((fp + fn) / (tp + tn + fp + fn), 6) AS error, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM cf)"""  # fmt: skip


def targets(spark, d):
    return src.scores(spark, d).withColumn("target", F.when(C("label") == C("class"), 1).otherwise(-1))


@query("a12_confusion", f"WITH {CONFUSION.format('')} SELECT * FROM ra", "scr")
def a12(spark, d):
    t = targets(spark, d)
    return op.rates(t.groupBy("class").agg(*op.confusion(t)))


@query("a13_cv_summary", f"WITH {CONFUSION.format('id % 5 AS fold, ')} SELECT class, round(avg(error), 5) AS error, round(avg(recall), 5) AS recall FROM ra GROUP BY 1", "scr")
def a13(spark, d):
    t = targets(spark, d)
    per_fold = op.rates(t.groupBy("class", (C("id") % 5).alias("fold")).agg(*op.confusion(t)))
    return per_fold.groupBy("class").agg(F.round(F.avg("error"), 5).alias("error"), F.round(F.avg("recall"), 5).alias("recall"))


@query("a14_extent", "SELECT camera_id, frame_id, min(x) AS lo, max(x + w) AS hi FROM det WHERE abs(cy - 60) <= 100 GROUP BY 1, 2 HAVING count(*) >= 3", "det")
def a14(spark, d):
    """Range of the boxes near the middle line, for groups of three or more."""
    near = src.detections(spark, d).where("abs(cy - 60) <= 100").groupBy(*FRAME)
    return near.agg(F.min("x").alias("lo"), F.max(C("x") + C("w")).alias("hi"), F.count("*").alias("_n")).where("_n >= 3").drop("_n")


@query("a14_guarded_extent", """WITH c AS (SELECT *, x + w / 2.0::DOUBLE AS mx, y + h / 2.0::DOUBLE AS my FROM det), t AS (SELECT *, 20 + 0.01::DOUBLE * mx AS top, 120 + 0.02::DOUBLE * mx AS bottom, count(*) OVER (PARTITION BY camera_id, frame_id) AS n FROM c),
  g AS (SELECT camera_id, frame_id, min(x) FILTER (ok) AS lo, max(x + w) FILTER (ok) AS hi FROM (SELECT *, n >= 3 AND bottom <> top AND abs(my - (top + (bottom - top) / 2)) / ((bottom - top) / 2) <= 0.5 AND h <= 1.5 * (bottom - top) AS ok FROM t) GROUP BY 1, 2)
  SELECT camera_id, frame_id, CASE WHEN wide THEN greatest(lo - 2, 0) ELSE 0 END AS lo, CASE WHEN wide THEN least(hi + 2, 999) ELSE 999 END AS hi FROM (SELECT *, coalesce(hi - lo >= 650, false) AS wide FROM g)""", "det")  # fmt: skip
def a14_guarded(spark, d):
    return op.guarded_extent(src.detections(spark, d), FRAME, 999, 3, lambda x: 20 + 0.01 * x, lambda x: 120 + 0.02 * x)


@query("a15_profile", "SELECT key, CAST(sum(cnt) AS BIGINT) AS total, max_by(bin, cnt * 1000 - bin) AS peak, min_by(bin, cnt * 1000 + bin) AS valley FROM prof GROUP BY 1", "prof")
def a15(spark, d):
    p = src.profile(spark, d).groupBy("key")
    return p.agg(F.sum("cnt").alias("total"), F.max_by("bin", F.struct("cnt", -C("bin"))).alias("peak"), F.min_by("bin", F.struct("cnt", "bin")).alias("valley"))


KERNELS = {
    "linear": kernels.linear(), "poly": kernels.polynomial(2), "rbf": kernels.rbf(0.5), "sigmoid": kernels.sigmoid(),
    # a user's own: histogram intersection
    "shared": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x),
}


def kernel_models(spark, d, vector):
    """class, b and support (alpha, v) of each class: a model of fixed size."""
    own = support(spark, d).select("class", C("alpha").cast("double").alias("alpha"), vector("sq").alias("v"), "sid")
    return own.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("sid", "alpha", "v"))), lambda s: F.struct(s["alpha"].alias("alpha"), s["v"].alias("v"))).alias("support"), F.lit(0.25).alias("b"))


def thousandths(c):
    return F.transform(c, lambda x: x / 1000.0)


@query("a16_score", f"""WITH {SUPPORT}, k AS (SELECT id, class, alpha, list_sum(list_transform(list_zip(q, sq), lambda p: p[1] * p[2])) / 1000000.0::DOUBLE AS dp, list_sum(list_transform(list_zip(q, sq), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 1000000.0::DOUBLE AS dd,
    list_sum(list_transform(list_zip(q, sq), lambda p: least(p[1], p[2]))) / 1000.0::DOUBLE AS mm FROM smp, sup)
  SELECT id, class, round(sum(alpha * dp) - 0.25, 6) AS linear, round(sum(alpha * (dp + 1) * (dp + 1)) - 0.25, 5) AS poly, round(sum(alpha * exp(-0.5::DOUBLE * dd)) - 0.25, 5) AS rbf, round(sum(alpha * tanh(dp)) - 0.25, 5) AS sigmoid,
    round(sum(alpha * mm) - 0.25, 5) AS shared FROM k GROUP BY 1, 2""", "smp")  # fmt: skip
def a16(spark, d):
    """Scores of every kernel against each class's support vectors."""
    rows = src.samples(spark, d).select("id", thousandths("q").alias("features"))
    models = kernel_models(spark, d, thousandths)
    out = None
    for name, kernel in KERNELS.items():
        own = ml.score(rows, models, kernel).select("id", "class", F.round("score", 6 if name == "linear" else 5).alias(name))
        out = own if out is None else out.join(own, ["id", "class"])
    return out


@query("a16_sparse_score", f"""WITH {SUPPORT} SELECT id, class, round(sum(alpha * list_sum(list_transform(list_zip(q, sq), lambda p: CASE WHEN abs(p[1]) > 100 AND abs(p[2]) > 100 THEN p[1] * p[2] ELSE 0 END)) / 1000000.0::DOUBLE) - 0.25, 6) AS score FROM smp, sup GROUP BY 1, 2""", "smp")
def a16_sparse(spark, d):
    """Linear kernel over sparse vectors: components up to a tenth count as zero and are not kept."""
    large = lambda c: kernels.sparse(F.transform(c, lambda x: F.when(F.abs(x) > 100, x / 1000.0).otherwise(0.0)))
    rows = src.samples(spark, d).select("id", large("q").alias("features"))
    return ml.score(rows, kernel_models(spark, d, large), kernels.linear(kernels.sparse_dot)).select("id", "class", F.round("score", 6).alias("score"))


@query("a17_otsu", """WITH c AS (SELECT key, bin, CAST(sum(cnt) OVER w AS BIGINT) AS n0, CAST(sum(cnt * bin) OVER w AS BIGINT) AS s0, CAST(sum(cnt) OVER (PARTITION BY key) AS BIGINT) AS n, CAST(sum(cnt * bin) OVER (PARTITION BY key) AS BIGINT) AS s FROM prof WINDOW w AS (PARTITION BY key ORDER BY bin ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT key, bin, round((s0 * n - s * n0) * (s0 * n - s * n0) / CAST(n0 * (n - n0) AS DOUBLE), 6) AS v FROM c WHERE n > n0), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v DESC, bin) AS k FROM b WHERE v > 0)
  SELECT key, bin AS threshold FROM r WHERE k = 1""", "prof")  # fmt: skip
def a17(spark, d):
    return op.otsu(src.profile(spark, d), "bin", ["key"])


@query("a18_principal_axes", """SELECT camera_id, frame_id, CASE WHEN count(*) <= 1 THEN 1.0::DOUBLE ELSE round(sqrt(count(*) * ((var_pop(cx) + var_pop(cy)) / 2 + sqrt((var_pop(cx) - var_pop(cy)) * (var_pop(cx) - var_pop(cy)) / 4 + covar_pop(cx, cy) * covar_pop(cx, cy)))), 3) END AS major,
  CASE WHEN count(*) <= 1 THEN 0.0::DOUBLE ELSE round(sqrt(count(*) * greatest(0, (var_pop(cx) + var_pop(cy)) / 2 - sqrt((var_pop(cx) - var_pop(cy)) * (var_pop(cx) - var_pop(cy)) / 4 + covar_pop(cx, cy) * covar_pop(cx, cy)))), 3) END AS minor FROM det GROUP BY 1, 2""", "det")
def a18(spark, d):
    return src.detections(spark, d).groupBy(*FRAME).agg(*op.axes())


@query("a19_fit_direction", """WITH s AS (SELECT camera_id, track_id, frame_idx, cx, cy, cx - lag(cx) OVER o AS ex, cy - lag(cy) OVER o AS ey FROM det WINDOW o AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
  g AS (SELECT camera_id, track_id, 0.5::DOUBLE * atan2(2 * covar_pop(cx, cy), var_pop(cx) - var_pop(cy)) AS a, max_by(ex, frame_idx) AS ex, max_by(ey, frame_idx) AS ey FROM s GROUP BY 1, 2 HAVING count(*) >= 3),
  d AS (SELECT *, CASE WHEN cos(a) * ex + sin(a) * ey < -1e-9 THEN -1 ELSE 1 END AS sign FROM g)
  SELECT camera_id, track_id, round(sign * cos(a), 4) + 0.0 AS dx, round(sign * sin(a), 4) + 0.0 AS dy FROM d""", "det")  # fmt: skip
def a19(spark, d):
    """Total least squares direction of each track, turned to agree with its last step."""
    o = Window.partitionBy(*TRACK).orderBy("frame_idx")
    steps = src.detections(spark, d).withColumns({"ex": C("cx") - F.lag("cx").over(o), "ey": C("cy") - F.lag("cy").over(o)})
    own = steps.groupBy(*TRACK).agg(op.fit_angle("cx", "cy").alias("a"), F.max_by("ex", "frame_idx").alias("ex"), F.max_by("ey", "frame_idx").alias("ey"), F.count("*").alias("_n"))
    dx, dy = geo.turned(F.cos("a"), F.sin("a"), C("ex"), C("ey"))
    return own.where("_n >= 3").select(*TRACK, (F.round(dx, 4) + 0.0).alias("dx"), (F.round(dy, 4) + 0.0).alias("dy"))


@query("a20_occupancy", "SELECT camera_id, frame_id, round(100.0::DOUBLE * sum(area) / 450000, 4) AS percent FROM det GROUP BY 1, 2", "det")
def a20(spark, d):
    return src.detections(spark, d).groupBy(*FRAME).agg(F.round(100.0 * F.sum("area") / 450000, 4).alias("percent"))


@query("a21_majority_keep", "SELECT camera_id, x // 50 AS place, avg(CASE WHEN occ > 50 THEN 1 ELSE 0 END) > 0.5 AS kept FROM det WHERE x >= 0 GROUP BY 1, 2", "det")
def a21(spark, d):
    det = src.detections(spark, d).where("x >= 0")
    return det.groupBy("camera_id", F.expr("x div 50").alias("place")).agg((F.avg((C("occ") > 50).cast("int")) > 0.5).alias("kept"))


@query("a21_score_keep", "SELECT det_id FROM (SELECT det_id, v, max(v) OVER (PARTITION BY camera_id, frame_id) AS most FROM det) WHERE v > CAST(trunc(most * 0.49::DOUBLE) AS BIGINT)", "det")
def a21_score(spark, d):
    """Boxes that score above 0.49 of their frame's best, that limit rounded down."""
    most = F.max("v").over(Window.partitionBy(*FRAME))
    return src.detections(spark, d).withColumn("_most", most).where(C("v") > (C("_most") * 0.49).cast("long")).select("det_id")


@query("a22_repeat_detections", f"WITH {CLUSTERS} SELECT cluster, count(*) AS n, list_sort(list(w))[len(list(w)) // 2 + 1] AS width FROM wk JOIN det ON det_id = node GROUP BY 1 HAVING count(*) >= 3", "det")
def a22(spark, d):
    own = clusters(spark, d).join(src.detections(spark, d).select(C("det_id").alias("node"), "w"), "node")
    return own.groupBy("cluster").agg(F.count("*").alias("n"), median_high("w").alias("width")).where("n >= 3")


@query("a23_merge_overlaps", """WITH r AS (SELECT camera_id, frame_id, det_id, x, x + w AS rt, max(x + w) OVER (PARTITION BY camera_id, frame_id ORDER BY x, x + w, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM det),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR x >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, frame_id ORDER BY x, rt, det_id ROWS UNBOUNDED PRECEDING) AS g FROM r)
  SELECT camera_id, frame_id, min(x) AS x, max(rt) AS "right", count(*) AS n FROM g GROUP BY 1, 2, g""", "det")  # fmt: skip
def a23(spark, d):
    return op.merge_overlaps(src.detections(spark, d).select(*FRAME, "det_id", "x", (C("x") + C("w")).alias("right")), FRAME)


@query("a24_merge_adjacent", """WITH RECURSIVE b AS (SELECT camera_id, frame_id, x, y, w, h, row_number() OVER (PARTITION BY camera_id, frame_id ORDER BY x, y, w, h) AS k FROM det),
  md AS (SELECT camera_id, frame_id, list_sort(list(w))[len(list(w)) // 2 + 1] AS m FROM det GROUP BY 1, 2),
  r AS (SELECT b.camera_id, b.frame_id, m, k, 1 AS g, x, y, w, h FROM b JOIN md USING (camera_id, frame_id) WHERE k = 1 UNION ALL
    SELECT camera_id, frame_id, m, k, CASE WHEN fits THEN g ELSE g + 1 END, CASE WHEN fits THEN ux ELSE x END, CASE WHEN fits THEN uy ELSE y END, CASE WHEN fits THEN uw ELSE w END, CASE WHEN fits THEN uh ELSE h END FROM (
      SELECT *, (abs(uw - m) * 13 < abs(w1 - m) * 10 AND abs(uw - m) * 13 < abs(w - m) * 10) OR (iw * 2 > least(w1, w) AND ih * 2 > least(h1, h)) OR ((least(w1, w) - iw) * 2 < greatest(w1, w) AND (least(h1, h) - ih) * 2 < greatest(h1, h)) AS fits FROM (
        SELECT *, CASE WHEN jw > 0 AND jh > 0 THEN jw ELSE 0 END AS iw, CASE WHEN jw > 0 AND jh > 0 THEN jh ELSE 0 END AS ih FROM (
          SELECT r.camera_id, r.frame_id, r.m, b.k, r.g, b.x, b.y, b.w, b.h, r.w AS w1, r.h AS h1, least(r.x, b.x) AS ux, least(r.y, b.y) AS uy, greatest(r.x + r.w, b.x + b.w) - least(r.x, b.x) AS uw, greatest(r.y + r.h, b.y + b.h) - least(r.y, b.y) AS uh,
            least(r.x + r.w, b.x + b.w) - greatest(r.x, b.x) AS jw, least(r.y + r.h, b.y + b.h) - greatest(r.y, b.y) AS jh
          FROM r JOIN b ON b.camera_id = r.camera_id AND b.frame_id = r.frame_id AND b.k = r.k + 1))))
  SELECT camera_id, frame_id, x, y, w, h FROM r QUALIFY row_number() OVER (PARTITION BY camera_id, frame_id, g ORDER BY k DESC) = 1""", "det")  # fmt: skip
def a24(spark, d):
    """Boxes of a frame (eight at most) folded in x order."""
    rows = src.detections(spark, d).groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("x", "y", "w", "h"))).alias("boxes"), median_high("w").alias("m"))
    return rows.select(*FRAME, F.explode(op.merge_adjacent(C("boxes"), C("m"))).alias("b")).select(*FRAME, "b.*")


@query("a25_worst_status", "SELECT track_id, CASE WHEN min(det_id % 5) = 0 THEN 0 ELSE max(det_id % 5) END AS status FROM det GROUP BY 1", "det")
def a25(spark, d):
    status = C("det_id") % 5
    return src.detections(spark, d).groupBy("track_id").agg(F.when(F.min(status) == 0, F.lit(0).cast("long")).otherwise(F.max(status)).alias("status"))


@query("a26_max_confidence", f"""WITH {VOTES}, b AS (SELECT plate_id, pos, max(total * 1000 + n) AS t, any_value(0) AS z FROM vo WHERE letter <> '~' GROUP BY 1, 2)
  SELECT plate_id, round(avg((t // 1000) / CAST(t % 1000 AS DOUBLE) + 45), 4) AS confidence FROM b GROUP BY 1""", "let")  # fmt: skip
def a26(spark, d):
    best = votes(spark, d).where("letter <> '~'").groupBy("plate_id", "pos").agg(F.max(F.struct("total", "n")).alias("b"))
    return best.groupBy("plate_id").agg(F.round(F.avg(C("b.total") / C("b.n") + 45), 4).alias("confidence"))


@query("a27_linear_weights", f"WITH {SUPPORT} SELECT class, i AS feature, CAST(sum(alpha * sq[i]) AS BIGINT) AS w FROM sup, range(1, (SELECT max(len(q)) + 1 FROM smp)) t(i) WHERE i <= len(sq) GROUP BY 1, 2", "smp")
def a27(spark, d):
    spread = support(spark, d).select("class", "alpha", F.posexplode("sq").alias("f", "v"))
    return spread.groupBy("class", (C("f") + 1).cast("long").alias("feature")).agg(F.sum(C("alpha") * C("v")).alias("w"))


@query("a28_class_counts", "SELECT class, count(*) FILTER (label = class) AS positive, count(*) FILTER (label <> class) AS negative, max(len((SELECT any_value(q) FROM smp))) AS features FROM scr GROUP BY 1", "scr")
def a28(spark, d):
    # one row: the largest feature index of the samples
    width = src.samples(spark, d).agg(F.max(F.size("q")).cast("long").alias("features")).withColumn("_all", F.lit(1))
    counts = targets(spark, d).groupBy("class").agg(F.count_if(C("target") > 0).alias("positive"), F.count_if(C("target") < 0).alias("negative"))
    return counts.withColumn("_all", F.lit(1)).join(F.broadcast(width), "_all").drop("_all")


@query("a29_feature_scale", "SELECT round(max(n), 4) AS largest, round(avg(n), 4) AS mean, round(1 / (avg(n) * avg(n)), 8) AS cost FROM (SELECT sqrt(CAST(list_sum(list_transform(q, lambda z: z * z)) AS DOUBLE)) AS n FROM smp)", "smp")
def a29(spark, d):
    n = F.sqrt(dot("q", "q").cast("double"))
    return src.samples(spark, d).select(n.alias("n")).agg(F.round(F.max("n"), 4).alias("largest"), F.round(F.avg("n"), 4).alias("mean"), F.round(1 / (F.avg("n") * F.avg("n")), 8).alias("cost"))


COVER = f"""bp AS ({BOXES_ON_PROFILE}), dl AS (SELECT key, pl, sum(d) AS d FROM (SELECT key, lo AS pl, 1 AS d FROM bp UNION ALL SELECT key, hi + 1, -1 FROM bp) GROUP BY 1, 2),
  co AS (SELECT key, pl, CAST(sum(d) OVER (PARTITION BY key ORDER BY pl ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM dl)"""  # fmt: skip


@query("a30_coverage", f"WITH {COVER} SELECT key, pl AS \"at\", depth FROM co", "det")
def a30(spark, d):
    return op.coverage(boxes_on_profile(spark, d), "lo", "hi", ["key"])


@query("a31_consensus_intervals", f"""WITH {COVER}, md AS (SELECT key, quantile_disc(hi - lo + 1, 0.5) AS median FROM bp GROUP BY 1),
  sp AS (SELECT key, pl AS lo, lead(pl) OVER (PARTITION BY key ORDER BY pl) - pl AS width, depth FROM co), lv AS (SELECT DISTINCT key, depth AS level FROM co WHERE depth > 0),
  le AS (SELECT key, level, lo, width FROM sp JOIN lv USING (key) WHERE depth >= level),
  rn AS (SELECT key, level, sum(width) AS w FROM (SELECT *, lo - sum(width) OVER (PARTITION BY key, level ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM le) GROUP BY key, level, coalesce(g, lo)),
  sc AS (SELECT key, level, median, sum(CASE WHEN w < 3 OR w * 100 > median * 155 THEN 0 WHEN abs(w - median) * 4 < median THEN 18 * (median - abs(w - median)) ELSE 10 * (median - abs(w - median)) END) AS points FROM rn JOIN md USING (key) GROUP BY 1, 2, 3)
  SELECT key, level, CAST(median AS BIGINT) AS median, round(CAST(points AS DOUBLE) / median, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY points DESC, level) AS r FROM sc) WHERE r = 1""", "det")  # fmt: skip
def a31(spark, d):
    return op.consensus_level(boxes_on_profile(spark, d), "lo", "hi", ["key"])


SPLIT = """ls AS (SELECT key, place, depth, lo, w, mw, l, r FROM wide JOIN curve USING (key) WHERE place BETWEEN lo AND lo + w),
  mn AS (SELECT key, lo, min_by(place, depth * 100000 + place) AS cut, min(depth) AS low FROM ls WHERE place BETWEEN l AND r GROUP BY 1, 2),
  pk AS (SELECT ls.key, ls.lo, any_value(w) AS w, any_value(cut) AS cut, any_value(low) AS low, max(depth) FILTER (place <= cut) AS left_peak, max(depth) FILTER (place >= cut) AS right_peak FROM ls JOIN mn ON mn.key = ls.key AND mn.lo = ls.lo GROUP BY 1, 2)"""


@query("a31_interval_boxes", f"""WITH {COVER}, md AS (SELECT key, quantile_disc(hi - lo + 1, 0.5) AS median FROM bp GROUP BY 1),
  sp AS (SELECT key, pl AS lo, lead(pl) OVER (PARTITION BY key ORDER BY pl) - pl AS width, depth FROM co), lv AS (SELECT DISTINCT key, depth AS level FROM co WHERE depth > 0),
  le AS (SELECT key, level, lo, width FROM sp JOIN lv USING (key) WHERE depth >= level),
  rn AS (SELECT key, level, min(lo) AS lo, sum(width) AS w FROM (SELECT *, lo - sum(width) OVER (PARTITION BY key, level ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM le) GROUP BY key, level, coalesce(g, lo)),
  sc AS (SELECT key, level, median, sum(CASE WHEN w < 3 OR w * 100 > median * 155 THEN 0 WHEN abs(w - median) * 4 < median THEN 18 * (median - abs(w - median)) ELSE 10 * (median - abs(w - median)) END) AS points FROM rn JOIN md USING (key) GROUP BY 1, 2, 3),
  bl AS (SELECT key, level, median AS mw FROM sc QUALIFY row_number() OVER (PARTITION BY key ORDER BY points DESC, level) = 1),
  br AS (SELECT key, lo, CAST(w AS BIGINT) AS w, mw FROM rn JOIN bl USING (key, level)),
  curve AS (SELECT key, unnest(range(lo, lo + width)) AS place, depth FROM sp WHERE width IS NOT NULL),
  wide AS (SELECT *, lo + CAST(trunc(w * 0.4::DOUBLE) AS BIGINT) AS l, lo + CAST(trunc(w * 0.6::DOUBLE) AS BIGINT) AS r FROM br WHERE w * 100 > mw * 155 AND w * 100 <= mw * 310), {SPLIT}
  SELECT key, lo, lo + w - 1 AS hi FROM br WHERE w >= 3 AND w * 100 <= mw * 155
  UNION ALL SELECT key, CASE WHEN low * 4 >= left_peak AND low * 4 < right_peak THEN cut + 1 ELSE lo END, CASE WHEN low * 4 < left_peak THEN cut - 2 ELSE lo + w - 1 END FROM pk""", "det")  # fmt: skip
def a31_boxes(spark, d):
    return op.consensus_intervals(boxes_on_profile(spark, d), "lo", "hi", ["key"])


#: Median width and height of a letter on a profile.
LETTER_W, LETTER_H = 3, 2


@query("a32_segment_profile", f"""WITH {RUNS}, rp AS (SELECT ru.key, lo, hi - lo + 1 AS w, {LETTER_W} AS mw, max(cnt) AS peak FROM ru JOIN prof ON ru.key = prof.key AND bin BETWEEN lo AND hi GROUP BY ALL),
  br AS (SELECT * FROM rp WHERE peak * 100 >= {LETTER_H * 35}), curve AS (SELECT key, bin AS place, cnt AS depth FROM prof),
  wide AS (SELECT *, lo + CAST(trunc(w * 0.4::DOUBLE) AS BIGINT) AS l, lo + CAST(trunc(w * 0.6::DOUBLE) AS BIGINT) AS r FROM br WHERE w * 100 > mw * 155 AND w * 100 < mw * 310), {SPLIT}
  SELECT key, lo, lo + w - 1 AS hi FROM br WHERE w >= 3 AND w * 100 <= mw * 155
  UNION ALL SELECT key, lo, cut - 2 FROM pk WHERE left_peak * 100 > {LETTER_H * 35} AND low * 2 < left_peak
  UNION ALL SELECT key, cut + 1, lo + w - 1 FROM pk WHERE right_peak * 100 > {LETTER_H * 35} AND low * 2 < right_peak""", "prof")  # fmt: skip
def a32(spark, d):
    """Runs of a profile that are high and wide enough, those too wide cut at their lowest place."""
    return op.segment_profile(src.profile(spark, d), "bin", "cnt", ["key"], LETTER_W, LETTER_H)


@query("w17_split_letters", f"""WITH b AS (SELECT *, hi - lo + 1 AS w FROM ({BOXES_ON_PROFILE})), wd AS (SELECT *, lo + CAST(trunc(w * 0.4::DOUBLE) AS BIGINT) AS l, lo + CAST(trunc(w * 0.6::DOUBLE) AS BIGINT) AS r FROM b WHERE w > 2.5 * 2.75 AND w < 2.7 * 2.75),
  pl AS (SELECT det_id, lo, hi, l, r, place, coalesce(cnt, 0) AS h FROM (SELECT *, unnest(range(lo, hi + 2)) AS place FROM wd) u LEFT JOIN prof ON prof.key = u.key AND bin = place),
  ct AS (SELECT det_id, min_by(place, h * 100000 + place) AS cut, min(h) AS low FROM pl WHERE place BETWEEN l AND r GROUP BY 1),
  pk AS (SELECT pl.det_id, any_value(lo) AS lo, any_value(hi) AS hi, any_value(cut) AS cut, coalesce(max(h) FILTER (place <= cut), 0) > 0.6 AND any_value(low) * 2 < coalesce(max(h) FILTER (place <= cut), 0) AS a, coalesce(max(h) FILTER (place >= cut), 0) > 0.6 AND any_value(low) * 2 < coalesce(max(h) FILTER (place >= cut), 0) AS z FROM pl JOIN ct USING (det_id) GROUP BY 1)
  SELECT det_id, lo, hi FROM b WHERE NOT (w > 2.5 * 2.75 AND w < 2.7 * 2.75) UNION ALL SELECT det_id, lo, cut - 2 FROM pk WHERE a UNION ALL SELECT det_id, cut + 1, hi FROM pk WHERE z UNION ALL SELECT det_id, lo, hi FROM pk WHERE NOT a AND NOT z""", "det prof")  # fmt: skip
def w17_letters(spark, d):
    return op.split_boxes(boxes_on_profile(spark, d), src.profile(spark, d), "bin", "cnt", ["key"], 2.75, 2.0)


@query("a33_half_vote", "SELECT camera_id, frame_id, count(*) FILTER (cy > 60 + cx * 0.05::DOUBLE) > count(*) FILTER (cy < 30 + cx * 0.05::DOUBLE) AS top_half FROM det GROUP BY 1, 2", "det")
def a33(spark, d):
    slope = C("cx") * 0.05
    return src.detections(spark, d).groupBy(*FRAME).agg((F.count_if(C("cy") > 60 + slope) > F.count_if(C("cy") < 30 + slope)).alias("top_half"))


@query("a34_edge_consensus", "SELECT camera_id, frame_id, list_sort(list(x))[-2] + 1 AS left_edge, list_sort(list(x + w))[2] - 1 AS right_edge FROM det GROUP BY 1, 2 HAVING count(*) >= 2", "det")
def a34(spark, d):
    own = src.detections(spark, d).groupBy(*FRAME).agg(F.sort_array(F.collect_list("x")).alias("l"), F.sort_array(F.collect_list(C("x") + C("w"))).alias("r")).where("size(l) >= 2")
    return own.select(*FRAME, (F.element_at("l", -2) + 1).alias("left_edge"), (F.element_at("r", 2) - 1).alias("right_edge"))


@query("a35_model_norm", f"WITH {SUPPORT} SELECT a.class, round(sqrt(greatest(0, CAST(sum(a.alpha * b.alpha * list_sum(list_transform(list_zip(a.sq, b.sq), lambda p: p[1] * p[2]))) AS DOUBLE))), 3) AS norm FROM sup a JOIN sup b USING (class) GROUP BY 1", "smp")
def a35(spark, d):
    s = support(spark, d)
    other = s.select("class", C("alpha").alias("beta"), C("sq").alias("tq"))
    total = F.sum(C("alpha") * C("beta") * dot("sq", "tq")).cast("double")
    return s.join(other, "class").groupBy("class").agg(F.round(F.sqrt(F.greatest(F.lit(0.0), total)), 3).alias("norm"))
