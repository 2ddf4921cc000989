"""Queries of feature files, sinks' text forms and classifier jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ml as op
from ..sources import adapters as src
from ..sources import readers, writers
from .base import query

C = F.col


def svm_lines(spark, d):
    """Feature lines made of lineitem rows, a few of them with growing errors."""
    li = src.table(spark, d, "lineitem")
    line = F.concat_ws(" ", C("l_linenumber").cast("string"), F.concat(F.lit("qid:"), (C("l_orderkey") % 7).cast("string")), F.concat(F.lit("2:"), C("l_quantity").cast("long").cast("string")),
        F.concat((C("l_partkey") % 5).cast("string"), F.lit(":1")), F.lit("#c"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", line.alias("value"))


GOOD = "(l_partkey % 5 > 2)"


@query("s5_read_svmlight", f"""SELECT count(*) AS n, count(*) FILTER (NOT {GOOD}) AS corrupt, CAST(sum(l_orderkey % 7) AS BIGINT) AS qids, CAST(sum(CASE WHEN {GOOD} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS f2 FROM lineitem""")
def s5(spark, d):
    p = svm_lines(spark, d).select(*[c.alias(n) for n, c in readers.parse_svmlight(C("value")).items()])
    f2 = F.coalesce(F.try_element_at("features", F.lit(2)), F.lit(0.0)).cast("long")
    return p.agg(F.count("*").alias("n"), F.count("_corrupt").alias("corrupt"), F.sum("qid").alias("qids"), F.sum(f2).alias("f2"))


@query("s6_signed_labels", "SELECT l_linenumber = 3 AS positive, count(*) AS n FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1")
def s6(spark, d):
    """Rows of a mask, with one label against all others."""
    rows = svm_lines(spark, d)
    keep = src.table(spark, d, "orders").select(C("o_orderkey").alias("l_orderkey")).where("l_orderkey % 3 = 0")
    mask = rows.select("l_orderkey").distinct().where("l_orderkey % 3 = 0").unionByName(keep).distinct()
    label = readers.parse_svmlight(C("value"))["label"]
    return rows.join(mask, "l_orderkey", "left_semi").groupBy((label == 3).alias("positive")).agg(F.count("*").alias("n"))


@query("s8_parse_capture_name", """SELECT det_id, strftime(ts, '%Y%m%d') AS date, 'cam' || camera_id AS cam, CAST(occ AS VARCHAR) AS fpm FROM det WHERE det_id % 2 = 0""", "det")
def s8(spark, d):
    name = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_cam"), C("camera_id").cast("string"), F.when(C("det_id") % 2 == 0, "_z").otherwise("_q"), F.lit("3_"), C("occ").cast("string"), F.lit(".jpg"))
    own = src.detections(spark, d).select("det_id", readers.parse_capture_name(name).alias("n")).where("n is not null")
    return own.select("det_id", "n.date", "n.cam", "n.fpm")


@query("k2_map_paths", "SELECT p_partkey, replace('/data/local/' || p_name, '/data/local', '//nas/media') AS path FROM part")
def k2(spark, d):
    return src.table(spark, d, "part").select("p_partkey", text.map_path(F.concat(F.lit("/data/local/"), "p_name"), "/data/local", "//nas/media").alias("path"))


@query("k4_area_samples", "SELECT label, count(*) AS n, min(area) AS least, max(area) AS most, quantile_disc(area, 0.5) AS middle FROM det WHERE area >= 600 GROUP BY 1", "det")
def k4(spark, d):
    own = src.detections(spark, d).where("area >= 600").groupBy("label")
    return own.agg(F.count("*").alias("n"), F.min("area").alias("least"), F.max("area").alias("most"), F.expr("percentile_disc(0.5) within group (order by area)").cast("long").alias("middle"))


@query("k8_svmlight_lines", "SELECT id, label || ' ' || array_to_string(list_transform(list_filter(list_zip(range(1, len(q) + 1), q), lambda p: p[2] <> 0), lambda p: p[1] || ':' || p[2]), ' ') AS line FROM smp", "smp")
def k8(spark, d):
    return src.samples(spark, d).select("id", writers.svmlight_line(C("label"), C("q")).alias("line"))


@query("k11_prediction_lines", "SELECT id, class, CASE WHEN score >= 0 THEN printf('%.4f:+1 %.4f:-1', score::DOUBLE, -score::DOUBLE) ELSE printf('%.4f:-1 %.4f:+1', -score::DOUBLE, score::DOUBLE) END AS line FROM scr WHERE score <> 0", "scr")
def k11(spark, d):
    return src.scores(spark, d).where("score <> 0").select("id", "class", writers.prediction_line(C("score").cast("double")).alias("line"))


def small(spark, d):
    return src.samples(spark, d).select("id", "label", "features")


@query("m1_train_one_vs_all")
def m1(spark, d):
    df = small(spark, d)
    return op.evaluate(op.score(df.select("id", "label", "features"), op.train_one_vs_all(df)))


@query("m2_cross_validate")
def m2(spark, d):
    return op.cross_validate(small(spark, d), 3)


@query("m3_validate")
def m3(spark, d):
    return op.validate(small(spark, d), 0.75)


@query("m4_learning_curve")
def m4(spark, d):
    return op.learning_curve(small(spark, d), (0.3, 0.6, 1.0))


@query("m5_rank_model")
def m5(spark, d):
    ranked = src.samples(spark, d).select("id", C("label").alias("qid"), (C("id") % 3).alias("rank"), "q")
    w = op.rank_model_of(ranked)
    return spark.createDataFrame([(i, x) for i, x in enumerate(w)], "feature int, w double")


@query("m6_pair_models")
def m6(spark, d):
    return op.pair_models(small(spark, d)).select("c1", "c2", F.round("b", 4).alias("b"))


@query("m7_pca_per_class")
def m7(spark, d):
    return op.pca_per_class(small(spark, d), 4)


@query("m8_shuffle_samples", "SELECT id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY md5(id || ':7'), id) AS INTEGER) AS place FROM smp", "smp")
def m8(spark, d):
    return op.shuffle_samples(src.samples(spark, d).select("id", "label"), 7)


@query("m9_allowed_kinds", """SELECT det_id, CASE WHEN cy >= 60 THEN 'digit' WHEN n BETWEEN 3 AND 4 AND p <= 1 THEN 'digit' WHEN n BETWEEN 3 AND 4 AND p = 2 THEN 'letter' ELSE 'any' END AS kind FROM (
  SELECT det_id, cy, row_number() OVER (PARTITION BY camera_id, frame_id, cy >= 60 ORDER BY x, det_id) - 1 AS p, count(*) OVER (PARTITION BY camera_id, frame_id, cy >= 60) AS n FROM det)""", "det")  # fmt: skip
def m9(spark, d):
    det = src.detections(spark, d).withColumn("low", C("cy") >= 60)
    w = Window.partitionBy("camera_id", "frame_id", "low")
    return det.select("det_id", op.allowed_kind(F.row_number().over(w.orderBy("x", "det_id")) - 1, F.count("*").over(w), C("low")).alias("kind"))


@query("m10_misclassified", "SELECT id, class FROM scr WHERE (CASE WHEN label = class THEN score ELSE -score END) <= 0", "scr")
def m10(spark, d):
    return op.misclassified(src.scores(spark, d)).select("id", "class")
