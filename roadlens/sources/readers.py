"""Readers of dimensions, feature files, patterns, events and capture names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_detections(spark: SparkSession, path: str, schema: T.StructType | None = None, stream: bool = False) -> DataFrame:
    """Detections from Parquet; as a stream the schema must be given."""
    if stream:
        return spark.readStream.schema(schema).parquet(path)
    return spark.read.parquet(path)


DIMENSION_DDL = (
    "camera_id long, video string, algorithm string, parameters map<string,string>, "
    "lines array<struct<x1:double,y1:double,x2:double,y2:double>>, roi array<struct<name:string,path:string,points:array<struct<x:double,y:double>>>>, lights array<struct<x:int,y:int,width:int,height:int,threshold:int>>"
)


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """Cameras with their parameters, lines, regions (name, image path, polygon) and lights, one JSON document per camera or an array of them."""
    return spark.read.schema(DIMENSION_DDL).option("multiLine", True).json(path)


def list_labelled_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "png", "ppm")) -> DataFrame:
    """path, length and label (the directory's name) of files by extension, whatever its case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    own = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return own.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def parse_svmlight(lines: Column) -> dict[str, Column]:
    """Columns of a feature line: label, qid, sid, cost, features, comment and _corrupt.

    Grammar: label [qid:n] [sid:n] [cost:x] index:value ... [#comment]. Indices begin at 1 and grow;
    a sid is positive; the label comes first.
    """
    body = F.trim(F.split_part(lines, F.lit("#"), F.lit(1)))
    parts = F.filter(F.split(body, r"\s+"), lambda p: p != "")
    rest = F.slice(parts, 2, 1 << 20)
    named = lambda n: F.try_element_at(F.filter(rest, lambda p: F.startswith(p, F.lit(n + ":"))), F.lit(1))
    value = lambda n: F.split_part(named(n), F.lit(":"), F.lit(2))
    pairs = F.filter(rest, lambda p: p.rlike(r"^\d+:"))
    index = F.transform(pairs, lambda p: F.try_element_at(F.split(p, ":"), F.lit(1)).try_cast("int"))
    weight = F.transform(pairs, lambda p: F.try_element_at(F.split(p, ":"), F.lit(2)).try_cast("double"))
    known = F.filter(rest, lambda p: p.rlike(r"^(\d+|qid|sid|cost):"))
    ordered = F.size(F.filter(index, lambda x, i: (x < 1) | ((i > 0) & (x <= index.getItem(F.greatest(i - 1, F.lit(0))))))) == 0
    label = F.try_element_at(parts, F.lit(1)).try_cast("double")
    sid = value("sid").try_cast("long")
    good = label.isNotNull() & (F.size(known) == F.size(rest)) & ordered & (F.coalesce(sid, F.lit(1)) > 0) & ~F.exists(weight, lambda w: w.isNull())
    return {
        "label": label, "qid": value("qid").try_cast("long"), "sid": sid, "cost": value("cost").try_cast("double"),
        "features": F.when(good, F.map_from_arrays(index, weight)),
        "comment": F.when(F.contains(lines, F.lit("#")), F.regexp_extract(lines, "#(.*)$", 1)), "_corrupt": F.when(~F.coalesce(good, F.lit(False)), lines),
    }


def read_svmlight(spark: SparkSession, path: str, keep: DataFrame | None = None, positive: int | None = None, fail_fast: bool = False) -> DataFrame:
    """Labelled sparse rows of text files; comment lines are not rows.

    keep: a DataFrame of row (number of a data line in its file, from 0) to keep. positive: labels
    become +1 for this one, -1 else. Bad lines are in _corrupt, or fail the read if asked.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.withColumn("_at", F.monotonically_increasing_id()) if keep is not None else lines
    if keep is not None:
        numbered = rows.withColumn("row", (F.row_number().over(Window.partitionBy("file").orderBy("_at")) - 1).cast("long"))
        rows = numbered.join(keep.select("row"), "row", "left_semi")
    out = rows.select(*[c.alias(n) for n, c in parse_svmlight(F.col("value")).items()])
    if fail_fast:
        out = out.withColumn("_corrupt", F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.lit("bad line: "), "_corrupt"))).cast("string"))
    if positive is not None:
        out = out.withColumn("label", F.when(F.col("label") == positive, 1.0).otherwise(-1.0))
    return out


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """region, rule_no (order within the region) and pattern of a small text file of pairs."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n")).alias("line", "text"))
    parts = F.split(F.trim("text"), r"\s+")
    rows = whole.where(F.size(parts) >= 2).select("line", parts[0].alias("region"), parts[1].alias("pattern"))
    return rows.withColumn("rule_no", F.row_number().over(Window.partitionBy("region").orderBy("line")) - 1).drop("line")


CAPTURE = r"^(\d{8})_(\d{6})_(\w+?)_z(\d+)_(\d+)\.(\w+)$"


def parse_capture_name(col: Column, regex: str = CAPTURE) -> Column:
    """Struct of date, time, cam, zone, fpm and ext; null where the name does not match in full."""
    names = ("date", "time", "cam", "zone", "fpm", "ext")
    return F.when(col.rlike(regex), F.struct(*[F.regexp_extract(col, regex, i + 1).alias(n) for i, n in enumerate(names)]))


def read_events_xml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "ViolationEvent").load(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """class, w and b of a saved set of linear models; raises where a class of its manifest is missing, there twice or changed."""
    manifest = spark.read.schema("class long, features int, hash long").json(f"{path}/manifest")
    models = spark.read.schema("w array<double>, b double, class long").parquet(f"{path}/models").select("class", "w", "b")
    found = models.select(F.col("class").alias("_class"), F.size("w").alias("_n"), F.xxhash64("w", "b").alias("_h"))
    met = manifest.join(found, F.col("class") == F.col("_class"), "full")
    same = F.coalesce((F.col("features") == F.col("_n")) & (F.col("hash") == F.col("_h")), F.lit(False))
    wrong = met.groupBy(F.coalesce("class", "_class").alias("class")).agg((F.min(same) & (F.count(F.lit(1)) == 1)).alias("_ok")).where("not _ok")
    if bad := sorted(r["class"] for r in wrong.select("class").collect()):  # classes are few
        raise ValueError(f"models missing or damaged: classes {bad}")
    return models
