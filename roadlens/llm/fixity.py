"""WARC records and their Merkle fixity audit.

Records lie at byte offsets of archives. Each replica gets a tree per archive: records are hashed,
records of one RANGE of offsets make a leaf, FANOUT nodes make a node of the next level. Roots of
the replicas are compared, and only children of nodes that differ are looked at on the way down;
records are compared within differing leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, table

#: Bytes of offsets in a leaf, children of a node.
RANGE, FANOUT = 1 << 16, 16
#: Pages of an archive file.
ARCHIVE_PAGES = 1000


def records(pages: DataFrame) -> DataFrame:
    """archive, page_id, length and record of pages (page_id, url, html).

    Archives take page_id ranges. Null urls and pages are empty ones; a null page_id lies in the
    archive -1, and repeated rows are records of their own.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), key, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / ARCHIVE_PAGES), F.lit(-1)).cast("long").alias("archive"),
        "page_id", F.concat(head, html, F.lit("\r\n\r\n")).alias("record"),
    )
    return rows.withColumn("length", F.octet_length("record").cast("long"))


def placed(rows: DataFrame) -> DataFrame:
    """rows (archive, page_id, length, h, ...) with byte_offset: archives hold their records by page_id, then by hash.

    So equal page_ids give the same offsets in whatever order the rows come. In two levels:
    records of one page_id and beginning of the hash are placed by themselves, and one row of each
    such group meets the others of its archive.
    """
    own = rows.withColumn("_x", F.substring("h", 1, 4))
    sums = own.groupBy("archive", "page_id", "_x").agg(F.sum("length").alias("_sum"))
    earlier = Window.partitionBy("archive").orderBy("page_id", "_x").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("archive").alias("_archive"), F.col("page_id").alias("_page"), F.col("_x").alias("_y"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("archive", "page_id", "_x").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_before", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    same = (F.col("archive") == F.col("_archive")) & F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_x") == F.col("_y"))
    return own.join(sums, same).withColumn("byte_offset", (F.col("_from") + F.col("_before")).cast("long")).select(*rows.columns, "byte_offset")


def warc_records(pages: DataFrame) -> DataFrame:
    """archive, page_id, byte_offset, length, record and h of pages; see records and placed."""
    return placed(records(pages).withColumn("h", F.sha2("record", 256))).select("archive", "page_id", "byte_offset", "length", "record")


def _hash_of(children: Column) -> Column:
    """Hash of sorted (place, hash) pairs."""
    return F.sha2(F.array_join(F.transform(F.sort_array(children), lambda c: F.concat_ws(":", c["i"].cast("string"), c["h"])), ","), 256)


def leaves(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed records (archive, byte_offset, length, h) and leaves (archive, i, h) of a replica."""
    hash_ = F.col("h") if "h" in records.columns else F.sha2("record", 256).alias("h")
    hashed = durable(records.select("archive", "byte_offset", "length", hash_).distinct(), "hashes")
    ranged = hashed.groupBy("archive", F.floor(F.col("byte_offset") / RANGE).cast("long").alias("i"))
    # a leaf holds what begins in RANGE bytes of one file
    of = _hash_of(F.collect_list(F.struct(F.col("byte_offset").alias("i"), F.concat_ws("/", F.col("length").cast("string"), "h").alias("h"))))
    return hashed, durable(ranged.agg(of.alias("h")), "leaves")


def tree(level: DataFrame, depth: int) -> list[DataFrame]:
    """The leaves and each level above, the roots last."""
    out = [level]
    for _ in range(depth):
        up = out[-1].groupBy("archive", F.floor(F.col("i") / FANOUT).cast("long").alias("_up")).agg(_hash_of(F.collect_list(F.struct("i", "h"))).alias("h"))
        out.append(durable(up.select("archive", F.col("_up").alias("i"), "h"), "level"))
    return out


def _differing(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    x, y = a.select(*on, F.col("h").alias("_a")), b.select(*on, F.col("h").alias("_b"))
    return x.join(y, on, "full").where("not (_a <=> _b)").select(*on)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """archive, byte_offset, length and status of every record in which two replicas differ.

    Both sides: archive, byte_offset, length, and record or its hash h. status: corrupt (other bytes), missing (not
    in the replica) or extra (in the replica alone). Records at one place that repeat count as
    one. Null records have no bytes to hash and equal each other. Equal replicas: no rows.
    """
    hashes, bottoms = zip(*map(leaves, (primary, replica)), strict=True)
    top = max((x.agg(F.max("i")).first()[0] or 0) for x in bottoms)
    depth = 0
    while FANOUT**depth <= top:
        depth += 1
    trees = [tree(x, depth) for x in bottoms]
    suspects = _differing(trees[0][-1], trees[1][-1], ["archive", "i"])
    for level in range(depth - 1, -1, -1):
        suspects = durable(suspects.withColumnRenamed("i", "_up"), "suspects")
        below = [t[level].withColumn("_up", F.floor(F.col("i") / FANOUT).cast("long")).join(suspects, ["archive", "_up"], "left_semi") for t in trees]
        suspects = _differing(*below, ["archive", "i"])
    suspects = durable(suspects, "suspects")
    inside = [h.withColumn("i", F.floor(F.col("byte_offset") / RANGE).cast("long")).join(suspects, ["archive", "i"], "left_semi") for h in hashes]
    a = inside[0].select("archive", "byte_offset", F.col("length").alias("_la"), F.coalesce("h", F.lit("")).alias("_a"))
    b = inside[1].select("archive", "byte_offset", F.col("length").alias("_lb"), F.coalesce("h", F.lit("")).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("corrupt")
    return a.join(b, ["archive", "byte_offset"], "full").where("not (_a <=> _b and _la <=> _lb)").select(
        "archive", "byte_offset", F.coalesce("_la", "_lb").alias("length"), status.alias("status")
    )


def op6_warc_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """The second replica has known damage: one record in 64 changed, one lost. Records are hashed where they are read."""
    draw = F.pmod(F.coalesce("page_id", F.lit(0)) * 40503, F.lit(64))
    changed = F.concat(F.lit("#"), F.substring("record", 2, 1 << 30))
    rows = records(table(spark, sf_dir, "pages")).select("archive", "page_id", "length", F.sha2("record", 256).alias("h"), draw.alias("draw"), F.when(draw == 3, F.sha2(changed, 256)).alias("other"))
    at = durable(placed(rows), "placed")
    replica = at.where("draw <> 7").withColumn("h", F.coalesce("other", "h"))
    return audit(at.select("archive", "byte_offset", "length", "h"), replica.select("archive", "byte_offset", "length", "h"))


OP6_SQL = """
WITH r AS (
  SELECT coalesce(CAST(floor(page_id / 1000.0) AS BIGINT), -1) AS archive, page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), o AS (
  SELECT archive, page_id, record, CAST(strlen(record) AS BIGINT) AS length,
    CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
    (coalesce(page_id, 0) * 40503) % 64 AS draw
  FROM r
), b AS (
  SELECT archive, byte_offset, CASE WHEN draw = 3 THEN '#' || substr(record, 2) ELSE record END AS copy FROM o WHERE draw <> 7
)
SELECT o.archive, o.byte_offset, o.length, CASE WHEN b.copy IS NULL THEN 'missing' ELSE 'corrupt' END AS status
FROM o LEFT JOIN b ON o.archive = b.archive AND o.byte_offset = b.byte_offset
WHERE b.copy IS NULL OR sha256(b.copy) <> sha256(o.record)
"""
