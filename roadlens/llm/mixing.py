"""Mixing sources to target weights by entropy balancing.

Each document d gets the rate r_d closest in relative entropy to 1 among all rates of at most
MAX_COPIES that meet its source's token target. The solution is r_d = min(MAX_COPIES,
exp(lambda_s * size_d / scale_s)); distributed Newton steps on the convex dual, several tilts at a time, find lambda for
all sources at once from (source, size) histograms. Systematic rounding turns rates into copies.

Nulls: a null text has size 0, a null source is a source of its own. Documents without words
have rate 1 and take no words. Repeated rows are documents of their own. No rows: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, n_words, packed, rest_columns, scratch, table

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_COPIES = 2
#: Rates are fixed-point numbers in the cumulative sums, which makes those exact in any order.
UNIT = 1 << 20
#: Tilts of a bracket that a step tries besides the last one.
POINTS = 15
#: Documents of a rounding run, about, and starting places tried.
RUN, OFFSETS = 256, 16


def source_targets(sizes: DataFrame) -> DataFrame:
    """s, source, source_size, scale and target of each source of (source, size, n) rows.

    Sources in code point order (null last) weigh 5, 2, 1, repeating; they share 1.5 times all
    sizes by weight, but none gets over twice its own size: with sources sorted by cap / weight,
    the first whose share of what the earlier, capped ones leave fits fixes the common level.
    """
    own = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("_squares"),
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place - 1) % len(WEIGHTS) + 1)
    own = own.withColumns({"s": place, "_w": weight, "_cap": F.col("source_size") * float(MAX_COPIES)})
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "s")
    earlier = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * TOTAL_SHARE
    own = own.withColumns({"_level": (total - earlier) / left, "_ratio": F.col("_cap") / F.col("_w")})
    fits = F.when(F.col("_level") <= F.col("_ratio") * (1 + 1e-12), F.struct("_ratio", "s", "_level"))
    own = own.withColumn("_at", F.min(fits).over(Window.partitionBy())["_level"])
    return own.select(
        "s", "source", "source_size",
        F.when(F.col("source_size") > 0, F.col("_squares") / F.col("source_size")).otherwise(1.0).alias("scale"),
        F.least(F.col("_cap"), F.coalesce("_at", F.lit(0.0)) * F.col("_w")).alias("target"),
    )


def solve_tilts(histogram: DataFrame, targets: DataFrame, steps: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """targets with the tilt of each source.

    The dual of all sources at once: a step sums tokens and their slope by source over the histogram (s, size, n), at
    the source's tilt and at POINTS more in the bracket known to hold the root of log(tokens(tilt)) = log(target). The
    sums narrow the bracket to two neighbouring points, and the next tilt is Newton's from the point that came nearest,
    or the bracket's middle where that leaves it. So few steps are needed, each of which is jobs for the driver to plan;
    sources whose documents are all taken MAX_COPIES times need none. Sums are decimals, so that they are the
    same in any order. Between steps the tilts lie in a table; whether all have settled is all that the driver learns.
    """
    target, scale = F.col("target"), F.col("scale")
    # every size is at least 1, so all rates are MAX_COPIES at hi and at most half the wanted mean at lo
    hi = scale * math.log(MAX_COPIES)
    full = target >= F.col("source_size") * (MAX_COPIES * (1 - 1e-12))
    own = targets.where((F.col("source_size") > 0) & (target > 0)).select(
        "s", "scale", "target", (scale * F.log(target / F.col("source_size") / 2)).alias("lo"), hi.alias("hi"),
        F.when(full, hi).otherwise(F.least(F.log(target / F.col("source_size")), hi)).alias("tilt"), full.alias("done"),
    )
    state = durable(own, "tilts")
    sized = histogram.where("size > 0")
    for _ in range(steps):
        if state.where("not done").isEmpty():
            break
        between = [F.col("lo") + (F.col("hi") - F.col("lo")) * (k / (POINTS + 1)) for k in range(1, POINTS + 1)]
        points = state.where("not done").select("s", "scale", "target", F.explode(F.array("tilt", *between)).alias("x"))
        rate, size = _rate(F.col("x"), F.col("size"), scale), F.col("size")
        tokens = F.col("n") * size * rate
        slope = F.when(rate < MAX_COPIES, tokens * size / scale).otherwise(0.0)
        exact = [F.sum(v.cast("decimal(38,12)")).cast("double").alias(name) for v, name in ((tokens, "_g"), (slope, "_d"))]
        sums = sized.join(points, "s").groupBy("s", "target", "x").agg(*exact)
        # far down the bracket the sum may be 0, which has no logarithm
        over = F.coalesce(F.log(F.col("_g") / target), F.lit(float("-inf")))
        newton = F.when(F.col("_d") > 0, F.col("x") - over * F.col("_g") / F.col("_d"))
        near = sums.groupBy("s").agg(
            F.max(F.when(over <= 0, F.col("x"))).alias("_low"), F.min(F.when(over >= 0, F.col("x"))).alias("_high"),
            F.min(F.struct(F.abs(over).alias("off"), "x", newton.alias("next"))).alias("_best"),
        )
        low, high, best = F.coalesce("_low", "lo"), F.coalesce("_high", "hi"), F.col("_best")
        settled = (best["off"] < tolerance) | (high - low < 1e-12 * F.abs(high))
        moved = F.when(settled, best["x"]).when(best["next"].between(low, high), best["next"]).otherwise((low + high) / 2)
        kept = lambda new, old: F.when(F.col("done"), F.col(old)).otherwise(new).alias(old)
        state = durable(state.join(near, "s", "left").select("s", "scale", "target", kept(low, "lo"), kept(high, "hi"), kept(moved, "tilt"), (F.col("done") | settled).alias("done")), "tilts")
    return targets.join(state.select("s", F.round("tilt", 9).alias("tilt")), "s", "left").fillna(0.0, ["tilt"])


def _rate(tilt, size, scale):
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.lit(30.0), tilt * size / scale)))


def round_to_copies(rated: DataFrame, key: str) -> DataFrame:
    """rated (s, size, target, rate, key) with copies, whole numbers whose words come near target.

    Systematic rounding along size order: a document gets the integers that its stretch of the
    running sum of rates covers, so neighbours of like size make up for each other. Runs are
    (source, size within an eighth, salt); a hot source spreads over many. Of OFFSETS places to
    begin at, each source takes the one whose words come nearest.
    """
    level = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) * 8).cast("int")
    df = rated.withColumns({"_level": level, "_part": F.floor(F.col("rate") * UNIT).cast("long"), "_h": F.xxhash64(key, "size")})
    n = df.groupBy("s", "_level").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("_salts"))
    df = df.join(n, ["s", "_level"]).withColumn("_salt", F.pmod("_h", "_salts").cast("int")).drop("_salts")
    run = ["s", "_level", "_salt"]
    # dealt anew: by source and level alone a hot source's rows would stay together
    df = durable(df.repartition(*run), "dealt")
    runs = durable(df.groupBy(*run).agg(F.sum("_part").alias("_sum")), "runs")
    levels = runs.groupBy("s", "_level").agg(F.sum("_sum").alias("_all"))
    earlier = Window.partitionBy("s").orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("s", "_level", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_from"))
    before = Window.partitionBy("s", "_level").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    start = runs.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(levels, ["s", "_level"])
    start = durable(start.select(*run, (F.col("_start") + F.col("_from")).alias("_start")), "starts")
    along = Window.partitionBy(*run).orderBy("size", "_h", key).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_end", F.sum("_part").over(along)).join(start, run)
    df = durable(df, "placed")

    def copies(offset):
        end = F.col("_start") + F.col("_end") + offset
        return (F.floor(end / UNIT) - F.floor((end - F.col("_part")) / UNIT)).cast("int")

    places = [(2 * k + 1) * UNIT // (2 * OFFSETS) for k in range(OFFSETS)]
    words = df.groupBy("s").agg(F.first("target").alias("_t"), *[F.sum(copies(F.lit(x)) * F.col("size")).alias(f"_w{x}") for x in places])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_w{x}") - F.col("_t")), F.lit(x).alias("at")) for x in places]))["at"]
    df = df.join(words.select("s", nearest.alias("_offset")), "s")
    return df.withColumn("copies", copies(F.col("_offset"))).drop("_level", "_part", "_h", "_salt", "_end", "_start", "_offset")


def mix_counts(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, size, source_size, target, rate and copies of each document."""
    with scratch() as keep:
        sizes = durable(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size")), "sizes")
        counts = durable(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
        targets = durable(source_targets(counts), "targets")
        histogram = counts.join(targets.select("s", "source"), counts["source"].eqNullSafe(targets["source"])).select("s", "size", "n")
        tilts = durable(solve_tilts(histogram, targets), "tilts")
        rated = sizes.join(tilts.withColumnRenamed("source", "_source"), sizes["source"].eqNullSafe(F.col("_source"))).select(
            "key", "s", "size", "source_size", "target", _rate(F.col("tilt"), F.col("size"), F.col("scale")).alias("rate")
        )
        return keep(durable(round_to_copies(rated, "key").drop("s").withColumnRenamed("key", key), "copies"))


def _named(x: Column) -> Column:
    """x as text, null apart from every text."""
    return F.when(x.isNull(), "n").otherwise(F.concat(F.lit("v"), x.cast("string")))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with each row as often as the mix takes it, none to MAX_COPIES times.

    Rows of one source with equal key and text have one rate, so some of them are taken once more often than the
    others: the first ones in the order of a hash of the whole row. Rows equal in every column count as
    one with a multiplicity, and rows of a repeated key are numbered in parts of about RUN rows, so a
    group of any size spreads out.
    """
    own = [_named(F.col(f"`{c}`")) for c in (key, source, text)]
    identity = F.unhex(F.md5(F.concat_ws("\0", *own).cast("binary")))
    named = packed(docs, [], _id=identity, _source=F.col(f"`{source}`"), _text=F.col(f"`{text}`"))
    with scratch() as keep:
        counts = mix_counts(named, "_id", "_source", "_text").groupBy("_id")
        counts = counts.agg(F.min("copies").alias("_each"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("_more"), F.count(F.lit(1)).alias("_rows"))
        counts = keep(durable(counts, "taken"))
    joined = named.drop("_source", "_text").join(counts, "_id")
    alike = joined.where("_more = 0").select("_rest", F.col("_each").alias("_n"))
    taken = alike.union(_dealt(joined.where("_more > 0"))).where("_n > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).select(*rest_columns(taken))


def _dealt(rows: DataFrame) -> DataFrame:
    """_rest and _n: how often rows are taken of whose _id `_more` of `_rows` rows are taken once more than the others."""
    classes = rows.groupBy("_id", "_each", "_more", "_rows", "_rest").agg(F.count(F.lit(1)).alias("_m"))
    salt = F.pmod(F.xxhash64("_rest"), F.ceil(F.col("_rows") / RUN)).cast("int")
    classes = classes.withColumn("_salt", salt)
    parts = classes.groupBy("_id", "_salt").agg(F.sum("_m").alias("_sum"))
    earlier = Window.partitionBy("_id").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_id", "_salt", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_id", "_salt").orderBy(F.xxhash64("_rest")).rowsBetween(Window.unboundedPreceding, -1)
    placed = classes.withColumn("_before", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(parts, ["_id", "_salt"])
    start = F.col("_from") + F.col("_before")
    extra = F.greatest(F.lit(0), F.least(start + F.col("_m"), F.col("_more")) - start)
    return placed.select("_rest", (F.col("_each") * F.col("_m") + extra).alias("_n"))


def op4_mix_entropy_balance(spark, sf_dir: str) -> DataFrame:
    mixed = mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
