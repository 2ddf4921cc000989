"""Plate texts from letter votes: ranking, n-best combinations, champions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import spread

SKIP = "~"


def rank_letters(votes: DataFrame) -> DataFrame:
    """votes with rank from 1 within a place: larger total first, then the letter."""
    w = Window.partitionBy("plate_id", "pos").orderBy(F.col("total").desc(), "letter")
    return votes.withColumn("rank", F.row_number().over(w))


def places(votes: DataFrame) -> DataFrame:
    """Each plate's places in order with their letters (letter, total, cost), best first.

    A letter over a tenth below its place's best costs one substitution, but for the skip sign
    and in the last place. The votes are ranked unless they have their rank. Costs are worked out
    within a plate's array, so the rows are not sorted for them.
    """
    own = votes if "rank" in votes.columns else rank_letters(votes)
    by_place = own.groupBy("plate_id", "pos").agg(F.sort_array(F.collect_list(F.struct("rank", "letter", "total"))).alias("letters"))
    by_plate = by_place.groupBy("plate_id").agg(F.sort_array(F.collect_list(F.struct("pos", "letters"))).alias("_all"))

    def with_costs(p: Column, i: Column) -> Column:
        best, last = p["letters"][0]["total"], i == F.size("_all") - 1
        weak = lambda v: (v["rank"] > 1) & (v["total"] * 10 < best * 9) & (v["letter"] != SKIP) & ~last
        return F.transform(p["letters"], lambda v: F.struct(v["letter"].alias("letter"), v["total"].alias("total"), F.when(weak(v), 1).otherwise(0).alias("cost")))

    return by_plate.select("plate_id", F.transform("_all", with_costs).alias("places"))


def combinations(rows: DataFrame, max_subs: int) -> DataFrame:
    """Each plate's combinations of letters with at most max_subs substitutions, as an array of text and total."""
    start = F.array(F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("subs")))

    def extend(done: Column, letters: Column) -> Column:
        def with_letter(c: Column) -> Column:
            sign = lambda v: F.when(v["letter"] == SKIP, "*").otherwise(v["letter"])
            return F.transform(letters, lambda v: F.struct(
                F.concat(c["text"], sign(v)).alias("text"), (c["total"] + v["total"]).alias("total"), (c["subs"] + v["cost"]).alias("subs")))

        return F.filter(F.flatten(F.transform(done, with_letter)), lambda c: c["subs"] <= max_subs)

    found = F.transform(F.aggregate("places", start, extend), lambda c: F.struct(c["text"].alias("text"), c["total"].alias("total")))
    return rows.select("plate_id", found.alias("texts"))


def best_first(texts: Column) -> Column:
    """Texts (text, total) of a plate by falling total, then by text."""
    keyed = F.sort_array(F.transform(texts, lambda c: F.struct((-c["total"]).alias("k"), c["text"].alias("text"))))
    return F.transform(keyed, lambda c: F.struct(c["text"].alias("text"), (-c["k"]).alias("total")))


def n_best(rows: DataFrame, max_subs: int) -> DataFrame:
    """One row for each combination of letters with at most max_subs substitutions: text and total."""
    return combinations(rows, max_subs).select("plate_id", F.explode("texts").alias("c")).select("plate_id", "c.text", "c.total")


def prune_letters(votes: DataFrame, n: int, together: bool = False) -> DataFrame:
    """votes kept so that the product of letters by place is n or just above, with their rank.

    Starting with the best letter of each place, the place whose next letter loses least is widened
    until the product is reached, the first place on ties. A letter is thus taken right after the
    largest loss on the way to it, so a sort by that loss gives the order without a loop. The rows are
    spread by plate, and all later steps stay within a partition; together: votes are so already.
    """
    place = Window.partitionBy("plate_id", "pos").orderBy(F.col("total").desc(), "letter")  # as rank_letters sorts
    turn = Window.partitionBy("plate_id").orderBy(F.col("_loss").asc_nulls_first(), "pos", "rank").rowsBetween(Window.unboundedPreceding, -1)
    own = votes.select("plate_id", "pos", "letter", "total")
    ranked = rank_letters(own if together else spread(own, ["plate_id"]))
    lost = ranked.withColumn("_drop", F.lag("total").over(place) - F.col("total"))
    lost = lost.withColumn("_loss", F.max("_drop").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    growth = F.when(F.col("rank") > 1, F.col("rank") / (F.col("rank") - 1)).otherwise(1.0)
    own = lost.withColumn("_before", F.round(F.product(growth).over(turn)))
    return own.where((F.col("rank") == 1) | (F.col("_before") < n)).select("plate_id", "pos", "letter", "total", "rank")


def tournament(candidates: Column, pairs: Column) -> Column:
    """Champion (class, score) of ordered candidates (class, score): the first, until a later one beats it.

    pairs maps `first_second` to the score that the pair's model gives the sample: above 0 the first
    class wins, else the second, with that score's size. The champion comes first in the name; where no such model
    exists the challenger does; where neither does, the larger score wins, the champion on ties. No candidates: null.
    """

    def named(a: Column, b: Column) -> Column:
        return F.try_element_at(pairs, F.concat_ws("_", a["class"].cast("string"), b["class"].cast("string")))

    def won(score: Column, a: Column, b: Column) -> Column:
        return F.struct(F.when(score > 0, a["class"]).otherwise(b["class"]).alias("class"), F.abs(score).alias("score"))

    def challenge(best: Column, x: Column) -> Column:
        ahead, behind = named(best, x), named(x, best)
        stronger = F.when(best["score"] < x["score"], x).otherwise(best)
        return F.when(ahead.isNotNull(), won(ahead, best, x)).when(behind.isNotNull(), won(behind, x, best)).otherwise(stronger)

    rest = F.slice(candidates, F.lit(2), F.greatest(F.size(candidates) - 1, F.lit(0)))
    return F.aggregate(rest, F.try_element_at(candidates, F.lit(1)), challenge)
