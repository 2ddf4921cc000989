"""Quality rules: learned decision lists over document statistics, in DataFrame functions only.

Sequential covering on labelled rows: a rule is a conjunction of thresholds, grown condition by
condition for the largest information gain on two thirds of the rows, pruned to its most
precise beginning on the rest, and kept while precise enough; the rows it covers are taken
away and the next rule is sought. The result is an ordered list that becomes one CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bind, durable, packed, rest_columns, table, words


@dataclass(frozen=True)
class Params:
    #: Labelled rows of each class to learn from, about (a hash threshold picks them).
    sample_per_class: int = 4_000
    #: Thresholds tried for each statistic: quantiles of the sample.
    quantiles: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    #: Share of bad rows among those a rule covers, at least, on the rows held out for pruning.
    min_precision: float = 0.9
    min_covered: int = 5


#: Statistics that rules may test, from the columns that text_statistics makes.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "bang_rate": "n_bangs / greatest(n_words, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
}


def _repeated(w: Column) -> Column:
    """Words of an array that lie in a 3-word window found twice or more, in n log n steps."""

    def covered(at: Column) -> Column:
        # sorted window starts: each adds the words that the one before has not covered
        added = F.transform(at, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - at.getItem(k - 1))))
        return F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)

    def equal_neighbour(s: Column):
        last = F.size(s) - 1
        return lambda x, k: ((k > 0) & (s.getItem(F.greatest(k - 1, F.lit(0)))["h"] == x["h"])) | (
            (k < last) & (s.getItem(F.least(k + 1, last))["h"] == x["h"])
        )

    def marked(tri: Column) -> Column:
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = bind(pairs, lambda s: F.transform(F.filter(s, equal_neighbour(s)), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(tri)) < F.size(tri), bind(F.sort_array(starts), covered)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(
        F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, w.getItem(i + 1), w.getItem(i + 2))
    )
    return F.when(F.size(w) >= 4, bind(windows, marked)).otherwise(F.lit(0).cast("long"))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with counts of words, characters, lines and repeats of each whole text.

    A null text has no words and counts 0 throughout. Windows of words are compared by a 64-bit
    hash. Existing columns with these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    of_words = bind(
        words(body),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    of_lines = bind(
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    counts = {"n_symbols": r"[#*$%&|<>]", "n_upper": r"\p{Lu}", "n_bangs": "!", "n_digits": "[0-9]"}
    names = ["n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines"]
    own = packed(docs, [*names, *counts], _w=of_words, _l=of_lines, **{c: F.regexp_count(body, F.lit(r)).cast("long") for c, r in counts.items()})
    return own.select(*rest_columns(own), *counts, *[F.col("_w" if c in names[:3] else "_l")[c].alias(c) for c in names])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def first_rule(rules: list[Rule]) -> Column:
    """Number from 1 of the first rule of the list that a row meets, else 0."""
    if not rules:
        return F.lit(0)
    out = F.when(holds(rules[0]), 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(holds(rule), i)
    return out.otherwise(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id") -> DataFrame:
    """Statistics and label (1: bad) of about p.sample_per_class documents of each class.

    Labels with nulls are left out; of repeated ids the worst label counts.
    """
    own = labels.where(f"{key} is not null and quality is not null").groupBy(key).agg((F.min("quality") <= 0).cast("int").alias("bad"))
    n = {r["bad"]: r["count"] for r in own.groupBy("bad").count().collect()}
    share = F.when(F.col("bad") == 1, p.sample_per_class / max(1, n.get(1, 0))).otherwise(p.sample_per_class / max(1, n.get(0, 0)))
    draw = F.pmod(F.xxhash64(key, F.lit("rules")), F.lit(1 << 30)) / float(1 << 30)
    picked = own.where(draw < share).withColumn("prune", F.pmod(F.xxhash64(key, F.lit("prune")), F.lit(3)) == 0)
    # about 2 * sample_per_class ids: bounded by the parameter
    found = text_statistics(docs.join(F.broadcast(picked), key).select("text", "bad", "prune"))
    return durable(found.where(~base_failed()).selectExpr("bad", "prune", *[f"{x} as {c}" for c, x in FEATURES.items()]), "sample")


def _gain(p: int, n: int, before: float) -> float:
    return p * (log2(p / (p + n)) - before) if p else 0.0


def learn(sample: DataFrame, p: Params = Params()) -> list[Rule]:
    """The decision list of a labelled sample; empty where no rule is precise enough.

    The driver only sees counts by statistic and threshold; ties go to the first in order.
    """
    names = list(FEATURES)
    probs = F.array(*[F.lit(i / (p.quantiles + 1)) for i in range(1, p.quantiles + 1)])
    cuts = sample.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in names]).first()
    if cuts is None or cuts[names[0]] is None:
        return []
    edges = {c: sorted(set(cuts[c])) for c in names}
    bins = [sum(((F.col(c) > float(e)).cast("int") for e in edges[c]), F.lit(0)) for c in names]
    binned = sample.select("bad", "prune", F.array(*bins).alias("bins"))
    binned = durable(binned.groupBy("bad", "prune", "bins").agg(F.count(F.lit(1)).alias("n")), "binned")

    def meets(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, cut in rule:
            out = out & (F.col("bins")[f] > cut if above else F.col("bins")[f] <= cut)
        return out

    def tally(where: Column) -> dict[tuple[int, int], tuple[int, int]]:
        counts = (
            binned.where(where).select("bad", "n", F.posexplode("bins").alias("f", "bin"))
            .groupBy("f", "bin").agg(F.sum(F.col("n") * F.col("bad")).alias("p"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("q"))
        )
        return {(r["f"], r["bin"]): (r["p"], r["q"]) for r in counts.collect()}  # features times quantiles rows

    found: list[list[tuple[int, bool, int]]] = []
    left = F.lit(True)
    for _ in range(p.max_rules):
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < p.max_conditions:
            counts = tally(left & ~F.col("prune") & meets(rule))
            total = [sum(v[i] for (f, _), v in counts.items() if f == 0) for i in (0, 1)]
            if not total[0] or not total[1]:
                break
            before, best = log2(total[0] / sum(total)), (0.0, None)
            for f, c in enumerate(names):
                low = [0, 0]
                for cut in range(len(edges[c])):
                    low = [low[i] + counts.get((f, cut), (0, 0))[i] for i in (0, 1)]
                    high = [total[i] - low[i] for i in (0, 1)]
                    for above, (bad, good) in ((False, low), (True, high)):
                        if bad >= p.min_covered and (g := _gain(bad, good, before)) > best[0] + 1e-9:
                            best = (g, (f, above, cut))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = binned.where(left & F.col("prune")).agg(
            *[F.sum(F.when(meets(rule[:k]), F.col("n") * F.col("bad"))).alias(f"p{k}") for k in range(1, len(rule) + 1)],
            *[F.sum(F.when(meets(rule[:k]), F.col("n"))).alias(f"n{k}") for k in range(1, len(rule) + 1)],
        ).first()
        precision = [((held[f"p{k}"] or 0) + 1) / ((held[f"n{k}"] or 0) + 2) for k in range(1, len(rule) + 1)]
        k = max(range(len(rule)), key=lambda i: (precision[i], -i))
        if (held[f"p{k + 1}"] or 0) < p.min_precision * (held[f"n{k + 1}"] or 0) or not held[f"n{k + 1}"]:
            break
        found.append(rule[: k + 1])
        left = left & ~meets(rule[: k + 1])
    return centred([tuple(Condition(names[f], above, float(edges[names[f]][cut])) for f, above, cut in rule) for rule in found], sample)


def centred(rules: list[Rule], sample: DataFrame) -> list[Rule]:
    """The rules with each threshold moved half way between the sample's values on its two sides."""
    flat = [c for rule in rules for c in rule]
    if not flat:
        return rules
    sides = sample.agg(
        *[F.max(F.when(F.col(c.feature) <= c.threshold, F.col(c.feature))).alias(f"a{i}") for i, c in enumerate(flat)],
        *[F.min(F.when(F.col(c.feature) > c.threshold, F.col(c.feature))).alias(f"b{i}") for i, c in enumerate(flat)],
    ).first()
    middle = {}
    for i, c in enumerate(flat):
        a, b = sides[f"a{i}"], sides[f"b{i}"]
        middle[c] = c if a is None or b is None else Condition(c.feature, c.above, (a + b) / 2)
    return [tuple(middle[c] for c in rule) for rule in rules]


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, rule (number of the first rule met, 0 if none) and kept."""
    out = stats.withColumns({"base_failed": base_failed(), "rule": first_rule(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op5_quality_decision_list(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(labelled_sample(docs, table(spark, sf_dir, "labels")))
    return judge(text_statistics(docs), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
