import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadlens.llm import mixing, quality, toxicity

from ..conftest import DATA

WORDS = r"[^\x20\x09-\x0D]+"


def targets_by_hand(sizes):
    """Sources in order weigh 5, 2, 1; shares over twice the size are cut and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, rest = {}, set(order), 1.5 * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weight[s] / total for s in left}
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        left -= over
    return target


@pytest.mark.parametrize("which", ["data", "hard"])
def test_mix_meets_targets(spark, hard, which):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if which == "data" else hard
    rows = mixing.mix_counts(docs).join(docs.select("doc_id", "source"), "doc_id").distinct().collect() if which == "data" else mixing.mix_counts(docs).collect()
    assert all(0 <= r["copies"] <= 2 for r in rows)
    if which == "data":
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["copies"] * r["size"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        want = targets_by_hand(sizes)
        for r in rows:
            assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        for s in want:
            assert abs(taken[s] - want[s]) <= largest[s]
        again = mixing.mix_counts(docs).collect()
        assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in rows)
    else:
        assert len(rows) == hard.count()


def test_rates_solve_the_entropy_balancing_dual(spark):
    """Each source's rates are min(2, exp(tilt * size)) with the one tilt, found by bisection, that meets its target."""
    rows = mixing.mix_counts(spark.read.parquet(f"{DATA}/documents.parquet")).select("size", "source_size", "target", "rate").collect()
    of = defaultdict(list)
    for r in rows:
        of[r["source_size"], r["target"]].append(r)
    for (_, target), own in of.items():
        mean = sum(r["size"] for r in own) / len(own)
        tokens = lambda tilt: sum(r["size"] * min(2.0, math.exp(min(30.0, tilt * r["size"] / mean))) for r in own)  # noqa: B023, E731
        low, high = -400.0, mean * math.log(2)
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if tokens(middle) < target else (low, middle)
        for r in own:
            assert r["rate"] == pytest.approx(min(2.0, math.exp(min(30.0, low * r["size"] / mean))), rel=1e-5, abs=1e-9)


def test_mix_repeats_rows(hard, empty):
    mixed = mixing.mix(hard)
    assert mixed.columns == hard.columns
    counts = sum(r["copies"] for r in mixing.mix_counts(hard).collect())
    assert abs(mixed.count() - counts) <= 2
    assert mixing.mix(empty).count() == 0 and mixing.mix_counts(empty).count() == 0


def base_by_hand(text):
    text = text or ""
    w = re.findall(WORDS, text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(spark, hard, empty):
    for df in (hard, spark.read.parquet(f"{DATA}/documents.parquet")):
        for r in quality.text_statistics(df).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_by_hand(r["text"])
    assert quality.text_statistics(empty).count() == 0


def test_decision_list_learns_and_holds(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality.learn(quality.labelled_sample(docs, labels), quality.Params(min_covered=2))
    rows = quality.judge(quality.text_statistics(docs), rules).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.97
    assert quality.learn(quality.labelled_sample(docs, labels.where("doc_id < 0"))) == []
    stats = quality.text_statistics(docs)
    assert stats.where(quality.first_rule(rules) == 0).count() + stats.where(quality.first_rule(rules) > 0).count() == docs.count()


def test_learned_thresholds_find_a_conjunction(spark):
    rows = [(int(a > 6 and b > 6), (a + b) % 3 == 0, float(a), float(b)) for a in range(12) for b in range(12) for _ in range(3)]
    names = list(quality.FEATURES)
    df = spark.createDataFrame(rows, "bad int, prune boolean, x double, y double").selectExpr("bad", "prune", f"x as {names[0]}", f"y as {names[1]}", *[f"0d as {c}" for c in names[2:]])
    (rule,) = quality.learn(df)
    assert {(c.feature, c.above) for c in rule} == {(names[0], True), (names[1], True)} and all(6 < c.threshold < 7 for c in rule)


def test_toxicity_finds_planted_words(spark):
    words = [f"plain{i}" for i in range(50)]
    rows = [(i, " ".join(words[(i * 7 + k * 3) % 50] for k in range(30)) + (" awfulword" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    p = toxicity.Params()
    weights = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")), p)
    out = toxicity.score(docs, weights, p).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and all((r["score"] >= p.threshold) == (r["doc_id"] % 4 == 0) for r in held)
    assert (weights[:-1] != 0).sum() < 100


def test_toxicity_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    p = toxicity.Params()
    for found in (labels, labels.where("doc_id < 0")):
        out = toxicity.score(hard, toxicity.train(hard, found, p), p)
        rows = out.collect()
        assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows) and set(out.columns) == set(hard.columns)
    assert toxicity.drop_toxic(hard, labels.where("doc_id < 0")).count() == hard.count()
    assert toxicity.drop_toxic(empty, labels).count() == 0


def test_mix_gives_copies_to_the_right_source(spark):
    """Equal texts and keys in three sources, and rows equal in all columns: each source's words meet its target."""
    rows = [(k % 150, " ".join(f"w{k % 150}x{i}" for i in range(3 + k % 29)), source, k % 4) for k in range(400) for source in ("a", "b", "c", None) if source or k < 390]
    rows += [(7, "the same row again and again", "a", 0)] * 900 + [(None, None, "b", 1)] * 50 + [(8, "one key, rows of many kinds", "b", k) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long").repartition(6)
    counts = mixing.mix_counts(docs.withColumn("id", F.monotonically_increasing_id()), "id").select("target", "source_size", "size", "copies").collect()
    want = {(r["source_size"], r["target"]) for r in counts}
    mixed = mixing.mix(docs)
    got = mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words")).collect()
    given = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    targets = {size: target for size, target in want}
    assert len(targets) == len(given) == 4
    for r in got:
        assert abs(r["words"] - targets[given[r["source"]]]) <= 40
    before = {tuple(r): n for *r, n in docs.groupBy(*docs.columns).count().collect()}
    after = {tuple(r): n for *r, n in mixed.groupBy(*docs.columns).count().collect()}
    assert set(after) <= set(before) and all(n <= mixing.MAX_COPIES * before[r] for r, n in after.items())
    assert after[(None, None, "b", 1)] == 50
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))


def test_ftrl_as_a_plain_loop():
    """Weights equal those of the published per-coordinate updates, one feature at a time in Python floats."""
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 12)))) + (" awful" if k % 4 == 0 and k % 12 else "") for k in range(60)]
    frame = pd.DataFrame({"text": texts, "toxic": [int(k % 4 == 0) for k in range(60)], "_order": rng.permutation(60), "_share": [0.5 if k % 4 else 1.0 for k in range(60)]})
    p = toxicity.Params(bits=12, epochs=3, l1=0.3)
    got = {int(r.slot): r.weight for r in toxicity.fit(frame, p).itertuples()}

    ordered = sorted(frame.itertuples(), key=lambda r: (r._3, r.text))
    bags = []
    for r in ordered:
        bag = {-1}
        for slot, _ in toxicity.features(pa.array([r.text], pa.large_string()), p.bits):
            bag |= set(slot.tolist())
        bags.append(sorted(bag))
    count = Counter(x for bag in bags for x in bag)
    pos, neg = (sum(r.toxic == c for r in ordered) + 0.5 for c in (1, 0))
    prior = math.log(pos / neg)
    z, n = defaultdict(float), defaultdict(float)
    l1 = {x: 0.0 if x < 0 else p.epochs * p.l1 * math.sqrt(max(c, 1) * neg * pos) / len(ordered) for x, c in count.items()}

    def weight(x):
        if abs(z[x]) <= l1[x]:
            return 0.0
        return (math.copysign(l1[x], z[x]) - z[x]) / ((p.beta + math.sqrt(n[x])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for bag, r in zip(bags, ordered, strict=True):
            own = {x: weight(x) for x in bag}
            g = 1 / (1 + math.exp(-(prior + sum(own.values())))) - r.toxic
            for x, w in own.items():
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / p.alpha * w
                n[x] += g * g
    want = {x: weight(x) for x in count}
    want[-1] += prior + math.log(0.5 / 1.0)
    want = {x: w for x, w in want.items() if w}
    assert 3 < len(want) < len(count) and set(got) == set(want)
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def plain_rules(rows, p, names):
    """The decision list by brute force over rows (bad, prune, values), with the same thresholds to choose from."""
    edges = {c: sorted({v[c] for _, _, v in rows}) for c in names}
    found, left = [], rows

    def meets(rule, v):
        return all(v[c] > t if above else v[c] <= t for c, above, t in rule)

    for _ in range(p.max_rules):
        rule = []
        while len(rule) < p.max_conditions:
            own = [(bad, v) for bad, prune, v in left if not prune and meets(rule, v)]
            total = sum(bad for bad, _ in own), sum(1 - bad for bad, _ in own)
            if not total[0] or not total[1]:
                break
            before, best = math.log2(total[0] / sum(total)), (0.0, None)
            for c in names:
                for t in edges[c]:
                    for above in (False, True):
                        hit = [bad for bad, v in own if (v[c] > t if above else v[c] <= t)]
                        bad = sum(hit)
                        if bad >= p.min_covered and (g := bad * (math.log2(bad / len(hit)) - before)) > best[0] + 1e-9:
                            best = (g, (c, above, t))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = [(sum(bad for bad, prune, v in left if prune and meets(rule[:k], v)), sum(1 for _, prune, v in left if prune and meets(rule[:k], v))) for k in range(1, len(rule) + 1)]
        k = max(range(len(rule)), key=lambda i: ((held[i][0] + 1) / (held[i][1] + 2), -i))
        if held[k][0] < p.min_precision * held[k][1] or not held[k][1]:
            break
        found.append(rule[: k + 1])
        left = [r for r in left if not meets(rule[: k + 1], r[2])]
    return found


def test_decision_list_by_brute_force(spark):
    """Rules equal those of a search over every row, where the sample has no more values than quantiles."""
    rng = np.random.default_rng(21)
    names = list(quality.FEATURES)
    rows = []
    for k in range(900):
        v = {c: float(rng.integers(0, 8)) for c in names}
        bad = int((v[names[1]] >= 6 and v[names[2]] <= 3) or v[names[5]] >= 7 or rng.random() < 0.02)
        rows.append((bad, k % 3 == 0, v))
    p = quality.Params(quantiles=60)
    sample = spark.createDataFrame([(bad, prune, *v.values()) for bad, prune, v in rows], ", ".join(["bad int", "prune boolean", *(f"{c} double" for c in names)]))
    got = quality.learn(sample, p)
    want = plain_rules(rows, p, names)
    assert len(want) >= 2
    # thresholds lie half way to the next value
    assert [[(c.feature, c.above, math.floor(c.threshold)) for c in rule] for rule in got] == [[(c, above, int(t)) for c, above, t in rule] for rule in want]


def test_tilts_are_found_in_few_steps(spark, monkeypatch):
    """Each step is several jobs, and the driver keeps plans, threads and broadcasts of all of them."""
    wanted = {1: 0.8, 2: 1.6, 3: 1.72, 4: 1.76, 5: 1.9}
    rows = [(s, size, math.ceil(20000 / size)) for s in wanted for size in sorted({int(5 * 1.12**k) for k in range(74)})]
    histogram = spark.createDataFrame(rows, "s int, size long, n long")
    own = histogram.groupBy("s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), (F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    targets = own.withColumn("target", F.col("source_size") * F.element_at(F.array(*map(F.lit, wanted.values())), F.col("s"))).withColumn("source", F.col("s").cast("string"))
    tables = []
    whole = mixing.durable
    monkeypatch.setattr(mixing, "durable", lambda df, name: (tables.append(name), whole(df, name))[1])
    for r in mixing.solve_tilts(histogram, targets).collect():
        words = sum(n * size * min(2.0, math.exp(min(30.0, r["tilt"] * size / r["scale"]))) for s, size, n in rows if s == r["s"])
        assert abs(words / r["target"] - 1) < 1e-7
    assert tables.count("tilts") - 1 <= 8
