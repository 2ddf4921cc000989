import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadlens.llm import fixity, queries, sharding, topk

from ..conftest import DATA
from ..test_oracle import rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def brute(rows, k):
    ok = {i: np.floor(1024 * np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % 100 == 0):
        scores = sorted(((-int(ok[q] @ x), i) for i, x in ok.items() if i != q and len(x) == len(ok[q])))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_topk_lengths_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 10 ** rng.uniform(-2, 1)).tolist()) for i in range(600)]
    rows += [(600 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(15)] + [(1000, None), (1100, [None, 1.0]), (1200, [float("nan")] * 6), (1300, [0.0] * 6), (1400, [1.0, 2.0])]
    rows += [(1500 + i, [50.0 + 0.01 * i, 0.02 * i, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, lambda c: c % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    assert topk.top_k(df.where("vec_id < 0"), lambda c: c % 100 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), lambda c: c == 0)
    assert few.count() == 2


def test_topk_pruning_keeps_the_best():
    rng = np.random.default_rng(5)
    x = np.floor(1024 * (rng.normal(size=(500, 8)) + 2)).astype(np.int64)
    import pandas as pd

    frame = lambda m, at: pd.DataFrame({"vec_id": np.arange(at, at + len(m)), "dim": 8, "length": np.sqrt((m**2).sum(1)), "v": [r.tobytes() for r in m]})
    q = frame(x[:5], 1000)
    scores = x[:5] @ x.T
    q["bound"] = np.sort(scores, 1)[:, -10].astype(float)
    got = topk.search_block(q, frame(x, 0), 10)
    for i in range(5):
        want = sorted(zip(-scores[i], range(500), strict=True))[:10]
        assert sorted(zip(-got[got["query_id"] == 1000 + i]["score"], got[got["query_id"] == 1000 + i]["vec_id"], strict=True)) == want


def test_shards(spark, hard, empty):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = sharding.with_slots(sharding.shard_rows(df, "doc_id"), "shard", ["doc_id"], 20_000, 24).toPandas()
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = rows[rows["shard"] != rows["grown_shard"]]
    assert set(moved["grown_shard"]) == {24} and 0.03 < len(moved) / len(rows) < 0.05
    counts = rows["shard"].value_counts()
    assert len(counts) == 24 and counts.min() > 650 and counts.max() < 1020
    out = sharding.with_slots(sharding.shard_rows(hard, "doc_id"), "shard", ["doc_id", "text"], hard.count(), 24)
    assert out.count() == hard.count() and set(out.columns) == set(hard.columns) | {"shard", "grown_shard", "slot"}
    assert out.where("doc_id = 7").select("shard").distinct().count() == 1
    assert sharding.with_slots(sharding.shard_rows(empty, "doc_id"), "shard", ["doc_id"], 0, 24).count() == 0


def test_weights_move_only_their_subtree(spark):
    df = spark.range(5_000)
    before, after = sharding.layout(24), sharding.layout(24, {5: 3.0})
    rows = df.select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b")).where("a <> b").toPandas()
    region = lambda s: s // 8
    assert len(rows) and all(region(b) == 0 for b in rows["b"])
    assert all(b == 5 or region(a) != 0 or a // 4 != b // 4 for a, b in zip(rows["a"], rows["b"], strict=True))


def test_audit(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 50) * 40) for i in range(300)] + [(None, None, None), (7, "u7", "again"), (7, "u7", "again")], "page_id long, url string, html string")
    a = fixity.warc_records(pages)
    assert fixity.audit(a, a).count() == 0
    victim = a.where("page_id = 123").first()
    b = a.withColumn("record", F.when(F.col("page_id") == 123, F.concat("record", F.lit("!"))).otherwise(F.col("record"))).where("page_id is null or page_id <> 200")
    got = {(r["byte_offset"], r["status"]) for r in fixity.audit(a, b).collect()}
    assert got == {(victim["byte_offset"], "corrupt"), (a.where("page_id = 200").first()["byte_offset"], "missing")}
    assert {r["status"] for r in fixity.audit(b, a).collect()} == {"corrupt", "extra"}
    none = a.where("page_id < 0")
    assert fixity.audit(none, none).count() == 0 and fixity.audit(a, none).count() == a.dropDuplicates(["archive", "byte_offset"]).count()


def test_audit_of_equal_keys_in_another_order(spark):
    """Rows of one page_id lie at the same offsets however they come, so equal replicas stay equal."""
    rows = [(i // 40 if i < 3900 else None, "u", f"page {i * 7919 % 4000:06d}") for i in range(4000)] + [(5, "u", "twice"), (5, "u", "twice")]
    schema = "page_id long, url string, html string"
    a = fixity.warc_records(spark.createDataFrame(rows, schema))
    b = fixity.warc_records(spark.createDataFrame(rows[::-1], schema).repartition(7))
    assert fixity.audit(a, b).count() == 0 and a.count() == len(rows)
    # offsets fill each archive without gaps
    for archive, own in a.select("archive", "byte_offset", "length").toPandas().groupby("archive"):
        own = own.sort_values("byte_offset")
        assert own["byte_offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]


def test_topk_blocks_that_no_bound_reaches_are_not_paired(spark, monkeypatch):
    """Queries near long vectors skip the classes of short ones, on both sides of the shuffle; nothing is lost."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=8) * 2.0 ** (i % 10) / 100).tolist()) for i in range(1200)]
    plans = []
    group = topk.Blocks.group
    monkeypatch.setattr(topk.Blocks, "group", lambda self, queries: plans.append(self) or group(self, queries))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, lambda c: c % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    plan = plans[0]
    met = sum(n * sum(p for c, p in plan.parts.items() if c >= least) for least, n in plan.count.items())
    assert met <= 0.6 * sum(plan.count.values()) * plan.n_blocks, (met, plan.count, plan.n_blocks)


def test_topk_of_components_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"), lambda c: c == 0).count()


def plain_shard(key, tree):
    """The shard of a key by walking the tree level by level in plain Python."""

    def draw(level, node, weight):
        h = 42
        for part in (("\0null" if key is None else str(key)).encode(), level.encode(), struct.pack("<i", node)):
            h = xxhash.xxh64(part, seed=h).intdigest()
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    own = [s for s in tree if s.weight > 0]
    for level in ("region", "rack", "shard"):
        weights = {}
        for s in own:
            weights[getattr(s, level)] = weights.get(getattr(s, level), 0.0) + s.weight
        best = min(weights, key=lambda n: (draw(level, n, weights[n]), n))
        own = [s for s in own if getattr(s, level) == best]
    return own[0].shard


def test_shards_as_a_plain_walk_of_the_tree(spark):
    df = spark.createDataFrame([(i,) for i in [*range(3000), None]], "doc_id long")
    for n, weights in ((24, None), (20, {3: 2.5, 7: 0.0}), (1, None)):
        tree = sharding.layout(n, weights)
        got = sharding.shard_rows(df, "doc_id", n, weights).collect()
        assert [(r["shard"], r["grown_shard"]) for r in got] == [(plain_shard(r["doc_id"], tree), plain_shard(r["doc_id"], sharding.grown(tree))) for r in got]
        # what moves goes to the new shard alone, whatever the number of shards
        assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {n}
        assert sum(r["grown_shard"] == n for r in got) <= 1.5 * len(got) / (n + 1) + 40
