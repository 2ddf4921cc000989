"""Tracker and assignment against plain references."""

import itertools

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from roadlens.operators import cluster, pipelines, tracker, windows
from roadlens.operators.assignment import greedy, optimal
from roadlens.operators.joins import near, pairs_within


def test_optimal_is_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 20, (n, m)).astype(float)
        got = optimal(cost)
        total = cost[np.flatnonzero(got >= 0), got[got >= 0]].sum()
        small, large = (cost, cost.shape) if n <= m else (cost.T, cost.T.shape)
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large[1]), large[0]))
        assert total == best and (got >= 0).sum() == min(n, m)


def test_greedy_order_and_nan():
    assert greedy(np.array([[3.0, 1.0, 2.0], [1.0, 1.0, 5.0]])).tolist() == [1, 0]
    assert greedy(np.array([[np.nan, 4.0], [np.nan, 2.0]])).tolist() == [-1, 1]
    assert greedy(np.zeros((0, 3))).tolist() == []


def plain_kalman(points, dt=0.2, accel=0.5):
    """One track that is matched with every point after the first, written out step by step."""
    f = np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    q = accel * np.array([[dt**4 / 4, 0, dt**3 / 2, 0], [0, dt**4 / 4, 0, dt**3 / 2], [dt**3 / 2, 0, dt**2, 0], [0, dt**3 / 2, 0, dt**2]])
    h = np.eye(4)[:2]
    x, c, out = np.array([*points[0], 0, 0], float), 0.1 * np.eye(4), []
    for z in points:
        x, c = f @ x, f @ c @ f.T + q
        k = c @ h.T @ np.linalg.inv(h @ c @ h.T + 0.1 * np.eye(2))
        x, c = x + k @ (np.array(z) - h @ x), c - k @ h @ c
        out.append(x[:2].copy())
    return np.array(out)


def test_single_track_follows_kalman():
    points = [(10.0 + 5 * i, 20.0 + 3 * i) for i in range(8)]
    p, tracks = tracker.Params(), tracker.Tracks()
    for z in points:
        tracker.update(tracks, np.array([z]), p)
    assert len(tracks.ids) == 1
    np.testing.assert_allclose(np.array(tracks.traces[0]), plain_kalman(points), atol=1e-9)


def test_two_objects_gap_and_expiry():
    rows = [(f, 10 * f + k, 10 + 5 * f if k == 0 else 300 - 5 * f, 50.0 + 100 * k) for f in range(6) for k in range(2)]
    rows += [(9, 91, 10 + 45, 50.0)]
    out, last = tracker.run_frames(tracker.Tracks(), pd.DataFrame(rows, columns=["frame_id", "det_id", "cx", "cy"]), tracker.Params(), None)
    found = tracker.frame_of(out)
    assert found["track_no"].nunique() == 2 and last == 9
    assert found[found["det_id"] == 91]["track_no"].iloc[0] == found[found["det_id"] == 0]["track_no"].iloc[0]
    tracks = tracker.Tracks()
    tracker.update(tracks, np.array([[1.0, 1.0]]), tracker.Params(max_skip=2))
    for _ in range(3):
        tracker.update(tracks, np.zeros((0, 2)), tracker.Params(max_skip=2))
    assert len(tracks.ids) == 0


def test_gate_rejection_opens_a_track_without_ageing():
    p, tracks = tracker.Params(distance=50.0), tracker.Tracks()
    tracker.update(tracks, np.array([[0.0, 0.0]]), p)
    got = tracker.update(tracks, np.array([[500.0, 0.0]]), p)
    assert got.tolist() == [-1] and len(tracks.ids) == 2 and tracks.skipped.tolist() == [0, 0] and tracks.traces[1] == []


def test_histories_in_small_batches(spark):
    """Frames and keys that begin and end within Arrow batches, and a null key."""
    rng = np.random.default_rng(8)
    rows = [(None if c == 3 else c, f"k{c % 2}", f, 1000 * c + 10 * f + i, float(40 * i + 3 * f), float(rng.integers(0, 9))) for c in range(5) for f in range(30) if rng.random() < 0.8 for i in range(rng.integers(1, 5))]
    rows += [(9, "k1", None, 1, 1.0, 1.0), (9, "k1", 1, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "camera_id long, kind string, frame_id long, det_id long, cx double, cy double").orderBy("cy")
    want = []
    for c in (0, 1, 2, None, 4):
        own = pd.DataFrame([r[2:] for r in rows if r[0] == c], columns=["frame_id", "det_id", "cx", "cy"])
        want += [(c, *r) for r in tracker.run_frames(tracker.Tracks(), own, tracker.Params(), None)[0]]
    for size in ("10000", "7", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = tracker.track(df, ["camera_id", "kind"]).drop("kind").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tracker.track(df.limit(0), ["camera_id"]).count() == 0


def test_stretches_are_tracked_apart(spark, monkeypatch):
    """Histories with gaps equal the sequential tracker, numbers included, in more tasks than keys."""
    rng = np.random.default_rng(11)
    rows = []
    for c in (0, 1, None):
        f = int(rng.integers(0, 5))
        for _ in range(120):
            rows += [(c, f, 1000 * f + i, float(60 * i + rng.integers(0, 30)), float(rng.integers(0, 99))) for i in range(int(rng.integers(1, 4)))]
            f += int(rng.choice([1, 1, 1, 2, 6, 7, 8, 40, 900]))
    df = spark.createDataFrame(rows, "camera_id long, frame_id long, det_id long, cx double, cy double")
    p = tracker.Params(max_skip=5)
    want = []
    for c in (0, 1, None):
        own = pd.DataFrame([r[1:] for r in rows if r[0] == c], columns=["frame_id", "det_id", "cx", "cy"])
        want += [(c, *r) for r in tracker.run_frames(tracker.Tracks(), own, p, None)[0]]
    for bucket in (16, 1 << 12):
        monkeypatch.setattr(tracker, "BUCKET", bucket)
        cut = tracker.segments(df, ["camera_id"], p)
        frames = {c: sorted({r[1] for r in rows if r[0] == c}) for c in (0, 1, None)}
        begins = {(c, f) for c, fs in frames.items() for f, before in zip(fs, [None, *fs], strict=False) if before is None or f - before > 6}
        assert {tuple(r) for r in cut.select("camera_id", "_segment").distinct().collect()} == begins and len(begins) > 30
        assert cut.where("_segment > frame_id").count() == 0 and cut.count() == len(rows)
        got = tracker.track(df, ["camera_id"], p)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def plain_night(frames, line_y, least):
    """The night counter written out: groups by repeated merging, counts by walking every track after every frame."""
    tracks, counted, out = tracker.Tracks(), set(), {"car": 0, "bike": 0}
    p = tracker.Params(distance=30.0, cos=-0.5)
    last = None
    for f, lights in frames:
        for _ in range(0 if last is None else min(f - last - 1, 6)):
            tracker.age(tracks, p)
        last = f
        groups = [[x] for x in lights]
        merged = True
        while merged:
            merged = False
            for i in range(len(groups)):
                for j in range(i + 1, len(groups)):
                    if any(abs(a[0] - b[0]) < 160 and abs(a[1] - b[1]) < 60 for a in groups[i] for b in groups[j]):
                        groups[i] += groups.pop(j)
                        merged = True
                        break
                if merged:
                    break
        centres = np.array([np.mean(g, 0) for g in groups])
        found = tracker.update(tracks, centres, p)
        for t, trace in zip(tracks.ids.tolist(), tracks.traces, strict=True):
            if len(trace) > least and t not in counted and (trace[0][1] - line_y) * (trace[-1][1] - line_y) <= 0:
                counted.add(t)
                for g, own in zip(groups, found, strict=True):
                    if own == t:
                        wide = max(x for x, _ in g) - min(x for x, _ in g) > 20
                        out["car" if len(g) > 1 and wide else "bike"] += 1
    return out


def test_night_counting_of_a_scene(spark):
    """A car of two lights and a bike drive over the line; another bike is hidden just as it crosses."""
    frames = []
    for f in range(24):
        lights = [(100.0, 20.0 + 8 * f), (150.0, 22.0 + 8 * f), (500.0, 190.0 - 7 * f)]
        if not 11 <= f <= 13:
            lights.append((900.0, 10.0 + 8 * f))
        frames.append((f, lights))
    rows = [(1, f, [(10 * f + k, x, y) for k, (x, y) in enumerate(lights)]) for f, lights in frames]
    df = spark.createDataFrame(rows, "camera_id long, frame_id long, lights array<struct<det_id long, cx double, cy double>>")
    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    for line in (100.0, 110.0, 60.0, 500.0):
        got = {r["vehicle"]: r["n"] for r in pipelines.night_counts(df, same, line).collect()}
        assert got == {k: n for k, n in plain_night(frames, line, 5).items() if n}
    assert plain_night(frames, 100.0, 5) == {"car": 1, "bike": 1} and plain_night(frames, 60.0, 5) == {"car": 1, "bike": 2}
    assert pipelines.night_counts(df.limit(0), same, 100.0).count() == 0


def test_fold_gives_the_closure_of_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, int(rng.integers(0, 900)), int(rng.integers(0, 300))) for g in range(30) for i in range(100 * g, 100 * g + int(rng.integers(1, 25)))]
    df = spark.createDataFrame(rows, "g long, det_id long, cx long, cy long")
    edges = pairs_within(df, near(120, 60), ["g"]).select(F.col("_a.det_id").alias("a"), F.col("_b.det_id").alias("b"))
    want = cluster.cluster(df.select(F.col("det_id").alias("node")), edges)
    got = cluster.cluster_groups(df, ["g"], near(120, 60))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert cluster.cluster_groups(df.limit(0), ["g"], near(1, 1)).count() == 0


def test_prefix_sums(spark):
    rows = [(k, i * 37 % 400 - 50, i) for k in (1, 2, None) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    for width in (7, 1000):
        got = windows.prefix_sums(df, "v", ["k"], "at", width, "before").collect()
        assert len(got) == len(rows)
        assert all(r["before"] == sum(v for k, at, v in rows if k == r["k"] and at < r["at"]) for r in got)
