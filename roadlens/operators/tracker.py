"""Stateful tracker of points per key: one numpy kernel for batch and stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .assignment import greedy
from .cluster import checkpointed
from .windows import prefix_sums, same_keys


@dataclass(frozen=True)
class Params:
    distance: float = 120.0
    cos: float = 0.0
    max_skip: int = 5
    max_trace: int = 10
    dt: float = 0.2
    accel: float = 0.5
    big: float = 1e6


@dataclass
class Tracks:
    """All tracks of one key as arrays; traces as lists of points."""

    next_id: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    skipped: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    state: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    cover: np.ndarray = field(default_factory=lambda: np.zeros((0, 4, 4)))
    predicted: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    traces: list = field(default_factory=list)

    def keep(self, mask: np.ndarray) -> None:
        for name in ("ids", "skipped", "state", "cover", "predicted"):
            setattr(self, name, getattr(self, name)[mask])
        self.traces = [t for t, k in zip(self.traces, mask, strict=True) if k]

    def open(self, points: np.ndarray) -> None:
        n = len(points)
        self.ids = np.concatenate([self.ids, np.arange(self.next_id, self.next_id + n)])
        self.next_id += n
        self.skipped = np.concatenate([self.skipped, np.zeros(n, np.int64)])
        self.state = np.concatenate([self.state, np.hstack([points, np.zeros((n, 2))])])
        self.cover = np.concatenate([self.cover, np.repeat(0.1 * np.eye(4)[None], n, 0)])
        self.predicted = np.concatenate([self.predicted, points])
        self.traces += [[] for _ in range(n)]


def cost_matrix(tracks: Tracks, points: np.ndarray, p: Params) -> np.ndarray:
    """Distance to the prediction, gated; with a trace weighed by the change of direction."""
    d = np.linalg.norm(tracks.predicted[:, None] - points[None], axis=2)
    cost = np.where(d > p.distance, p.big, d)
    long = np.array([len(t) > 1 for t in tracks.traces], bool)
    if long.any():
        last = np.array([t[-1] for t, k in zip(tracks.traces, long, strict=True) if k])
        moved = last - np.array([t[-2] for t, k in zip(tracks.traces, long, strict=True) if k])
        ahead = points[None] - last[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            cos = (moved[:, None] * ahead).sum(2) / np.sqrt((moved**2).sum(1)[:, None] * (ahead**2).sum(2))
            own = d[long]
            gate = (own > p.distance) | (np.abs(cos) < p.cos) | ((own > p.distance / 2) & (cos < -0.3))
            cost[long] = np.where(gate, p.big, own * np.exp((1 - np.abs(cos)) / 2))
    return cost


def age(tracks: Tracks, p: Params) -> None:
    """An empty frame: all tracks age, those too old go."""
    tracks.skipped = tracks.skipped + 1
    tracks.keep(tracks.skipped <= p.max_skip)


def update(tracks: Tracks, points: np.ndarray, p: Params) -> np.ndarray:
    """One frame. Returns the track of each detection, -1 where it opens a track that has no point yet.

    Pairs whose cost is over the distance are undone without ageing the track; tracks without a
    pair age. Tracks opened for left-over detections get their first point in the next frame, the
    others are predicted and corrected with their detection or with their own prediction.
    """
    if not len(points):
        age(tracks, p)
        return np.zeros(0, np.int64)
    if not len(tracks.ids):
        tracks.open(points)
    cost = cost_matrix(tracks, points, p)
    chosen = greedy(cost)
    tracks.skipped[chosen < 0] += 1
    for i in np.flatnonzero(chosen >= 0):
        if cost[i, chosen[i]] > p.distance:
            chosen[i] = -1
    alive = tracks.skipped <= p.max_skip
    tracks.keep(alive)
    chosen = chosen[alive]
    older = len(tracks.ids)
    free = np.setdiff1d(np.arange(len(points)), chosen[chosen >= 0])
    tracks.open(points[free])
    # Kalman: constant velocity, positions measured
    t = p.dt
    f = np.eye(4)
    f[0, 2] = f[1, 3] = t
    q = p.accel * np.kron(np.array([[t**4 / 4, t**3 / 2], [t**3 / 2, t**2]]), np.eye(2))
    x = tracks.state[:older] @ f.T
    c = f @ tracks.cover[:older] @ f.T + q
    hit = chosen >= 0
    measured = x[:, :2].copy()
    measured[hit] = points[chosen[hit]]
    gain = c[:, :, :2] @ np.linalg.inv(c[:, :2, :2] + 0.1 * np.eye(2)) if older else np.zeros((0, 4, 2))
    x = x + (gain @ (measured - x[:, :2])[:, :, None])[:, :, 0]
    tracks.state[:older], tracks.cover[:older], tracks.predicted[:older] = x, c - gain @ c[:, :2, :], x[:, :2]
    tracks.skipped[:older][hit] = 0
    out = np.full(len(points), -1)
    for i in range(older):
        trace = tracks.traces[i]
        if len(trace) > p.max_trace:
            del trace[: len(trace) - p.max_trace]
        trace.append(tuple(x[i, :2]))
        if hit[i]:
            out[chosen[i]] = tracks.ids[i]
    return out


@dataclass(frozen=True)
class Crossing:
    """A vehicle counts once, in the frame in which the trace of its track (more than least_points
    points) reaches the other side of line_y. A crossing of a track without a detection in that frame
    is not counted; with unmatched_ends the track's chance is gone then, as in the night counter."""

    line_y: float
    least_points: int
    unmatched_ends: bool = False

    def of(self, tracks: Tracks, matched: np.ndarray, counted: set[int]) -> np.ndarray:
        """Which of the matched tracks (one for each detection, -1 for none) count now; counted gets them."""
        at = {int(t): k for k, t in enumerate(matched) if t >= 0}
        out = np.zeros(len(matched), bool)
        for i, trace in zip(tracks.ids.tolist(), tracks.traces, strict=True):
            if i in counted or len(trace) <= self.least_points or (trace[0][1] - self.line_y) * (trace[-1][1] - self.line_y) > 0:
                continue
            if i in at or self.unmatched_ends:
                counted.add(i)
            if i in at:
                out[at[i]] = True
        counted &= set(tracks.ids.tolist())
        return out


OUTPUT = "frame_id long, det_id long, track_no long, n_points long, px double, py double, first_x double, first_y double"


def run_frames(
    tracks: Tracks, rows: pd.DataFrame, p: Params, last: int | None, crossing: Crossing | None = None, counted: set[int] | None = None
) -> tuple[list[tuple], int | None]:
    """Feeds frames in order, missing frame numbers as empty frames. Rows need frame_id, det_id, cx, cy."""
    return run_arrays(tracks, *(rows[c].to_numpy() for c in ("frame_id", "det_id", "cx", "cy")), p, last, crossing, counted)


def run_arrays(
    tracks: Tracks, frames: np.ndarray, dets: np.ndarray, xs: np.ndarray, ys: np.ndarray, p: Params, last: int | None,
    crossing: Crossing | None = None, counted: set[int] | None = None,
) -> tuple[list[tuple], int | None]:
    """OUTPUT rows of the matched detections, or of those that count with a crossing; counted is kept from call to call."""
    if not len(frames):
        return [], last
    counted = set() if counted is None else counted
    order = np.lexsort((dets, frames))
    frames, dets, points = frames[order], dets[order], np.column_stack([xs[order], ys[order]]).astype(float)
    begin = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1))
    out = []
    for start, end in zip(begin, np.append(begin[1:], len(frames)), strict=True):
        frame = int(frames[start])
        if last is not None and frame <= last:
            continue  # late: that frame is over
        for _ in range(0 if last is None else min(frame - last - 1, p.max_skip + 1)):
            age(tracks, p)
        found = update(tracks, points[start:end], p)
        wanted = found >= 0 if crossing is None else crossing.of(tracks, found, counted)
        at = {t: i for i, t in enumerate(tracks.ids)}
        for det, t in zip(dets[start:end][wanted], found[wanted], strict=True):
            trace = tracks.traces[at[t]]
            out.append((frame, int(det), int(t), len(trace), *map(float, trace[-1]), *map(float, trace[0])))
        last = frame
    return out, last


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def track_short(df: DataFrame, key: list[str], p: Params = Params()) -> DataFrame:
    """track for keys that end after few rows, such as the phases of a signal: a key's rows make one array, and a task takes many keys at once."""
    ship(df.sparkSession)
    ready = df.select(*key, "frame_id", "det_id", "cx", "cy").dropna(subset=["frame_id", "cx", "cy"])
    histories = ready.groupBy(*key).agg(F.collect_list(F.struct("frame_id", "det_id", "cx", "cy")).alias("_rows"))
    names = [c.split() for c in OUTPUT.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(key))
            at, columns = lists.offsets.to_numpy(), [lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
            rows, whose = [], []
            for k in range(batch.num_rows):
                found, _ = run_arrays(Tracks(), *(c[at[k] : at[k + 1]] for c in columns), p, None)
                rows += found
                whose += [k] * len(found)
            of = pa.array(whose, pa.int64())
            made = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(of) for c in batch.columns[: len(key)]), *(pa.array(list(x), types[t]) for x, (_, t) in zip(made, names, strict=True))],
                [*key, *(n for n, _ in names)],
            )

    return histories.mapInArrow(run, ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in key), OUTPUT]))


#: Frames of a key that lie in one bucket where histories are cut; openings are summed by as many.
BUCKET = 1 << 12


def segments(df: DataFrame, key: list[str], p: Params) -> DataFrame:
    """df with _segment: the first frame of the stretch that a row lies in.

    After more than max_skip empty frames no track is left, so what follows is tracked apart.
    Gaps are found in buckets of BUCKET frames; only one row a bucket meets the others of its key.
    """
    gap = p.max_skip + 1
    own = df.withColumn("_b", F.floor(F.col("frame_id") / BUCKET))
    inside = Window.partitionBy(*key, "_b").orderBy("frame_id")
    begins = F.when(F.col("frame_id") - F.lag("frame_id").over(inside) > gap, F.col("frame_id"))
    own = own.withColumn("_begin", begins)
    own = own.withColumn("_begin", F.max("_begin").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    buckets = own.groupBy(*key, "_b").agg(F.min("frame_id").alias("_lo"), F.max("frame_id").alias("_hi"), F.max("_begin").alias("_last"))
    along = Window.partitionBy(*key).orderBy("_b")
    entered = F.when(F.coalesce(F.col("_lo") - F.lag("_hi").over(along) > gap, F.lit(True)), F.col("_lo"))
    buckets = buckets.withColumn("_entered", entered)
    before = F.last(F.coalesce("_last", "_entered"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(*[F.col(k).alias(f"_of_{k}") for k in [*key, "_b"]], F.coalesce("_entered", before).alias("_open"))
    joined = own.join(buckets, same_keys([*key, "_b"], "_of_"))
    return joined.withColumn("_segment", F.coalesce("_begin", "_open")).select(*df.columns, "_segment")


def track(df: DataFrame, key: list[str], p: Params = Params(), crossing: Crossing | None = None) -> DataFrame:
    """Matched detections (key columns and OUTPUT) of each key's frames; with a crossing those that count.

    A key's history is cut where more than max_skip frames are empty: no track lives on, so the
    stretches are tracked in tasks of their own and their track numbers shifted by how many tracks the earlier ones opened.
    A stretch is a sequence and cannot be split; its frames pass in order through a
    task that holds the live tracks and one Arrow batch, so its memory does not grow with the
    history. Rows with a null frame or point take no part; rows with a null key are one key.
    """
    ship(df.sparkSession)
    by = [*key, "_segment"]
    ready = segments(df.select(*key, "frame_id", "det_id", "cx", "cy").dropna(subset=["frame_id", "cx", "cy"]), key, p)
    schema = ", ".join([*(f"{c} {dict(ready.dtypes)[c]}" for c in by), OUTPUT])

    def ended(tracks: Tracks, of: pd.Series) -> pd.DataFrame:
        # n_points -1: not a detection, track_no says how many tracks the stretch opened
        return _keyed([(0, 0, tracks.next_id, -1, 0.0, 0.0, 0.0, 0.0)], of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tracks, last, counted = None, Tracks(), None, set()
        for own in batches:
            # the last frame of a batch may go on in the next one
            own = own if held is None else pd.concat([held, own], ignore_index=True)
            if not len(own):
                continue
            begin = _begins(own, by)
            done = begin[-1] + int(np.searchsorted(own["frame_id"].to_numpy()[begin[-1] :], own["frame_id"].iloc[-1]))
            for k, (start, end) in enumerate(zip(begin, [*begin[1:], done], strict=True)):
                if k:
                    yield ended(tracks, own[by].iloc[begin[k - 1]])
                    tracks, last, counted = Tracks(), None, set()
                out, last = run_frames(tracks, own.iloc[start:end], p, last, crossing, counted)
                yield _keyed(out, own[by].iloc[start])
            held = own.iloc[done:]
        if held is not None:
            yield _keyed(run_frames(tracks, held, p, last, crossing, counted)[0], held[by].iloc[0])
            yield ended(tracks, held[by].iloc[0])

    tracked = checkpointed(ready.repartition(*by).sortWithinPartitions(*by, "frame_id", "det_id").mapInPandas(run, schema))
    opened = tracked.where("n_points = -1").select(*by, F.col("track_no").alias("_opened"))
    shift = prefix_sums(opened, "_opened", key, "_segment", BUCKET * 16, "_shift").select(*[F.col(k).alias(f"_of_{k}") for k in by], "_shift")
    own = tracked.where("n_points <> -1").join(shift, same_keys(by, "_of_"))
    return own.withColumn("track_no", F.col("track_no") + F.col("_shift")).select(*key, *[c.split()[0] for c in OUTPUT.split(", ")])


def _begins(rows: pd.DataFrame, key: list[str]) -> list[int]:
    """Where runs of equal keys begin."""
    before, now = rows[key].shift(), rows[key]
    other = ~((now == before) | (now.isna() & before.isna())).all(axis=1).to_numpy()
    return [0, *(int(k) for k in np.flatnonzero(other) if k)]


def _keyed(rows: list[tuple], key: pd.Series) -> pd.DataFrame:
    out = frame_of(rows)
    for i, (c, v) in enumerate(key.items()):
        out.insert(i, c, v)
    return out


def dump(tracks: Tracks, last: int | None, marks: dict | set) -> bytes:
    return pickle.dumps((tracks, last, marks))


def load(raw: bytes | None, marks: dict | set) -> tuple[Tracks, int | None, dict | set]:
    return pickle.loads(raw) if raw else (Tracks(), None, marks)
