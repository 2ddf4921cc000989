"""Structured Streaming forms of the stateful operators: the batch kernels with kept state.

Rows of a key are sorted by frame inside each micro-batch; a frame must not be split over
micro-batches. Frames at or before the last one processed are late and dropped. Sessions need the
RocksDB state store provider (STATE_STORE).

Streams of several stateful steps hand the event time `ts` from one to the next: each step has the
watermark of the one before, and timers run on it, so that what is kept depends on the
data alone and not on when they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import DENSITY_LEVELS
from ..operators import pipelines, tracker
from ..operators.filters import lane_region
from ..shipping import ship

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Event time column, and how late a row may be.
TIME, DELAY = "ts", "10 minutes"


@dataclass(frozen=True)
class Nth:
    """Of each track's rows, or of those on whose trace (least_points or more) line_y lies, only the n-th."""

    n: int
    line_y: float | None = None
    least_points: int = 0

    def of(self, rows: pd.DataFrame, seen: dict[int, int]) -> pd.DataFrame:
        """rows of one key in order of frame and detection; seen counts the rows of each live track so far."""
        if self.line_y is not None:
            crossed = (rows["first_y"] - self.line_y) * (rows["py"] - self.line_y) <= 0
            rows = rows[crossed & (rows["n_points"] >= self.least_points)]
        keep = []
        for track in rows["track_no"]:
            seen[track] = seen.get(track, 0) + 1
            keep.append(seen[track] == self.n)
        return rows[pd.Series(keep, rows.index, bool)]


class TrackProcessor(StatefulProcessor):
    """Keeps one key's tracks.

    rule: a tracker.Crossing or an Nth that picks rows; its memory of live tracks is part of the state.
    carry: columns of a detection that its row keeps. When the watermark passes the key's last event
    time by idle_ms, the tracks go; the track numbers and the last frame stay, so that what
    comes later neither reuses a number nor goes back in time. With forget the key goes as a whole.
    """

    def __init__(self, params: tracker.Params, names: list[str], carry: list[str] = (), rule: Nth | tracker.Crossing | None = None, idle_ms: int | None = None, forget: bool = False):
        self.params, self.names, self.carry, self.rule, self.idle_ms, self.forget = params, names, list(carry), rule, idle_ms, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracks", "raw binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        crossing = self.rule if isinstance(self.rule, tracker.Crossing) else None
        tracks, last, marks = tracker.load(bytes(held[0]) if held else None, set() if crossing else {})
        own = pd.concat(list(rows), ignore_index=True)
        found, last = tracker.run_frames(tracks, own, self.params, last, crossing, marks if crossing else None)
        out = tracker.frame_of(found)
        if isinstance(self.rule, Nth):
            out = self.rule.of(out, marks)
            live = set(tracks.ids.tolist())
            for gone in [t for t in marks if t not in live]:
                del marks[gone]
        self.state.update((tracker.dump(tracks, last, marks),))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(int(own[TIME].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        if self.carry:
            of = own.drop_duplicates(["frame_id", "det_id"])[["frame_id", "det_id", *self.carry]]
            out = out.merge(of, on=["frame_id", "det_id"], how="left")
        if len(out):
            yield out.assign(**dict(zip(self.names, key, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.forget:
            self.state.clear()
        elif self.state.exists():
            tracks, last, marks = tracker.load(bytes(self.state.get()[0]), {})
            self.state.update((tracker.dump(tracker.Tracks(next_id=tracks.next_id), last, type(marks)()),))
        return iter(())

    def close(self) -> None:
        pass


def _tracked(
    rows: DataFrame, params: tracker.Params, key: list[str], carry: list[str] = (), rule: Nth | tracker.Crossing | None = None, idle_ms: int | None = None, forget: bool = False
) -> DataFrame:
    """The tracker over a stream with the event time TIME and a watermark; TIME is handed on."""
    ship(rows.sparkSession)
    carry = [*carry, TIME]
    kinds = dict(rows.dtypes)
    own = rows.select(*dict.fromkeys([*key, "frame_id", "det_id", "cx", "cy", *carry])).dropna(subset=["frame_id", "cx", "cy", TIME])
    schema = ", ".join([tracker.OUTPUT, *(f"{c} {kinds[c]}" for c in [*carry, *key])])
    return own.groupBy(*key).transformWithStateInPandas(
        TrackProcessor(params, key, carry, rule, idle_ms, forget), outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=TIME
    )


def track_stream(detections: DataFrame, params: tracker.Params = tracker.Params(), idle_ms: int | None = None, key: tuple[str, ...] = ("camera_id",)) -> DataFrame:
    """tracker.track over a stream.

    With idle_ms, detections have the event time TIME under a watermark, and tracks of a key
    go when the watermark has passed its last detection by idle_ms. That should cover the frames that a
    track may skip; then the rows are those of the batch tracker.
    """
    if idle_ms is not None:
        return _tracked(detections, params, list(key), idle_ms=idle_ms)
    ship(detections.sparkSession)
    rows = detections.select(*key, "frame_id", "det_id", "cx", "cy").dropna(subset=["frame_id", "cx", "cy"])
    types = ", ".join(f"{c} {dict(detections.dtypes)[c]}" for c in key)
    return rows.groupBy(*key).transformWithStateInPandas(TrackProcessor(params, list(key)), outputStructType=f"{tracker.OUTPUT}, {types}", outputMode="Append", timeMode="None")


class SignalProcessor(StatefulProcessor):
    """Carries a camera's light state and the number of its phase from frame to frame."""

    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "red boolean, phase long, frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        red, phase, last = self.state.get() if self.state.exists() else (False, 0, -1)
        own = pd.concat(list(rows)).sort_values("frame_idx")
        own = own[own["frame_idx"] > last]
        if not len(own):
            return
        clear_red = own["red"] & ~own["yellow"] & ~own["green"]
        clear_green = own["green"] & ~own["red"] & ~own["yellow"]
        known = clear_red.astype(float).where(clear_red | clear_green)
        states = known.ffill().fillna(float(red)) > 0.5
        phases = phase + (states != states.shift(fill_value=red)).cumsum()
        self.state.update((bool(states.iloc[-1]), int(phases.iloc[-1]), int(own["frame_idx"].iloc[-1])))
        out = pd.DataFrame({"camera_id": key[0], "frame_idx": own["frame_idx"], "is_red": states, "phase": phases})
        yield out.assign(**{TIME: own[TIME]}) if self.timed else out

    def close(self) -> None:
        pass


def signal_stream(signals: DataFrame) -> DataFrame:
    """windows.signal_state over a stream, with the number of the phase."""
    ship(signals.sparkSession)
    rows = signals.select("camera_id", "frame_idx", "red", "yellow", "green")
    return rows.groupBy("camera_id").transformWithStateInPandas(
        SignalProcessor(False), outputStructType="camera_id long, frame_idx long, is_red boolean, phase long", outputMode="Append", timeMode="None"
    )


def phase_stream(signals: DataFrame, delay: str = DELAY) -> DataFrame:
    """signal_stream that hands on the event time TIME of the signals."""
    ship(signals.sparkSession)
    rows = signals.select("camera_id", "frame_idx", "red", "yellow", "green", TIME).withWatermark(TIME, delay)
    return rows.groupBy("camera_id").transformWithStateInPandas(
        SignalProcessor(True), outputStructType=f"camera_id long, frame_idx long, is_red boolean, phase long, {TIME} timestamp",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName=TIME,
    )


class DensityProcessor(StatefulProcessor):
    """Keeps the last n - 1 percentages of a camera."""

    def __init__(self, roi_area: int, n: int):
        self.roi_area, self.n = roi_area, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "frame long, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, held = self.ring.get() if self.ring.exists() else (-1, [])
        own = pd.concat(list(rows))
        percent = (own[own["frame_id"] > last].groupby("frame_id")["area"].sum() * 100.0 / self.roi_area).round(4)
        values = pd.Series([*held, *percent])
        means = values.rolling(self.n, min_periods=1).mean().iloc[len(held) :].round(4).to_numpy()
        if len(percent):
            self.ring.update((int(percent.index[-1]), [float(x) for x in values.iloc[max(0, len(values) - self.n + 1) :]]))
        levels = [next((name for top, name in DENSITY_LEVELS if m < top), "Too crowded") for m in means]
        yield pd.DataFrame({"camera_id": key[0], "frame_id": percent.index, "percent": percent.to_numpy(), "mean_percent": means, "level": levels})

    def close(self) -> None:
        pass


def density_stream(detections: DataFrame, roi_area: int, n: int) -> DataFrame:
    """pipelines.density over a stream."""
    ship(detections.sparkSession)
    return detections.select("camera_id", "frame_id", "area").groupBy("camera_id").transformWithStateInPandas(
        DensityProcessor(roi_area, n), outputStructType="camera_id long, frame_id long, percent double, mean_percent double, level string",
        outputMode="Append", timeMode="None",
    )


def attach_plates_stream(events: DataFrame, plates: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events wait for their plate's text at most `delay`; without one they are not written.

    events: event_id, ts; plates: event_id, plate_ts, plate, confidence. Both sides have
    watermarks, so the waiting events are bounded.
    """
    left = events.withWatermark("ts", delay)
    right = plates.withColumnRenamed("event_id", "_event").withWatermark("plate_ts", delay)
    late = (F.col("plate_ts") >= F.col("ts")) & (F.col("plate_ts") <= F.col("ts") + F.expr(f"interval {delay}"))
    return left.join(right, (F.col("event_id") == F.col("_event")) & late).drop("_event")


def first_events_stream(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts_stream(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by camera and tumbling window, written once the watermark has passed."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "camera_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "camera_id", "n")


def red_light_stream(
    detections: DataFrame, signals: DataFrame, line_y: float, params: tracker.Params = tracker.Params(), delay: str = DELAY, idle_ms: int | None = None
) -> DataFrame:
    """pipelines.red_light over two streams: each track of a red phase once, in the frame it first crosses the line.

    Lights become phases by camera; detections (frame_idx, ts) meet the phase of their frame, which has
    the same ts; those of red frames are tracked by (camera, phase). A phase does not come back, so its
    state goes as a whole when the watermark has passed its last detection by idle_ms.
    """
    phases = phase_stream(signals, delay).where("is_red").select(F.col("camera_id").alias("_c"), F.col("frame_idx").alias("_f"), F.col(TIME).alias("_t"), "phase")
    seen = detections.withWatermark(TIME, delay).join(phases, (F.col("camera_id") == F.col("_c")) & (F.col("frame_idx") == F.col("_f")) & (F.col(TIME) == F.col("_t")))
    return _tracked(seen.drop("_c", "_f", "_t"), params, ["camera_id", "phase"], rule=Nth(1, line_y, 2), idle_ms=idle_ms, forget=True)


def lane_violations_stream(detections: DataFrame, line_y: float, params: tracker.Params = tracker.Params(), delay: str = DELAY, idle_ms: int | None = None) -> DataFrame:
    """pipelines.lane_violations over a stream: a tracker by camera, then one by camera and class that confirms."""
    tracked = _tracked(detections.withWatermark(TIME, delay), params, ["camera_id"], ["cx", "cy", "area"], idle_ms=idle_ms)
    crossed = tracked.where(((F.col("first_y") - line_y) * (F.col("py") - line_y) <= 0) & (F.col("n_points") >= 3))
    again = crossed.withColumn("vehicle", _kind()).select("camera_id", "vehicle", "frame_id", "det_id", "cx", "cy", TIME)
    return _tracked(again, params, ["camera_id", "vehicle"], rule=Nth(2), idle_ms=idle_ms)


def _kind() -> Column:
    return F.when(F.col("area") < 900, "bike").otherwise("car")


def lane_violations_region_stream(
    detections: DataFrame, cells: DataFrame, bike: tuple[int, int], car: tuple[int, int], params: tracker.Params = tracker.Params(), delay: str = DELAY, idle_ms: int | None = None
) -> DataFrame:
    """pipelines.lane_violations_region over a stream; cells is a static table."""
    own = detections.withWatermark(TIME, delay)
    bikes = lane_region(own, cells, *bike, tall=True).withColumn("vehicle", F.lit("bike"))
    cars = lane_region(own, cells, *car, tall=False).withColumn("vehicle", F.lit("car"))
    return _tracked(bikes.unionByName(cars), params, ["camera_id", "vehicle"], rule=Nth(2), idle_ms=idle_ms)


def plate_scans_stream(
    detections: DataFrame, cells: DataFrame, least: int, most: int, params: tracker.Params = tracker.Params(), delay: str = DELAY, idle_ms: int | None = None
) -> DataFrame:
    """pipelines.plate_scans over a stream."""
    own = lane_region(detections.withWatermark(TIME, delay), cells, least, most, tall=False)
    return _tracked(own, params, ["camera_id"], rule=Nth(2), idle_ms=idle_ms)


class CountProcessor(StatefulProcessor):
    """A key's rows counted so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get()[0] if self.state.exists() else 0
        own = pd.concat(list(rows)).sort_values([TIME, "frame_id"])
        self.state.update((before + len(own),))
        yield pd.DataFrame({"camera_id": key[0], "vehicle": key[1], "n": range(before + 1, before + len(own) + 1), TIME: own[TIME].to_numpy()})

    def close(self) -> None:
        pass


def _counted(rows: DataFrame) -> DataFrame:
    """camera_id, vehicle, n and ts: the count after each vehicle."""
    return rows.select("camera_id", "vehicle", "frame_id", TIME).groupBy("camera_id", "vehicle").transformWithStateInPandas(
        CountProcessor(), outputStructType=f"camera_id long, vehicle string, n long, {TIME} timestamp", outputMode="Append", timeMode="EventTime", eventTimeColumnName=TIME
    )


def vehicle_counts_stream(
    detections: DataFrame, line_y: float, least_points: int = 3, params: tracker.Params = tracker.Params(), delay: str = DELAY, idle_ms: int | None = None
) -> DataFrame:
    """pipelines.vehicle_counts over a stream: a tracker by camera latches each track that crosses, then counts by class grow."""
    once = _tracked(detections.withWatermark(TIME, delay), params, ["camera_id"], ["area"], Nth(1, line_y, least_points + 1), idle_ms)
    return _counted(once.withColumn("vehicle", _kind()))


def night_counts_stream(
    lights: DataFrame, matrix: list[float], line_y: float, params: tracker.Params = pipelines.NIGHT, least_points: int = pipelines.NIGHT_POINTS, delay: str = DELAY, idle_ms: int | None = None
) -> DataFrame:
    """pipelines.night_counts over a stream of frames (camera_id, frame_id, ts, lights)."""
    vehicles = pipelines.night_vehicles(lights.withWatermark(TIME, delay), matrix)
    once = _tracked(vehicles, params, ["camera_id"], ["vehicle"], tracker.Crossing(line_y, least_points, unmatched_ends=True), idle_ms)
    return _counted(once)
