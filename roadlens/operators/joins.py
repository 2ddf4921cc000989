"""Joins of detections, tracks, regions and plates. Every theta join carries an equality key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..shipping import ship

FRAME = ["camera_id", "frame_id"]


def pairs_within(df: DataFrame, predicate: Callable, by: list[str], key: str = "det_id", cell: int | None = None) -> DataFrame:
    """Pairs a < b of rows of one group that meet predicate(a, b), functions from name to Column.

    With `cell`, only rows whose cx lies in the same or the next cell meet, for groups with many
    rows; the predicate must then imply |cx difference| < cell.
    """
    keys = list(by)
    left, right = df, df
    if cell:
        place = F.floor(F.col("cx") / cell)
        left = left.withColumn("_cell", F.explode(F.array(place - 1, place, place + 1)))
        right = right.withColumn("_cell", place)
        keys.append("_cell")
    left = left.select(*[F.col(k).alias(k) for k in keys], F.struct(*df.columns).alias("_a"))
    right = right.select(*keys, F.struct(*df.columns).alias("_b"))
    met = left.join(right, keys).where((F.col(f"_a.{key}") < F.col(f"_b.{key}")) & predicate(F.col("_a"), F.col("_b")))
    return met.drop("_cell") if cell else met


def near(dx: int, dy: int) -> Callable:
    return lambda a, b: (F.abs(a["cx"] - b["cx"]) < dx) & (F.abs(a["cy"] - b["cy"]) < dy)


def overlapping(touching: bool) -> Callable:
    def meets(a: Column, b: Column) -> Column:
        if touching:
            return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])
        return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])

    return meets


def tracks_cross_lines(tracks: DataFrame, lines: DataFrame) -> DataFrame:
    """Tracks whose segment from first to last point meets a line of their camera.

    lines is a dimension of a few rows a camera; Spark broadcasts it by its size.
    """
    met = tracks.join(lines, "camera_id")
    return met.where(geo.intersects(*[F.col(c).cast("double") for c in ("first_x", "first_y", "last_x", "last_y", "x1", "y1", "x2", "y2")]))


def points_in_boxes(points: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """For each point the first box (smallest box_id) that holds it; right and bottom edges are outside."""
    met = points.join(boxes, by).where((F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h")))
    return met.groupBy("point_id").agg(F.min("box_id").alias("box_id"))


def signal_at(det: DataFrame, states: DataFrame) -> DataFrame:
    """Each detection with the last state at or before its frame: union, then a carried value."""
    a = det.select("camera_id", "frame_idx", "det_id", F.lit(None).cast("boolean").alias("state"), F.lit(1).alias("_o"))
    b = states.select("camera_id", "frame_idx", F.lit(None).cast("long").alias("det_id"), F.col("is_red").alias("state"), F.lit(0).alias("_o"))
    w = Window.partitionBy("camera_id").orderBy("frame_idx", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("state", F.last("state", ignorenulls=True).over(w)).where("_o = 1").drop("_o")


def contained_groups(groups: DataFrame, by: list[str], eps: float = 0.2) -> DataFrame:
    """Groups (gid, x, y, w, h, n) without those inside a stronger group's box, enlarged by eps."""
    a = groups.select(*by, F.struct("gid", "x", "y", "w", "h", "n").alias("_a"))
    b = groups.select(*by, F.struct("gid", "x", "y", "w", "h", "n").alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    dx, dy = F.floor(y["w"] * eps), F.floor(y["h"] * eps)
    inside = (
        (x["gid"] != y["gid"]) & (x["x"] >= y["x"] - dx) & (x["y"] >= y["y"] - dy) & (x["x"] + x["w"] <= y["x"] + y["w"] + dx)
        & (x["y"] + x["h"] <= y["y"] + y["h"] + dy) & ((y["n"] > F.greatest(F.lit(3), x["n"])) | (x["n"] < 3))
    )
    weak = a.join(b, by).where(inside).select(F.col("_a.gid").alias("gid")).distinct()
    return groups.join(weak, "gid", "left_anti")


def rank_pairs(df: DataFrame) -> DataFrame:
    """Pairs a < b of one query with different ranks: target +-1 and the difference of their vectors."""
    met = pairs_within(df, lambda a, b: a["rank"] != b["rank"], ["qid"], key="id")
    return met.select(
        "qid", F.col("_a.id").alias("a"), F.col("_b.id").alias("b"), F.when(F.col("_a.rank") > F.col("_b.rank"), 1).otherwise(-1).alias("target"),
        F.zip_with("_a.q", "_b.q", lambda x, y: x - y).alias("q"),
    )


#: Rows of a block of rank_distances, about, and blocks of a query at least.
BLOCK_ROWS, BLOCKS = 8192, 4


def rank_distances(df: DataFrame) -> DataFrame:
    """qid, a, b, target and l1 of the pairs of rank_pairs(df): l1 is the sum of absolute differences of whole-number vectors.

    The rows of a query are dealt into blocks by a hash of their id, every two blocks meet in one place, and rows stream from
    there, so a task holds two blocks and the pairs of one row. l1 is null where a vector is null, holds a null, or the two differ in length.
    """
    ship(df.sparkSession)
    own = df.where("qid is not null and id is not null and rank is not null").select("qid", "id", "rank", "q")
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int")
    own = own.join(own.groupBy("qid").agg(blocks.alias("_n")), "qid").withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    own = own.select("qid", F.least("_k", "_other").alias("_lo"), F.greatest("_k", "_other").alias("_hi"), "_k", "id", "rank", "q")
    cells = own.repartition("qid", "_lo", "_hi").sortWithinPartitions("qid", "_lo", "_hi", "_k")
    kinds = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            begin = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            for start, end in zip(begin, [*begin[1:], len(keys)], strict=True):
                if start < end:
                    if keys[start] != at and parts:
                        yield from _cell_pairs(pa.concat_tables(parts))
                        parts = []
                    at = keys[start]
                    parts.append(rows.slice(start, end - start))
        if parts:
            yield from _cell_pairs(pa.concat_tables(parts))

    return cells.mapInArrow(run, f"qid {kinds['qid']}, a {kinds['id']}, b {kinds['id']}, target int, l1 long")


def _cell_pairs(cell: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of the two blocks of a cell, or of its one block, in batches of about 2^17."""
    cell = cell.combine_chunks()
    qid, ids, rank, block = cell["qid"][0], cell["id"].to_numpy(), cell["rank"].to_numpy(), cell["_k"].to_numpy()
    if cell["_lo"][0] == cell["_hi"][0]:
        first = second = np.arange(len(ids))
    else:
        first, second = (np.flatnonzero(block == cell[c][0].as_py()) for c in ("_lo", "_hi"))
    # rows whose vectors can be compared, by length; place: a row's number there
    of = cell["q"].combine_chunks()
    of = of.chunk(0) if isinstance(of, pa.ChunkedArray) else of
    size = np.array([-1 if v is None else v for v in pc.list_value_length(of).to_pylist()])
    if of.flatten().null_count:
        size[np.unique(pc.list_parent_indices(of).to_numpy()[pc.is_null(of.flatten()).to_numpy(zero_copy_only=False)])] = -1
    vectors = {}
    for n in set(size.tolist()) - {-1}:
        rows = np.flatnonzero(size == n)
        made = of.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
        small = n and max(abs(int(made.min())), abs(int(made.max()))) * 2 * n < 2**31
        place = np.full(len(ids), -1)
        place[rows] = np.arange(len(rows))
        vectors[n] = made.astype(np.int32 if small else np.int64), place
    out, held = [], 0
    for i in first:
        met = second[rank[second] != rank[i]]
        met = met[ids[met] > ids[i]] if first is second else met[ids[met] != ids[i]]
        if not len(met):
            continue
        l1, known = np.zeros(len(met), np.int64), (size[met] == size[i]) & (size[i] >= 0)
        if known.any():
            x, place = vectors[size[i]]
            l1[known] = np.abs(x[place[met[known]]] - x[place[i]]).sum(1, dtype=np.int64)
        ahead = ids[met] > ids[i]
        higher = np.where(ahead, rank[i] > rank[met], rank[met] > rank[i])
        out.append((np.where(ahead, ids[i], ids[met]), np.where(ahead, ids[met], ids[i]), np.where(higher, 1, -1).astype(np.int32), l1, ~known))
        held += len(met)
        if held >= 1 << 17:
            yield _pair_batch(qid, out)
            out, held = [], 0
    if out:
        yield _pair_batch(qid, out)


def _pair_batch(qid: pa.Scalar, out: list[tuple]) -> pa.RecordBatch:
    a, b, target, l1, unknown = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.repeat(qid, len(a)), pa.array(a), pa.array(b), pa.array(target), pa.array(l1, mask=unknown)], ["qid", "a", "b", "target", "l1"])


def pair_model_lookup(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """Model of two classes, whichever comes first; null where there is none."""
    own = models.select(F.least("m1", "m2").alias("_lo"), F.greatest("m1", "m2").alias("_hi"), "model")
    key = (F.least("c1", "c2") == F.col("_lo")) & (F.greatest("c1", "c2") == F.col("_hi"))
    return pairs.join(own, key, "left").drop("_lo", "_hi")
