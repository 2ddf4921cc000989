"""Assignment of rows to columns of small cost matrices, and its use by frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def greedy(cost: np.ndarray) -> np.ndarray:
    """Column of each row, -1 if none: the cheapest pair goes first, the first in row order on ties.

    A cost that is not a number is never taken.
    """
    out = np.full(cost.shape[0], -1)
    left = np.where(np.isnan(cost), np.inf, cost)
    for _ in range(min(cost.shape)):
        i, j = np.unravel_index(np.argmin(left), left.shape)
        if not np.isfinite(left[i, j]):
            break
        out[i] = j
        left[i, :] = np.inf
        left[:, j] = np.inf
    return out


def optimal(cost: np.ndarray) -> np.ndarray:
    """Column of each row for the smallest total cost, by shortest augmenting paths."""
    if cost.size == 0:
        return np.full(cost.shape[0], -1)
    if cost.shape[0] > cost.shape[1]:
        columns = optimal(cost.T)
        out = np.full(cost.shape[0], -1)
        out[columns] = np.arange(cost.shape[1])
        return out
    n, m = cost.shape
    price_row, price_col, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        best, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column = start, -1
        while True:
            slack = cost[row] - price_row[row] - price_col + (best[column] if column >= 0 else 0.0)
            better = ~done & (slack < best)
            best[better], came[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, best)))
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        length = best[column]
        price_row[start] += length
        settled = np.flatnonzero(done & (owner >= 0))
        price_row[owner[settled]] += length - best[settled]
        price_col[done] -= length - best[done]
        while column >= 0:
            before = came[column]
            owner[column] = start if before < 0 else owner[before]
            column = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def assign(pairs: DataFrame, by: list[str], left: str, right: str, cost: str, mode: str = "greedy", gate: float | None = None) -> DataFrame:
    """by, left, right and cost of the pairs chosen in each group of cost rows.

    A group is one frame's matrix; pairs without a row cannot be chosen. With a gate, chosen pairs that cost
    more come undone: their row and column stay free, as they were taken by the choice.
    """
    ship(pairs.sparkSession)
    solve = greedy if mode == "greedy" else optimal
    columns = [*by, left, right, cost]
    # a frame's few cost rows make one array, so that a task takes many frames at once
    frames = pairs.select(*columns).groupBy(*by).agg(F.collect_list(F.struct(left, right, cost)).alias("_pairs"))

    def solve_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(by))
            at, values = lists.offsets.to_numpy(), lists.values
            l_values, r_values, c_values = (values.field(k) for k in range(3))
            ls, rs, cs = (x.to_numpy(zero_copy_only=False) for x in (l_values, r_values, c_values))
            frame, taken = [], []
            for f in range(batch.num_rows):
                own = slice(at[f], at[f + 1])
                rows, i = np.unique(ls[own], return_inverse=True)
                cols, j = np.unique(rs[own], return_inverse=True)
                costs = np.full((len(rows), len(cols)), np.nan)
                np.fmin.at(costs, (i, j), cs[own].astype(float))
                chosen = solve(costs if mode == "greedy" else np.where(np.isnan(costs), 1e12, costs))
                hit = np.flatnonzero((chosen[i] == j) & (cs[own] == costs[i, j]))
                _, first = np.unique(i[hit], return_index=True)
                taken.append(hit[first] + at[f])
                frame += [f] * len(first)
            which = pa.array(np.concatenate(taken) if taken else np.zeros(0, np.int64))
            whose = pa.array(frame, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(whose) for c in batch.columns[: len(by)]), *(x.take(which) for x in (l_values, r_values, c_values))], columns)

    chosen = frames.mapInArrow(solve_frames, pairs.select(*columns).schema)
    return chosen if gate is None else chosen.where(F.col(cost) <= gate)
