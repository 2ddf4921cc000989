"""Kernels of support vector models as functions of two vector columns; a user's own has the same form.

Vectors are dense arrays, or sparse structs of index (sorted array<int>) and value (array<double>).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[Column, Column], Column]


def dot(a: Column, b: Column) -> Column:
    """Of dense vectors of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def sparse(values: Column) -> Column:
    """A dense array as a sparse vector, with indices from 1."""
    own = F.filter(F.transform(values, lambda x, i: F.struct((i + 1).alias("i"), x.cast("double").alias("x"))), lambda p: p["x"] != 0)
    return F.struct(F.transform(own, lambda p: p["i"]).alias("index"), F.transform(own, lambda p: p["x"]).alias("value"))


def sparse_dot(a: Column, b: Column) -> Column:
    """Of sparse vectors: a merge of the two sorted index arrays, one step for each of their entries."""

    def step(at: Column, _: Column) -> Column:
        i, j = F.try_element_at(a["index"], at["i"]), F.try_element_at(b["index"], at["j"])
        product = F.try_element_at(a["value"], at["i"]) * F.try_element_at(b["value"], at["j"])
        add = F.when(i == j, product).otherwise(F.lit(0.0))
        one = F.lit(1)
        return F.struct(
            (at["i"] + F.when(i <= j, one).otherwise(F.lit(0))).alias("i"), (at["j"] + F.when(j <= i, one).otherwise(F.lit(0))).alias("j"), (at["s"] + F.coalesce(add, F.lit(0.0))).alias("s")
        )

    steps = F.sequence(F.lit(1), F.greatest(F.size(a["index"]) + F.size(b["index"]), F.lit(1)))
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0.0).alias("s"))
    return F.aggregate(steps, start, step, lambda at: at["s"])


def linear(of: Kernel = dot) -> Kernel:
    return of


def polynomial(degree: int, scale: float = 1.0, offset: float = 1.0, of: Kernel = dot) -> Kernel:
    return lambda a, b: F.pow(scale * of(a, b) + offset, F.lit(float(degree)))


def rbf(gamma: float, of: Kernel = dot) -> Kernel:
    return lambda a, b: F.exp(-gamma * (of(a, a) - 2 * of(a, b) + of(b, b)))


def sigmoid(scale: float = 1.0, offset: float = 0.0, of: Kernel = dot) -> Kernel:
    return lambda a, b: F.tanh(scale * of(a, b) + offset)
