"""All queries over the driver's tables, by name, with their SQL counterparts."""

from __future__ import annotations

from . import aggregates, filters, joins, learning, ranking, tracking, windows  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["a1_count_crossings"](spark, sf_dir)
