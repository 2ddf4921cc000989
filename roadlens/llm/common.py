"""Shared helpers: reading tables, cutting lineage in the shared folder, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

#: A word is a maximal run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to a Python worker: texts are long, and both sides hold whole batches.
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors, and the session's Arrow batches ARROW_BYTES at most."""
    shipping.ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset and all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again.

    Cuts the lineage; what is read back survives the loss of any executor and is the same on
    every read, which matters wherever row ids or several consumers are involved.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    if (scope := _scope.get()) is not None:
        scope.append(out)
    return out


_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that durable() writes in the block are deleted when it ends, but for those given to keep().

    What leaves the block must read kept tables only.
    """
    outer, own, kept = _scope.get(), [], []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.durable_path)
        if outer is not None:
            outer.append(table)
        return table

    token = _scope.set(own)
    try:
        yield keep
    finally:
        _scope.reset(token)
        release(*[x for x in own if x.durable_path not in kept])


def release(*tables: DataFrame) -> None:
    """Deletes tables that durable() wrote."""
    for x in tables:
        spark = x.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(x.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which the side of a join is broadcast; beyond that the join shuffles.
BROADCAST_BYTES = 32 << 20


def beside(rows: DataFrame, row_bytes: int | Column = 64) -> DataFrame:
    """rows, which a durable table holds, to be broadcast if their counted bytes are few."""
    size = F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))
    return F.broadcast(rows) if (rows.agg(size).first()[0] or 0) <= BROADCAST_BYTES else rows


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bind(value: Column, use) -> Column:
    """use(v) with v bound to value, which is then evaluated once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)




#: Bits of a filter of hashes: 4 MB to broadcast, whatever the number of hashes. Where it fills up,
#: more rows than need be take part in what follows, with the same result.
FILTER_BITS = 1 << 25


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """Bit array of FILTER_BITS bits with the places of the hashes in column h set."""
    place = F.col("h").bitwiseAND(FILTER_BITS - 1)
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("m"))
    # at most FILTER_BITS / 64 rows, as Arrow columns of 8 MB and not as Python objects
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return bits


def hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & (FILTER_BITS - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def packed(df: DataFrame, leave: list[str], **named: Column) -> DataFrame:
    """The columns of df but those to leave, as one struct _rest, and the named ones.

    Operators that pass columns through work on this form, so that no name a caller may use
    clashes with their own.
    """
    rest = [F.col(f"`{c}`").alias(c) for c in df.columns if c not in leave]
    return df.select(F.struct(*rest, F.lit(0).alias("_none")).alias("_rest"), *[c.alias(n) for n, c in named.items()])


def rest_columns(df: DataFrame) -> list[Column]:
    """The columns that packed() put away."""
    names = df.schema["_rest"].dataType.names
    return [F.col("_rest")[n].alias(n) for n in names[:-1]]
