"""Token-ID output in training order: fixed-stride binary shards.

Every sequence has a number in a dense range; a keyed Feistel permutation with cycle-walking maps
it to its slot, the training order is that of the slots. Slots are range-partitioned into shards,
and each shard is one file of equal records in slot order: record i begins at i * stride, so a
reader resumes anywhere. A text of b bytes owns the numbers of ceil((b + 1) / LENGTH) sequences, as
many as it could need at most; slots without a sequence take no place in the files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_tokenizer, vocabulary
from .bytehash import buffer_of, in_slices, mix
from .common import shared_path, ship, table

#: Tokens of a sequence and, about, sequences of a shard.
LENGTH, SHARD_ROWS = 256, 4096
ROUNDS = 4
#: Fields of a record before its tokens; after them comes one line feed, the text writer's row end.
HEAD = np.dtype([("key", "<i8"), ("seq", "<i4"), ("n_tokens", "<i4"), ("slot", "<i8")])


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of x under a permutation of 0 .. n - 1 that the key picks.

    Feistel rounds permute the next domain of 4**h values; images from n on are permuted again
    until they lie below n (cycle-walking), which takes fewer than four steps on average.
    """
    half = max(1, ceil((max(n, 2) - 1).bit_length() / 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + mix(np.array([key * ROUNDS + r], np.uint64))[0]) & mask)
        return left << shift | right

    out = once(np.asarray(x, np.uint64))
    while len(at := np.flatnonzero(out >= n)):
        out[at] = once(out[at])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shards:
    """A written set: <path>/shard=<i>/part-*, records of stride bytes."""

    path: str
    n_slots: int
    n_shards: int
    stride: int
    length: int
    width: int


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS, seed: int = 1) -> Shards:
    """Tokenises docs and writes all sequences, once through one shuffle.

    A text's tokens and one end token are cut every `length` tokens and padded with end tokens;
    null and empty texts have the end token alone, a null key is written as -1, repeated rows are
    sequences of their own. No rows: no files. docs should be a plain scan: sequences are numbered by
    partition, and a task whose rows are not those counted before fails rather than misnumber them.
    Files appear when the job commits, so lost executors only cost their tasks.
    """
    spark, where = docs.sparkSession, tokenizer or default_tokenizer()
    ship(spark)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    most = F.ceil((F.octet_length(F.coalesce("text", F.lit(""))) + 1) / length).cast("long")
    sums = dict(docs.select(F.spark_partition_id().alias("p"), most.alias("m")).groupBy("p").agg(F.sum("m")).collect())
    starts, total = {}, 0
    for p in sorted(sums):
        starts[p] = total
        total += sums[p]
    # about two bytes and a half make a token
    n_shards = max(1, ceil(total * 0.45 / shard_rows))
    vocab = vocabulary(where)
    width = np.dtype(vocab.dtype).itemsize
    stride = HEAD.itemsize + length * width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(where)
        end = next(iter(vocab.special.values()), vocab.size)
        p = TaskContext.get().partitionId()
        at = starts.get(p, 0)
        for batch in (part for whole in batches for part in in_slices(whole, "text", 1 << 19)):
            size = np.diff(buffer_of(batch.column(1))[1])
            coded = [np.array(vocab.encode(x or ""), vocab.dtype) for x in batch.column(1).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
            ids = np.concatenate(coded)
            many = np.diff(cuts) + 1
            pieces = -(-many // length)
            own = np.repeat(np.arange(len(many)), pieces)
            seq = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = at + np.concatenate([[0], np.cumsum((size + length) // length)])
            at = int(first[-1])
            rows = np.full((len(own), length), end, ids.dtype)
            # the end token is the padding already there
            place = np.repeat((np.cumsum(pieces) - pieces) * length - cuts[:-1], np.diff(cuts)) + np.arange(len(ids))
            rows.ravel()[place] = ids
            records = np.zeros(len(own), np.dtype([("head", HEAD), ("ids", np.uint8, length * width)]))
            keys = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            slot = feistel(first[own] + seq, total, seed)
            records["head"]["key"], records["head"]["seq"], records["head"]["slot"] = keys[own], seq, slot
            records["head"]["n_tokens"] = np.minimum(length, many[own] - seq * length)
            records["ids"] = rows.view(np.uint8).reshape(len(own), -1)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride - 1), len(own), [None, pa.py_buffer(records.tobytes())]).cast(pa.binary())
            shard = (slot.astype(object) * n_shards // max(1, total)).astype(np.int32) if total > 1 << 40 else (slot * n_shards // max(1, total)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), raw], ["shard", "slot", "record"])
        if at != starts.get(p, 0) + sums.get(p, 0):
            raise RuntimeError("the rows of a partition are not those that were counted")

    records = docs.mapInArrow(run, "shard int, slot long, record binary").repartition(n_shards, "shard").sortWithinPartitions("shard", "slot")
    records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    return Shards(path, total, n_shards, stride, length, width)


def read_shards(spark: SparkSession, shards: Shards) -> DataFrame:
    """shard, position (record in the shard), byte_offset, key, seq, n_tokens, slot and tokens."""
    ship(spark)
    if not spark._jvm.org.apache.hadoop.fs.Path(shards.path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(shards.path + "/shard=*")):
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(shards.path).select("shard", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = np.dtype([("head", HEAD), ("ids", np.uint8, shards.length * shards.width), ("end", "u1")])
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(content.as_buffer(), record)
                n, head = len(rows), rows["head"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n, dtype=np.int64)), pa.array(np.arange(n, dtype=np.int64) * shards.stride),
                        pa.array(head["key"].copy()), pa.array(head["seq"].copy()), pa.array(head["n_tokens"].copy()), pa.array(head["slot"].copy()),
                        pa.array([x.tobytes()[: k * shards.width] for x, k in zip(rows["ids"], head["n_tokens"], strict=True)], pa.binary()),
                    ],
                    ["shard", "position", "byte_offset", "key", "seq", "n_tokens", "slot", "tokens"],
                )

    return files.mapInArrow(parse, RECORDS)


RECORDS = "shard int, position long, byte_offset long, key long, seq int, n_tokens int, slot long, tokens binary"


def op3_token_shards_feistel(spark, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), shared_path(spark, "shards"))
    return read_shards(spark, shards).select(
        F.col("key").alias("doc_id"), "seq", "n_tokens", "slot", "shard", "position", "byte_offset", F.crc32("tokens").alias("tokens_crc32")
    )
