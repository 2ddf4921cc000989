"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct shingles of five words, in the order unique ones (no partner),
rare ones, frequent ones; classes go by corpus count. Two documents of similarity 0.8 share two
tokens of their prefixes, extended by one. A rare prefix token is indexed singly. Where the prefix
reaches into the frequent class, combinations are indexed as well: the set is dealt by token hash
into groups of a few tokens, one of which must be as similar as the whole sets are (their
similarity is a weighted mean of the groups'), and of each group's prefix, extended to share COMBINED
tokens, every combination of that many is a key. So the keys of a set grow with its size only.

Documents with one shingle set are one node. A node carries its number of unique tokens and a
parity sketch of the others; both bound the symmetric difference from below, so pairs that
cannot be similar never leave a join. First each node meets the most central node of each key,
then, across the components that this gives, the nodes outside a key's largest component meet
all of the key. Every pair that passes is verified exactly.

Classes come from a table of fixed size, so they are a function of the token, whatever the corpus:
where the table fills up more tokens count as frequent, and only the work grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import buffer_of, in_slices, lut_of, mix, word_hashes
from .common import durable, hash_filter, hits, packed, rest_columns, scratch, ship, table
from .components import components

WORDS, SIMILARITY = 5, 80
#: Tokens found more often are frequent. Slots of the class table (2 bits each), at most as a power of 2.
FREQUENT, SLOT_BITS = 8, 27
#: Tokens of a combination, and the mean size of the smallest groups that sets are dealt into.
COMBINED, GROUP = 4, 3
#: Longs of a parity sketch.
SKETCH = 8
#: Tokens that a task counts before it passes them on; tokens of a counting group, as a power of 2.
FLUSH, GROUP_BITS, REST = 1 << 22, 17, 24
_LUT = lut_of(lambda b: b not in (32, 9, 10, 11, 12, 13), True)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of each text, repeats included, and where each text's begin (n + 1)."""
    data, offsets = buffer_of(column)
    hashes, at = word_hashes(data, offsets, _LUT)
    n = np.diff(at)
    many = np.maximum(n - WORDS + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(many)])
    own = np.repeat(np.arange(len(n)), many)
    first = at[own] + np.arange(starts[-1]) - starts[own]
    have = np.minimum(n[own], WORDS)
    padded = np.append(hashes, np.zeros(WORDS, np.uint64))
    total = have.astype(np.uint64)
    for k in range(WORDS):
        total = total * _STEP + np.where(have > k, padded[first + k], np.uint64(0))
    return mix(total), starts


def token_sets(column: pa.Array) -> list[np.ndarray]:
    h, at = shingle_hashes(column)
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def node_of(tokens: np.ndarray) -> bytes | None:
    """Identity of a token set, None for the empty one."""
    if not len(tokens):
        return None
    return np.array([mix(tokens).sum(dtype=np.uint64), mix(tokens + _STEP).sum(dtype=np.uint64)], np.uint64).tobytes()


def prefix_length(n: int) -> int:
    return n - (SIMILARITY * n + 99) // 100 + 1


def size_classes(n: int) -> set[int]:
    """Powers of 2 of the sizes from n to n / 0.8: of two similar sets the smaller has the larger's."""
    return {n.bit_length() - 1, (n * 100 // SIMILARITY).bit_length() - 1}


@lru_cache(None)
def _choices(of: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(of), k)), np.int64)


def keys_of(tokens: np.ndarray, shared: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Index keys of one token set; shared and frequent are the tokens' classes."""
    n = len(tokens)
    if n < 4:  # smaller sets are only like themselves
        return np.zeros(0, np.uint64)
    reach = prefix_length(n) + 1
    rank = np.where(frequent, 2, shared.astype(np.int8))
    unique, rare = int((rank == 0).sum()), tokens[rank == 1]
    out = [mix(rare[: max(0, reach - unique)])]
    if unique + len(rare) < reach:
        out += [x for c in size_classes(n) for x in _group_keys(tokens, rank, c)]
    return np.unique(np.concatenate(out))


def _group_keys(tokens: np.ndarray, rank: np.ndarray, size_class: int) -> Iterator[np.ndarray]:
    """Keys of the groups of a set; combinations that hold a unique token have no partner and go."""
    groups = (1 << size_class) // GROUP + 1
    group = mix(tokens ^ np.uint64(size_class + 1)) % np.uint64(groups)
    order = np.lexsort((tokens, rank, group))
    tokens, rank, group = tokens[order], rank[order], group[order]
    begin = np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1))
    sizes = np.diff(np.append(begin, len(tokens)))
    for size in np.unique(sizes):
        k = min(COMBINED, int(size))  # groups of fewer tokens are only like themselves
        chosen = _choices(prefix_length(int(size)) + k - 1, k)
        first = begin[sizes == size]
        at = first[:, None, None] + chosen[None]
        have = (rank[at] > 0).all(axis=2)
        total = np.repeat((group[first] * _STEP + np.uint64(size_class * 64 + k))[:, None], len(chosen), 1)
        for j in range(k):
            total = mix(total) * _STEP + tokens[at[:, :, j]]
        yield mix(total[have])


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens in 64 * SKETCH hash ranges, as longs.

    Two sets' sketches differ in at most as many bits as the sets differ in tokens.
    """
    odd = np.bincount((mix(tokens ^ _STEP) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    return (part for whole in batches for part in in_slices(whole, text))


def packed_numbers(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Runs of rising numbers below 2^28, which begin at `begin`, each as the gaps between them, 7 bits a byte, low ones first."""
    gaps = values.astype(np.int64)
    gaps[1:] -= values[:-1].astype(np.int64)
    gaps[begin] = values[begin]
    many = 1 + (gaps >= 1 << 7).astype(np.int64) + (gaps >= 1 << 14) + (gaps >= 1 << 21)
    ends = np.cumsum(many)
    out = np.zeros(ends[-1], np.uint8)
    for k in range(4):
        own = many > k
        out[(ends - many)[own] + k] = (gaps[own] >> 7 * k) & 127 | np.where(many[own] > k + 1, 128, 0)
    cuts = np.append((ends - many)[begin], ends[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked_numbers(run: bytes) -> np.ndarray:
    """The numbers of one run of packed_numbers."""
    raw = np.frombuffer(run, np.uint8)
    first = np.flatnonzero(np.append(True, raw[:-1] < 128))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.uint32) << (7 * place).astype(np.uint32), first), dtype=np.uint32)


def token_classes(docs: DataFrame, text: str, n_tokens: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit tables of slots with a token that occurs twice, and with one over FREQUENT times.

    Sorted token hashes are counted in groups of the hash space; a token goes into a group at most
    FREQUENT + 1 times from each FLUSH tokens, so none makes a group large. The tables' size is
    bounded by SLOT_BITS.
    """
    bits = max(1, ceil(log2(max(2, n_tokens))))
    slot_bits = min(SLOT_BITS, max(14, bits + 3))
    group_bits = min(max(6, bits - GROUP_BITS), slot_bits - 3)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held) >> np.uint64(64 - group_bits - REST), return_counts=True)
            value = np.repeat(value, np.minimum(n, FREQUENT + 1))
            group = (value >> np.uint64(REST)).astype(np.int64)
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            held.clear()
            return pa.RecordBatch.from_pydict({"g": group[begin], "v": packed_numbers(value & np.uint64((1 << REST) - 1), begin)})

        for batch in _slices(batches, text):
            h = shingle_hashes(batch.column(batch.schema.get_field_index(text)))[0]
            if len(h):
                held.append(h)
            if sum(map(len, held)) > FLUSH:
                yield flush()
        if held:
            yield flush()

    def classify(group: pd.DataFrame) -> pd.DataFrame:
        value, n = np.unique(np.concatenate([unpacked_numbers(v) for v in group["v"]]), return_counts=True)
        slot = value >> np.uint32(REST - (slot_bits - group_bits)) if slot_bits - group_bits <= REST else value
        out = [np.zeros(1 << (slot_bits - group_bits), bool) for _ in range(2)]
        out[0][slot[n > 1]] = True
        out[1][slot[n > FREQUENT]] = True
        return pd.DataFrame({"g": group["g"].iloc[:1], "s": [np.packbits(out[0]).tobytes()], "f": [np.packbits(out[1]).tobytes()]})

    found = docs.select(text).mapInArrow(count, "g long, v binary").groupBy("g").applyInPandas(classify, "g long, s binary, f binary").toPandas()
    width = (1 << (slot_bits - group_bits)) // 8
    tables = [np.zeros((1 << group_bits, width), np.uint8) for _ in range(2)]
    for g, s, f in zip(found["g"], found["s"], found["f"], strict=True):
        tables[0][g], tables[1][g] = np.frombuffer(s, np.uint8), np.frombuffer(f, np.uint8)
    return tables[0].ravel(), tables[1].ravel(), slot_bits


def _bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def similar_nodes(docs: DataFrame, nodes: DataFrame, n_tokens: int) -> DataFrame:
    """node and component of every shingle set that is like another one.

    docs: _text and _hash, the text's hash. nodes: node and _hash of a text that has it.
    """
    with scratch() as keep:
        index = durable(_index(docs, n_tokens), "index")
        pairs = durable(_central_pairs(index), "pairs")
        edges = _linked(pairs, docs, nodes)
        found = components(edges)
        across = durable(_pairs_across(index, found), "across")
        more = _linked(across, docs, nodes)
        return keep(found if more.isEmpty() else components(edges.union(more)))


def _index(docs: DataFrame, n_tokens: int) -> DataFrame:
    """node, n (tokens), u (unique ones), sketch and keys of each node that has keys."""
    classes = docs.sparkSession.sparkContext.broadcast(token_classes(docs, "_text", n_tokens))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, frequent, slot_bits = classes.value
        for batch in _slices(batches, "_text"):
            rows = []
            for tokens in token_sets(batch.column(0)):
                slot = (tokens >> np.uint64(64 - slot_bits)).astype(np.int64)
                twice, often = _bit(shared, slot), _bit(frequent, slot)
                keys = keys_of(tokens, twice, often)
                if len(keys):
                    alone = ~twice & ~often
                    rows.append((node_of(tokens), len(tokens), int(alone.sum()), sketch_of(tokens[~alone]), keys.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * len(_INDEX)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _INDEX.values(), strict=True)], list(_INDEX))

    schema = "node binary, n int, u int, sketch array<long>, keys array<long>"
    return docs.select("_text").mapInArrow(index, schema).dropDuplicates(["node"])


_INDEX = {"node": pa.binary(), "n": pa.int32(), "u": pa.int32(), "sketch": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}


def _bits(index: DataFrame, *more: str) -> DataFrame:
    """What is compared of each node. A node has many keys, so rows of keys get it once few are left."""
    return index.select("node", "n", "u", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)], *more)


def _as_other(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_2" for c in rows.columns if c != "key"})


def _may_be_similar() -> Column:
    """False only for pairs below the threshold: the sets differ in at least so many tokens."""
    apart = F.col("u") + F.col("u_2")
    for k in range(SKETCH):
        apart += F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_2")))
    # intersection / union = (n + n_2 - difference) / (n + n_2 + difference)
    return (100 - SIMILARITY) * (F.col("n") + F.col("n_2")) >= (100 + SIMILARITY) * apart


def _pair() -> list[Column]:
    return [F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")]


def _central_pairs(index: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the node of fewest unique tokens of each of its keys."""
    slim = index.select(F.explode("keys").alias("key"), "node", "u")
    hub = slim.groupBy("key").agg(F.min(F.struct("u", "node")).alias("_hub"), F.min("node").alias("_a"), F.max("node").alias("_b"))
    hub = hub.where("_a <> _b").select("key", F.col("_hub.node").alias("node_2"))
    met = slim.select("key", "node").join(hub, "key").where("node <> node_2").select("node", "node_2").distinct()
    bits = _bits(index)
    return met.join(bits, "node").join(_as_other(bits), "node_2").where(_may_be_similar()).select(*_pair()).distinct()


def _pairs_across(index: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, are in two components and may be similar."""
    own = durable(index.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    counts = own.select(F.explode("keys").alias("key"), "component").groupBy("key", "component").agg(F.count(F.lit(1)).alias("_n"))
    open_keys = counts.groupBy("key").agg(F.max(F.struct("_n", "component")).alias("_main"), F.count(F.lit(1)).alias("_of")).where("_of > 1")
    open_keys = durable(open_keys.select("key", F.col("_main.component").alias("_main")), "open")
    slim = own.select(F.explode("keys").alias("key"), "node").join(open_keys, "key")
    active = durable(slim.join(_bits(own, "component"), "node"), "active")
    outside = active.where("component <> _main").drop("_main")
    met = outside.join(_as_other(active.drop("_main")), "key").where((F.col("component") != F.col("component_2")) & _may_be_similar())
    return met.select(*_pair()).distinct()


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Only texts of nodes in pairs are hashed again."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(hash_filter(named.join(nodes, "node").select(F.col("_hash").alias("h"))))
    sets = durable(docs.select("_text", "_hash").mapInArrow(_sets_of(wanted), "node binary, s array<long>").dropDuplicates(["node"]), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("_sb"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    similar = 100 * common >= SIMILARITY * (F.size("_sa") + F.size("_sb") - common)
    return durable(pairs.join(left, "a").join(right, "b").where(similar).select("a", "b"), "linked")


def _sets_of(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(hits(wanted.value, batch.column(1).to_numpy())))
            for part in in_slices(kept, "_text"):
                sets = [s for s in token_sets(part.column(0)) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"]
                )

    return run


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id, the smallest key reachable by links, of each document.

    Words are lower-cased in A-Z only; a text with fewer than five words is one shingle; null and
    empty texts have none and are linked with nothing. Repeated rows are documents of their own.
    Rows with a null key take part, but a null is never the smallest of a component with others.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.xxhash64(f"`{text}`").alias("_hash"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "_text"):
            sets = token_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.binary())],
                ["_key", "_hash", "n_shingles", "node"],
            )

    schema = T.StructType([docs.schema["_key"], T.StructField("_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType())])
    nodes = durable(docs.mapInArrow(describe, schema), "nodes")
    n_tokens = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    reps = nodes.where("node is not null").groupBy("node").agg(F.min("_hash").alias("_hash"))
    found = similar_nodes(docs, reps, n_tokens).where("node <> component")
    own = nodes.join(found, "node", "left").select("_key", "n_shingles", F.coalesce("component", "node").alias("_class"))
    firsts = own.where("_class is not null").groupBy("_class").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return own.join(firsts.select("_class", "_first"), "_class", "left").select(
        F.col("_key").alias(key), "n_shingles", F.coalesce("_first", "_key").alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is their component's smallest; documents without shingles stay.

    Of rows that repeat key and text one stays; rows that share a key with different texts are
    kept or dropped together, by the key.
    """
    found = join_components(docs, key, text)
    kept = found.where(F.col("component_id").eqNullSafe(F.col(f"`{key}`"))).groupBy(F.col(f"`{key}`").alias("_kept"))
    kept = durable(kept.agg(F.count(F.lit(1)).alias("_n")), "kept")
    own = packed(docs, [], _key=F.col(f"`{key}`"), _text=F.col(f"`{text}`") if _repeats(kept) else F.lit(None))
    out = own.join(kept.select("_kept"), F.col("_key").eqNullSafe(F.col("_kept")), "left_semi")
    if _repeats(kept):
        out = out.dropDuplicates(["_key", "_text"])
    return out.select(*rest_columns(out))


def _repeats(kept: DataFrame) -> bool:
    return (kept.agg(F.max("_n")).first()[0] or 0) > 1


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
