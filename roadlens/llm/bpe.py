"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes hits a mask, so equal passages yield equal
chunks wherever they stand. Chunks found more than once in the corpus are encoded once and
joined to the texts that hold them; what lies between is encoded in place; at every join the
tokens around it are encoded again, over a window widened until both its ends are places where
the tokenizer always splits, and so agree with the tokens outside. Windows that meet are one, so
the repair is linear in the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import INVERSE, buffer_of, in_slices, mix, powers, prefix_sums, slices
from .common import durable, hash_filter, hits, packed, rest_columns, ship, table

# Fixed value: the split pattern of byte-level BPE files with "use_regex".
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that the rolling hash sees; one place in MASK + 1 is a cut, and cuts are LEAST bytes apart.
WINDOW, MASK, LEAST = 24, (1 << 10) - 1, 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A byte-level BPE tokenizer file: bytes of each id, and a plain encoder of short texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.length = [len(x) for x in self.bytes_of]
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.encode_plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special_pattern = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or r"(?!)")

    def encode(self, text: str) -> list[int]:
        """As the tokenizers library does without adding special tokens; those in the text count."""
        if not self.special_pattern.search(text):
            return self.encode_plain(text)
        ids, at = [], 0
        for m in self.special_pattern.finditer(text):
            ids += self.encode_plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self.encode_plain(text[at:])

    def decode_bytes(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks (the end of data last) and their hashes; texts begin chunks."""
    sums = prefix_sums(data)
    n = len(data)
    cuts = np.zeros(0, np.int64)
    if n > WINDOW:
        start = np.arange(n - WINDOW)
        rolled = mix((sums[WINDOW:n] - sums[: n - WINDOW]) * powers(INVERSE, n)[start])
        cuts = np.flatnonzero((rolled & np.uint64(MASK)) == 0) + WINDOW
        cuts = cuts[(data[cuts] & 0xC0) != 0x80]
        own = np.searchsorted(offsets, cuts, "right") - 1
        cuts = cuts[cuts - offsets[own] >= LEAST]
        cuts = cuts[np.diff(cuts, prepend=-LEAST) >= LEAST]
    starts = np.union1d(cuts, offsets)
    return starts, mix(slices(sums, starts[:-1], starts[1:]) + np.diff(starts).astype(np.uint64))


def _chunks(batch: pa.RecordBatch, text: str):
    data, offsets = buffer_of(batch.column(batch.schema.get_field_index(text)))
    starts, hashes = chunk_cuts(data, offsets)
    return data, starts, hashes.view(np.int64), np.searchsorted(starts, offsets)


def _kind(char: str) -> str:
    """The class of SPLIT that a character is in: L, N, P for the rest, a space for white space; empty where unsure."""
    if char in " \t\n\r":
        return " "
    first = category(char)[0]
    return first if first in "LN" else "P" if first in "PSM" else ""


def _is_safe(raw: bytes, at: int) -> bool:
    """True for places inside raw where every text is split, whatever stands further away.

    SPLIT has no piece that holds white space or a character of another class behind a visible
    one, but for the letters behind an apostrophe.
    """
    start = at - 1
    while raw[start] & 0xC0 == 0x80:
        start -= 1
    if raw[at] & 0xC0 == 0x80:
        return False
    before, after = raw[start:at].decode(), raw[at : at + 4].decode("utf-8", "ignore")[0]
    left, right = _kind(before), _kind(after)
    return left in ("L", "N", "P") and right != "" and left != right and before != "'"


def assemble(raw: bytes, pieces: list[tuple[int, int, list[int] | None]], vocab: Vocabulary) -> list[int]:
    """Tokens of raw from adjoining pieces (start, end, known tokens or None).

    Between the last safe place before a join and the first behind it raw is encoded again; joins
    without a safe place between them share one such window, so no byte is encoded again twice.
    """
    ids: list[int] = []
    length = vocab.length
    since, tail = 0, []  # what is not settled yet: its start, and its tokens unless a join lies in it
    for start, end, known in pieces:
        if known is None:
            known = vocab.encode(raw[start:end].decode())
        first, at = 0, start
        if start and not _is_safe(raw, start):
            while first < len(known) and (at == start or at < end and not _is_safe(raw, at)):
                at += length[known[first]]
                first += 1
            if at >= end:
                tail = None
                continue
            ids += vocab.encode(raw[since:at].decode())
        elif start:
            ids += tail if tail is not None else vocab.encode(raw[since:start].decode())
        last, place = len(known), end
        while last > first and (place == end or not _is_safe(raw, place)):
            last -= 1
            place -= length[known[last]]
        ids += known[first:last]
        since, tail = place, known[last:]
    return ids + (tail if tail is not None else vocab.encode(raw[since:].decode()))


def shared_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """h, the hash of every chunk that stands at two places of the corpus or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole, text, 1 << 19)):
            h, n = np.unique(_chunks(batch, text)[2], return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h, "n": n.astype(np.int64)})

    return docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def encode(docs: DataFrame, text: str = "text", to: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """docs without text and with the token ids of each whole text as an array.

    A null text is an empty one, without tokens. All other columns pass through, a column named
    as `to` is replaced, and repeated rows stay. The result equals the tokenizers library's with
    add_special_tokens=False.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    ship(spark)
    docs = packed(docs, [text, to], _text=F.col(f"`{text}`"))
    text, others, ids_name = "_text", ["_rest"], to
    to = "_out"
    shared = spark.sparkContext.broadcast(hash_filter(shared_chunks(docs, text)))
    out_schema = T.StructType([docs.schema["_rest"], T.StructField(to, T.ArrayType(T.IntegerType()))])

    def marked(batch: pa.RecordBatch):
        """The chunks of a batch, and for each text whether it holds a shared chunk."""
        data, starts, h, at = _chunks(batch, text)
        hit = hits(shared.value, h)
        many = np.add.reduceat(np.append(hit, False), np.minimum(at[:-1], len(hit)))
        has = np.where(np.diff(at) > 0, many, 0) > 0
        special = vocabulary(path).special
        column = batch.column(batch.schema.get_field_index(text))
        for token in special:
            if has.any():
                has &= ~np.asarray(pa.compute.match_substring(column, token).fill_null(False))
        return data, starts, h, at, hit, has

    def representatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole, text, 1 << 19)):
            data, starts, h, at, hit, has = marked(batch)
            own = np.repeat(has, np.diff(at))
            at_hit = np.flatnonzero(hit & own)
            found, first = np.unique(h[at_hit], return_index=True)
            raw = [data[starts[i] : starts[i + 1]].tobytes() for i in at_hit[first]]
            yield pa.RecordBatch.from_pydict({"h": found, "raw": pa.array(raw, pa.binary())})

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = [np.array(vocab.encode(x.decode()), vocab.dtype).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["h", "ids"])

    def consumers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole, text, 1 << 19)):
            _, _, h, at, hit, has = marked(batch)
            refs = [np.unique(h[at[i] : at[i + 1]][hit[at[i] : at[i + 1]]]) for i in np.flatnonzero(has)]
            kept = batch.filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(refs, pa.list_(pa.int64()))], [*batch.schema.names, "_refs"])

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in (part for whole in batches for part in in_slices(whole, text, 1 << 19)):
            kept = batch.filter(pa.array(~marked(batch)[-1]))
            ids = [np.array(vocab.encode(x or ""), np.int32) for x in kept.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(others)], pa.array(ids, pa.list_(pa.int32()))], [*others, to])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in (part for whole in batches for part in in_slices(whole, text, 1 << 19)):
            data, starts, h, at = _chunks(batch, text)
            tables = batch.column(batch.schema.get_field_index("_ids")).to_pylist()
            ids = []
            for i, known in enumerate(tables):
                base, end = int(starts[at[i]]), int(starts[at[i + 1]])
                raw = data[base:end].tobytes()
                of = {x["h"]: x["ids"] for x in known}
                pieces: list[tuple[int, int, list[int] | None]] = []
                for k in range(at[i], at[i + 1]):
                    a, b, found = int(starts[k]) - base, int(starts[k + 1]) - base, of.get(int(h[k]))
                    tokens = None if found is None else np.frombuffer(found, vocab.dtype).tolist()
                    if tokens is not None and vocab.decode_bytes(tokens) != raw[a:b]:
                        tokens = None  # another chunk with the same hash
                    if tokens is None and pieces and pieces[-1][2] is None:
                        pieces[-1] = (pieces[-1][0], b, None)
                    else:
                        pieces.append((a, b, tokens))
                ids.append(np.array(assemble(raw, pieces, vocab), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(ids, pa.list_(pa.int32()))], [*others, to])

    tokens = durable(docs.select(text).mapInArrow(representatives, "h long, raw binary").dropDuplicates(["h"]).mapInArrow(encode_chunks, "h long, ids binary"), "chunks")
    todo = docs.mapInArrow(consumers, T.StructType([*docs.schema.fields, T.StructField("_refs", T.ArrayType(T.LongType()))]))
    todo = durable(todo.withColumn("_row", F.monotonically_increasing_id()), "texts")
    refs = todo.select("_row", F.explode("_refs").alias("h")).join(tokens, "h")
    known = refs.groupBy("_row").agg(F.collect_list(F.struct("h", "ids")).alias("_ids"))
    with_shared = todo.drop("_refs").join(known, "_row").select(*others, text, "_ids").mapInArrow(joined, out_schema)
    out = docs.mapInArrow(in_place, out_schema).unionByName(with_shared)
    return out.select(*rest_columns(out), F.col(to).alias(ids_name))


def decode(docs: DataFrame, ids: str = "ids", to: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """docs with the text of their token ids, special tokens included; null ids give an empty text."""
    path = tokenizer or default_tokenizer()
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for lists in batches:
            yield pa.array([vocab.decode(x.values.to_pylist()) if x.is_valid else "" for x in lists], pa.string())

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != to], decoded(F.col(f"`{ids}`")).alias(to))


def op1_bpe_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
