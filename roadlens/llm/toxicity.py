"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of labelled rows is fitted in one task; its weights are sparse (L1) and at most
2**bits in number, so they can be broadcast; scoring runs over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import buffer_of, in_slices, lut_of, mix, word_hashes
from .common import ship, table


@dataclass(frozen=True)
class Params:
    #: Feature space: 2**bits weights, and so at most that many to broadcast (12 bytes each).
    bits: int = 18
    #: Labelled rows of each class to fit on, about (a hash threshold picks them).
    sample_per_class: int = 2_500
    epochs: int = 6
    #: Per-coordinate rate alpha / (beta + sqrt(sum of squared gradients)).
    alpha: float = 1.0
    beta: float = 1.0
    #: L1 strength in standard deviations of the gradient sum that a feature without influence
    #: gathers, which grows as the root of its document count: common words stay out. L2 strength.
    l1: float = 2.0
    l2: float = 0.1
    threshold: float = 0.3


#: Words are runs of letters, digits and bytes of other scripts, ASCII lower-cased.
_LUT = lut_of(lambda b: b >= 128 or chr(b).isalnum(), True)
#: Lengths in bytes of the word heads that count as unigrams too: inflected words share them.
_HEADS = (4, 5)


def features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, word heads, bigrams and skip-grams: slot of each occurrence and its text."""
    data, offsets = buffer_of(column)
    hashes, at, *heads = word_hashes(data, offsets, _LUT, _HEADS)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    shift = np.uint64(64 - bits)
    for k, h in enumerate([hashes, *heads]):
        yield ((h + np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD) >> shift).astype(np.int64), text
    for reach in (1, 2):
        same = text[:-reach] == text[reach:]
        h = hashes[:-reach] * np.uint64(2 * reach + 3) + (hashes[reach:] >> np.uint64(1))
        yield (mix(h[same]) >> shift).astype(np.int64), text[:-reach][same]


def fit(frame: pd.DataFrame, p: Params) -> pd.DataFrame:
    """Sequential FTRL-proximal over the sample in hash order; returns slot and weight, bias as -1.

    frame: text, toxic, _order and _share, the share of its class in the sample. The bias is
    corrected for unequal shares, so that scores follow the labels' own base rate.
    """
    size = (1 << p.bits) + 1
    frame = frame.sort_values(["_order", "text"], kind="stable")
    y = frame["toxic"].to_numpy(float)
    n_of = {c: (y == c).sum() + 0.5 for c in (0.0, 1.0)}
    prior = np.log(n_of[1.0] / n_of[0.0])
    seen: list[np.ndarray] = []
    for part in in_slices(pa.RecordBatch.from_pydict({"text": pa.array(frame["text"], pa.large_string())}), "text"):
        found = [(slot, np.searchsorted(own, np.arange(part.num_rows + 1))) for slot, own in features(part.column(0), p.bits)]
        for i in range(part.num_rows):
            seen.append(np.unique(np.concatenate([*(slot[at[i] : at[i + 1]] for slot, at in found), [size - 1]])).astype(np.int32))
    count = np.zeros(size)
    for x in seen:
        count[x] += 1
    l1 = p.epochs * p.l1 * np.sqrt(np.maximum(count, 1) * n_of[0.0] * n_of[1.0]) / len(y)
    l1[-1] = 0.0
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(p.epochs):
        for i, x in enumerate(seen):
            w, nx = _weights(z[x], n[x], l1[x], p), n[x]
            g = 1 / (1 + np.exp(-np.clip(prior + w.sum(), -35, 35))) - y[i]
            z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / p.alpha * w
            n[x] = nx + g * g
    w = _weights(z, n, l1, p)
    share = frame.groupby("toxic")["_share"].first()
    w[-1] += prior + np.log(share.get(0, 1.0) / share.get(1, 1.0))
    kept = np.flatnonzero(w)
    return pd.DataFrame({"slot": np.where(kept == size - 1, -1, kept), "weight": w[kept]})


def _weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray, p: Params) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def training_sample(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """About p.sample_per_class labelled texts of each class, picked by a hash of doc_id.

    labels: doc_id and toxic; rows with a null in either are left out, and of repeated ids the
    larger label counts.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] in (0, 1)}
    rank = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    of = {c: min(1.0, p.sample_per_class / max(1, n.get(c, 0))) for c in (0, 1)}
    share = F.when(F.col("toxic") == 1, of[1]).otherwise(of[0])
    picked = own.where(F.col("toxic").isin(0, 1) & (rank < share * (1 << 30))).select(F.col("doc_id"), "toxic", rank.alias("_order"), share.alias("_share"))
    # at most about 2 * sample_per_class ids: bounded by the parameter
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> np.ndarray:
    """Dense weights of 2**bits slots and the bias; all zero but for a negative bias without labels."""
    ship(docs.sparkSession)
    fitted = (
        training_sample(docs, labels, p)
        .groupBy(F.lit(0).alias("_model"))
        .applyInPandas(lambda g: fit(g, p), "slot long, weight double")
        .toPandas()
    )
    out = np.zeros((1 << p.bits) + 1)
    out[-1] = 0.0 if len(fitted) else -2.0
    out[fitted["slot"].to_numpy(np.int64)] = fitted["weight"].to_numpy()
    return out


def score_of(spark: SparkSession, text: str, weights: np.ndarray, p: Params = Params()) -> Column:
    """Column with the score from 0 to 1 of each whole text of column text; only texts go to Python and only scores return."""
    ship(spark)
    sparse = np.flatnonzero(weights[:-1])
    model = spark.sparkContext.broadcast((sparse, weights[sparse], weights[-1]))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, value, bias = model.value
        rank = np.zeros(1 << p.bits, np.int32)
        rank[at] = np.arange(1, len(at) + 1)
        for texts in batches:
            total = np.full(len(texts), bias)
            done = 0
            for part in in_slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
                met = []
                for slot, own in features(part.column(0), p.bits):
                    r = rank[slot]
                    hit = r > 0
                    met.append(own[hit] * np.int64(len(at) + 1) + r[hit])
                key = np.unique(np.concatenate(met))
                np.add.at(total, done + key // (len(at) + 1), value[key % (len(at) + 1) - 1])
                done += part.num_rows
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return scored(F.col(f"`{text}`"))


def score(docs: DataFrame, weights: np.ndarray, p: Params = Params(), text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text.

    Each feature counts once however often it occurs in a text. Null and empty texts get the
    bias's score. All input columns pass through; one named as `to` is replaced.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != to]
    return docs.select(*others, score_of(docs.sparkSession, text, weights, p).alias(to))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that score below p.threshold; only labels outside the held-out part teach."""
    weights = train(docs, labels.where(~held_out("doc_id")), p)
    return docs.where(score_of(docs.sparkSession, "text", weights, p) < p.threshold)


def op10_toxicity_ftrl(spark, sf_dir: str) -> DataFrame:
    p = Params()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id"))
    scored = score(docs, train(docs, labels, p), p)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted")
    )
