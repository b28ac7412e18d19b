"""Operator 11: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between, lower-cased letters only,
hashed to ``BITS`` bits. A bounded sample of labelled rows is dealt to at most ``SHARDS`` packed shards once. In each of
``ROUNDS`` rounds every shard runs the per-coordinate updates over its rows from the common state, and Spark averages
what the shards moved, coordinate by coordinate. L1 leaves a few thousand weights, which travel to every task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, kept
from .exchange import arrays, packed_rows, row_key, unpacked_rows
from .language_id import letters_of
from .names import only
from .words import as_array, hash_strings, horner, lookup, mix, slices, split_words, window_starts

BITS, SHARDS, ROUNDS = 24, 48, 8
#: Rows that a shard has at least, on average.
ROWS = 60
#: Learning rate, its offset, L1 and L2 of the per-coordinate updates.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1.0, 0.1
#: Sampled documents that must have a feature before it has a coordinate.
SEEN = 5


class State(NamedTuple):
    """Per admitted feature, and last the bias: the sums ``z`` and ``n`` of the updates."""

    keys: np.ndarray
    z: np.ndarray
    n: np.ndarray


class Weights(NamedTuple):
    """Sorted features with a weight other than zero, their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of a slice of texts and each one's text, repeats included."""
    words = split_words(texts)
    clean = letters_of(words.vocab)
    hashed = hash_strings(clean)[words.codes]
    written = (pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0)[words.codes]
    offsets = np.concatenate([[0], np.cumsum(written)])[words.offsets]
    hashed, of_text = hashed[written], np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys, owners = [hashed], [of_text]
    for step in (1, 2):
        inside = window_starts(offsets, step + 1, len(hashed))
        keys.append(mix(horner(hashed, 2, step)[inside] + np.uint64(step)))
        owners.append(of_text[: len(inside)][inside])
    return np.concatenate(keys) >> np.uint64(64 - BITS), np.concatenate(owners)


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct features in order, and the texts' offsets in them."""
    keys, owners = occurrences(texts)
    both = np.unique((owners.astype(np.uint64) << np.uint64(BITS)) | keys)
    ends = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    return (both & np.uint64((1 << BITS) - 1)).astype("<u4"), ends


def weights_of(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
    """The weights that a state stands for."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(state: State, features: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> None:
    """One pass of updates over rows of places in the state; ``state`` changes. The bias has no L1."""
    z, n = state.z, state.n
    for lo, hi, label in zip(offsets[:-1], offsets[1:], labels):
        at = np.append(features[lo:hi], len(z) - 1)
        l1 = np.append(np.full(hi - lo, L1), 0.0)
        w = weights_of(z[at], n[at], l1)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        moved = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - moved * w
        n[at] += g * g


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> tuple[DataFrame, int]:
    """``key, text, toxic``, distinct labelled texts of about ``most_rows`` labelled doc_ids at most, picked by a hash of the
    id; and about how many ids there are."""
    known = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    found = known.count()
    share = min(1.0, most_rows / max(1, found))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most about most_rows ids
    return rows.groupBy(row_key().alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), min(found, most_rows)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000) -> Weights:
    """Learns from the texts of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks 0 or 1.

    ``most_rows`` bounds the labelled documents: of more, a hash of doc_id picks about that many. An id with several labels
    is toxic if one says so; texts repeated under an id count once, a null text as an empty one. Null ids and labels teach
    nothing. Without labelled rows all scores are one half. Further columns are ignored.
    """
    spark = docs.sparkSession

    def pack(rows: pa.Table) -> pa.Table:
        block = packed_rows(rows.sort_by("key").select(["text", "toxic"]).combine_chunks().to_batches()[0])
        return pa.table({"shard": rows["shard"].slice(0, 1), "block": pa.array([block], pa.binary())})

    def features(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A shard's features, their number in each row, and the rows' labels."""
        rows = unpacked_rows(block)
        texts, flat, sizes = as_array(rows["text"]), [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for lo, hi in slices(texts):
            found, ends = distinct_features(texts.slice(lo, hi - lo))
            flat.append(found)
            sizes.append(np.diff(ends))
        return np.concatenate(flat), np.concatenate(sizes), rows["toxic"].to_numpy()

    rows, labelled = sample(docs, labels, most_rows)
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(min(SHARDS, max(1, labelled // ROWS)))).cast("int"))
    shards = kept(dealt.groupBy("shard").applyInArrow(pack, "shard int, block binary"), "shards")

    def spread(bucket_of: np.ndarray, columns: dict[str, np.ndarray]):
        """A shard's sorted coordinates by bucket, so that no task meets all of them."""
        edges = np.searchsorted(bucket_of, np.arange(SHARDS + 1))
        for bucket, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if hi > lo:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32())} | {k: [v[lo:hi].tobytes()] for k, v in columns.items()})

    def count(batches):
        for batch in batches:
            for block in batch.column("block").to_pylist():
                keys, n = np.unique(features(block)[0], return_counts=True)
                yield from spread(keys.astype(np.int64) * SHARDS >> BITS, {"keys": keys, "n": n.astype("<u2")})

    def admit(found: pa.Table) -> pa.Table:
        keys, n = np.concatenate(arrays(found["keys"], "<u4")), np.concatenate(arrays(found["n"], "<u2"))
        each, back = np.unique(keys, return_inverse=True)
        return pa.table({"keys": [each[np.bincount(back, weights=n) >= SEEN].astype("<u4").tobytes()]})

    admitted = shards.mapInArrow(count, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(admit, "keys binary")
    known = np.sort(np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(r[0], "<u4") for r in admitted.collect())]))  # at most 2 ** BITS

    def place(batches):
        for batch in batches:
            for block in batch.column("block").to_pylist():
                flat, sizes, toxic = features(block)
                at = lookup(known, flat)
                sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at >= 0], minlength=len(sizes))
                columns = {"places": at[at >= 0].astype("<u4"), "sizes": sizes.astype("<u4"), "labels": toxic.astype("u1")}
                yield pa.RecordBatch.from_pydict({name: [x.tobytes()] for name, x in columns.items()})

    placed = kept(shards.mapInArrow(place, "places binary, sizes binary, labels binary"), "shards")
    state = State(known, np.zeros(len(known) + 1), np.zeros(len(known) + 1))
    held = []
    for _ in range(ROUNDS if len(known) else 0):
        held.append(spark.sparkContext.broadcast((state.keys, state.z, state.n)))
        at_start = held[-1]

        def train(batches, at_start=at_start):
            keys, z, n = at_start.value
            for batch in batches:
                for places, sizes, toxic in zip(*(batch.column(c).to_pylist() for c in ("places", "sizes", "labels"))):
                    own = State(keys, z.copy(), n.copy())
                    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))])
                    learn(own, np.frombuffer(places, "<u4"), offsets, np.frombuffer(toxic, "u1"))
                    moved = np.flatnonzero(own.n != n)
                    columns = {"at": moved.astype("<u4"), "z": (own.z - z)[moved].astype("<f2"), "n": (own.n - n)[moved].astype("<f2")}
                    yield from spread(moved * SHARDS // len(z), columns)

        def average(found: pa.Table) -> pa.Table:
            at = np.concatenate(arrays(found["at"], "<u4"))
            each, back, times = np.unique(at, return_inverse=True, return_counts=True)
            order = np.lexsort((np.concatenate(arrays(found["z"], "<f2")), back))  # sums don't depend on which shard came first
            z, n = (np.bincount(back[order], weights=np.concatenate(arrays(found[c], "<f2"))[order]) / times for c in ("z", "n"))
            return pa.table({"at": [each.astype("<u4").tobytes()], "z": [z.tobytes()], "n": [n.tobytes()]})

        moved = placed.mapInArrow(train, "bucket int, at binary, z binary, n binary").groupBy("bucket").applyInArrow(average, "at binary, z binary, n binary")
        for row in moved.collect():  # at most 2 ** BITS coordinates
            at = np.frombuffer(row["at"], "<u4")
            state.z[at] += np.frombuffer(row["z"])
            state.n[at] += np.frombuffer(row["n"])
    for x in held:
        x.destroy()
    discard(shards, placed)
    w = weights_of(state.z, state.n, np.append(np.full(len(known), L1), 0.0))
    there = np.flatnonzero(w[:-1])
    return Weights(known[there], w[there], float(w[-1]))


def scores_of(texts: pa.Array, model: Weights) -> np.ndarray:
    """The model's probability that each text of a slice is toxic."""
    keys, owners = occurrences(texts)
    wanted = np.zeros(1 << BITS, bool)
    wanted[model.keys] = True
    hit = wanted[keys]
    both = np.unique((owners[hit].astype(np.uint64) << np.uint64(BITS)) | keys[hit])
    at = lookup(model.keys, (both & np.uint64((1 << BITS) - 1)).astype("<u4"))
    total = np.bincount((both >> np.uint64(BITS)).astype(np.int64), weights=model.weights[at], minlength=len(texts)) if len(both) else np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -500, 500)))


def score(docs: DataFrame, model: Weights) -> DataFrame:
    """``doc_id, score, predicted`` per row of ``docs(doc_id, text)``: the probability of label 1, and whether it is a half or more.

    Texts are read whole; a very long one is a slice of its own. A null or empty text, or one without known features, has
    the score of the bias. Repeated rows and null doc_ids are rows like others; further columns are ignored.
    """

    def rate(batches):
        for batch in batches:
            texts = as_array(batch.column("text"))
            for lo, hi in slices(texts):
                found = scores_of(texts.slice(lo, hi - lo), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(rate, "doc_id long, score double, predicted int")


def held_out():
    """A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op11_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
