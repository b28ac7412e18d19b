"""Operator 10: mergeable bottom-k sketches of shingle hashes.

A sketch is the ``K`` smallest distinct 64-bit hashes of a document's 5-word shingles. The smallest K
of two sketches together are the sketch of the union, so parts merge; the share of those that both
sketches hold estimates resemblance, and the K-th smallest value estimates the distinct count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import as_array, shingle_sets, slices

K = 64
#: Ranges of doc_ids at most; a task streams its range, so ranges may be larger than memory.
MOST_RANGES = 20_000
#: Stands for a null doc_id, which comes before all others.
LOWEST = -(2**63) + 1


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes."""
    return hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact below k distinct shingles. Two empty sets are alike (1)."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    repeat = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~repeat])
    last = np.flatnonzero(distinct)[:k]
    starts = last[last < len(repeat)]
    return float(np.count_nonzero(repeat[starts])) / len(last)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty a is contained (1)."""
    if not len(a):
        return 1.0
    alike = resemblance(a, b, k)
    return min(1.0, alike * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last quarter of the text gives way to as much of the following document's start."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def range_of(starts: np.ndarray):
    """A column function: how many of the sorted starts are at or below the value."""

    @F.pandas_udf("int")
    def part(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, at.to_numpy(np.int64), side="right").astype(np.int32))

    return part


def fingerprint_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles, in_edited``
    per row; the last two estimate the text's distinct shingles and the share of them that the edited text has.

    Takes ``docs(doc_id, text)``; a null text is empty. The next document is the next row by doc_id
    (nulls first), rows of one doc_id by text; after the last row comes the first, so a single row is
    its own next. Extra columns are ignored and no rows give no rows.

    Rows are dealt by doc_id ranges that start at doc_ids taken from the table, so the row after a range's
    last is known beforehand: it is copied to that range and only read there.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    ids = docs.select(at.alias("at"))
    if parts is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(MOST_RANGES, max(8, -(-total // (8 << 20))))
    shares = [i / parts for i in range(1, parts)]
    found = (shares and ids.agg(F.percentile_approx("at", shares, 4 * parts)).first()[0]) or []
    cuts = np.unique(np.array(found, np.int64))
    lows = ids.groupBy(range_of(cuts)("at").alias("part")).agg(F.min("at").alias("at")).collect()  # one row per range
    starts = np.array(sorted(row["at"] for row in lows), np.int64)[1:]  # each is in the table; range 0 starts anywhere
    first = [row["at"] for row in lows if row["part"] == 0] or [min((row["at"] for row in lows), default=0)]
    part, last = range_of(starts), len(starts)
    dealt = own.withColumn("part", part(at)).withColumn("ahead", F.lit(False))
    heads = own.where(at.isin([int(x) for x in starts] + [int(min(first))])).withColumn("part", part(at))
    heads = heads.withColumn("part", F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1))
    heads = heads.withColumn("ahead", F.lit(True))
    ordered = (
        dealt.unionByName(heads)
        .repartition(last + 1, "part")
        .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    )
    return ordered.mapInArrow(
        _compare,
        "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, distinct_shingles double, in_edited double",
    )


def _compare(batches):
    """Streams the sorted rows of ranges; a row waits until the one after it is seen."""
    wait = None  # (part, doc_id, text) that awaits its next
    for batch in batches:
        texts = as_array(batch.column("text"))
        for lo, hi in slices(texts):
            rows = list(
                zip(
                    batch.column("part").slice(lo, hi - lo).to_pylist(),
                    batch.column("ahead").slice(lo, hi - lo).to_pylist(),
                    batch.column("doc_id").slice(lo, hi - lo).to_pylist(),
                    texts.slice(lo, hi - lo).to_pylist(),
                )
            )
            pairs = []
            for part, ahead, doc_id, text in rows:
                if wait is not None and wait[0] == part:
                    pairs.append((wait[1], wait[2], text))
                wait = None if ahead else (part, doc_id, text)
            if pairs:
                yield _rows(pairs)


def _rows(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
    changed = [edited(text, following) for _, text, following in pairs]
    texts = [text for _, text, _ in pairs]
    # A next text is the following pair's own text but for the last of a range or slice.
    chain = [*texts, pairs[-1][2]]
    follow = [i + 1 if chain[i + 1] is pairs[i][2] else -1 for i in range(len(pairs))]
    extra = [pairs[i][2] for i, x in enumerate(follow) if x < 0]
    sketches = [sketch(s) for s in shingle_sets(pa.array([*chain, *changed, *extra], pa.string()))]
    own, after, others = sketches[: len(chain)], sketches[len(chain) : len(chain) + len(pairs)], iter(sketches[len(chain) + len(pairs) :])
    nexts = [own[x] if x >= 0 else next(others) for x in follow]
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "in_edited"]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in pairs], pa.int64()),
            pa.array([len(x) for x in texts], pa.int64()),
            pa.array(changed, pa.string()),
            pa.array([to_text(x) for x in own[: len(pairs)]], pa.string()),
            pa.array([to_text(x) for x in after], pa.string()),
            pa.array([resemblance(a, b) for a, b in zip(own, after)], pa.float64()),
            pa.array([resemblance(a, b) for a, b in zip(own, nexts)], pa.float64()),
            pa.array([distinct_count(a) for a in own[: len(pairs)]], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own, after)], pa.float64()),
        ],
        names,
    )


def merged_sketches(docs: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """``key, fingerprint, distinct_shingles`` of each value of ``key``, from sketches of its parts.

    A task merges what it sees of a key in each batch, salted groups merge those, and at most ``salts`` sketches of a key
    meet in the end, so a key with a third of all rows is no group of rows anywhere. Null keys are a value of their own.
    """

    def part(batches):
        for batch in batches:
            texts, keys = as_array(batch.column("text")), as_array(batch.column("key")).dictionary_encode(null_encoding="encode")
            codes, found = keys.indices.to_pylist(), {}
            for lo, hi in slices(texts):
                for code, own in zip(codes[lo:hi], shingle_sets(texts.slice(lo, hi - lo))):
                    found[code] = merge(found[code], sketch(own)) if code in found else sketch(own)
            names = keys.dictionary.to_pylist()
            columns = [pa.array([names[c] for c in found], pa.string()), pa.array([x.tobytes() for x in found.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sketch"])

    def together(rows: pa.Table) -> pa.Table:
        whole = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["sketch"].to_pylist()]))[:K]
        return pa.table({"key": rows["key"].slice(0, 1), "sketch": pa.array([whole.tobytes()], pa.binary())})

    schema = "key string, sketch binary"
    parts = docs.select(F.col(key).cast("string").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(part, schema)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts))).groupBy("key", "salt").applyInArrow(together, schema)
    text = F.pandas_udf(lambda s: s.map(lambda x: to_text(np.frombuffer(x, np.uint64))), "string")
    count = F.pandas_udf(lambda s: s.map(lambda x: distinct_count(np.frombuffer(x, np.uint64))), "double")
    return parts.groupBy("key").applyInArrow(together, schema).select("key", text("sketch").alias("fingerprint"), count("sketch").alias("distinct_shingles"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fingerprint_pairs(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "distinct_shingles",
        "in_edited",
    )
