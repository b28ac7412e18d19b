"""Operator 4: exact substring deduplication from fixed-block anchors.

Every document's non-overlapping blocks of ``BLOCK`` words are the index; every rolling window of BLOCK words
of every document probes it. A repeat of at least 2 * BLOCK - 1 words always covers a whole block of its
source, so no repeat of ``WINDOW`` words is missed. Hits are extended: around each hit both documents' WINDOW-word
windows are compared, and those that repeat are joined into maximal spans.

Index and probes are 64-bit keys in a packed exchange (see exchange.py): a chunk of documents sends each distinct
key once, with one bit for "is a block here" and one for "in several documents here", as 32 bits within its
bucket. The buckets return the keys that are a block somewhere and occur in two documents or more. Only windows
next to such hits go to the second exchange, with full keys and the least doc_id that has them in the chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import arrays, bucket_bits, chunked, first_value, runs, table, text_bytes
from .names import carried, numbered, place, restored
from .words import PASS, as_array, hash_strings, horner, lookup, slices, split_words, then_free, window_starts

BLOCK, WINDOW = 25, 50
#: Bits of a probe within its bucket; the two lowest of its 32 are flags.
RESIDUE = 30
#: Order of a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the texts' offsets."""
    parts, ends = [], [np.zeros(1, np.int64)]
    for lo, hi in slices(texts, PASS):
        words = split_words(texts.slice(lo, hi - lo))
        parts.append(hash_strings(words.vocab)[words.codes])
        ends.append(words.offsets[1:] + ends[-1][-1])
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.concatenate(ends)


def block_windows(hashes: np.ndarray) -> np.ndarray:
    return horner(horner(hashes, 5), BLOCK // 5, 5)


def ids_of(rows: pa.Table) -> np.ndarray:
    return rows["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def text_of_word(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


PROBES = {"bucket": pa.int32(), "chunk": pa.int32(), "keys": pa.binary()}


def block_keys(texts: pa.Array, which: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading bits of every window of BLOCK words, the document it lies in, and 1 where it is a block."""
    hashes, offsets = hashed_words(texts)
    at = np.flatnonzero(window_starts(offsets, BLOCK, len(hashes)))
    text = text_of_word(offsets)[at]
    block = (at - offsets[text]) % BLOCK == 0
    return block_windows(hashes)[at] >> np.uint64(64 - bits - RESIDUE), which[text], block.astype(np.uint8)


def probe(rows: pa.Table, bits: int) -> pa.Table:
    """One chunk's distinct block windows by bucket, each with its flags."""
    texts, which = as_array(rows["text"]), np.unique(ids_of(rows), return_inverse=True)[1].astype(np.int32)
    parts = [block_keys(texts.slice(lo, hi - lo), which[lo:hi], bits) for lo, hi in slices(texts, PASS)]
    out = {"bucket": [], "chunk": [], "keys": []}
    if any(len(keys) for keys, _, _ in parts):
        short, which, flags = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(short)
        short, which, flags = short[order], which[order], flags[order]
        del order
        again = short[1:] == short[:-1]
        if again.any():  # the first row of a key gets the flags of all
            begins = np.concatenate([[True], ~again])
            heads = begins & np.concatenate([again, [False]])
            own = np.flatnonzero(heads | ~begins)
            first = np.flatnonzero(heads[own])
            several = np.minimum.reduceat(which[own], first) != np.maximum.reduceat(which[own], first)
            flags[heads] = np.bitwise_or.reduceat(flags[own], first) | (several.astype(np.uint8) << 1)
            short, flags = short[begins], flags[begins]
        packed = (((short << np.uint64(2)) | flags) & np.uint64(0xFFFFFFFF)).astype("<u4")
        short <<= np.uint64(64 - bits - RESIDUE)
        for bucket, lo, hi in runs(short, bits):
            out["bucket"].append(bucket)
            out["chunk"].append(first_value(rows["chunk"]))
            out["keys"].append(packed[lo:hi].tobytes())
    return table(out, PROBES)


def shared(rows: pa.Table) -> pa.Table:
    """A bucket's keys that are a block somewhere and lie in two documents or more, back to each chunk."""
    each = arrays(rows["keys"], "<u4")
    keys = np.concatenate(each)
    keys.sort()  # the flags are the lowest bits
    again = (keys[1:] ^ keys[:-1]) < 4
    twice = np.concatenate([again, [False]]) | np.concatenate([[False], again])
    once = keys[~twice & ((keys & 3) == 3)] >> np.uint32(2)
    keys = keys[twice]
    residue, flags = keys >> np.uint32(2), keys & np.uint32(3)
    first = np.flatnonzero(np.concatenate([[True], residue[1:] != residue[:-1]])[: len(residue)])
    blocks = np.bitwise_or.reduceat(flags, first) & 1 if len(first) else first
    good = np.sort(np.concatenate([once, residue[first[blocks > 0]]]))
    out = {"bucket": [], "chunk": [], "keys": []}
    for chunk, own in zip(rows["chunk"].to_pylist(), each):
        short = own >> np.uint32(2)
        mark = lookup(good, short) >= 0
        if mark.any():
            out["bucket"].append(first_value(rows["bucket"]))
            out["chunk"].append(chunk)
            out["keys"].append(short[mark].tobytes())
    return table(out, PROBES)


def candidate_windows(rows: pa.Table, hits: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and keys of the WINDOW-word windows next to hits, their texts, and the texts' offsets."""
    hashes, offsets = hashed_words(as_array(rows["text"]))
    short = [
        (np.uint64(bucket) << np.uint64(RESIDUE)) | own.astype(np.uint64)
        for bucket, own in zip(hits["bucket"].to_pylist(), arrays(hits["keys"], "<u4"))
    ]
    ok = np.flatnonzero(window_starts(offsets, WINDOW, len(hashes)))
    if not short or not len(ok):
        return ok[:0], np.empty(0, np.uint64), ok[:0], offsets
    good = np.sort(np.concatenate(short))
    windows = block_windows(hashes)
    probes = windows >> np.uint64(64 - bits - RESIDUE)
    found = good[np.minimum(np.searchsorted(good, probes), len(good) - 1)] == probes
    upto = np.concatenate([[0], np.cumsum(found)])
    ok = ok[upto[ok + WINDOW - BLOCK + 1] > upto[ok]]  # a hit lies within the window
    keys = horner(windows, 2, BLOCK)[ok] if len(ok) else np.empty(0, np.uint64)
    return ok, keys, text_of_word(offsets)[ok], offsets


CLAIMS = {"bucket": pa.int32(), "chunk": pa.int32(), "keys": pa.binary(), "least": pa.binary(), "most": pa.binary()}


def claim(rows: pa.Table, hits: pa.Table, bits: int) -> pa.Table:
    """The chunk's distinct candidate windows by bucket, with the least and greatest doc_id that has each."""
    _, keys, text, _ = candidate_windows(rows, hits, bits)
    out = {name: [] for name in CLAIMS}
    if len(keys):
        ids = ids_of(rows)[text]
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least, most, keys = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first), keys[first]
        for bucket, lo, hi in runs(keys, bits):
            for name, value in zip(CLAIMS, (bucket, first_value(rows["chunk"]), keys[lo:hi].tobytes(), least[lo:hi].tobytes(), most[lo:hi].tobytes())):
                out[name].append(value)
    return table(out, CLAIMS)


OWNERS = {"chunk": pa.int32(), "keys": pa.binary(), "least": pa.binary()}


def settle(rows: pa.Table) -> pa.Table:
    """For each chunk the windows that a smaller doc_id has too, with the least doc_id of all."""
    each, lows, tops = arrays(rows["keys"], "<u8"), arrays(rows["least"], "<i8"), arrays(rows["most"], "<i8")
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    least = np.full(len(keys), LAST)
    np.minimum.at(least, at, np.concatenate(lows))
    out = {"chunk": [], "keys": [], "least": []}
    for chunk, own, top, where in zip(rows["chunk"].to_pylist(), each, tops, np.split(at, np.cumsum([len(x) for x in each])[:-1])):
        later = top > least[where]
        if later.any():
            out["chunk"].append(chunk)
            out["keys"].append(own[later].tobytes())
            out["least"].append(least[where[later]].tobytes())
    return table(out, OWNERS)


def covered(rows: pa.Table, hits: pa.Table, owners: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks the words to remove; the texts' offsets."""
    at, keys, text, offsets = candidate_windows(rows, hits, bits)
    cover = np.zeros(int(offsets[-1]) + 1, np.int64)
    known = arrays(owners["keys"], "<u8")
    if known and len(keys):
        known, least = np.concatenate(known), np.concatenate(arrays(owners["least"], "<i8"))
        order = np.argsort(known)
        known, least = known[order], least[order]
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        gone = (known[place] == keys) & (least[place] < ids_of(rows)[text])
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0, offsets


def kept_text(text: str | None, gone: np.ndarray) -> tuple[str, str | None]:
    """The kept words joined by one space; the text without the removed words and the white space after each."""
    raw = (text or "").encode()
    words = raw.split()
    if not gone.any():
        return b" ".join(words).decode(), text
    kept, left, at = [], [], 0
    for word, drop in zip(words, gone):
        begin = raw.index(word, at)
        if not drop:
            kept.append(word)
            left.append(raw[at:begin] + word)
        elif not left:
            left.append(raw[at:begin])
        at = begin + len(word)
    return b" ".join(kept).decode(), b"".join(left).decode() + raw[at:].decode()


def remove_repeats(docs: DataFrame, *more) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_text, left_text`` per row of ``docs(doc_id, text)``, and ``more`` columns.

    A word goes if a window of 50 consecutive words covers it whose word sequence also starts in a document
    with a smaller doc_id; windows are judged on the input. spans lists the removed maximal repeats as word
    positions (start, length). kept_text joins the kept words by one space; left_text keeps the white space
    before each, and the text itself, null included, where nothing goes. A null doc_id counts as greater than
    all others, rows of one doc_id as one document. Null and short texts lose nothing; no rows give no rows.
    """
    total = text_bytes(docs)
    bits = bucket_bits(total)
    chunks = chunked(docs, total, *more)
    by_chunk = chunks.groupBy("chunk")
    probes = by_chunk.applyInArrow(lambda rows: then_free(probe, rows, bits), "bucket int, chunk int, keys binary")
    hits = probes.groupBy("bucket").applyInArrow(lambda rows: then_free(shared, rows), "bucket int, chunk int, keys binary")
    claims = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(
        lambda rows, found: then_free(claim, rows, found, bits), "bucket int, chunk int, keys binary, least binary, most binary"
    )
    owners = claims.groupBy("bucket").applyInArrow(lambda rows: then_free(settle, rows), "chunk int, keys binary, least binary")
    # One cogroup takes two sides, so hits and owners travel as one.
    answers = hits.withColumn("least", F.lit(None).cast("binary")).unionByName(owners.withColumn("bucket", F.lit(None).cast("int")))

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        own = pc.is_valid(found["least"])
        gone, offsets = covered(rows, found.filter(pc.invert(own)), found.filter(own), bits)
        out = {"n_words": np.diff(offsets), "n_removed": [], "spans": [], "kept_text": [], "left_text": []}
        for text, lo, hi in zip(as_array(rows["text"]).to_pylist(), offsets[:-1], offsets[1:]):
            mark = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
            out["n_removed"].append(int(mark.sum()))
            out["spans"].append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
            kept, left = kept_text(text, mark)
            out["kept_text"].append(kept)
            out["left_text"].append(left)
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), span, pa.string(), pa.string()]
        passed = {name: rows[name] for name in rows.column_names if name not in ("chunk", "doc_id", "text")}
        return pa.table({"doc_id": rows["doc_id"], **{k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)}} | passed)

    schema = T._parse_datatype_string(
        "doc_id long, n_words long, n_removed long, spans array<struct<start: int, length: int>>, kept_text string, left_text string"
    )
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(lambda rows, found: then_free(finish, rows, found), T.StructType(schema.fields + chunks.schema.fields[3:]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns under any names, with the repeats gone from text; a column n_chars is counted anew.
    Nulls, ties and repeated rows are as in ``remove_repeats``; of a row that loses all its words white space may stay."""
    left = remove_repeats(carried(docs, "doc_id", "text"), "rest")
    rows = restored(left, docs, "left_text")
    if "n_chars" not in docs.columns:
        return rows
    at, n = place(docs, "n_chars"), F.char_length(F.col(f"c{place(docs, 'text')}")).cast("long")
    return numbered(rows).withColumn(f"c{at}", n).toDF(*docs.columns)


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
