"""Operator 5: hierarchical multi-length packing.

Each document's ids go to the smallest context tier that holds them; what exceeds the longest tier is
cut into full windows first. Tiers are packed from long to short: a document opens a window of its
tier, whole documents of shorter tiers fill the gap, largest first, and one is cut where none fits. So
every window but a task's last is full at a power of two and needs no padding. Windows of a tier form
step groups of equal tokens. A task packs its own rows in blocks of bounded size, nothing is shuffled,
and the rows left at a block's end go on to the next.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import as_array, ragged_take, slices, then_free

TIERS = (256, 512, 1024, 2048)
#: Tokens that a task gathers before it packs them, and tokens of a step group.
BLOCK, STEP = 1 << 20, 8 * 2048
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: The splitting pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def byte_level_encoding(path: str):
    """The file's byte-level BPE, loaded once in each Python process; its special tokens stay special."""
    if path not in _encodings:
        import tiktoken

        from .token_counts import byte_alphabet

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte, special = byte_alphabet(), {x["content"]: x["id"] for x in data["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cuts texts before each space or newline that follows a character that surely is no white space.

    The pattern never joins what stands on both sides of such a cut, so units can be encoded alone.
    Returns the units and each text's offsets into them.
    """
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        before = raw[:-1]
        sure = (before > 32) & (before < 127)
        sure[1:] |= (before[1:] >= 128) & (before[:-1] >= 0xC3) & (before[:-1] <= 0xDF)
        cut[1:-1] = sure & ((raw[1:] == 32) | (raw[1:] == 10))
    cut[ends] = True
    cut[-1] = False
    begins = np.flatnonzero(cut)
    offsets = np.concatenate([begins, [len(raw)]]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
    return flat, np.searchsorted(begins, ends)


def token_ids(texts: pa.Array, path: str, end: int) -> list[np.ndarray]:
    """Each text's ids with ``end`` after them; each distinct unit of the texts is encoded once."""
    coding = byte_level_encoding(path)
    special = set(coding.special_tokens_set)
    flat, offsets = units(texts)
    coded = flat.dictionary_encode()
    ids = [
        coding.encode(u, allowed_special=special) if "<|" in u else coding.encode_ordinary(u)
        for u in coded.dictionary.to_pylist()
    ]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    joined = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    taken, lengths = ragged_take(joined, np.concatenate([[0], np.cumsum(sizes)]), codes)
    places = np.concatenate([[0], np.cumsum(lengths)])[offsets]
    last = np.array([end], np.uint32)
    return [np.concatenate([taken[a:b], last]) for a, b in zip(places[:-1], places[1:])]


class Piece(NamedTuple):
    """``ids[start:stop]`` of a document; pieces sort by length."""

    length: int
    order: int
    doc_id: int | None
    start: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(length=at), self._replace(length=self.length - at, start=self.start + at)


def tier_of(length: int) -> int:
    return next(t for t in TIERS if t >= length)


def pack(pool: list[Piece], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (tier, pieces) and, unless this is the ``last`` block, the pieces of the one that isn't full."""
    windows: list[tuple[int, list[Piece]]] = []
    short: list[Piece] = []
    for piece in pool:
        while piece.length > TIERS[-1]:
            head, piece = piece.cut(TIERS[-1])
            windows.append((TIERS[-1], [head]))
        short.append(piece)
    short.sort(key=lambda p: (p.length, p.order, p.start))
    while short:
        opened = short.pop()
        size = tier_of(opened.length)
        window, gap = [opened], size - opened.length
        while gap and short:
            at = bisect_right(short, gap, key=lambda p: p.length)
            if at:
                filler = short.pop(at - 1)
            else:
                filler, rest = short.pop(0).cut(gap)
                insort(short, rest, key=lambda p: p.length)
            window.append(filler)
            gap -= filler.length
        if gap and not last:
            return windows, window
        windows.append((size, window))
    return windows, []


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset, window, step_group`` per piece.

    Takes ``docs(doc_id, text)``; a null or empty text is its end id alone. Every id lies in one piece.
    ids is binary, little-endian unsigned 32-bit. A window is full but for the last of a task, whose
    sequence is to be padded to 2048 unless its length is a power of two. sequence_id and step_group
    hold the task's number in their high bits. Repeated rows are packed each; no rows give no pieces.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        pool: list[Piece] = []
        held = sequence = order = 0
        filled = dict.fromkeys(TIERS, 0)

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal pool, held, sequence
            windows, pool = pack(pool, last)
            held = sum(p.length for p in pool)
            rows = []
            for tier, window in windows:
                step = base + (filled[tier] // STEP << 2) + TIERS.index(tier)
                filled[tier] += tier
                offset = 0
                for p in window:
                    ids = p.ids[p.start : p.start + p.length].astype("<u4").tobytes()
                    rows.append((p.doc_id, p.start, p.length, ids, len(p.ids), base + sequence, offset, tier, step))
                    offset += p.length
                sequence += 1
            columns = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            texts = as_array(batch.column("text"))
            for lo, hi in slices(texts, SLICE):
                doc_ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                for doc_id, ids in zip(doc_ids, then_free(token_ids, texts.slice(lo, hi - lo), tokenizer, end)):
                    pool.append(Piece(len(ids), order, doc_id, 0, ids))
                    order += 1
                    held += len(ids)
                    if held >= BLOCK:
                        yield emit(False)
        if pool:
            yield emit(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
        "window int, step_group long",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group"
    )
