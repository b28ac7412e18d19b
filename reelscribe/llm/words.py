"""Batched word handling inside tasks: Arrow text in, numpy codes and hashes out.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; both sets are ASCII, so bytes
and code points give the same words. A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15))
SHIFT = np.uint64(33)
#: Bytes of text whose words are taken apart at once where only hashes of them go on.
PASS = 2 << 20


class Words(NamedTuple):
    """Words of a slice of texts: ``codes`` index ``vocab``; text i holds ``offsets[i]:offsets[i+1]``."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.StringArray


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each; a longer text is a range of its own."""
    ends = np.cumsum(byte_lengths(texts))
    lo = 0
    while lo < len(texts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield lo, hi
        lo = hi
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Returns to the system what Arrow's pool and the C library's heap hold free. Python workers live from task to task and
    stage to stage, and share their executor's memory with its JVM and each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def then_free(f: Callable, *args):
    """``f(*args)``, after which the memory of its temporaries goes back."""
    try:
        return f(*args)
    finally:
        give_back()


def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def split_words(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    offsets = np.minimum(offsets, len(flat))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # space at either end of a text leaves an empty word
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(codes, offsets, coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> SHIFT)
    x = x * MIX[0]
    x ^= x >> SHIFT
    x *= MIX[1]
    x ^= x >> SHIFT
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit SipHash of each string."""
    if not len(values):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(values.to_pylist(), dtype=object), categorize=False)


def horner(hashes: np.ndarray, count: int, step: int = 1) -> np.ndarray:
    """Hash of ``count`` hashes that are ``step`` apart, from each start where they fit."""
    n = len(hashes) - (count - 1) * step
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, count):
        out = mix(out * MIX[2] + hashes[j * step : j * step + n])
    return out


def window_starts(offsets: np.ndarray, width: int, total: int) -> np.ndarray:
    """Marks the positions of ``total`` words at which a window of ``width`` stays in its text."""
    ok = np.zeros(max(0, total - width + 1), bool)
    edge = np.zeros(total + 1, np.int32)
    lo, hi = offsets[:-1], offsets[1:] - width + 1
    keep = hi > lo
    np.add.at(edge, lo[keep], 1)
    np.add.at(edge, hi[keep], -1)
    ok[:] = np.cumsum(edge)[: len(ok)] > 0
    return ok


def sum_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty texts give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: offsets[-1]], offsets[:-1][full])
    return out


def ragged_take(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the chosen rows of a ragged array; returns it with the rows' lengths."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    ends = np.cumsum(lengths)
    if not len(rows) or not ends[-1]:
        return flat[:0], lengths
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1][rows] - (ends - lengths), lengths)
    return flat[at], lengths


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles, A-Z lower-cased.

    A text with fewer words has its whole word sequence as its one shingle; one without words, or null, has none.
    """
    out: list[np.ndarray] = []
    for lo, hi in slices(texts, PASS):
        words = split_words(lower_ascii(texts.slice(lo, hi - lo)))
        hashed = hash_strings(words.vocab)[words.codes]
        windows = horner(hashed, width)
        for a, b in zip(words.offsets[:-1], words.offsets[1:]):
            if b - a >= width:
                out.append(np.unique(windows[a : b - width + 1]))
            elif b > a:
                sized = np.concatenate([np.array([b - a], np.uint64), hashed[a:b]])
                out.append(horner(sized, len(sized)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
