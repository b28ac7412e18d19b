"""Operator 1: greedy word-piece lengths from a linear longest-match automaton.

The vocabulary is a byte trie. Each node that is a piece fails to the root and pops one piece; any
other node fails to where its parent's failure path can go on, and carries how many pieces that pops.
A word's length is the sum of what its failures pop, so each byte is read once, no piece is built and
nothing is read again. Words of a slice are dictionary-encoded first and the automaton steps through
all distinct words together, one byte position at a time.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import as_array, lookup, slices, split_words, sum_by_text

START = b" "


class Automaton(NamedTuple):
    """``edges`` is sorted (node * 256 + byte) with ``goto`` beside it; ``fail`` is -1 where nothing can go on."""

    edges: np.ndarray
    goto: np.ndarray
    fail: np.ndarray
    pops: np.ndarray


def build_automaton(pieces: list[bytes]) -> Automaton:
    """Pieces that start a word begin with ``START``; the others continue one."""
    children: list[dict[int, int]] = [{}]
    ends = [False]
    for piece in pieces:
        node = 0
        for byte in piece:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(False)
            node = children[node][byte]
        ends[node] = node > 0
    fail, pops = [-1] * len(children), [0] * len(children)
    level = [0]
    while level:
        below = []
        for parent in level:
            for byte, node in children[parent].items():
                below.append(node)
                if ends[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                at, popped = fail[parent], pops[parent]
                while at >= 0 and byte not in children[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = children[at][byte], popped
        level = below
    edges = sorted((node * 256 + byte, to) for node, own in enumerate(children) for byte, to in own.items())
    pair = np.array(edges, np.int64).reshape(-1, 2)
    return Automaton(pair[:, 0].copy(), pair[:, 1].copy(), np.array(fail), np.array(pops))


def piece_lengths(auto: Automaton, words: list[bytes]) -> np.ndarray:
    """Pieces per word (each already begins with ``START``); -1 where the vocabulary can't spell it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))  # words longer than step
        todo = np.arange(live)
        todo = todo[node[todo] >= 0]
        while len(todo):
            at = lookup(auto.edges, node[todo] * 256 + flat[begins[todo] + step])
            went = at >= 0
            node[todo[went]] = auto.goto[at[went]]
            todo = todo[~went]
            count[todo] += auto.pops[node[todo]]
            node[todo] = auto.fail[node[todo]]
            todo = todo[node[todo] >= 0]
    todo = np.flatnonzero(node > 0)
    while len(todo):
        count[todo] += auto.pops[node[todo]]
        node[todo] = auto.fail[node[todo]]
        todo = todo[node[todo] > 0]
    out = np.empty(len(words), np.int64)
    out[order] = np.where(node < 0, -1, count)
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file; its leading-space pieces are those that start a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = byte_alphabet()
    return [bytes(byte[c] for c in piece) for piece in vocab]


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` per row of ``docs(doc_id, text)``.

    A word the pieces can't spell counts as one unknown token. Null and empty texts have no words and
    no tokens. Rows stay as they are, repeated ones included; other columns are ignored.
    """
    auto = build_automaton(pieces)

    def count(batches):
        for batch in batches:
            texts = as_array(batch.column("text"))
            for lo, hi in slices(texts, 16 << 20):
                words = split_words(texts.slice(lo, hi - lo))
                each = piece_lengths(auto, [START + w for w in words.vocab.cast(pa.binary()).to_pylist()])
                unknown = each < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(words.offsets)),
                        pa.array(sum_by_text(np.where(unknown, 1, each)[words.codes], words.offsets)),
                        pa.array(sum_by_text(unknown.astype(np.int64)[words.codes], words.offsets)),
                    ],
                    ["doc_id", "n_words", "n_tokens", "n_unknown"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, n_words long, n_tokens long, n_unknown long"
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json")))
