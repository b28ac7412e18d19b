"""Operator 7: byte-pair encoding and decoding by batched numpy merge rounds.

The distinct words of a slice are normalised, cut into pieces and laid out as symbols in one flat
array. Each round finds every neighbouring pair's rank by binary search over the sorted pair keys and
merges, in every word at once, the occurrences of its lowest-ranked pair. A word leaves the rounds when
no pair of it has a rank. The whole texts' ids are then gathered from their words' ids.

A round looks at all symbols that are left, so words that outlast ``ROUNDS`` of them go on in another kind of round: it takes
the lowest rank of all these words, and looks only at the pairs of that rank and at the neighbours that their merges change. A
word of a million letters costs about as many steps as it has letters.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import unicodedata
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Words, as_array, lookup, ragged_take, slices, split_words

NEVER = np.iinfo(np.int64).max
#: Rounds over all symbols, before long words go on by rank.
ROUNDS = 48
#: How the lower-case word vocabulary cuts normalised text into pieces.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordBpe(NamedTuple):
    """A word-end BPE vocabulary. ``inner`` and ``final`` map a byte to its symbol inside and at a word's end."""

    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    tokens: list[str]
    special: dict[str, int]


def load_word_bpe(path: str, end: str = "</w>") -> WordBpe:
    """Reads a tokenizer file; nothing is trained."""
    from .token_counts import byte_alphabet

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, special = data["model"]["vocab"], {x["content"]: x["id"] for x in data["added_tokens"]}
    size = 1 + max([*vocab.values(), *special.values()])
    tokens = [""] * size
    for token, number in [*vocab.items(), *special.items()]:
        tokens[number] = token
    rows = sorted(
        (vocab[a] * size + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(data["model"]["merges"])
    )
    table = np.array(rows, np.int64)
    inner, final = np.full(256, -1), np.full(256, -1)
    for char, byte in byte_alphabet().items():
        inner[byte], final[byte] = vocab.get(char, -1), vocab.get(char + end, -1)
    return WordBpe(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), inner, final, tokens, special)


def apart(starts: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of runs of overlapping occurrences, given in order and where one follows the one before it, every other from the left."""
    if not follows.any():
        return starts
    run = np.flatnonzero(np.concatenate([[True], ~follows]))
    place = np.arange(len(starts)) - np.repeat(run, np.diff(np.concatenate([run, [len(starts)]])))
    return starts[place % 2 == 0]


def rank_rounds(bpe: WordBpe, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``merge_rounds`` gives, in a round per rank: places wait in a queue by the rank of the pair they begin."""
    size, n = len(bpe.tokens), len(symbols)
    by_rank = np.zeros(len(bpe.ranks), np.int64)
    by_rank[bpe.ranks] = bpe.merged
    symbols, rank = symbols.copy(), np.full(n, NEVER)
    edge = word[1:] != word[:-1]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # neighbours that are left; n and -1 beyond a word
    after[:-1][edge], before[1:][edge] = n, -1
    waiting: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def wait(places: np.ndarray) -> list[int]:
        """Ranks and queues these places' pairs; returns the ranks that nothing waited for."""
        right = after[places]
        inner = right < n
        at = lookup(bpe.pairs, symbols[places] * size + symbols[np.where(inner, right, 0)])
        known = inner & (at >= 0)
        rank[places] = np.where(known, bpe.ranks[at], NEVER)
        places = places[known]
        ranks = rank[places]
        by = np.argsort(ranks, kind="stable")
        places, ranks = places[by], ranks[by]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        new = []
        for lo, hi, r in zip([0, *cuts], [*cuts, len(ranks)], ranks[[0, *cuts]].tolist() if len(ranks) else ()):
            if r not in waiting:
                waiting[r] = []
                new.append(r)
            waiting[r].append(places[lo:hi])
        return new

    order.extend(wait(np.arange(n)))
    heapify(order)
    while order:
        lowest = heappop(order)
        places = np.concatenate(waiting.pop(lowest))
        places = np.unique(places[rank[places] == lowest])
        if not len(places):
            continue
        places = apart(places, after[places[:-1]] == places[1:])
        right = after[places]
        beyond = after[right]
        symbols[places], symbols[right], rank[right] = by_rank[lowest], -1, NEVER
        after[places] = beyond
        inner = beyond < n
        before[beyond[inner]] = places[inner]
        left = before[places]
        for r in wait(np.concatenate([left[left >= 0], places])):
            heappush(order, r)
    live = symbols >= 0
    return symbols[live], word[live]


def merge_rounds(bpe: WordBpe, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges flat symbols, each with its word's number in ascending order, until no pair has a rank."""
    size = len(bpe.tokens)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rounds = 0
    while len(symbols):
        rounds += 1
        if rounds > ROUNDS:
            done.append(rank_rounds(bpe, symbols, word))
            break
        at = lookup(bpe.pairs, symbols[:-1] * size + symbols[1:])
        at[word[1:] != word[:-1]] = -1
        rank = np.full(len(symbols), NEVER)
        rank[:-1] = np.where(at >= 0, bpe.ranks[at], NEVER)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.concatenate([starts, [len(word)]])))
        over = lowest == NEVER
        done.append((symbols[over], word[over]))
        take = np.flatnonzero((rank == lowest) & ~over)
        take = apart(take, np.diff(take) == 1)
        symbols = symbols.copy()
        symbols[take] = bpe.merged[at[take]]
        live = ~over
        live[take + 1] = False
        symbols, word = symbols[live], word[live]
    if not done:
        return symbols, word
    symbols, word = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def normalise(text: str) -> str:
    """Canonical composition, then each character's own lower case."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def encode_vocab(bpe: WordBpe, vocab: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the distinct words and their offsets. Special tokens are found in the raw word."""
    special = regex.compile("|".join(map(regex.escape, bpe.special))) if bpe.special else None
    pieces: list[bytes] = []
    owner: list[int] = []  # of each piece: its word
    extra: list[tuple[int, int, int]] = []  # place among the pieces, word, id
    for number, text in enumerate(vocab.to_pylist()):
        if text.isascii() and text.isalpha():
            pieces.append(text.lower().encode())
            owner.append(number)
            continue
        marks = [*special.finditer(text)] if special and "<" in text else []
        begin = 0
        for mark in [*marks, None]:
            part = text[begin : mark.start() if mark else None]
            for piece in PIECE.findall(normalise(part)) if part else ():
                pieces.append(piece.encode())
                owner.append(number)
            if mark:
                extra.append((len(pieces), number, bpe.special[mark[0]]))
                pieces.append(b"\0")  # its one symbol is replaced below
                owner.append(number)
                begin = mark.end()
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    symbols = bpe.inner[flat]
    ends = np.cumsum(sizes)
    symbols[ends - 1] = bpe.final[flat[ends - 1]]
    for place, _, number in extra:
        symbols[ends[place] - 1] = number
    piece = np.repeat(np.arange(len(pieces)), sizes)
    ids, piece = merge_rounds(bpe, symbols[symbols >= 0], piece[symbols >= 0])
    word = np.array(owner, np.int64)[piece]
    return ids, np.searchsorted(word, np.arange(len(vocab) + 1))


def join_words(strings: pa.Array, words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's word strings joined by a space, without the words that are not kept."""
    kept = keep[words.codes]
    ends = np.concatenate([[0], np.cumsum(kept)])[words.offsets]
    flat = strings.take(pa.array(words.codes[kept]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat), " ")


def encode_decode(docs: DataFrame, bpe: WordBpe) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` per row of ``docs(doc_id, text)``.

    ids is binary, little-endian unsigned 32-bit; decoded joins the ids' tokens by a space, special ones
    included, as a file without a decoder asks for. Null and empty texts give no ids and an empty string.
    Rows stay as they are, repeated ones too, and equal pairs merge from the left; other columns are ignored. A text over 8 MB is
    a slice of its own, and one long word takes time about in proportion to its length.
    """

    def run(batches):
        names = np.array(bpe.tokens, dtype=object)
        for batch in batches:
            texts = as_array(batch.column("text"))
            for lo, hi in slices(texts):
                words = split_words(texts.slice(lo, hi - lo))
                ids, offsets = encode_vocab(bpe, words.vocab)
                flat, lengths = ragged_take(ids.astype("<u4"), offsets, words.codes)
                ends = np.concatenate([[0], np.cumsum(lengths)])[words.offsets]
                raw = flat.tobytes()
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(names[ids], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(ends)),
                        pa.Array.from_buffers(
                            pa.binary(), hi - lo, [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(raw)]
                        ),
                        join_words(pc.binary_join(tokens, " "), words, np.diff(offsets) > 0),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string"
    )


def op7_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode_decode(docs, load_word_bpe(public_tokenizers.path("word_bpe_49k.json")))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
