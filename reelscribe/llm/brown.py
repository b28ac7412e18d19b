"""Operator 3: Brown class-based n-gram scores.

Word counts are gathered over all training documents, and exchange clustering gives every training word a class:

1. The ``CORE`` most frequent words are put into classes by the sequential exchange algorithm, which moves a word to the
   class that raises the class-bigram likelihood most until a sweep moves none. Their matrix of counts has a fixed size.
2. Every other training word goes to the class that raises the likelihood most: Spark gathers each word's counts of the
   classes before and after it in buckets of the key space, whatever the size of the vocabulary.
3. Sweeps then exchange all words, the core too, given the classes of all their neighbours: a word is taken out of the
   table of class bigrams and goes where the likelihood is highest. All words of a sweep move at once, each as if the others
   stayed, so half of them, by their keys, take turns, and only those due send their contexts. The exchange ends when both
   halves in turn raise the likelihood by less than ``TOLERANCE`` of it; a sweep that lowers it is taken back. Words seen once
   move together, by their endings.

A text's score adds, for each token, the smoothed log probability of its class after the class before it and of the word
in its class. Words never seen in training go to the class that holds most words seen once with their ending.

The vocabulary grows with the corpus, so it is never broadcast: words are 64-bit keys, counted in buckets of the key
space, and the buckets answer each chunk of documents with counts and classes of its distinct words. One scan writes the
documents as numbers; all passes read those. What is sent to every task is bounded: the core's classes and class tables.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, kept, kept_by
from .exchange import answers_of, arrays, batch_chunks, bucket_bits, first_value, packed_rows, row_key, runs, table, text_bytes, unpacked_rows
from .words import as_array, hash_strings, lookup, lower_ascii, split_words, sum_by_text

#: Words that are exchanged one by one, classes of words, endings (a power of two).
CORE, CLASSES, ENDINGS = 1024, 48, 16
#: The least share by which two sweeps must raise the likelihood for more to follow.
TOLERANCE = 1e-3
#: Words whose gains are found together, and counts up to which what they add to a cell is worked out once for all words.
BATCH, SMALL = 1024, 16
#: Classes that aren't exchanged: the text's end, and words without a class yet.
END, OPEN, FIXED = 0, 1, 2
WIDTH = FIXED + CLASSES
#: A word's contexts: classes before it, classes after it, and itself.
ITSELF = 2 * WIDTH
CONTEXTS = ITSELF + 1
#: Added to the class of a word that moves in the next sweep.
DUE = 128
#: Weight of the class unigram in transitions, in observations.
PRIOR = 50.0
#: Key of the token that ends a text: no word has it, and it sorts first.
END_KEY = np.uint64(0)


def word_keys(vocab: pa.Array) -> np.ndarray:
    """A key per word: a 60-bit hash, then the class of the word's last two bytes in the low bits."""
    hashed = hash_strings(vocab)
    if not len(hashed):
        return hashed
    ends = np.frombuffer(vocab.buffers()[1], np.int32)[vocab.offset : vocab.offset + len(vocab) + 1].astype(np.int64)
    raw = np.frombuffer(vocab.buffers()[2], np.uint8)
    last = raw[ends[1:] - 1].astype(np.uint64)
    before = np.where(np.diff(ends) > 1, raw[np.maximum(ends[1:] - 2, 0)], 0).astype(np.uint64)
    ending = (last * np.uint64(31) + before * np.uint64(7)) % np.uint64(ENDINGS)
    keys = (hashed & ~np.uint64(ENDINGS - 1)) | ending
    return np.where(keys == END_KEY, np.uint64(ENDINGS), keys)


CHUNKED = {"chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "block": pa.binary()}


def numbered(docs: DataFrame) -> DataFrame:
    """``chunk, keys, counts, block`` for each chunk of ``docs(row_key, doc_id, text, train)``: sorted distinct word keys (the
    end's first), their counts in training texts, and the compressed rows with their tokens as places in ``keys``."""

    def number(batches):
        for batch in batches:
            for chunk, rows in batch_chunks(batch):
                words = split_words(lower_ascii(as_array(rows.column("text"))))
                keys, place = np.unique(np.concatenate([[END_KEY], word_keys(words.vocab)]), return_inverse=True)
                n = np.diff(words.offsets) + 1
                tokens = np.zeros(int(n.sum()), "<u4")
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(n) - 1] = False
                tokens[inner] = place[1:][words.codes]
                train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(tokens[np.repeat(train, n)], minlength=len(keys)).astype("<u4")
                whole = {"tokens": [tokens.tobytes()], "n": [n.tolist()], "train": [train.tolist()], "doc_id": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))}
                out = {"chunk": [chunk], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "block": [packed_rows(pa.RecordBatch.from_pydict(whole))]}
                yield from table(out, CHUNKED).to_batches()

    return docs.mapInArrow(number, "chunk long, keys binary, counts binary, block binary")


class Texts(NamedTuple):
    """A chunk's rows: tokens as places, each one's text, the texts' offsets, which texts are for training, doc_ids."""

    tokens: np.ndarray
    of_text: np.ndarray
    offsets: np.ndarray
    train: np.ndarray
    doc_ids: pa.Array

    @classmethod
    def read(cls, block: bytes) -> Texts:
        rows = unpacked_rows(block)
        n, train = (np.array(rows[c][0].as_py(), kind) for c, kind in (("n", np.int64), ("train", bool)))
        tokens = np.frombuffer(rows["tokens"][0].as_py(), "<u4").astype(np.int64)
        return cls(tokens, np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)]), train, pa.array(rows["doc_id"][0].as_py(), pa.int64()))

    def neighbours(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the training tokens: places, classes before and classes after. A text begins after an end."""
        own = classes[self.tokens]
        before = np.concatenate([[END], own[:-1]])
        after = np.concatenate([own[1:], [END]])  # what follows an end belongs to another text and isn't used
        use = self.train[self.of_text]
        return self.tokens[use], before[use], after[use]

    def contexts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the training tokens: places, once for what is before and once for what is after, and contexts."""
        own, before, after = self.neighbours(classes)
        again = np.concatenate([[False], self.tokens[1:] == self.tokens[:-1]])  # texts end in a token that no word is
        repeated, repeats = again[self.train[self.of_text]], np.concatenate([again[1:], [False]])[self.train[self.of_text]]
        return np.concatenate([own, own[~repeats]]), np.concatenate([np.where(repeated, ITSELF, before), WIDTH + after[~repeats]])


COUNTED = {"bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "places": pa.binary()}
COUNTED_TEXT = "bucket int, chunk long, keys binary, counts binary, places binary"


def vocabulary(chunks: DataFrame, bits: int) -> DataFrame:
    """``bucket, keys, counts`` for each bucket of the key space, and rows ``bucket, chunk, places``: where in them a chunk's are."""

    def ask(batches):
        for batch in batches:
            for chunk, keys, counts in zip(batch.column("chunk").to_pylist(), arrays(batch.column("keys"), "<u8"), arrays(batch.column("counts"), "<u4")):
                cut = [(b, chunk, keys[lo:hi].tobytes(), counts[lo:hi].tobytes(), None) for b, lo, hi in runs(keys, bits)]
                yield from table(dict(zip(COUNTED, map(list, zip(*cut)))), COUNTED).to_batches()

    def add(rows: pa.Table) -> pa.Table:
        each = arrays(rows["keys"], "<u8")
        keys, back = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, back, np.concatenate(arrays(rows["counts"], "<u4")).astype(np.int64))
        places = [x.astype("<i4").tobytes() for x in np.split(back, np.cumsum([len(x) for x in each])[:-1])]
        bucket, none = first_value(rows["bucket"]), [None] * len(each)
        out = {"bucket": [bucket] * (len(each) + 1), "chunk": [None, *rows["chunk"].to_pylist()], "keys": [keys.tobytes(), *none], "counts": [counts.tobytes(), *none], "places": [None, *places]}
        return table(out, COUNTED)

    return chunks.select("chunk", "keys", "counts").mapInArrow(ask, COUNTED_TEXT).groupBy("bucket").applyInArrow(add, COUNTED_TEXT)


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` frequent keys, ascending, and their counts; ties go to the smaller key."""

    def best(batches):
        for batch in batches:
            for keys, n in zip(arrays(batch.column("keys"), "<u8"), arrays(batch.column("counts"), "<i8")):
                own = np.lexsort((keys, -n))
                own = own[keys[own] != END_KEY][:most]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(n[own])], ["key", "n"])

    top = counts.mapInArrow(best, "key long, n long").orderBy(F.desc("n"), "key").limit(most).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(np.int64)[order]


def core_classes(keys: np.ndarray, known: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Classes of a chunk's keys where only the core has any."""
    at = lookup(known, keys)
    return np.where(at >= 0, of[at] if len(of) else OPEN, np.where(keys == END_KEY, END, OPEN))


def core_bigrams(chunks: DataFrame, known: np.ndarray) -> np.ndarray:
    """Counts of neighbouring places (the end, any other word, the core's words) in training texts; the size is fixed."""
    size = FIXED + len(known)

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for keys, block in zip(arrays(batch.column("keys"), "<u8"), batch.column("block").to_pylist()):
                place = core_classes(keys, known, FIXED + np.arange(len(known)))
                own, before, _ = Texts.read(block).neighbours(place)
                total += np.bincount(before * size + place[own], minlength=size * size)
        there = np.flatnonzero(total)
        for lo in range(0, len(there), 1 << 16):
            own = there[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["pair", "n"])

    summed = chunks.select("keys", "block").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[summed["pair"].to_numpy(np.int64)] = summed["n"]
    return out.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, fixed: int = FIXED) -> np.ndarray:
    """A class for each place: the first ``fixed`` places are classes of their own, the other words share ``classes``.

    Words start dealt out by frequency. A sweep takes each word, most frequent first, out of its class and puts
    it where the likelihood of the class bigrams is highest. It ends when a sweep moves no word.
    """
    size = len(bigrams)
    total = fixed + classes
    order = fixed + np.argsort(-bigrams.sum(0)[fixed:], kind="stable")
    of = np.arange(size)
    of[order] = fixed + np.arange(len(order)) % classes
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # of each place: counts of classes after and before it
    grid = member.T @ right
    free = np.arange(fixed, total)
    moved = 1
    while moved:
        moved = 0
        for w in order:
            own, loop = of[w], bigrams[w, w]
            after, before = right[w].copy(), left[w].copy()
            after[own] -= loop
            before[own] -= loop
            grid[own] -= after
            grid[:, own] -= before
            grid[own, own] -= loop
            rows, columns = grid[free], grid.T[free]
            gain = (xlogx(rows + after) - xlogx(rows)).sum(1) + (xlogx(columns + before) - xlogx(columns)).sum(1)
            diagonal = grid[free, free]
            gain -= xlogx(diagonal + after[free]) - xlogx(diagonal) + xlogx(diagonal + before[free]) - xlogx(diagonal)
            gain += xlogx(diagonal + after[free] + before[free] + loop) - xlogx(diagonal)
            outs, ins = rows.sum(1) + before[free], columns.sum(1) + after[free]  # with what goes to and comes from w
            gain -= xlogx(outs + after.sum() + loop) - xlogx(outs) + xlogx(ins + before.sum() + loop) - xlogx(ins)
            gain[own - fixed] += 1e-9 * (1 + abs(gain[own - fixed]))  # a tie moves nothing, so sweeps come to an end
            new = int(free[gain.argmax()])
            grid[new] += after
            grid[:, new] += before
            grid[new, new] += loop
            if new != own:
                moved += 1
                of[w] = new
                column = bigrams[:, w]
                right[:, own] -= column
                right[:, new] += column
                row = bigrams[w]
                left[:, own] -= row
                left[:, new] += row
    return of


def grid_of(bigrams: np.ndarray, of: np.ndarray) -> np.ndarray:
    member = np.zeros((len(of), WIDTH))
    member[np.arange(len(of)), of] = 1
    return member.T @ bigrams @ member


def likelihood(grid: np.ndarray) -> float:
    """The part of the training likelihood that depends on the classes."""
    return float(xlogx(grid).sum() - xlogx(grid.sum(0)).sum() - xlogx(grid.sum(1)).sum())


TOLD = {"bucket": pa.int32(), "block": pa.binary(), "pair": pa.int32(), "n": pa.int64()}
TOLD_TEXT = "bucket int, block binary, pair int, n long"


def context_rows(texts: list[Texts], keys: np.ndarray, classes: np.ndarray, wanted: np.ndarray, bits: int) -> pa.Table:
    """By bucket, the wanted words' counts of their contexts, compressed."""
    tokens, beside = (np.concatenate(c) for c in zip(*(t.contexts(classes) for t in texts)))
    use = wanted[tokens]
    pair, n = np.unique(tokens[use] * CONTEXTS + beside[use], return_counts=True)
    word, context = pair // CONTEXTS, (pair % CONTEXTS).astype(np.uint8)
    words, first = np.unique(word, return_index=True)
    ends = np.append(first[1:], len(word))
    out = {name: [] for name in TOLD}
    for bucket, lo, hi in runs(keys[words], bits):
        a, b = first[lo], ends[hi - 1]
        own = {"keys": keys[words[lo:hi]].tobytes(), "sizes": (ends[lo:hi] - first[lo:hi]).astype(np.uint8).tobytes(), "contexts": context[a:b].tobytes(), "n": n[a:b].astype("<u4").tobytes()}
        values = (bucket, packed_rows(pa.RecordBatch.from_pydict({k: [v] for k, v in own.items()})), None, None)
        for name, value in zip(TOLD, values):
            out[name].append(value)
    return table(out, TOLD)


def bucket_contexts(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's words, sorted, and their counted contexts: places among the words, ascending, contexts and counts."""
    told = pa.concat_tables([unpacked_rows(x) for x in blocks])
    keys = np.concatenate(arrays(told["keys"], "<u8"))
    sizes, contexts, n = (np.concatenate(arrays(told[c], kind)) for c, kind in (("sizes", "u1"), ("contexts", "u1"), ("n", "<u4")))
    there = np.unique(keys)
    cell = np.repeat(np.searchsorted(there, keys), sizes) * CONTEXTS + contexts
    order = np.argsort(cell, kind="stable")  # of sorted runs, one for each block
    cell, n = cell[order], n[order].astype(float)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
    return there, cell[first] // CONTEXTS, cell[first] % CONTEXTS, np.add.reduceat(n, first) if len(first) else n


def small_gains(grid: np.ndarray) -> np.ndarray:
    """``[n, beside, class]``: what ``n`` more bigrams, up to ``SMALL``, gain in the cell ``grid[class, beside]``."""
    cells = grid[FIXED:].T
    return xlogx(cells + np.arange(SMALL + 1)[:, None, None]) - xlogx(cells)


def gains_beside(cells: tuple[np.ndarray, np.ndarray, np.ndarray], other: np.ndarray, own: np.ndarray, grid: np.ndarray, small: np.ndarray) -> np.ndarray:
    """What the cells beside a word's class, but for the diagonal, gain by its bigrams in each class it may get.

    ``cells`` are words, ascending, the classes beside them and counts. ``grid[class, beside]`` has the word in its ``own``
    class; ``other`` are the word's bigrams on its other side.
    """
    gain = np.zeros((len(own), CLASSES))
    word, beside, count = cells
    if not len(word):
        return gain
    mine = own[word]
    more = small[np.minimum(count, SMALL).astype(np.int64), beside]
    at = np.flatnonzero(count > SMALL)
    large = grid[FIXED:, beside[at]].T
    more[at] = xlogx(large + count[at, None]) - xlogx(large)
    at = np.flatnonzero(mine >= FIXED)
    held = grid[mine[at], beside[at]]
    more[at, mine[at] - FIXED] = xlogx(held) - xlogx(held - count[at])
    at = np.flatnonzero(beside == mine)
    left = grid[FIXED:, beside[at]].T - other[word[at], FIXED:]
    more[at] = xlogx(left + count[at, None]) - xlogx(left)
    at = np.flatnonzero(beside >= FIXED)
    more[at, beside[at] - FIXED] = 0
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    gain[word[first]] = np.add.reduceat(more, first)
    return gain


def class_gains(counts: np.ndarray, own: np.ndarray, grid: np.ndarray, small: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """By how much each class raises the likelihood if a word, of ``counts[word, context]`` and taken out of its ``own`` class,
    is put there and all other words stay; up to what is the same for all classes. ``small`` are the ``small_gains`` of the
    grid and of its transpose."""
    before, after, loop = counts[:, :WIDTH], counts[:, WIDTH:ITSELF], counts[:, ITSELF]
    rows, columns = small or (small_gains(grid), small_gains(grid.T))
    word, context = np.nonzero(counts)
    n = counts[word, context]
    ahead, behind = (context >= WIDTH) & (context < ITSELF), context < WIDTH
    gain = gains_beside((word[ahead], context[ahead] - WIDTH, n[ahead]), before, own, grid, rows)
    gain += gains_beside((word[behind], context[behind], n[behind]), after, own, grid.T, columns)
    both = after[:, FIXED:] + before[:, FIXED:] + loop[:, None]
    word, of = np.nonzero(both)
    n = both[word, of]
    diagonal = grid[FIXED + of, FIXED + of] - np.where(own[word] == FIXED + of, n, 0)
    gain[word, of] += xlogx(diagonal + n) - xlogx(diagonal)
    held = np.flatnonzero(own >= FIXED)
    mine = own[held]
    for side, total in ((after, grid.sum(1)), (before, grid.sum(0))):
        size = side.sum(1) + loop
        cases, case = np.unique(size, return_inverse=True)
        less = (xlogx(total[FIXED:] + cases[:, None]) - xlogx(total[FIXED:]))[case]
        less[held, mine - FIXED] = xlogx(total[mine]) - xlogx(total[mine] - size[held])
        gain -= less
    return gain


def best_classes(word: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class that raises the likelihood most for each word, given its counted contexts, its ``own`` class and the class
    bigrams ``grid``; of equal ones its own, then the first."""
    best, small = own.copy(), (small_gains(grid), small_gains(grid.T))
    for lo in range(0, len(own), BATCH):
        mine = own[lo : lo + BATCH]
        a, b = np.searchsorted(word, [lo, lo + len(mine)])
        counts = np.zeros((len(mine), CONTEXTS))
        counts[word[a:b] - lo, context[a:b]] = n[a:b]
        gain = class_gains(counts, mine, grid, small)
        held = np.flatnonzero(mine >= FIXED)
        gain[held, mine[held] - FIXED] += 1e-9 * (1 + np.abs(gain[held, mine[held] - FIXED]))
        best[lo : lo + len(mine)] = FIXED + gain.argmax(1)
    return best


def turns_of(keys: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Which of two turns each word takes: words seen ``once`` that of their ending."""
    return (np.where(once, keys, keys // np.uint64(ENDINGS)) % np.uint64(2)).astype(np.int64)


def shared_classes(keys: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_classes`` of a bucket's words, and which of two turns each takes. Those seen once are placed together, by their
    endings: without its one sighting such a word is like one never seen, so what stands beside it says nothing of its own."""
    once = np.bincount(word, weights=n * ((context < WIDTH) | (context == ITSELF)), minlength=len(keys)) == 1
    group = (keys & np.uint64(ENDINGS - 1)).astype(np.int64)
    of = np.where(once, group, ENDINGS + np.arange(len(keys)))  # groups first, then words of their own
    shared = once[word]
    together = np.bincount(group[word[shared]] * CONTEXTS + context[shared], weights=n[shared], minlength=ENDINGS * CONTEXTS)
    cells = np.flatnonzero(together)
    own_cells = of[word[~shared]] * CONTEXTS + context[~shared]
    cells, n = np.concatenate([cells, own_cells]), np.concatenate([together[cells], n[~shared]])
    low, high = np.full(ENDINGS, WIDTH), np.full(ENDINGS, -1)
    np.minimum.at(low, group[once], own[once])
    np.maximum.at(high, group[once], own[once])
    held = np.concatenate([np.where(low == high, low, OPEN), own])  # a group that is spread has no class to be taken out of
    best = best_classes(cells // CONTEXTS, cells % CONTEXTS, n, held, grid)
    return best[of], turns_of(keys, once)


PLACED = {"bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "classes": pa.binary()}
PLACED_TEXT = "bucket int, keys binary, counts binary, classes binary"


def placed(words: DataFrame, contexts: DataFrame, grid: np.ndarray, known: np.ndarray, of: np.ndarray) -> DataFrame:
    """``bucket, keys, counts, classes`` of the vocabulary; words with contexts get their best class. Words that have no class
    yet begin with the core's, or open."""
    given = "classes" in words.columns

    def place(held: pa.Table, told: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, np.uint64), *arrays(held["keys"], "<u8")])
        classes = arrays(held["classes"], "u1")[0].astype(np.int64) if given and held.num_rows else core_classes(keys, known, of)
        if told.num_rows:
            there, *counted = bucket_contexts(told["block"].to_pylist())
            at = lookup(keys, there)
            classes[at], _ = shared_classes(there, *counted, classes[at], grid)
        return table({"bucket": held["bucket"].to_pylist(), "keys": [keys.tobytes()], "counts": held["counts"].to_pylist(), "classes": [classes.astype("u1").tobytes()]}, PLACED)

    told = contexts.where("bucket is not null").select(F.col("bucket").alias("told_bucket"), "block")
    return words.groupBy("bucket").cogroup(told.groupBy("told_bucket")).applyInArrow(place, PLACED_TEXT)


def answered(requests: DataFrame, words: DataFrame, endings: np.ndarray | None = None, counts: bool = False, turn: int | None = None) -> DataFrame:
    """``chunk, bucket, classes, counts``: classes (and counts) of each chunk's keys; with ``endings``, unseen words get theirs;
    the classes of words that move in ``turn`` are marked as ``DUE``."""
    kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "classes": pa.binary(), "counts": pa.binary()}

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys, n, classes = (arrays(held[c], kind)[0] for c, kind in (("keys", "<u8"), ("counts", "<i8"), ("classes", "u1")))
        if endings is not None:
            classes = np.where((n == 0) & (keys != END_KEY), endings[(keys & np.uint64(ENDINGS - 1)).astype(int)], classes)
        if turn is not None:
            classes = classes + DUE * ((turns_of(keys, n == 1) == turn) & (keys != END_KEY))
        places = arrays(asked["places"], "<i4")
        out = {"chunk": asked["chunk"].to_pylist(), "bucket": asked["asked"].to_pylist(), "classes": [classes[p].astype("u1").tobytes() for p in places]}
        return table(out | {"counts": [n[p].tobytes() if counts else None for p in places]}, kinds)

    asked = requests.select(F.col("bucket").alias("asked"), "chunk", "places")
    return asked.groupBy("asked").cogroup(words.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, classes binary, counts binary")


def counted_pass(chunks: DataFrame, answers: DataFrame, bits: int, contexts: bool) -> DataFrame:
    """``pair, n``: class bigrams of training texts given all words' classes; and, if asked for, ``bucket, block``: contexts of
    the words that are due."""

    def count(held: pa.Table, found: pa.Table) -> pa.Table:
        out = [table(dict.fromkeys(TOLD, []), TOLD)]
        if held.num_rows:
            texts = [Texts.read(block) for block in held["block"].to_pylist()]
            keys = arrays(held["keys"], "<u8")[0] if contexts else np.empty(0, np.uint64)
            marked = answers_of(found, "classes", "u1", held["size"][0].as_py())
            classes = (marked % DUE).astype(np.int64)
            own, before, _ = (np.concatenate(c) for c in zip(*(t.neighbours(classes) for t in texts)))
            grid = np.bincount(before * WIDTH + classes[own], minlength=WIDTH * WIDTH)
            there = np.flatnonzero(grid)
            none = [None] * len(there)
            out.append(table({"bucket": none, "block": none, "pair": there, "n": grid[there]}, TOLD))
            if contexts:
                out.append(context_rows(texts, keys, classes, marked >= DUE, bits))
        return pa.concat_tables(out)

    size = (F.octet_length("keys") / 8).cast("long").alias("size")
    held = chunks.select("chunk", "block", size, *(["keys"] if contexts else []))
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(count, TOLD_TEXT)


def summed_grid(passed: DataFrame) -> np.ndarray:
    found = passed.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # class pairs
    grid = np.zeros(WIDTH * WIDTH)
    grid[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return grid.reshape(WIDTH, WIDTH)


def first_contexts(chunks: DataFrame, known: np.ndarray, of: np.ndarray, bits: int) -> DataFrame:
    """``bucket, block``: contexts of the words beyond the core, whose own neighbours beyond it are open."""

    def count(batches):
        for batch in batches:
            for keys, block in zip(arrays(batch.column("keys"), "<u8"), batch.column("block").to_pylist()):
                classes = core_classes(keys, known, of)
                yield from context_rows([Texts.read(block)], keys, classes, classes == OPEN, bits).to_batches()

    return chunks.select("keys", "block").mapInArrow(count, TOLD_TEXT)


class BrownModel(NamedTuple):
    """Transitions are log10 of p(class | class before); ``totals`` and ``unseen`` are a class's tokens and its mass for
    words never seen, ``endings`` the class of such a word by its ending."""

    grid: np.ndarray
    transitions: np.ndarray
    totals: np.ndarray
    unseen: np.ndarray
    endings: np.ndarray
    tokens: int
    types: int


def class_model(words: DataFrame, grid: np.ndarray) -> BrownModel:
    """From the class bigrams and the classes of ``words(keys, counts, classes)``, gathered in Spark by class and ending."""

    def add(batches):
        for batch in batches:
            for keys, n, of in zip(*(arrays(batch.column(c), kind) for c, kind in (("keys", "<u8"), ("counts", "<i8"), ("classes", "u1")))):
                cell = of.astype(np.int64) * ENDINGS + (keys & np.uint64(ENDINGS - 1)).astype(np.int64)
                parts = [np.bincount(cell, weights=w, minlength=WIDTH * ENDINGS).astype(np.int64) for w in (n, n == 1, n > 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH * ENDINGS)), *map(pa.array, parts)], ["cell", "tokens", "once", "types"])

    summed = words.select("keys", "counts", "classes").mapInArrow(add, "cell long, tokens long, once long, types long").groupBy("cell")
    found = summed.agg(*(F.sum(c).alias(c) for c in ("tokens", "once", "types"))).toPandas()  # classes times endings
    cells = np.zeros((3, WIDTH * ENDINGS), np.int64)
    if len(found):
        cells[:, found["cell"].to_numpy(np.int64)] = found[["tokens", "once", "types"]].to_numpy(np.int64).T
    tokens, once, types = cells.reshape(3, WIDTH, ENDINGS)
    totals, free = tokens.sum(1), once[FIXED:]
    endings = FIXED + np.where(free.sum(0) > 0, free.argmax(0), free.sum(1).argmax())
    unseen = np.zeros(WIDTH)
    open_ = np.unique(endings)
    unseen[open_] = np.where(totals[open_] > 0, (once.sum(1)[open_] + 0.5) / (totals[open_] + 1), 1)
    single = (totals + 1) / (totals + 1).sum()
    transitions = np.log10((grid + PRIOR * single) / (grid.sum(1, keepdims=True) + PRIOR))
    return BrownModel(grid, transitions, totals, unseen, endings, int(totals.sum()), int(types.sum()))


class Fitted(NamedTuple):
    model: BrownModel
    chunks: DataFrame
    requests: DataFrame
    words: DataFrame


def fit(docs: DataFrame, sweeps: int | None = None, tolerance: float = TOLERANCE) -> Fitted:
    """The model, the numbered chunks of ``docs(doc_id, text)``, what they ask for, and all words with counts and classes.
    Rows that are held out are numbered too, but nothing is learned from them. ``sweeps`` ends the exchange early."""
    bits = bucket_bits(text_bytes(docs))
    given = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long"), F.col("text").cast("string"), (~held_out()).alias("train"))
    chunks = kept_by(numbered(given), "chunks", "chunk")
    found = kept(vocabulary(chunks, bits), "vocabulary")
    counts, requests = found.where("chunk is null").select("bucket", "keys", "counts"), found.where("chunk is not null").select("bucket", "chunk", "places")
    known, _ = frequent_words(counts, CORE)
    bigrams = core_bigrams(chunks, known)
    of = exchange(bigrams, CLASSES)
    grid, known_classes = grid_of(bigrams, of), of[FIXED:]
    words = kept(placed(counts, first_contexts(chunks, known, known_classes, bits), grid, known, known_classes), "classes")

    def passed_with(held: DataFrame, turn: int | None) -> tuple[DataFrame, np.ndarray]:
        passed = kept(counted_pass(chunks, answered(requests, held, turn=turn), bits, turn is not None), "class_bigrams")
        return passed, summed_grid(passed)

    rose: list[float] = []

    def goes_on() -> bool:
        return len(rose) != sweeps and (len(rose) < 2 or max(rose[-2:]) >= tolerance)

    passed, grid = passed_with(words, 0 if goes_on() else None)
    while goes_on():
        tried = kept(placed(words, passed, grid, known, known_classes), "classes")
        turn = None if len(rose) + 1 == sweeps else (len(rose) + 1) % 2
        tried_passed, tried_grid = passed_with(tried, turn)
        rose.append((likelihood(tried_grid) - likelihood(grid)) / max(1.0, abs(likelihood(grid))))
        if rose[-1] > 0:
            words, passed, grid, tried, tried_passed = tried, tried_passed, tried_grid, words, passed
        elif goes_on():  # the words that stay have told contexts of the half that was due before
            discard(passed)
            passed, _ = passed_with(words, turn)
        discard(tried, tried_passed)
    discard(passed)
    return Fitted(class_model(words, grid), chunks, requests, words)


def score(fitted: Fitted) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` per row.

    A null or empty text is its end alone. Repeated rows are scored each; no rows give no rows.
    """
    model = fitted.model
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def weigh(held: pa.Table, found: pa.Table) -> pa.Table:
        done = [table(dict.fromkeys(kinds, []), kinds)]
        for block, size in zip(held["block"].to_pylist(), held["size"].to_pylist()):
            texts = Texts.read(block)
            of = answers_of(found, "classes", "u1", size).astype(np.int64)
            c = answers_of(found, "counts", "<i8", size)
            unseen = model.unseen[of]
            with np.errstate(divide="ignore"):
                emit = np.log10(np.where(c > 0, (1 - unseen) * c / np.maximum(model.totals[of], 1), unseen))
            emit[0] = 0  # the end is its class's only word
            base = np.log10((c + 1) / (model.tokens + model.types + 1))
            classes = of[texts.tokens]
            before = np.concatenate([[END], classes[:-1]])
            each = {
                "n_tokens": np.diff(texts.offsets), "n_known": sum_by_text((c > 0).astype(np.int64)[texts.tokens], texts.offsets),
                "base_score": sum_by_text(base[texts.tokens], texts.offsets), "score": sum_by_text(emit[texts.tokens] + model.transitions[before, classes], texts.offsets),
            }
            done.append(pa.table({"doc_id": texts.doc_ids, **each}, pa.schema(list(kinds.items()))))
        return pa.concat_tables(done)

    size = (F.octet_length("keys") / 8).cast("long").alias("size")
    answers = answered(fitted.requests, fitted.words, model.endings, counts=True)
    held = fitted.chunks.select("chunk", "block", size)
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(weigh, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out():
    """A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def class_scores(docs: DataFrame) -> DataFrame:
    """Learns from the rows of ``docs(doc_id, text)`` that aren't held out and scores all rows; see ``score``.

    A null doc_id is not held out. A very long text is a chunk of its own. Further columns are ignored. Words are known by
    60-bit hashes (and four bits of their ending), so two words may in principle share a count.
    """
    fitted = fit(docs)
    return score(fitted).withColumn("held_out", held_out()).withColumn("train_tokens", F.lit(fitted.model.tokens).cast("long"))


def op3_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return class_scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
