"""Operator 12: spelling variants by dynamic programming over a sorted vocabulary.

Two words are near if one inserted, deleted or replaced code point makes them equal. What a word and a near word share
before or after the edit is at least ``shared`` code points long, so a word looks for near ones only among the words that
begin as it does, and in the list of reversed words among those that end as it does. Such a stretch of a sorted list is read
as the runs of equal prefixes that the lengths of neighbours' common prefixes (LCPs) cut it into. All words of a
task go down these runs together, depth by depth: the three cells of the edit matrix next to its diagonal are computed once
for a run and passed on to the runs inside it, and a run whose prefix is more than one edit away is skipped whole.

The lists are cut into blocks at words of a sample. The same descent, over the cuts alone, tells which blocks a word can
have near words in. A block's words meet those in bounded pieces, and what leaves it is a row per word, not a pair.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, kept
from .names import only
from .words import as_array, slices, split_words

#: A word's least code points and occurrences; the modulus of what is deleted from runs.
LETTERS, TIMES, ODDS = 5, 3, 97
#: Words of a block, words that meet a block in one piece, and the most blocks of a list.
BLOCK, PIECE, BLOCKS = 20_000, 60_000, 10_000
#: Sampled words per block, and the code points that a cut keeps.
PER_BLOCK, CUT = 20, 256
#: Depth from which single words are compared as a whole.
DEEP = 64
#: Words that go down a list together.
TOGETHER = 4_000
LAST = "\U0010ffff"


def letter_runs(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a space for each byte outside ``A-Za-z\\u00C0-\\u00FF``, whose last 64 are the
    two-byte sequences that C3 begins."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy()
    upper = (raw >= 65) & (raw <= 90)
    raw[upper] += 32
    lead = raw == 0xC3
    wanted = ((raw >= 97) & (raw <= 122)) | lead
    wanted[1:] |= lead[:-1]
    raw[~wanted] = 32
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(raw)])


def count_runs(texts: pa.Array, doc_ids: list[int | None]) -> tuple[pa.Array, np.ndarray]:
    """A slice's distinct words, with what the hash deletes gone, and their counts."""
    words = split_words(letter_runs(texts))
    of_text = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    pairs, times = np.unique(of_text * np.int64(max(1, len(words.vocab))) + words.codes, return_counts=True)
    owner, code = np.divmod(pairs, max(1, len(words.vocab)))
    spelled = words.vocab.cast(pa.binary()).to_pylist()
    begun = [zlib.crc32(b"%s:" % (b"" if x is None else str(x).encode())) for x in doc_ids]
    hashes = np.fromiter((zlib.crc32(spelled[c], begun[o]) for o, c in zip(owner.tolist(), code.tolist())), np.int64, len(pairs))
    hit = hashes % ODDS == 0
    n = np.bincount(code[~hit], weights=times[~hit], minlength=len(spelled)).astype(np.int64)
    cut, cut_n = [], times[hit].tolist()
    for c, h in zip(code[hit].tolist(), hashes[hit].tolist()):
        word = spelled[c].decode()
        at = h % len(word)
        cut.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([words.vocab, pa.array(cut, pa.string())]), np.concatenate([n, np.array(cut_n, np.int64)])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: words of LETTERS code points or more that all rows of ``docs(doc_id, text)`` have TIMES times or more."""

    def count(batches):
        for batch in batches:
            texts, ids = as_array(batch.column("text")), batch.column("doc_id").to_pylist()
            for lo, hi in slices(texts):
                words, n = count_runs(texts.slice(lo, hi - lo), ids[lo:hi])
                there = pa.array((n > 0) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= LETTERS))
                yield pa.RecordBatch.from_arrays([words.filter(there), pa.array(n).filter(there)], ["word", "n"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def shared(word: str) -> int:
    """Code points that a word shares with a near one at its begin or its end, at least."""
    return (len(word) - 1) // 2


class SortedList:
    """A sorted list of distinct words as code points, with each word's LCP with the one before it."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.lcp = np.full(len(words), -1, np.int64)
        at, depth = np.arange(1, len(words)), 0
        while len(at):
            ended = (self.length[at - 1] <= depth) | (self.length[at] <= depth)
            same = ~ended
            same[same] = self.flat[self.offset[at[same] - 1] + depth] == self.flat[self.offset[at[same]] + depth]
            self.lcp[at[~same]] = depth
            at, depth = at[same], depth + 1


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether words, as code points, are exactly one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    off = np.flatnonzero(a != b[: len(a)])
    if len(a) == len(b):
        return len(off) == 1
    at = off[0] if len(off) else len(a)
    return bool((a[at:] == b[at + 1 :]).all())


def descend(lists: SortedList, asked: SortedList, blocks: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``asked, found``: places of words of ``lists`` one edit away from words of ``asked``, among those that begin alike.

    With ``blocks`` the list holds cuts, and ``found`` are blocks (0 before the first cut) that may hold such words; the
    same one may come repeatedly.
    """
    begin = [word[: shared(word)] for word in asked.words]
    low = np.fromiter((bisect_left(lists.words, x) for x in begin), np.int64, len(begin))
    high = np.fromiter((bisect_left(lists.words, x + LAST) for x in begin), np.int64, len(begin))
    depth_of = np.fromiter(map(len, begin), np.int64, len(begin))
    if blocks:
        yield np.arange(len(begin)), low  # the block that the first of these words may lie in
    new = high > low
    order = np.argsort(depth_of, kind="stable")
    order = order[new[order]]
    sorted_depths = depth_of[order]
    q, lo, hi = (np.empty(0, np.int64) for _ in range(3))
    cells = np.empty((3, 0), np.int8)  # at one place before the diagonal, on it, and one after
    depth = int(sorted_depths[0]) if len(order) else 0
    while True:
        come = order[np.searchsorted(sorted_depths, depth) : np.searchsorted(sorted_depths, depth, side="right")]
        if len(come):
            q, lo, hi = np.concatenate([q, come]), np.concatenate([lo, low[come]]), np.concatenate([hi, high[come]])
            cells = np.concatenate([cells, np.repeat(np.array([[1], [0], [1]], np.int8), len(come), axis=1)], axis=1)
        if not len(q):
            later = np.searchsorted(sorted_depths, depth, side="right")
            if later == len(order):
                return
            depth = int(sorted_depths[later])
            continue
        if depth >= DEEP and not blocks:
            alone = np.flatnonzero(hi - lo == 1)
            near = [i for i in alone.tolist() if one_edit(asked.flat[asked.offset[q[i]] : asked.offset[q[i] + 1]], lists.flat[lists.offset[lo[i]] : lists.offset[lo[i] + 1]])]
            yield q[near], lo[near]
            more = hi - lo > 1
            q, lo, hi, cells = q[more], lo[more], hi[more], cells[:, more]
        # The runs one deeper, and the cells of each.
        breaks = np.flatnonzero(lists.lcp <= depth)
        first, last = np.searchsorted(breaks, lo), np.searchsorted(breaks, hi)
        times = last - first
        up = np.repeat(np.arange(len(q)), times)
        at = np.arange(len(up)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        q, lo = q[up], breaks[at]
        hi = np.append(breaks, len(lists.words))[at + 1]
        a, b, c = cells[:, up]
        if blocks:
            yield q, hi
        size = asked.length[q]
        ends = lists.length[lo] == depth
        if ends.any() and not blocks:
            off = np.select([size == depth - 1, size == depth, size == depth + 1], [a, b, c], 2)
            near = ends & (off == 1)
            yield q[near], lo[near]
        go = ~ends
        q, lo, hi, a, b, c, size = q[go], lo[go], hi[go], a[go], b[go], c[go], size[go]
        letter = lists.flat[lists.offset[lo] + depth]
        start = asked.offset[q]

        def differs(j: int) -> np.ndarray:
            """Whether the run's letter isn't letter j of the word; there is none before the first and after the last."""
            if j < 0:
                return np.ones(len(q), np.int8)
            return ((j >= size) | (asked.flat[np.minimum(start + j, len(asked.flat) - 1)] != letter)).astype(np.int8)

        before = np.minimum(a + differs(depth - 1), b + 1)
        same = np.minimum(np.minimum(b + differs(depth), c + 1), before + 1)
        after = np.minimum(c + differs(depth + 1), same + 1)
        cells = np.minimum(np.stack([np.where(depth > size, 2, before), np.where(depth + 1 > size, 2, same), np.where(depth + 2 > size, 2, after)]), 2).astype(np.int8)
        alive = cells.min(0) <= 1
        q, lo, hi, cells = q[alive], lo[alive], hi[alive], cells[:, alive]
        depth += 1


def blocks_of(cuts: SortedList, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word, block``, each once, for what ``descend`` finds over the cuts of a list."""
    for low in range(0, len(words), TOGETHER):
        asked = SortedList(words[low : low + TOGETHER])
        found = list(descend(cuts, asked, blocks=True))
        both = np.unique(np.concatenate([q * np.int64(len(cuts.words) + 1) + block for q, block in found]))
        q, block = np.divmod(both, len(cuts.words) + 1)
        yield q + low, block


def near_words(block: pa.Table) -> pa.Table:
    """``word, n_near, form, form_n`` for each of a piece's words that has near words among the block's members."""
    back = block["side"][0].as_py() == 1
    table = block.to_pydict()
    members, asking = ({w: n for w, n, m in zip(table["word"], table["n"], table["member"]) if m is wanted} for wanted in (True, False))
    lists, asking = SortedList(sorted(members)), sorted(asking)
    n = [members[w] for w in lists.words]
    out: dict[str, list] = {}
    for low in range(0, len(asking), TOGETHER):
        asked = SortedList(asking[low : low + TOGETHER])
        for q, at in descend(lists, asked) if lists.words else ():
            for i, j in zip(q.tolist(), at.tolist()):
                word, other = asked.words[i], lists.words[j]
                if back:
                    word, other = word[::-1], other[::-1]
                    if other.startswith(word[: shared(word)]):
                        continue  # found in the other list
                best = out.setdefault(word, [0, 0, ""])
                best[0] += 1
                if n[j] > best[1] or n[j] == best[1] and other < best[2]:
                    best[1:] = n[j], other
    columns = list(zip(*out.values())) or [(), (), ()]
    return pa.table({"word": pa.array(out, pa.string()), "n_near": pa.array(columns[0], pa.int64()), "form": pa.array(columns[2], pa.string()), "form_n": pa.array(columns[1], pa.int64())})


def cuts_of(words: DataFrame, total: int, size: int) -> list[str]:
    """Words that cut a sorted list of ``words(word)`` into blocks of about ``size`` words, at most BLOCKS of them."""
    count = min(BLOCKS, -(-total // size))
    share = min(1.0, count * PER_BLOCK / max(1, total))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.substring("word", 1, CUT).alias("word"))
    found = sorted({r["word"] for r in drawn.collect()})  # about BLOCKS * PER_BLOCK at most
    return sorted({found[len(found) * i // count] for i in range(1, count)}) if found else []


def near_table(vocab: DataFrame, size: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``word, n_near, form, form_n`` of the words of ``vocab(word, n)`` that have near words; ``form`` is the near word of
    the largest n, of several the smallest."""
    total = vocab.count()
    cuts = [cuts_of(vocab if side == 0 else vocab.select(F.reverse("word").alias("word")), total, size) for side in (0, 1)]

    def route(batches):
        lists = [SortedList(x) for x in cuts]
        for batch in batches:
            own = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            for side in (0, 1):
                turned = {w[::-1]: n for w, n in own.items()} if side else own
                words = sorted(turned)
                home = [bisect_right(cuts[side], w) for w in words]
                rows = [(words, home, True)]
                rows += [([words[i] for i in q.tolist()], block.tolist(), False) for q, block in blocks_of(lists[side], words)]
                for spelled, block, member in rows:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([side] * len(spelled), pa.int32()), pa.array(block, pa.int32()), pa.array(spelled, pa.string()),
                        pa.array([turned[w] for w in spelled], pa.int64()), pa.array([member] * len(spelled)),
                    ], ["side", "block", "word", "n", "member"])

    routed = kept(vocab.select("word", "n").mapInArrow(route, "side int, block int, word string, n long, member boolean"), "routes")
    pieces = routed.where("not member").groupBy("side", "block").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    dealt = routed.join(F.broadcast(pieces), ["side", "block"])  # at most 2 * BLOCKS rows
    own = F.when(F.col("member"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")))
    found = dealt.withColumn("piece", F.explode(own)).groupBy("side", "block", "piece").applyInArrow(near_words, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    near = kept(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "near")
    discard(routed)
    return near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows of ``forms(word, form)``: the last form that following them leads to. Counts at least double with
    each step, so a chain has at most 63, and each round here doubles the steps taken."""
    steps = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        taken = kept(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(steps)
        steps = taken
        if taken.where("moved").isEmpty():
            return steps.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of ``docs(doc_id, text)``.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]`` count, A-Z lower-cased; from one whose crc32 with its doc_id is a multiple of 97 a code
    point is deleted. Words have at least 5 code points and 3 occurrences. The form is the near word of the largest n, of
    several the smallest, if its n is at least twice the word's; else it is null and the word its own root. Texts are read
    whole, very long runs too. A null text has no words, a null doc_id counts as an empty string; repeated rows count
    each; no rows give no rows. Further columns are ignored.
    """
    vocab = kept(vocabulary(docs), "vocabulary")
    rows = vocab.join(near_table(vocab), "word", "left")
    twice = F.col("form_n") >= 2 * F.col("n")
    rows = kept(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(twice, F.col("form")).alias("form"), F.when(twice, F.col("form_n")).alias("form_n")), "forms")
    roots = roots_of(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
