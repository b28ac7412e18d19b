"""Operator 2: quality rules with a modified Kneser-Ney n-gram perplexity.

One scan counts the character 5-grams of every word (between word-start and word-end marks) per language. Counts meet in
buckets of the grams' key space, sorted arrays of hashes; Spark turns all of them into interpolated modified
Kneser-Ney probabilities, order by order, in joins on grams. The grams grow with the table, so they are never broadcast:
the buckets answer each chunk of the scan with the probabilities of its distinct grams, all of which are known, and a
second scan scores each distinct word once per language. A document's level is the upper quartile of its words'
perplexities: a few odd words (a key, an address, a foreign name) leave it alone, text that is odd throughout moves
it. Documents whose level is outside their language's band are rejected.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import discard, kept
from .exchange import answers_of, arrays, blocks, bucket_bits, first_value, packed_rows, runs, table, text_bytes, unpacked_rows
from .names import carried, only, restored
from .words import Words, as_array, hash_strings, horner, lookup, mix, split_words, sum_by_text, then_free, window_starts

ORDER = 5
#: Band half-width in robust standard deviations of log perplexity, and the least such deviation.
WIDTH, NARROWEST = 6.0, 0.02
START, END, NUL = "\x02", "\x03", "�"
UNKNOWN = "und"


class Level(NamedTuple):
    """Grams of one order and their log probabilities; their contexts and log back-off weights. All sorted."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def row_hash(points: np.ndarray) -> np.ndarray:
    """Hash of each row of character hashes, equal to ``horner`` over the same characters."""
    if not points.shape[1]:
        return np.zeros(len(points), np.uint64)
    return horner(np.ascontiguousarray(points.T).reshape(-1), points.shape[1], len(points)) if len(points) else points[:, 0]


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more; a half each where counts of counts give none."""
    return counted_discounts([np.count_nonzero(counts == i) for i in range(1, 5)])


def counted_discounts(n: list[int]) -> np.ndarray:
    """``discounts`` from how many counts are 1, 2, 3 and 4."""
    out = np.array([0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for i in range(3):
            if n[i]:
                d = i + 1 - (i + 2) * y * n[i + 1] / n[i]
                out[i] = d if 0 < d < i + 1 else out[i]
    return out


def estimate(points: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Modified Kneser-Ney levels, order 1 first, from the distinct highest-order grams and their counts."""
    grams, n, stack = points, counts.astype(np.float64), []
    while grams.shape[1]:
        stack.append((grams, n))
        _, first, n = np.unique(row_hash(grams[:, 1:]), return_index=True, return_counts=True)
        grams, n = grams[first][:, 1:], n.astype(np.float64)  # a shorter gram counts its distinct left neighbours
    levels: list[Level] = []
    for grams, n in reversed(stack):
        cut = discounts(n)[np.minimum(n, 3).astype(int) - 1]
        contexts, which = np.unique(row_hash(grams[:, :-1]), return_inverse=True)
        total, freed = np.bincount(which, weights=n), np.bincount(which, weights=cut)
        gamma = freed / total
        if levels:
            below = levels[-1]
            lower = np.exp(below.logp[lookup(below.keys, row_hash(grams[:, 1:]))])
        else:
            lower = np.full(len(grams), 1 / (len(grams) + 1))
        p = (n - cut) / total[which] + gamma[which] * lower
        keys = row_hash(grams)
        order = np.argsort(keys)
        levels.append(Level(keys[order], np.log(p[order]), contexts, np.log(gamma)))
    return levels


def gram_logp(levels: list[Level], points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log p of the grams of ORDER that start ``at`` these places, backing off where one is unseen."""
    full = levels[-1]
    found = lookup(full.keys, horner(points, len(levels))[at])  # nearly all are seen, so no rows of characters are built
    out = np.where(found >= 0, full.logp[found], 0)
    todo = np.flatnonzero(found < 0)
    for order in range(len(levels), 0, -1):
        level, skip = levels[order - 1], len(levels) - order
        rows = points[at[todo][:, None] + np.arange(skip, len(levels))]
        found = lookup(level.keys, row_hash(rows))
        out[todo[found >= 0]] += level.logp[found[found >= 0]]
        todo, rows = todo[found < 0], rows[found < 0]
        if not len(todo):
            break
        context = lookup(level.contexts, row_hash(rows[:, :-1]))
        out[todo] += np.where(context >= 0, level.backoff[context], 0)
        if order == 1:  # a character never seen
            out[todo] -= np.log(len(level.keys) + 1)
    return out


def marked(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words between their marks, and the words' offsets."""
    text = pc.binary_join_element_wise(START * (ORDER - 1), vocab, END, "")
    raw = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.where(raw == 0, np.uint32(ord(NUL)), raw), np.concatenate([[0], ends])


def used_words(codes: np.ndarray, of_word: np.ndarray, lang: int, size: int) -> np.ndarray:
    return np.bincount(codes[of_word == lang], minlength=size)


class Part(NamedTuple):
    """A chunk's words and, per language, (words used, offsets of their marked code points, places and keys of grams)."""

    words: Words
    of_word: np.ndarray
    grams: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    marks: list[np.ndarray]
    languages: list[str]


def gram_keys(points: np.ndarray, lang: str) -> np.ndarray:
    """Keys of a language's grams from their hashes."""
    return mix(points + hash_strings(pa.array([lang]))[0])


def chunk_part(rows: pa.RecordBatch | pa.Table) -> Part:
    texts, langs = as_array(rows.column("text")), as_array(rows.column("lang")).dictionary_encode()
    words, names = split_words(texts), langs.dictionary.to_pylist()
    of_word = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(words.offsets))
    grams, marks = [], []
    for lang in np.unique(of_word):
        there = np.flatnonzero(used_words(words.codes, of_word, lang, len(words.vocab)))
        raw, offsets = marked(words.vocab.take(pa.array(there)))
        ok = np.flatnonzero(window_starts(offsets, ORDER, len(raw)))
        hashes = horner(mix(raw.astype(np.uint64) + np.uint64(1)), ORDER)[ok]
        grams.append((int(lang), there, offsets, ok, gram_keys(hashes, names[int(lang)])))
        marks.append(raw)
    return Part(words, of_word, grams, marks, names)


def distinct_grams(part: Part) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *(g[4] for g in part.grams)]))


TOLD = {"bucket": pa.int32(), "chunk": pa.int64(), "block": pa.binary()}


def tell(chunk: int, part: Part, bits: int) -> pa.Table:
    """The chunk's distinct grams by bucket, in order of their keys: the grams themselves in a row, their counts and
    languages, compressed. Keys follow from grams and languages, so they don't travel."""
    found = []
    for (lang, there, offsets, ok, keys), raw in zip(part.grams, part.marks):
        times = used_words(part.words.codes, part.of_word, lang, len(part.words.vocab))
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(back, weights=np.repeat(times[there], np.diff(offsets))[ok])
        found.append((keys, counts.astype("<u4"), raw[ok[first][:, None] + np.arange(ORDER)], np.full(len(keys), lang, "<u2")))
    out = {name: [] for name in TOLD}
    if found:
        keys, counts, points, of_lang = map(np.concatenate, zip(*found))
        order = np.argsort(keys)
        keys, counts, of_lang = keys[order], counts[order], of_lang[order]
        text = points[order].astype("<u4").tobytes().decode("utf-32-le")
        for bucket, lo, hi in runs(keys, bits):
            values = {"grams": [text[ORDER * lo : ORDER * hi]], "counts": [counts[lo:hi].tobytes()], "of_lang": [of_lang[lo:hi].tobytes()], "langs": [part.languages]}
            for name, value in zip(TOLD, (bucket, chunk, packed_rows(pa.RecordBatch.from_pydict(values)))):
                out[name].append(value)
    return table(out, TOLD)


MERGED = {"bucket": pa.int32(), "key": pa.int64(), "lang": pa.string(), "gram": pa.string(), "n": pa.int64(), "chunk": pa.int64(), "places": pa.binary()}
MERGED_TEXT = "bucket int, key long, lang string, gram string, n long, chunk long, places binary"


def packed_places(places: np.ndarray) -> bytes:
    """Ascending places as steps, byte plane by byte plane: the upper planes are nearly all zero, and shrink to nothing
    where files and shuffles compress them."""
    return np.diff(places, prepend=0).astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def unpacked_places(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, "u1").reshape(4, -1).T).view("<u4")[:, 0]
    return np.cumsum(steps.astype(np.int64))


def merge(rows: pa.Table) -> pa.Table:
    """A bucket's distinct grams with their keys and counts, and for each chunk the places of its grams among them."""
    told = pa.concat_tables([unpacked_rows(x) for x in rows["block"].to_pylist()])
    counts, of_lang = arrays(told["counts"], "<u4"), arrays(told["of_lang"], "<u2")
    points = np.frombuffer("".join(told["grams"].to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
    names = sorted({name for own in told["langs"].to_pylist() for name in own})
    lang = np.concatenate([np.searchsorted(names, own)[of] for own, of in zip(told["langs"].to_pylist(), of_lang)])
    each = row_hash(mix(points.astype(np.uint64) + np.uint64(1)))
    for i, name in enumerate(names):
        each[lang == i] = gram_keys(each[lang == i], name)
    keys, first, back = np.unique(each, return_index=True, return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, back, np.concatenate(counts).astype(np.int64))
    grams = np.ascontiguousarray(points[first]).view(f"<U{ORDER}")[:, 0]
    places = [packed_places(x) for x in np.split(back, np.cumsum([len(x) for x in counts])[:-1])]
    bucket = first_value(rows["bucket"])
    held = {"bucket": [bucket] * len(keys), "key": keys.view(np.int64), "lang": np.array(names, object)[lang[first]], "gram": grams.astype(object), "n": n}
    asked = {"bucket": [bucket] * len(counts), "chunk": rows["chunk"].to_pylist(), "places": places}
    return pa.concat_tables([table(dict.fromkeys(MERGED, [None] * size) | own, MERGED) for size, own in ((len(keys), held), (len(counts), asked))])


def scanned(docs: DataFrame, *more) -> DataFrame:
    """``row_key, doc_id, text, lang`` and the columns ``more``; a null lang is ``und``."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(0), F.col("text").cast("string"), lang).alias("row_key")
    return docs.select(key, F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang"), *more)


def gram_table(held: DataFrame, bits: int) -> DataFrame:
    """All grams of the texts in ``held``, which are ``blocks``, by bucket, ``bucket, key, lang, gram, n``, and rows ``bucket,
    chunk, places`` that say which of a bucket's grams a chunk has."""

    def ask(batches):
        for batch in batches:
            for chunk, block in zip(batch.column("chunk").to_pylist(), batch.column("block").to_pylist()):
                yield from then_free(lambda: tell(chunk, chunk_part(unpacked_rows(block)), bits)).to_batches()

    return held.mapInArrow(ask, "bucket int, chunk long, block binary").groupBy("bucket").applyInArrow(lambda rows: then_free(merge, rows), MERGED_TEXT)


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n``: character 5-grams of all words of ``docs(doc_id, text, lang)``; a null lang is ``und``."""
    return gram_table(blocks(scanned(only(docs, "doc_id", "text", "lang"))), bucket_bits(text_bytes(docs))).where("gram is not null").select("lang", "gram", "n")


def gram_scores(counts: DataFrame) -> DataFrame:
    """``lang, gram, p`` and any further columns: what ``estimate`` gives each gram of ORDER, from all of ``counts(lang, gram, n, …)``."""
    spark, suffix = counts.sparkSession, F.expr("substring(gram, 2)")
    more = [c for c in counts.columns if c not in ("lang", "gram", "n")]
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # a shorter gram counts its distinct left neighbours
        levels[order] = kept(levels[order + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")), "grams")
    low = None
    for order in range(1, ORDER + 1):
        sizes = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]
        found = levels[order].groupBy("lang").agg(*sizes).collect()  # a row per language
        cuts = np.array([counted_discounts([r[f"n{i}"] for i in range(1, 5)]) for r in found]).reshape(-1, 3)
        names = pa.array([r["lang"] for r in found], pa.string())
        cuts = spark.createDataFrame(pa.table({"lang": names, "d1": cuts[:, 0], "d2": cuts[:, 1], "d3": cuts[:, 2]}))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.substring("gram", 1, order - 1) if order > 1 else F.lit("")
        grams = levels[order].join(cuts, "lang").select("lang", "gram", "n", cut.alias("cut"), context.alias("context"), suffix.alias("suffix"), *(more if order == ORDER else []))
        total = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"), F.count("*").alias("types"))
        grams = grams.join(total, ["lang", "context"])
        if low is None:
            grams = grams.withColumn("lower", 1 / (F.col("types") + 1))
        else:
            grams = grams.join(low.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        low = grams.select(*(more if order == ORDER else []), "lang", "gram", ((F.col("n") - F.col("cut") + F.col("freed") * F.col("lower")) / F.col("total")).alias("p"))
    return low


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in 3-word windows found twice or more."""
    if len(codes) < 4:
        return 0
    _, small = np.unique(codes, return_inverse=True)
    base = np.int64(small.max() + 1)
    pair = np.unique(small[:-1] * base + small[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * base + small[2:], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[window] > 1)
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def upper_quartile(values: np.ndarray) -> float:
    at = 3 * (len(values) - 1) // 4
    return float(np.partition(values, at)[at]) if len(values) else float("nan")


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    return len(lines) - len(set(lines))


def byte_hits(texts: pa.Array, wanted: bytes) -> np.ndarray:
    """How many bytes of each text are among the wanted ones."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    table = np.zeros(256, bool)
    table[list(wanted)] = True
    hit = np.flatnonzero(table[np.frombuffer(texts.buffers()[2] or b"", np.uint8)])
    return np.diff(np.searchsorted(hit, ends))


ANSWERED = {"chunk": pa.int64(), "bucket": pa.int32(), "logp": pa.binary()}
MEASURED = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, log_perplexity double, log_level double"
)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "log_level"]


def measure(blocks_: DataFrame, found: DataFrame, more: list[T.StructField]) -> DataFrame:
    """``doc_id, lang``, the base counts, ``base_failed``, ``log_perplexity`` and ``log_level`` (null without words) per row,
    and the columns ``more`` of the rows in ``blocks_``; ``found`` is their ``gram_table``."""

    def answer(requests: pa.Table, held: pa.Table) -> pa.Table:
        keys = held["key"].to_numpy().view(np.uint64)
        logp = np.log(held["p"].to_numpy())[np.argsort(keys)]
        found = [logp[unpacked_places(x)].tobytes() for x in requests["places"].to_pylist()]
        return table({"chunk": requests["chunk"].to_pylist(), "bucket": requests["asked"].to_pylist(), "logp": found}, ANSWERED)

    def weigh(held: pa.Table, answers: pa.Table) -> pa.Table:
        done = []
        for block in held["block"].to_pylist():
            rows = unpacked_rows(block)
            part = chunk_part(rows)
            known = distinct_grams(part)
            columns = measured(as_array(rows["text"]), part, known, answers_of(answers, "logp", "<f8", len(known)))
            named = dict(zip(COUNTS, (pa.array(c, from_pandas=True) for c in columns)))
            done.append(pa.table({"doc_id": rows["doc_id"], "lang": rows["lang"]} | named | {c.name: rows[c.name] for c in more}))
        return pa.concat_tables(done) if done else to_arrow_schema(schema).empty_table()

    schema = T.StructType(T._parse_datatype_string(MEASURED).fields + more)
    scores = gram_scores(found.where("gram is not null").select("lang", "gram", "n", "bucket", "key")).select("bucket", "key", "p")
    requests = found.where("chunk is not null").select(F.col("bucket").alias("asked"), "chunk", "places")
    answers = requests.groupBy("asked").cogroup(scores.groupBy("bucket")).applyInArrow(lambda asked, held: then_free(answer, asked, held), "chunk long, bucket int, logp binary")
    return blocks_.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda held, told: then_free(weigh, held, told), schema)


def measured(texts: pa.Array, part: Part, known: np.ndarray, gram_logps: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of a chunk."""
    words = part.words
    n_words = np.diff(words.offsets)
    size = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = sum_by_text(size[words.codes], words.offsets)
    logp = np.zeros(len(words.codes))
    for lang, there, offsets, ok, keys in part.grams:
        each = np.zeros(offsets[-1])
        each[ok] = gram_logps[lookup(known, keys)]
        full = np.zeros(len(words.vocab))
        full[there] = sum_by_text(each, offsets)
        mine = part.of_word == lang
        logp[mine] = full[words.codes[mine]]
    each_word = -logp / (size[words.codes] + 1)
    level = np.array([upper_quartile(each_word[a:b]) for a, b in zip(words.offsets[:-1], words.offsets[1:])], float)
    repeats = np.array([repeated_words(words.codes[a:b]) for a, b in zip(words.offsets[:-1], words.offsets[1:])], np.int64)
    lines = [repeated_lines(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
    score = np.where(n_words > 0, -sum_by_text(logp, words.offsets) / np.maximum(1, chars + n_words), np.nan)
    return [
        n_words, chars, byte_hits(texts, b"#*$%&|<>"), np.array(lines, np.int64), repeats,
        (n_words < 50) | (100 * repeats > 50 * n_words), score, level,
    ]


def median(rows: DataFrame, value: str, name: str, step: float = 1e-5) -> DataFrame:
    """``lang, name``: the lower median per language, to ``step``. Values are counted in cells, so it needs no sorted
    group and doesn't depend on how rows are dealt."""
    cells = rows.groupBy("lang", F.floor(F.col(value) / step).alias("cell")).agg(F.count("*").alias("n"))
    inside = Window.partitionBy("lang")
    running = F.sum("n").over(inside.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    half = cells.withColumn("upto", running).withColumn("all", F.sum("n").over(inside)).where("2 * upto >= all")
    return half.groupBy("lang").agg((F.min("cell") * step).alias(name))


def by_language(rows: DataFrame) -> DataFrame:
    """The same rows, one per language, as an Arrow table: its size is known, and Spark broadcasts it if it is small."""
    return rows.sparkSession.createDataFrame(rows.toArrow())


def judged(docs: DataFrame, width: float, narrowest: float, more: list[str]) -> DataFrame:
    written = blocks(docs)
    found = kept(gram_table(written, bucket_bits(text_bytes(docs))), "grams")
    scored = kept(measure(written, found, [docs.schema[c] for c in more]), "quality")
    discard(found, written)
    sound = scored.where(~F.col("base_failed") & F.col("log_level").isNotNull()).select("lang", "log_level")
    middle = by_language(median(sound, "log_level", "middle"))
    spread = sound.join(middle, "lang").select("lang", F.abs(F.col("log_level") - F.col("middle")).alias("off"))
    half = F.greatest(F.col("mad") * 1.4826, F.lit(narrowest)) * width
    bands = by_language(middle.join(median(spread, "off", "mad"), "lang").select("lang", (F.col("middle") - half).alias("low"), (F.col("middle") + half).alias("high")))
    inside = F.coalesce(F.col("log_level").between(F.col("low"), F.col("high")), F.lit(False))
    return scored.join(bands, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame, width: float = WIDTH, narrowest: float = NARROWEST) -> DataFrame:
    """The base counts, ``base_failed``, ``perplexity``, ``level``, its language's ``low`` and ``high``, ``kept`` per row.

    Takes ``docs(doc_id, text, lang)``. A language's band is the median log level of its rows that pass the
    base rules, ``width`` robust standard deviations (1.4826 times the median absolute deviation, at least
    ``narrowest``) to each side. A null lang is a language of its own, ``und``. Rows without words, and null texts, fail
    the base rules and have a null perplexity. A very long text is a chunk of its own. Further columns are ignored.
    Repeated rows count and return each; no rows give no rows.
    """
    out = judged(scanned(only(docs, "doc_id", "text", "lang")), width, narrowest, [])
    exact = {name: F.exp(old) for name, old in (("perplexity", "log_perplexity"), ("level", "log_level"), ("low", "low"), ("high", "high"))}
    return out.withColumns(exact).drop("log_perplexity", "log_level")


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns under any names, that ``judge`` keeps; each row travels through the scoring itself.
    Rows with a null text, or without words, go; repeated rows are judged, and stay, each."""
    rows = carried(docs, "doc_id", "text", "lang")
    return restored(judged(scanned(rows, "rest"), WIDTH, NARROWEST, ["text", "rest"]).where("kept"), docs)


def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "level"
    )
