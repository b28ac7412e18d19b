"""Operator 9: word-first language identification with character n-gram backoff.

A word that any language's word list holds is scored by its log frequency in each language. Any other
word falls back to its character 4-grams, and where the model knows none of them to 3-grams, 2-grams
and single characters. The lists are sorted arrays of 64-bit hashes, with the languages that have each entry beside them,
so their size is that of the sample's distinct words and n-grams and doesn't multiply with the number of languages.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, kept
from .names import numbered, only, place
from .words import as_array, hash_strings, horner, lookup, mix, ragged_take, slices, split_words, sum_by_text, window_starts

ORDERS = (4, 3, 2, 1)
#: Words whose joint evidence a score reflects at most.
EVIDENCE = 20


class Entries(NamedTuple):
    """Sorted keys; entry i's languages and log frequencies, less ``floor``, are at ``starts[i]:starts[i + 1]``. A language
    without the entry has the ``floor``, half a sighting in the language with the most."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    floor: float


class LanguageModel(NamedTuple):
    """``Entries`` per order (0: words)."""

    languages: list[str]
    tables: dict[int, Entries]


def gains(table: Entries, at: np.ndarray, rows: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A rows x languages matrix of the summed gains of entries ``at`` that belong to ``rows``."""
    places, times = ragged_take(np.arange(len(table.langs)), table.starts, at)
    cell = np.repeat(rows, times) * shape[1] + table.langs[places]
    return np.bincount(cell, weights=table.gains[places], minlength=shape[0] * shape[1]).reshape(shape)


def letters_of(vocab: pa.Array) -> pa.Array:
    """Lower-cased words without what is not a letter."""
    return pc.replace_substring_regex(pc.utf8_lower(vocab), r"\P{L}+", "")


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed characters of the words, each between two spaces, and the words' offsets."""
    padded = pc.binary_join_element_wise(" ", words, " ", "")
    flat = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64))
    return mix(flat + np.uint64(1)), np.concatenate([[0], ends])


def grams(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside words, and each one's word."""
    ok = window_starts(offsets, order, len(points))
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return horner(points, order)[ok], word[: len(ok)][ok]


def count_features(docs: DataFrame) -> DataFrame:
    """``lang, kind, key, n`` summed over all rows of ``docs(lang, text)``; kind 0 is words."""

    def count(batches):
        for batch in batches:
            texts, langs = as_array(batch.column("text")), as_array(batch.column("lang")).dictionary_encode()
            which = langs.indices.to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                words = split_words(texts.slice(lo, hi - lo))
                clean = letters_of(words.vocab)
                keys = hash_strings(clean)
                written = pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0
                points, offsets = code_points(clean)
                of_word = np.repeat(which[lo:hi], np.diff(words.offsets))
                for lang in np.unique(which[lo:hi]):
                    times = np.bincount(words.codes[of_word == lang], minlength=len(keys)) * written
                    for kind in (0, *ORDERS):
                        key, n = (keys, times) if kind == 0 else (lambda g: (g[0], times[g[1]]))(grams(points, offsets, kind))
                        key, n = key[n > 0], n[n > 0]
                        key, at = np.unique(key, return_inverse=True)
                        n = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([langs.dictionary[int(lang)].as_py()] * len(key), pa.string()),
                                pa.array(np.full(len(key), kind, np.int32)),
                                pa.array(key.view(np.int64)),
                                pa.array(n),
                            ],
                            ["lang", "kind", "key", "n"],
                        )

    parts = docs.select("text", "lang").mapInArrow(count, "lang string, kind int, key long, n long")
    return parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, most_rows: int = 5_000, most_languages: int = 200) -> LanguageModel:
    """Learns from rows of ``docs(doc_id, text, lang)`` that have a lang and a text.

    Of a language with more than ``most_rows`` such rows a hash of doc_id and text picks about that many, and of more than
    ``most_languages`` those with the most rows (ties: in order) are learned; that is the classifier's bound, and a rare
    language keeps all its rows. Every word and n-gram seen twice in a language's sample is learned. Further columns are
    ignored; no rows give a model without languages.
    """
    known = only(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    lang, share = pa.array([r["lang"] for r in rows], pa.string()), pa.array([min(1.0, most_rows / r["count"]) for r in rows], pa.float64())
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": lang, "share": share}))  # Arrow: Spark knows its size and broadcasts it if small
    picked = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    known = known.join(shares, "lang").where(picked)
    counts = kept(count_features(known.select("text", "lang")), "features")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total")).toPandas()  # a row per language and kind
    found = counts.where("n >= 2").toArrow()  # as many as the sample's rows have
    discard(counts)
    languages = sorted(str(x) for x in totals["lang"].unique())
    kinds, of_lang = found["kind"].to_numpy(), np.searchsorted(languages, found["lang"].to_numpy().astype(str)) if len(found) else np.empty(0, np.int64)
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    tables = {}
    for kind in (0, *ORDERS):
        total = np.ones(len(languages))
        own = totals[totals["kind"] == kind]
        total[np.searchsorted(languages, own["lang"].to_numpy().astype(str)) if len(own) else []] = own["total"]
        floor = float(np.log(0.5 / total.max(initial=1)))
        at = np.flatnonzero(kinds == kind)
        at = at[np.lexsort((of_lang[at], keys[at]))]
        each, starts = np.unique(keys[at], return_index=True)
        logp = np.log(n[at] / total[of_lang[at]])
        tables[kind] = Entries(each, np.append(starts, len(at)), of_lang[at].astype(np.int16), (logp - floor).astype(np.float32), floor)
    return LanguageModel(languages, tables)


def word_scores(model: LanguageModel, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of log scores for each word, and whether it has a letter."""
    clean = letters_of(vocab)
    written = pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0
    languages, table = len(model.languages), model.tables[0]
    at = lookup(table.keys, hash_strings(clean))
    known = np.flatnonzero(at >= 0)
    out = gains(table, at[known], known, (len(vocab), languages)) + table.floor
    rest = np.flatnonzero(written & (at < 0))
    for order in ORDERS:
        if not len(rest):
            break
        points, offsets = code_points(clean.take(pa.array(rest)))
        gram, word = grams(points, offsets, order)
        table = model.tables[order]
        at = lookup(table.keys, gram)
        word, at = word[at >= 0], at[at >= 0]
        hits = np.bincount(word, minlength=len(rest))
        done = hits > 0
        out[rest[done]] = (gains(table, at, word, (len(rest), languages)) / np.maximum(1, hits)[:, None] + table.floor)[done]
        rest = rest[~done]
    out[~written] = 0
    return out, written


def languages_of(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language and score, as ``identify`` defines them."""
    names = np.array([*model.languages, "und"], dtype=object)
    words = split_words(texts)
    best, share = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
    if len(names) > 1 and len(words.codes):
        scores, written = word_scores(model, words.vocab)
        n = sum_by_text(written.astype(np.int64)[words.codes], words.offsets)
        sums = np.stack([sum_by_text(column[words.codes], words.offsets) for column in scores.T], axis=1)
        has = n > 0
        sums = sums[has] * np.minimum(1, EVIDENCE / n[has])[:, None]
        best[has] = sums.argmax(1)
        share[has] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    return names[best], share


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs(doc_id, text)``.

    A null text, one without a letter, and any text under a model without languages are ``und`` with
    score 0. Otherwise score is the softmax share of the best language, with the evidence of a longer
    text scaled down to that of ``EVIDENCE`` words; ties go to the first language in order. A very long text is a slice
    of its own. Repeated rows and null doc_ids are rows like others.
    """

    def predict(batches):
        for batch in batches:
            texts = as_array(batch.column("text"))
            for lo, hi in slices(texts):
                best, share = languages_of(texts.slice(lo, hi - lo), model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(best, pa.string()), pa.array(share)],
                    ["doc_id", "lang_pred", "score"],
                )

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        predict, "doc_id long, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns under any names, whose text has a language with a score of ``least`` or more. Null
    texts, and those without a letter, go; repeated rows are judged each; a very long text is a slice of its own."""
    at = place(docs, "text")

    def keep(batches):
        for batch in batches:
            texts = as_array(batch.column(at))
            for lo, hi in slices(texts):
                best, share = languages_of(texts.slice(lo, hi - lo), model)
                yield batch.slice(lo, hi - lo).filter(pa.array((best != "und") & (share >= least)))

    rows = numbered(docs)
    return rows.mapInArrow(keep, rows.schema).toDF(*docs.columns)


def held_out():
    """A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
