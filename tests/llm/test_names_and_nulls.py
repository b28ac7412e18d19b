"""Stages on tables whose extra columns bear the names used inside, and whose ids are half null; brute force for models."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelscribe.llm import fingerprints, language_id, quality

from .fixtures import SCHEMA, documents, empty, words

CLASHING = [
    "key", "tie", "whole", "row_key", "chunk", "block", "bucket", "keys", "root", "set_key", "stays_key", "stays_number", "sound_key", "rest", "kept", "low", "high", "n", "share", "part", "h", "middle",
]


def test_clashing_columns_and_null_ids(spark):
    half = F.when(F.xxhash64("text") % 2 == 0, F.col("doc_id"))
    docs = documents(spark).withColumn("doc_id", half)
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-{i}-"), F.coalesce(F.md5("text"), F.lit("none"))))
    dotted = F.concat(F.lit("a.b-"), F.coalesce(F.md5("text"), F.lit("none")))
    docs = docs.select("*", dotted.alias("a.b"), dotted.alias("Text"), dotted.alias("DOC_ID"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r["a.b"] == r["Text"] == r["DOC_ID"] and r["a.b"].startswith("a.b-") for r in rows)
        for i, name in enumerate(CLASHING):
            assert all(str(r[name]).startswith(f"{name}-{i}-") for r in rows)


def plain_kneser_ney(counts):
    """Interpolated modified Kneser-Ney by the book, on dictionaries."""
    levels = {quality.ORDER: counts}
    for order in range(quality.ORDER - 1, 0, -1):
        levels[order] = Counter(g[1:] for g in levels[order + 1])
    cuts = {o: quality.counted_discounts([sum(n == i for n in level.values()) for i in range(1, 5)]) for o, level in levels.items()}
    sums = {o: Counter() for o in levels}
    freed = {o: Counter() for o in levels}
    for o, level in levels.items():
        for g, n in level.items():
            sums[o][g[:-1]] += n
            freed[o][g[:-1]] += cuts[o][min(n, 3) - 1]

    def p(gram):
        o = len(gram)
        if not o:
            return 1 / (len(levels[1]) + 1)
        n = levels[o][gram]
        return (n - cuts[o][min(n, 3) - 1] + freed[o][gram[:-1]] * p(gram[1:])) / sums[o][gram[:-1]]

    return p


def test_perplexity_and_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    spelled = {r.doc_id: [quality.START * 4 + w.decode() + quality.END for w in (r.text or "").encode().split()] for r in rows}
    counts = {}
    for r in rows:
        for w in spelled[r.doc_id]:
            counts.setdefault(r.lang or "und", Counter()).update(w[i : i + 5] for i in range(len(w) - 4))
    models = {lang: plain_kneser_ney(c) for lang, c in counts.items()}
    memo, levels = {}, {}
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in rows:
        lang, own = r.lang or "und", []
        for w in spelled[r.doc_id]:
            if (lang, w) not in memo:
                memo[lang, w] = sum(math.log(models[lang](w[i : i + 5])) for i in range(len(w) - 4))
            own.append(memo[lang, w])
        if own:
            sizes = [len(w) - 4 for w in spelled[r.doc_id]]
            assert judged[r.doc_id].perplexity == pytest.approx(math.exp(-sum(own) / sum(sizes)), rel=1e-9)
            levels[r.doc_id] = sorted(-a / b for a, b in zip(own, sizes))[3 * (len(own) - 1) // 4]
    for lang in counts:
        own = [r.doc_id for r in rows if (r.lang or "und") == lang and r.doc_id in levels]
        fine = [levels[d] for d in own if not judged[d].base_failed]
        middle = sorted(fine)[(len(fine) - 1) // 2]
        half = quality.WIDTH * max(quality.NARROWEST, 1.4826 * sorted(abs(x - middle) for x in fine)[(len(fine) - 1) // 2])
        for d in own:
            if abs(abs(levels[d] - middle) - half) > 1e-3:
                assert judged[d].kept == (not judged[d].base_failed and abs(levels[d] - middle) < half)


def test_language_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~language_id.held_out())
    rows = docs.collect()

    def clean(text):
        return [re.sub(r"[^\W\d_]", lambda m: m[0], "".join(c for c in w.decode().lower() if c.isalpha())) for w in (text or "").encode().split()]

    def grams(word, n):
        padded = f" {word} "
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    seen = {}
    for r in rows:
        if r.lang and r.text is not None:
            own = seen.setdefault(r.lang, {k: Counter() for k in (0, *language_id.ORDERS)})
            for w in filter(None, clean(r.text)):
                own[0][w] += 1
                for n in language_id.ORDERS:
                    own[n].update(grams(w, n))
    names = sorted(seen)
    logs = {k: {} for k in (0, *language_id.ORDERS)}
    for k, table in logs.items():
        most = max(sum(seen[lang][k].values()) for lang in names)
        for i, lang in enumerate(names):
            total = sum(seen[lang][k].values())
            for feature, n in seen[lang][k].items():
                if n >= 2:
                    table.setdefault(feature, np.full(len(names), math.log(0.5 / most)))[i] = math.log(n / total)

    def score(word):
        if word in logs[0]:
            return logs[0][word]
        for n in language_id.ORDERS:
            found = [logs[n][g] for g in grams(word, n) if g in logs[n]]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(names))

    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    for r in rows:
        written = [w for w in clean(r.text) if w]
        if not written:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        total = sum(map(score, written)) * min(1, language_id.EVIDENCE / len(written))
        share = 1 / np.exp(total - total.max()).sum()
        assert got[r.doc_id].lang_pred == names[int(total.argmax())] and got[r.doc_id].score == pytest.approx(share, rel=1e-4)


def test_a_rare_language_keeps_its_rows(spark):
    rng = random.Random(1)
    rows = [(None, words(rng, 30), "aa", None, None, None, None, None) for _ in range(300)] + [(i, "zig zag zug zog " * 8, "zz", None, None, None, None, None) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs, most_rows=20)
    assert model.languages == ["aa", "zz"]
    assert {r.lang_pred for r in language_id.identify(docs.where("lang = 'zz'"), model).collect()} == {"zz"}


def test_sketches_merge_across_parts(spark):
    docs = documents(spark).withColumn("whose", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    got = {r.key: r for r in fingerprints.merged_sketches(docs.repartition(7), "whose").collect()}
    for key in ("a", None):
        texts = [r.text for r in docs.collect() if r.whose == key]
        sets = fingerprints.shingle_sets(fingerprints.pa.array(texts, fingerprints.pa.string()))
        whole = np.unique(np.concatenate(sets))
        assert got[key].fingerprint == fingerprints.to_text(whole[: fingerprints.K])
        assert got[key].distinct_shingles == pytest.approx(len(whole), rel=0.5)
    assert fingerprints.merged_sketches(empty(spark), "lang").count() == 0


def test_learning_covers_what_is_rare_in_a_large_sample(spark):
    common = [(i, "the and of to " * 30_000, "en", None, None, None, None, None) for i in range(2)]
    docs = spark.createDataFrame(common + [(7, "zyx zyx", "en", None, None, None, None, None), (8, "qua qua", "la", None, None, None, None, None)], SCHEMA)
    model = language_id.fit(docs)
    asked = spark.createDataFrame([(1, "zyx", None, None, None, None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score > 0.5) for r in language_id.identify(asked, model).collect()] == [("en", True)]
    assert language_id.fit(docs, most_languages=1).languages == ["en"]
