"""Operator 2: base counts against brute force, the model's probabilities, and what it rejects."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelscribe.llm import quality
from reelscribe.llm.words import mix

from .fixtures import brute_words, documents, empty


def points(grams):
    raw = np.array(grams, f"<U{quality.ORDER}").view(np.uint32).reshape(-1, quality.ORDER)
    return mix(raw.astype(np.uint64) + np.uint64(1))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    grams = ["".join(g) for g in itertools.product("abc", repeat=quality.ORDER)]
    counts = rng.integers(0, 6, len(grams))
    seen = [(g, c) for g, c in zip(grams, counts) if c]
    levels = quality.estimate(points([g for g, _ in seen]), np.array([c for _, c in seen]))
    for context in ("aaaa", "abca", "ccbb", "zzzz", "zzab"):
        p = points([context + c for c in "abc"]).reshape(-1)
        total = np.exp(quality.gram_logp(levels, p, np.arange(0, len(p), quality.ORDER))).sum()
        unseen = points([context + "q"]).reshape(-1)
        total += np.exp(quality.gram_logp(levels, unseen, np.array([0])))[0]
        assert total == pytest.approx(1, abs=1e-9)


def test_a_rare_gram_is_scored_from_all_counts(spark):
    common, rare = "word " * 700_000, " ".join("".join(c) for c in itertools.product("abcd", repeat=3))
    docs = spark.createDataFrame([(1, common, "en"), (2, rare, "en"), (3, rare, "fr")], "doc_id long, text string, lang string")
    counts = quality.count_grams(docs).where("lang = 'en'").toPandas()
    p = points(list(counts["gram"]))
    levels = quality.estimate(p, counts["n"].to_numpy())
    expected = dict(zip(counts["gram"], np.exp(quality.gram_logp(levels, p.reshape(-1), np.arange(0, p.size, quality.ORDER)))))
    got = {r.gram: r.p for r in quality.gram_scores(quality.count_grams(docs)).where("lang = 'en'").collect()}
    assert got == pytest.approx(expected)
    words = rare.split()
    logs = [np.log(expected[m[i : i + 5]]) for w in words for m in ["\x02" * 4 + w + "\x03"] for i in range(len(w) + 1)]
    row = quality.judge(docs).where("doc_id = 2").first()
    assert row.perplexity == pytest.approx(np.exp(-sum(logs) / len(logs)))


@pytest.mark.parametrize("places", [[], [0], [7], [0, 1, 300, 70_000, 20_000_000]])
def test_places_come_back(places):
    packed = quality.packed_places(np.array(places, np.int64))
    assert len(packed) == 4 * len(places) and quality.unpacked_places(packed).tolist() == places


def test_discounts_of_chen_and_goodman():
    counts = np.array([1] * 40 + [2] * 15 + [3] * 8 + [4] * 5)
    y = 40 / 70
    assert quality.discounts(counts) == pytest.approx([1 - 2 * y * 15 / 40, 2 - 3 * y * 8 / 15, 3 - 4 * y * 5 / 8])
    assert quality.discounts(np.array([5, 6])) == pytest.approx([0.5, 1, 1.5])


def expected(text):
    w = brute_words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 2000 else None
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), None if hit is None else len(hit),
    )


def test_base_counts(spark):
    extra = [(1000 + i, t, "en", "s", 1, 1, "c", 1) for i, t in enumerate(["a b c a b c d", "x x x x", "a\nb\na\n \n \na ", "### a|b <c>" * 30, "a b c d " * 20])]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, documents(spark).schema))
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_words), r) for r in quality.judge(docs).collect())
    rows = sorted(((r.doc_id is not None, r.doc_id, len(brute_words(r.text))), r.text) for r in docs.collect())
    assert [k for k, _ in got] == [k for k, _ in rows]
    for (_, r), (_, text) in zip(got, rows):
        n_words, chars, symbols, dup, repeat = expected(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n_words, chars, symbols, dup)
        assert repeat is None or r.n_repeat_words == repeat
        assert r.base_failed == (n_words < 50 or 100 * r.n_repeat_words > 50 * n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty(spark)).count() == 0


def test_noise_goes_and_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = docs.select("doc_id").join(quality.judge(docs), "doc_id").join(labels, "doc_id").where("not base_failed").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.6


@pytest.fixture(scope="module")
def long_rows(spark, tmp_path_factory):
    """80 MB of rows with a wide column in one file, so that batches are cut by their bytes, not by their rows."""
    path = str(tmp_path_factory.mktemp("long") / "docs")
    text = "array_join(transform(sequence(1, 1500), i -> concat('w', pmod(hash(id, i), 3000))), ' ')"
    rows = spark.range(9000).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "repeat(cast(id AS string), 500) AS `wide.r`", "'x' AS TEXT")
    rows.toDF("doc_id", "text", "lang", "wide.r", "other").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_long_rows_and_wide_columns_pass_whole(spark, long_rows):
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        assert long_rows.rdd.getNumPartitions() == 1
        found = quality.keep_sound(long_rows).cache()
        assert found.count() == quality.judge(long_rows).where("kept").count() > 8000
        assert found.exceptAll(long_rows).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_rows_that_come_in_another_order_each_time_are_judged_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dealt = docs.union(docs).repartition(5, F.rand()).select("doc_id", "text", "lang", F.rand().alias("r"))
    whole, odd = ({r.doc_id for r in quality.keep_sound(x).collect()} for x in (docs.union(docs), dealt))
    assert whole == odd
