"""Awkward documents that every operator must take: nulls, empties, ties, repeats, very long texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, code string, words int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def documents(spark, seed=7, rows=60):
    rng = random.Random(seed)
    texts = [
        None, "", "   ", "\n\t ", "one", "a b c d", "a b c d e", "The the THE", "123 456", "!!! ???", "Ünïcode ｗｏｒｄ 漢字 ١٢٣ x",
        "<|endoftext|> mid <|startoftext|>x", "tail space \n", " lead", "it's we'll 'S", "x" * 5000, "a\x1cb \x85 c　d",
    ]
    base = words(rng, 300)
    texts += [base, base, base + " extra tail", "new head " + base, words(rng, 20) + " " + base + " " + words(rng, 70)]
    texts += [words(rng, rng.randrange(1, 200)) for _ in range(rows)] + [words(rng, 30000, 9000)]
    texts += [base.replace(" ", "\n"), base.upper()]
    out = [(3 * i, t, rng.choice(["en", "fr", None]), "s", None if t is None else len(t), 1, "c", 2) for i, t in enumerate(texts)]
    out += [(None, "no id " + base, "en", None, 3, None, None, None), out[20], out[20], (9, "same id other text", None, None, None, None, None, None)]
    return spark.createDataFrame(out, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_words(text):
    return (text or "").encode().split()
