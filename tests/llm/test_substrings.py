"""Operator 4 against brute force over all windows."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reelscribe.llm import substrings

from .fixtures import brute_words, documents, empty, words


def brute(rows):
    split = [(d if d is not None else 2**63 - 1, brute_words(t)) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, w), (doc_id, _) in zip(split, rows):
        gone = set()
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((doc_id is not None, doc_id, len(w), len(gone), kept))
    return sorted(out)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = substrings.remove_repeats(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed
        assert (r.left_text or "").encode().split() == r.kept_text.encode().split()
        assert r.n_removed or r.left_text in texts[r.doc_id]


def test_awkward_documents(spark):
    check(documents(spark))
    assert substrings.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages_of_every_length(spark, seed):
    rng = random.Random(seed)
    passages = [words(rng, n, 5000) for n in (30, 49, 50, 51, 60, 74, 75, 99, 120)]
    rows = []
    for i in range(80):
        parts = [words(rng, rng.randrange(0, 60), 5000) for _ in range(3)]
        parts[1:1] = [rng.choice(passages)]
        parts[3:3] = [rng.choice(passages)] if rng.random() < 0.5 else []
        rows.append((rng.randrange(70), rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(200 + i, " ".join(passages[6:])) for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def peak_mb(f, *args):
    """The result, and the most that numpy and Python held on the way."""
    tracemalloc.start()
    try:
        return f(*args), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_chunk_and_a_bucket_take_little_memory():
    rng = np.random.default_rng(4)
    vocab = np.array([f"w{i:05d}" for i in range(20_000)])
    texts = [" ".join(vocab[rng.integers(0, len(vocab), 500)]) for _ in range(2300)]
    texts[7] = texts[9]
    chunk = pa.table({"doc_id": np.arange(2300), "text": texts, "chunk": pa.array([0] * 2300, pa.int32())})
    probes, most = peak_mb(substrings.probe, chunk, 6)
    assert sum(len(x) // 4 for x in probes["keys"].to_pylist()) == pytest.approx(2299 * 476, abs=50)  # few of the short keys collide
    assert most < 80
    other = probes.set_column(1, "chunk", pa.array([1] * len(probes), pa.int32()))
    found, most = peak_mb(substrings.shared, pa.concat_tables([probes, other]))
    assert sum(len(x) // 4 for x in found["keys"].to_pylist()) == pytest.approx(2 * 2299 * 20, abs=2_000)  # taken as one bucket
    assert most < 80
