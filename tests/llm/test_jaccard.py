"""Operator 6 against brute force over all pairs, its R-tree and its components."""

import random

import numpy as np
import pyarrow as pa
import pytest

from reelscribe.llm import components, jaccard

from .fixtures import brute_words, documents, empty, words


def shingles(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in brute_words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(d, least[r]))
    return sorted(((d is not None, d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [(r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def near_copies(rng, count, base, most):
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w[rng.randrange(4) :]))
    return out


def test_awkward_documents(spark):
    check(documents(spark))
    assert jaccard.components(empty(spark)).count() == 0


@pytest.mark.parametrize("salted", [200_000, 40])
def test_groups_of_near_copies(spark, monkeypatch, salted):
    monkeypatch.setattr(jaccard, "SALTED", salted)
    monkeypatch.setattr(jaccard, "PART", 16)
    rng = random.Random(salted)
    line = words(rng, 12)
    texts = [line + " " + words(rng, rng.randrange(8, 60)) for _ in range(60)]
    texts += near_copies(rng, 50, words(rng, 150, 5000), 9) + near_copies(rng, 6, words(rng, 60, 5000), 5)
    texts += [words(rng, n, 900) for n in (1, 3, 4, 5, 6, 7)] * 2
    chain = words(rng, 120, 5000).split()
    texts += [" ".join(chain[5 * i :] + [f"n{j}" for j in range(5 * i)]) for i in range(12)]
    rng.shuffle(texts)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_short_near_copies_meet_across_salts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALTED", 40)
    rng = random.Random(11)
    texts = []
    for _ in range(300):
        w = words(rng, rng.randrange(9, 13), 10**6).split()
        texts += [" ".join(w), " ".join(w[1:] if rng.random() < 0.5 else [*w[:-1], "other"])]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_counts_over_16_bits_bound_nothing():
    own = np.arange(6_000_000, dtype=np.uint64)
    points = jaccard.group_counts(pa.chunked_array([[jaccard.point(x).tobytes() for x in (own, own[:-1])]]))
    assert jaccard.bound(points[0], points[1], len(own), len(own) - 1)


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 9, (40, jaccard.GROUPS))
    points = np.maximum(0, base[rng.integers(0, 40, 900)] + rng.integers(-1, 2, (900, jaccard.GROUPS))).astype(np.uint16)
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard.CountTree(points, sizes)
    for q in range(0, 900, 31):
        expected = np.flatnonzero(jaccard.bound(points, points[q], sizes, sizes[q]))
        assert sorted(tree.search(points[q], sizes[q])) == expected.tolist()


def test_components_of_a_path_a_hub_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(500, 500), (7, 3), (3, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.a, r.b) for r in got) == [(i, 0) for i in range(1, 41)] + [(200 + i, 100) for i in range(30)]
