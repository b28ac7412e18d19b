"""Operator 3 against a plain-Python base score, a brute-force exchange gain and held-out quality."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reelscribe.llm import brown
from reelscribe.plans import storage

from .fixtures import brute_words, documents, empty


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_base_score_and_counts(spark):
    rows = [(r.doc_id, brute_words(lower(r.text)) + [None]) for r in documents(spark).collect()]
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter(w for (_, ws), o in zip(rows, out) if not o for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (d is not None, d, len(ws), o, sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4))
        for (d, ws), o in zip(rows, out)
    )
    scored = brown.class_scores(documents(spark)).collect()
    got = sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.held_out, r.n_known, round(r.base_score, 4)) for r in scored)
    assert got == expected
    assert {r.train_tokens for r in scored} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)
    assert brown.class_scores(empty(spark)).count() == 0


def likelihood(bigrams, of):
    k = of.max() + 1
    m = np.zeros((len(of), k))
    m[np.arange(len(of)), of] = 1
    g = m.T @ bigrams @ m
    return brown.xlogx(g).sum() - brown.xlogx(g.sum(0)).sum() - brown.xlogx(g.sum(1)).sum()


def test_exchange_finds_a_local_best():
    rng = np.random.default_rng(5)
    fixed = brown.FIXED
    size = fixed + 12
    kind = np.arange(12) % 2
    bigrams = rng.integers(0, 3, (size, size)).astype(float)
    for a in range(12):
        for b in range(12):
            bigrams[fixed + a, fixed + b] += 60 * (kind[a] != kind[b])
    of = brown.exchange(bigrams, 2)
    assert len({tuple(sorted({of[fixed + a] for a in range(12) if kind[a] == k})) for k in (0, 1)}) == 2
    best = likelihood(bigrams, of)
    for w in range(fixed, size):
        for c in (fixed, fixed + 1):
            other = of.copy()
            other[w] = c
            assert likelihood(bigrams, other) <= best + 1e-6


def contexts_of(bigrams, of):
    """Of each place: counts of classes before it and after it, and of itself."""
    member = np.zeros((len(of), brown.WIDTH))
    member[np.arange(len(of)), of] = 1
    other = bigrams - np.diag(np.diag(bigrams))
    return np.hstack([other.T @ member, other @ member, np.diag(bigrams)[:, None]]), member.T @ bigrams @ member


@pytest.mark.parametrize("seed", range(4))
def test_gains_equal_the_likelihoods_of_all_moves(monkeypatch, seed):
    rng, size = np.random.default_rng(seed), brown.FIXED + 30
    bigrams = rng.poisson(0.4 * 3**seed, (size, size)).astype(float)
    bigrams[brown.OPEN + 1 :, brown.OPEN + 1 :] += np.diag(rng.poisson(1, size - brown.FIXED))
    classes = rng.choice([brown.FIXED, brown.FIXED + 1, brown.FIXED + 2, brown.WIDTH - 1], size)
    classes[:2], classes[2:5] = [brown.END, brown.OPEN], brown.OPEN  # words without a class yet, too
    counts, grid = contexts_of(bigrams, classes)
    gains = brown.class_gains(counts, classes, grid)
    wanted = classes.copy()
    for w in range(brown.FIXED, size):
        each = []
        for c in range(brown.FIXED, brown.WIDTH):
            other = classes.copy()
            other[w] = c
            each.append(brown.likelihood(contexts_of(bigrams, other)[1]))
        assert np.allclose(gains[w] - gains[w][0], np.array(each) - each[0], atol=1e-6)
        own = classes[w] - brown.FIXED
        wanted[w] = classes[w] if own >= 0 and each[own] >= max(each) - 1e-9 else brown.FIXED + int(np.argmax(gains[w]))
    word, context = np.nonzero(counts)
    monkeypatch.setattr(brown, "BATCH", 7)
    assert (brown.best_classes(word, context, counts[word, context], classes, grid)[brown.FIXED :] == wanted[brown.FIXED :]).all()


def test_contexts_are_those_of_the_words():
    tokens = np.array([1, 1, 1, 2, 0, 2, 1, 0, 0, 3, 3, 0])
    offsets = np.array([0, 5, 8, 9, 12])
    train = np.array([True, True, True, False])
    texts = brown.Texts(tokens, np.repeat(np.arange(4), np.diff(offsets)), offsets, train, pa.array([1, 2, 3, 4]))
    classes = np.array([brown.END, 5, 7, 9])
    got = Counter(zip(*(x.tolist() for x in texts.contexts(classes))))
    w, itself = brown.WIDTH, brown.ITSELF
    mine = {k: n for k, n in got.items() if k[0] != 0}
    assert mine == {(1, itself): 2, (1, brown.END): 1, (1, 7): 1, (1, w + 7): 1, (1, w + brown.END): 1, (2, 5): 1, (2, brown.END): 1, (2, w + brown.END): 1, (2, w + 5): 1}


def test_words_seen_once_move_by_their_endings():
    keys = np.array([0x10, 0x20, 0x31, 0x41], np.uint64)  # endings 0, 0, 1, 1; the last is seen twice
    word, context, n = np.array([0, 0, 1, 1, 2, 2, 3, 3]), np.array([5, 60, 6, 61, 7, 62, 7, 62]), np.array([1, 1, 1, 1, 1, 1, 2, 2])
    best, turns = brown.shared_classes(keys, word, context, n, np.array([2, 3, 4, 5]), np.ones((brown.WIDTH, brown.WIDTH)) * 9)
    assert best[0] == best[1] and turns.tolist() == [0, 0, 1, 0]


def test_classes_beat_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = brown.class_scores(docs).where("held_out").toPandas()
    assert len(rows) > 50 and rows.score.sum() > rows.base_score.sum()


def test_every_training_word_is_exchanged_and_scores_follow_from_the_classes(spark):
    docs = documents(spark)
    fitted = brown.fit(docs)
    model = fitted.model
    assert np.allclose((10.0**model.transitions).sum(1), 1)
    classes, counts = {}, {}
    for r in fitted.words.collect():
        keys, n, of = (np.frombuffer(r[c], kind) for c, kind in (("keys", "<u8"), ("counts", "<i8"), ("classes", "u1")))
        classes |= dict(zip(keys.tolist(), of.tolist()))
        counts |= dict(zip(keys.tolist(), n.tolist()))
    rows = [(r.doc_id, brute_words(lower(r.text))) for r in docs.collect()]
    vocab = sorted({w for _, ws in rows for w in ws})
    key = dict(zip(vocab, brown.word_keys(pa.array([w.decode() for w in vocab])).tolist()))
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[key[w] for w in ws] + [0] for _, ws in rows]
    seen = Counter(t for ts, o in zip(tokens, out) if not o for t in ts)
    assert all(counts[k] == seen[k] for k in counts)
    assert all(classes[k] >= brown.FIXED for k in seen if k)  # no word of the training texts is left out
    grid = np.zeros((brown.WIDTH, brown.WIDTH))
    for ts, o in zip(tokens, out):
        for a, b in zip([0] + ts, [] if o else ts):
            grid[classes[a], classes[b]] += 1
    assert (grid == model.grid).all()

    def score(ts):
        of = [classes[t] if seen[t] or not t else int(model.endings[t % brown.ENDINGS]) for t in ts]
        total = sum(model.transitions[a, b] for a, b in zip([0] + of, of))
        for t, c in zip(ts, of):
            if t:
                total += math.log10((1 - model.unseen[c]) * seen[t] / model.totals[c] if seen[t] else model.unseen[c])
        return total

    wanted = sorted(((d is not None, d, round(score(ts), 4)) for (d, _), ts in zip(rows, tokens)), key=str)
    got = sorted(((r.doc_id is not None, r.doc_id, round(r.score, 4)) for r in brown.score(fitted).collect()), key=str)
    assert got == wanted


def test_a_sweep_never_lowers_the_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none, some = (brown.likelihood(brown.fit(docs, n).model.grid) for n in (0, 2))
    assert some >= none


def moved(tokens, classes, turn):
    """``classes`` after all words are placed with all contexts, in buckets, but only those of ``turn`` move."""
    contexts, grid = Counter(), np.zeros((brown.WIDTH, brown.WIDTH))
    for ts in tokens:
        for last, t, following in zip([0] + ts, ts, ts[1:] + [0]):
            grid[classes[last], classes[t]] += 1
            contexts[t, brown.ITSELF if last == t else classes[last]] += 1
            if following != t:
                contexts[t, brown.WIDTH + classes[following]] += 1
    out, buckets = dict(classes), {}
    for (t, c), n in sorted(contexts.items()):
        if t:
            buckets.setdefault(t >> 58, []).append((t, c, n))
    for cells in buckets.values():
        keys, context, n = (np.array(x) for x in zip(*cells))
        keys, word = np.unique(keys.astype(np.uint64), return_inverse=True)
        best, turns = brown.shared_classes(keys, word, context, n.astype(float), np.array([classes[k] for k in keys.tolist()]), grid)
        out |= {k: int(b) for k, b, t in zip(keys.tolist(), best, turns) if t == turn}
    return out


@pytest.mark.parametrize("levels, turns, told_turns", [([0, 1, 2], [0, 1], [0, 1, None]), ([0, 1, 0, None, 2], [0, 0], [0, 1, 0, 0, None])])
def test_a_sweep_is_told_of_the_words_it_moves_and_of_no_others(spark, monkeypatch, levels, turns, told_turns):
    tables, grids = {"vocabulary": [], "classes": [], "class_bigrams": []}, []

    def kept(df, name):
        tables[name].append(storage.kept(df, name))
        return tables[name][-1]

    def summed_grid(passed, real=brown.summed_grid):
        grids.append(real(passed))
        return grids[-1]

    monkeypatch.setattr(brown, "kept", kept)
    monkeypatch.setattr(brown, "discard", lambda *tables: None)
    monkeypatch.setattr(brown, "summed_grid", summed_grid)
    monkeypatch.setattr(brown, "likelihood", lambda grid: next(n for g, n in zip(grids, levels) if g is grid))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fitted = brown.fit(docs, sum(n is not None for n in levels) - 1)

    def classes_of(words):
        rows = [[np.frombuffer(r[c], kind).tolist() for c, kind in (("keys", "<u8"), ("classes", "u1"))] for r in words.collect()]
        return {k: c for keys, classes in rows for k, c in zip(keys, classes)}

    texts = [brute_words(lower(r.text)) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    vocab = sorted({w for ws in texts for w in ws})
    key = dict(zip(vocab, brown.word_keys(pa.array([w.decode() for w in vocab])).tolist()))
    tokens = [[key[w] for w in ws] + [0] for ws in texts]
    wanted = classes_of(tables["classes"][0])
    for turn in turns:
        before, wanted = wanted, moved(tokens, wanted, turn)
        assert wanted != before
    assert classes_of(fitted.words) == wanted
    seen = Counter(t for ts in tokens for t in ts if t)
    keys = np.array(list(seen), np.uint64)
    turn_of = np.array([(k % brown.ENDINGS if n == 1 else k // brown.ENDINGS) % 2 for k, n in seen.items()])
    assert {*turn_of.tolist()} == {0, 1}
    for passed, turn in zip(tables["class_bigrams"], told_turns, strict=True):
        told = [brown.bucket_contexts([r.block])[0] for r in passed.where("bucket is not null").collect()]
        assert {k for ks in told for k in ks.tolist()} == {*keys[turn_of == turn].tolist()}


def test_gains_worked_out_once_are_those_of_each_word(monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.2, (40, brown.CONTEXTS)) * rng.choice([1.0, brown.SMALL, brown.SMALL + 1, 500], (40, 1))
    own, grid = rng.integers(brown.OPEN, brown.WIDTH, 40), rng.integers(90000, 99000, (brown.WIDTH, brown.WIDTH)).astype(float)
    gains = brown.class_gains(counts, own, grid)
    monkeypatch.setattr(brown, "SMALL", 0)
    assert np.isfinite(gains).all() and (gains == brown.class_gains(counts, own, grid)).all()
