"""Operators 1, 5, 7, 8, 9 and 10 against brute force, the tokenizers library and round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelscribe.llm import bpe, fingerprints, language_id, packing, sharding, token_counts

from .fixtures import brute_words, documents, empty

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in documents(spark).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_token_counts_match_greedy_longest_match(spark, rows):
    pieces = [b" low", b" lower", b"er", b"e", b"s", b"t", b" ", b"est", b" new", b"w", *(b"w%d" % i for i in range(50)), *(bytes([c]) for c in b"0123456789abcd")]
    known = set(pieces)

    def greedy(word):
        n = at = 0
        while at < len(word):
            stop = next((j for j in range(len(word), at, -1) if word[at:j] in known), None)
            if stop is None:
                return None
            n, at = n + 1, stop
        return n

    def expected(text):
        each = [greedy(b" " + w) for w in brute_words(text)]
        return len(each), sum(1 if x is None else x for x in each), sum(x is None for x in each)

    got = token_counts.token_counts(documents(spark), pieces).collect()
    assert sorted(map(tuple, got), key=key) == sorted([(d, *expected(t)) for d, t in rows], key=key)
    assert token_counts.token_counts(empty(spark), pieces).count() == 0


def test_automaton_on_the_public_vocabulary():
    pieces = token_counts.byte_level_pieces(BYTE)
    auto = token_counts.build_automaton(pieces)
    assert token_counts.piece_lengths(auto, [b" the", b" zqxj", b" "]).tolist()[0] == 1
    assert (auto.fail[1:] >= 0).sum() > 0


def test_bpe_rounds_match_the_library(spark, rows):
    library = Tokenizer.from_file(WORD)
    got = {}
    for r in bpe.encode_decode(documents(spark), bpe.load_word_bpe(WORD)).collect():
        got.setdefault((r.doc_id, hashlib.sha256(r.ids).hexdigest()), r)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        r = got[doc_id, hashlib.sha256(raw).hexdigest()]
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), raw)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty(spark), bpe.load_word_bpe(WORD)).count() == 0


def test_long_words_match_the_library():
    import pyarrow as pa

    library, rng = Tokenizer.from_file(WORD), random.Random(3)

    def letters(n, among="etaoinshrdlucmfwypvbgkqjxz"):
        return "".join(rng.choices(among, weights=range(len(among), 0, -1), k=n))

    texts = [letters(300_000), "x" * 70_001, "ab" * 9_000, letters(30_000, "ha"), "é漢字Ü" * 2_000, "#$%&" * 3_000, "the", letters(2_000) + "<|endoftext|>" + letters(900), letters(5_000)]
    ids, offsets = bpe.encode_vocab(bpe.load_word_bpe(WORD), pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_rounds_by_rank_equal_rounds_over_all(monkeypatch, rounds):
    import pyarrow as pa

    rng, model = random.Random(rounds), bpe.load_word_bpe(WORD)
    texts = pa.array(["".join(rng.choices("aehlnost", k=rng.randrange(1, 60))) for _ in range(2_000)] + ["a" * n for n in range(1, 40)])
    wanted = bpe.encode_vocab(model, texts)
    monkeypatch.setattr(bpe, "ROUNDS", rounds)
    assert all((a == b).all() for a, b in zip(bpe.encode_vocab(model, texts), wanted))


def test_byte_level_ids_match_the_library(rows):
    import pyarrow as pa

    library = Tokenizer.from_file(BYTE)
    odd = ["a  b", "a \n b", "a\n\n b ", "x  y", "é à", "é　 à", "foo <|endoftext|> bar", "foo \n<|endoftext|>", "\n\na", "a\t b", "don't I'LL 's", "  z"]
    texts = [t for _, t in rows] + odd
    for text, ids in zip(texts, packing.token_ids(pa.array(texts), BYTE, 1)):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_keeps_every_id_once(spark, rows):
    library = Tokenizer.from_file(BYTE)
    pieces = packing.pack_documents(documents(spark).coalesce(1), BYTE).collect()
    expected = sorted(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id, p.doc_tokens].append(p)
    counts = defaultdict(int)
    for d, t in rows:
        counts[d, len(library.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    for k, own in by_doc.items():
        assert sum(p.length for p in own) == counts[k] * k[1]
        if counts[k] == 1:
            own.sort(key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in own) in expected
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
    partial = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert total <= own[0].window
        partial += total != own[0].window
    assert partial <= 1 and {p.window for p in pieces} == {256, 512, 1024, 2048}
    steps = defaultdict(set)
    for p in pieces:
        steps[p.step_group].add((p.sequence_id, p.window))
    assert all(len({w for _, w in s}) == 1 and sum(w for _, w in s) <= packing.STEP for s in steps.values())
    assert packing.pack_documents(empty(spark), BYTE).count() == 0


def test_shards_are_balanced_gapless_and_keep_copies_together(spark, rows):
    got = sharding.byte_shards(documents(spark), shards=3, together=0.5).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None
    )
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    home = defaultdict(set)
    for r in got:
        home[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in home.values())
    assert sharding.byte_shards(empty(spark)).count() == 0


def test_a_hot_group_is_cut_at_the_targets(spark):
    df = spark.createDataFrame([(i, "copy" if i % 2 else f"text {i:04d}") for i in range(4000)], "doc_id long, text string")
    sizes = [r["b"] for r in sharding.byte_shards(df).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 100


def test_language_is_found_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    seen = docs.where(language_id.held_out()).join(language_id.identify(docs, model), "doc_id").where("lang is not null")
    hits, total = seen.where("lang = lang_pred").count(), seen.count()
    assert total and hits / total > 0.9


def test_unknown_languages(spark, rows):
    model = language_id.fit(documents(spark))
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.identify(documents(spark), model).collect()}
    for doc_id, text in rows:
        none = not any(c.isalpha() for c in text or "")
        assert (got[doc_id].lang_pred == "und") == none or doc_id in (9,)
        assert 0 <= got[doc_id].score <= 1
    nothing = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.identify(documents(spark), nothing).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_against_brute_force(spark, rows, parts):
    def shingles(text):
        w = [x.lower() for x in brute_words(text)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0], x[1].encode()))
    got = fingerprints.fingerprint_pairs(documents(spark), parts).collect()
    found = defaultdict(list)
    for r in got:
        found[r.doc_id, r.n_chars].append(r)
    marks = {}
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own = [r for r in found[doc_id, len(text)] if r.edited_text == changed]
        assert own, (doc_id, changed[:40])
        r = own[0]
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint
        exact = len(shingles(text) | shingles(changed)) <= fingerprints.K
        assert abs(r.near_edited - jaccard(shingles(text), shingles(changed))) < (1e-9 if exact else 0.25)
        assert any(abs(x.near_next - jaccard(shingles(text), shingles(after))) < 0.25 for x in own)
    assert fingerprints.fingerprint_pairs(empty(spark), parts).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    c = np.union1d(a, b)
    k = 512
    assert (fingerprints.merge(a[:k], b[:k], k) == c[:k]).all()
    assert abs(fingerprints.distinct_count(c[:k], k) / len(c) - 1) < 0.15
    assert abs(fingerprints.resemblance(a[:k], c[:k], k) - 0.5) < 0.1
    assert fingerprints.containment(a[:k], c[:k], k) > 0.8
    assert (fingerprints.from_text(fingerprints.to_text(a[:k])) == a[:k]).all()
