import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from reelscribe.llm import variants
from reelscribe.llm.variants import SortedList, blocks_of, descend, group_variants, near_table, shared

SCHEMA = "doc_id long, text string"


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows: list[tuple]) -> set[tuple]:
    import re

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    found, form = {w: [o for o in n if near(w, o)] for w in n}, {}
    for w, others in found.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(found[w]), n[form[w]] if form[w] else None))
    return out


def words(count: int, letters: str, least: int, most: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randint(least, most))) for _ in range(count)})


@pytest.mark.parametrize("least,most", [(5, 8), (70, 73)])
def test_descent_finds_every_near_word_that_begins_alike(least, most):
    lists = words(600, "abé", least, most, 1)
    stem = "ab" * 34
    lists = sorted(set(lists) | {stem + x for x in words(200, "ab", 3, 5, 2)})
    found = {(lists[i], lists[j]) for q, at in descend(SortedList(lists), SortedList(lists)) for i, j in zip(q.tolist(), at.tolist())}
    wanted = {(a, b) for a in lists for b in lists if near(a, b) and b.startswith(a[: shared(a)])}
    assert len(wanted) > 20
    assert found == wanted


def test_cuts_lead_to_every_block_that_holds_a_near_word():
    lists = words(900, "abc", 5, 7, 3)
    cuts = lists[20::37]
    block = {w: sum(c <= w for c in cuts) for w in lists}
    led = {(i, b) for q, at in blocks_of(SortedList(cuts), lists) for i, b in zip(q.tolist(), at.tolist())}
    for i, a in enumerate(lists):
        assert all((i, block[b]) in led for b in lists if near(a, b) and b.startswith(a[: shared(a)]))


def test_blocks_and_pieces_leave_nothing_out(spark):
    counted = {w: 3 + i % 50 for i, w in enumerate(words(800, "abcd", 5, 8, 4))}
    vocab = spark.createDataFrame(list(counted.items()), "word string, n long")
    found = {tuple(r) for r in near_table(vocab, size=40, piece=25).collect()}
    wanted = set()
    for w in counted:
        others = [o for o in counted if near(w, o)]
        if others:
            best = min(others, key=lambda o: (-counted[o], o))
            wanted.add((w, len(others), best, counted[best]))
    assert found == wanted


def test_groups_equal_brute_force(spark):
    draw = random.Random(5)
    vocab = words(60, "abé", 5, 6, 6) + ["Straße", "naïve", "caf×e", "x" * 3000, "x" * 2999 + "y"]
    rows = [(i, " ".join(draw.choice(vocab[: 3 + i]) + draw.choice(["", ",", "1", "Ā"]) for _ in range(120))) for i in range(60)]
    rows += [(1, None), (None, "Abbbb Abbbb abbbb."), (2, ""), (3, "x" * 3000 + " " + "x" * 2999 + "y"), *rows[:3]]
    columns = "word", "form", "root", "n", "n_near", "form_n"
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, `a.b` string, TEXT int")
    found = [tuple(r) for r in group_variants(docs).select(*columns).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


def test_runs_keep_only_letters_of_two_blocks():
    texts = pa.array(["Aß-Ā÷×É9b", None, "ŸaŸÿ"])
    assert [x.split() for x in variants.letter_runs(texts).to_pylist()] == [["aß", "÷×É", "b"], [], ["a", "ÿ"]]


def test_an_empty_table_has_no_words(spark):
    assert group_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert group_variants(spark.createDataFrame([(1, None), (2, "a b")], SCHEMA)).count() == 0
