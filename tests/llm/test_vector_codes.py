import hashlib
import math

import numpy as np
import pytest

from reelscribe.llm import vector_codes
from reelscribe.llm.vector_codes import assigned, digest, fit_and_encode, gathered, grow, packed, unpacked, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], rounds: int = 6):
    """``{(vec_id, label): (code, error)}`` in lists, and the codebooks' digest."""
    sound = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in sound]
    width = len(v[0]) // 8
    part = [[x[p * width : (p + 1) * width] for x in v] for p in range(8)]
    books = [list(own[:16]) for own in part]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p: [min(range(len(books[p])), key=lambda e: (off(x, books[p][e]), e)) for x in part[p]]
    for _ in range(rounds):
        for p in range(8):
            to = nearest(p)
            for e in range(len(books[p])):
                own = [x for x, y in zip(part[p], to) if y == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    to = [nearest(p) for p in range(8)]
    out = [(r[0], r[2], "".join(f"{to[p][i]:02x}" for p in range(8)), sum(off(part[p][i], books[p][to[p][i]]) for p in range(8))) for i, r in enumerate(sound)]
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((*r, sums[r[1]]) for r in out), key=str), hashlib.sha256(flat.encode()).hexdigest()


def vectors(count: int, seed: int, width: int = 16) -> list[tuple]:
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(6, width))
    return [(i, [float(np.float32(x)) for x in middle[i % 6] + 0.3 * draw.normal(size=width)], i % 4 or None) for i in range(count)]


@pytest.mark.parametrize("spread", [3, 4000, 1 << 25])
def test_walks_over_a_tree_equal_plain_assignment(spread):
    draw = np.random.default_rng(spread)
    points = draw.integers(-spread, spread, (700, 4))
    entries = draw.integers(-spread, spread, (16, 4))
    entries[7] = entries[2]
    tree = unpacked(packed(grow(points)), 4)
    gap = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2).astype(np.int64)
    nearest, off = assigned(tree, entries)
    assert (nearest == gap.argmin(1)).all() and (off == gap.min(1)).all()
    n, total = gathered(tree, entries)
    assert (n == np.bincount(nearest, minlength=16)).all()
    assert (total == np.stack([points[nearest == e].sum(0) for e in range(16)])).all()


def test_a_node_covers_its_points_and_siblings_stay_apart():
    points = np.random.default_rng(1).integers(-4000, 4000, (900, 3))
    tree = grow(points)
    assert (tree.children > 0).sum() > 3
    for node in range(len(tree.low)):
        own = tree.points[tree.low[node] : tree.high[node]]
        center = tree.points[tree.center[node]]
        assert np.sqrt(((own - center) ** 2).sum(1)).max() <= tree.radius[node]
        below = range(tree.child[node], tree.child[node] + tree.children[node])
        if tree.children[node]:
            assert sum(tree.high[i] - tree.low[i] for i in below) == len(own)
            centers = tree.points[tree.center[list(below)]]
            gaps = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
            assert gaps[~np.eye(len(centers), dtype=bool)].min() > tree.radius[node] / 2


def test_whole_subtrees_are_assigned_without_their_points():
    far = np.array([[0, 0], [1_000_000, 0]])
    points = np.concatenate([far[i] + np.random.default_rng(i).integers(-50, 50, (300, 2)) for i in (0, 1)])
    assert sum(len(entry) for entry, _, _ in vector_codes.walk(grow(points), far)) < 10


def test_codes_equal_brute_force(spark):
    rows = vectors(300, 2)
    rows += [(400, None, 1), (401, [], 1), (402, [0.1] * 15 + [float("nan")], 1), (403, [float("inf")] * 16, 2), (404, [None] + [0.5] * 15, 2)]
    rows += [rows[5], rows[5], (None, rows[7][1], None), *((500 + i, rows[0][1], 3) for i in range(200))]
    shuffled = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", `a.b` int, LABEL string").repartition(7)
    found, books = fit_and_encode(shuffled)
    got = sorted((tuple(r) for r in with_label_errors(found).select("vec_id", "label", "code", "error", "label_error").collect()), key=str)
    wanted, sha = brute(rows)
    assert got == wanted
    assert digest(books) == sha


def test_few_or_no_vectors_give_small_or_no_codebooks(spark):
    rows = vectors(3, 4, 8) + [(9, [1.0] * 16, 1), (10, [1.0] * 9, 1)]
    found, books = fit_and_encode(spark.createDataFrame(rows, SCHEMA))
    assert books.shape == (8, 3, 1) and sorted(r.vec_id for r in found.collect()) == [0, 1, 2]
    found, books = fit_and_encode(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert found.count() == 0 and books.size == 0 and with_label_errors(found).count() == 0


def test_huge_components_count_as_the_limit(spark):
    found, books = fit_and_encode(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], SCHEMA))
    assert [r.error for r in found.collect()] == [0, 0] and books.max() == vector_codes.LIMIT
