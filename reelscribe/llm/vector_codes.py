"""Operator 13: product codes of vectors by Lloyd rounds over partition-local cover trees.

A vector is cut into ``PARTS`` parts. Each task packs its vectors into chunks and builds a cover tree over the distinct
points of each part once: a node covers a stretch of the points in tree order, so prefix sums give any subtree's count and
sum. A round walks the trees level by level with the codebook's entries that may still be nearest somewhere in a
node's ball; where the triangle inequality leaves one, the whole subtree goes to it, and only the others descend, to exact
comparisons at the leaves. What a round gives is a row per part, entry and task, so the driver sees nothing but codebooks.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import kept
from .names import only

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this, and below its negative, count as this: distances then fit 64 bits.
LIMIT = 1 << 27
#: Vectors of a chunk, and points of a leaf.
CHUNK, LEAF = 2048, 24


class Tree(NamedTuple):
    """A part's distinct points in tree order with their counts; per node its center's place, its stretch, its radius
    (rounded up) and its children, which are next to each other. ``place`` is each vector's point."""

    points: np.ndarray
    counts: np.ndarray
    center: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    place: np.ndarray


KINDS = {"points": "<i4", "counts": "<i8", "center": "<i4", "low": "<i4", "high": "<i4", "radius": "<f8", "child": "<i4", "children": "<i4", "place": "<i4"}


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x others."""
    small = max(np.abs(points).max(initial=0), np.abs(others).max(initial=0)) < 1 << 22
    kind = np.float64 if small and points.shape[1] <= 64 else np.int64  # below 2 ** 53 doubles are exact
    out = np.zeros((len(points), len(others)), kind)
    a, b = points.astype(kind), others.astype(kind)
    for j in range(points.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        gap *= gap
        out += gap
    return out.astype(np.int64)


def grow(points: np.ndarray) -> Tree:
    """A cover tree of a part's points: a child is one of its parent's points, further than half the parent's radius from
    its elder siblings, and covers what lies within that half."""
    each, place, counts = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    place = place.reshape(-1)
    order, nodes, level = np.empty(len(each), np.int64), [], []
    if len(each):
        off = np.sqrt(distances(each, each[:1])[:, 0])
        level = [(np.arange(len(each)), 0, off)]
    while level:  # breadth first, so that a node's children are next to each other
        below = []
        first = len(nodes) + len(level)
        for members, low, off in level:
            radius = float(np.nextafter(off.max(), np.inf))
            order[low : low + len(members)] = members
            found = []
            if len(members) > LEAF:
                left, begin = members, low
                at, gaps = 0, off
                while len(left):
                    if found:  # the next center is the first point that no elder sibling covers
                        gaps = np.sqrt(distances(each[left], each[left[at : at + 1]])[:, 0])
                    near = gaps <= radius / 2
                    found.append((left[near], begin, gaps[near]))
                    begin += int(near.sum())
                    left = left[~near]
            nodes.append((low, low, low + len(members), radius, first + len(below), len(found)))
            below += found
        level = below
    center, low, high, radius, child, children = (np.array(x) for x in zip(*nodes)) if nodes else [np.empty(0, int)] * 6
    back = np.empty(len(each), np.int64)
    back[order] = np.arange(len(each))
    return Tree(each[order], counts[order], center, low, high, radius, child, children, back[place])


def packed(tree: Tree) -> dict[str, bytes]:
    return {name: np.ascontiguousarray(getattr(tree, name)).astype(kind).tobytes() for name, kind in KINDS.items()}


def unpacked(row: dict[str, bytes], width: int) -> Tree:
    own = {name: np.frombuffer(row[name], kind) for name, kind in KINDS.items() if row.get(name) is not None}
    own["points"] = own["points"].reshape(-1, width).astype(np.int64)
    return Tree(*(own.get(name) for name in KINDS))


def walk(tree: Tree, entries: np.ndarray):
    """``entry, low, high`` of stretches of points, as arrays, that cover each point once with its nearest entry; ties go to
    the lower index."""
    node = np.zeros(min(1, len(tree.low)), np.int64)
    open_ = np.ones((len(node), len(entries)), bool)
    while len(node):
        far = np.sqrt(distances(tree.points[tree.center[node]], entries))
        far[~open_] = np.inf
        radius = tree.radius[node]
        # An entry is out if another is nearer to every point of the ball, with room for the roots' rounding.
        bound = far.min(1) + 2 * radius
        open_ = far <= (bound * (1 + 1e-12) + 1e-9)[:, None]
        sole = open_.sum(1) == 1
        if sole.any():
            yield open_[sole].argmax(1), tree.low[node[sole]], tree.high[node[sole]]
        leaf = ~sole & (tree.children[node] == 0)
        if leaf.any():
            low, high = tree.low[node[leaf]].astype(np.int64), tree.high[node[leaf]].astype(np.int64)
            size = high - low
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            exact = distances(tree.points[at], entries)  # those that are out are farther anyway
            yield exact.argmin(1), at, at + 1
        deeper = ~sole & ~leaf
        times = tree.children[node[deeper]].astype(np.int64)
        begin = tree.child[node[deeper]].astype(np.int64)
        open_ = np.repeat(open_[deeper], times, axis=0)
        node = np.arange(times.sum()) + np.repeat(begin - (np.cumsum(times) - times), times)


def gathered(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the count and the componentwise sum of its points, from prefix sums of the tree."""
    n, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    many = np.concatenate([[0], np.cumsum(tree.counts)])
    sums = np.concatenate([np.zeros((1, entries.shape[1]), np.int64), np.cumsum(tree.points * tree.counts[:, None], axis=0)])
    for entry, low, high in walk(tree, entries):
        np.add.at(n, entry, many[high] - many[low])
        np.add.at(total, entry, sums[high] - sums[low])
    return n, total


def assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's entry and squared distance."""
    nearest = np.zeros(len(tree.points), np.int64)
    for entry, low, high in walk(tree, entries):
        nearest[np.arange((high - low).sum()) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)] = np.repeat(entry, high - low)
    gap = tree.points - entries[nearest]
    return nearest[tree.place], (gap * gap).sum(1)[tree.place]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: the rows that the codes cover, but for their common length."""
    rows = only(vectors, "vec_id", "embedding", "label")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(f"size(vector) > 0 and size(vector) % {PARTS} = 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def scaled(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64)


def fit_and_encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``chunk, vec_id, label, code, error`` per kept row of ``vectors(vec_id, embedding, label)``, and the codebooks
    (parts x entries x components). ``chunk`` names the stretch of rows that was packed together.

    Rows whose vector is null, empty or not a multiple of eight long, or holds a null or a value that isn't finite, are
    dropped, and so are those whose length isn't that of the vector with the least vec_id. Vectors start codebooks in
    order of vec_id (null last), then of their components; fewer than 16 give smaller codebooks. Repeated rows and
    null labels are rows like others; no rows give no rows. Components beyond 2 ** 27 after scaling count as that.
    Further columns are ignored.
    """
    rows = whole_vectors(vectors)
    order = F.col("vec_id").asc_nulls_last(), F.col("vector")
    first = rows.orderBy(*order).limit(1).collect()
    width = len(first[0]["vector"]) if first else PARTS
    rows = rows.where(F.size("vector") == width)
    first = rows.orderBy(*order).limit(ENTRIES).collect()
    part = width // PARTS
    books = scaled(np.array([r["vector"] for r in first], float).reshape(-1, PARTS, part)).transpose(1, 0, 2).copy()

    def build(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, len(batch), CHUNK):
                own = batch.slice(low, CHUNK)
                flat = scaled(own.column("vector").flatten().to_numpy(zero_copy_only=False)).reshape(-1, PARTS, part)
                ids = pa.StructArray.from_arrays([own.column("vec_id"), own.column("label")], ["vec_id", "label"])
                ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids)
                trees = pa.array([[packed(grow(flat[:, i])) for i in range(PARTS)]], pa.list_(pa.struct([(name, pa.binary()) for name in KINDS])))
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), ids, trees], ["chunk", "rows", "trees"])
                chunk += 1

    label = rows.schema["label"].dataType.simpleString()
    tree = ", ".join(f"{name}: binary" for name in KINDS)
    chunks = kept(rows.mapInArrow(build, f"chunk long, rows array<struct<vec_id: long, label: {label}>>, trees array<struct<{tree}>>"), "trees")

    def gather(batches, books):
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for trees in batch.column("trees"):
                for i, each in enumerate(trees.as_py()):
                    more, sums = gathered(unpacked(each, part), books[i])
                    n[i] += more
                    total[i] += sums
        at = np.argwhere(n)
        columns = {"part": at[:, 0].astype("i4"), "entry": at[:, 1].astype("i4"), "n": n[n > 0]}
        yield pa.RecordBatch.from_pydict(columns | {"sums": pa.array(total[n > 0].tolist(), pa.list_(pa.int64()))})

    for _ in range(rounds if first else 0):
        found = chunks.select("trees").mapInArrow(lambda x, books=books: gather(x, books), "part int, entry int, n long, sums array<long>")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(part)]
        books = books.copy()
        for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # at most 128 rows
            books[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(part)]

    def finish(batches):
        for batch in batches:
            for chunk, rows, trees in zip(*(batch.column(c) for c in ("chunk", "rows", "trees"))):
                done = [assigned(unpacked(each, part), books[i]) for i, each in enumerate(trees.as_py())]
                codes = np.stack([x[0] for x in done], axis=1).astype("u1").tobytes().hex()
                ids = rows.values
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([chunk.as_py()] * len(ids), pa.int64()), "vec_id": ids.field("vec_id"), "label": ids.field("label"),
                    "code": [codes[i : i + 2 * PARTS] for i in range(0, len(codes), 2 * PARTS)], "error": sum(x[1] for x in done),
                })

    return chunks.mapInArrow(finish, f"chunk long, vec_id long, label {label}, code string, error long"), books


def with_label_errors(found: DataFrame) -> DataFrame:
    """``found`` with ``label_error``, the error summed over rows of its label, nulls together. A label meets its sum once per
    chunk, so that a frequent one loads no task."""
    inside = found.groupBy("chunk", "label").agg(F.sum("error").alias("own"))
    total = inside.groupBy(F.col("label").alias("of")).agg(F.sum("own").alias("label_error"))
    told = inside.join(total, F.col("label").eqNullSafe(F.col("of"))).select(F.col("chunk").alias("in_chunk"), "of", "label_error")
    return found.join(told, (F.col("chunk") == F.col("in_chunk")) & F.col("label").eqNullSafe(F.col("of"))).drop("in_chunk", "of")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = fit_and_encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = with_label_errors(kept(found, "codes"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
