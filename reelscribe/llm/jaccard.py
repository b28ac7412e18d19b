"""Operator 6: shingle-set Jaccard join over count-vector R-trees.

A document's set is that of its distinct 5-word shingles' hashes. Equal sets are one set from the start.

1. Survivors. Two sets that link share at least 3/4 of either, so of a set's smallest hashes (an extended prefix)
   a known number must be shared with some other document. A packed exchange finds the shared ones; sets with too
   few are linked with nothing.
2. Blocks. Survivors meet where they share one of their ``n / 4 + 1`` smallest hashes; any two that link do.
3. Points. Hashes fall into ``GROUPS`` groups and a set's group counts are its point. The sum over groups of the
   lesser count bounds the overlap. What passes is bounded again with the groups split until eight (in step 5 two)
   hashes share one, since the more share a group the more chance fills it alike. In a small block every pair under the bound is a candidate. In a large one an
   R-tree over the points is searched from central sets, each gathering what the bound lets it link (stars).
4. Candidates are verified on their whole sets and links become components.
5. A large block whose sets lie in one component needs nothing more. Of the others, those with the same least
   component are united, since a family of near copies shares most of its blocks; every pair of different components
   that the bound lets through is verified too, cell by cell of a grid of bounded parts.

So no group of copies is expanded into its pairs, yet no link that could join two components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import kept
from .components import connected_components
from .exchange import arrays, bucket_bits, chunked, first_value, row_key, runs, table, text_bytes
from .names import numbered, only, place
from .words import as_array, mix, shingle_sets, then_free

GROUPS, LEAF, FAN = 64, 32, 8
#: Blocks up to this size list their pairs; sets of a bucket's salt, and of a grid's part.
SMALL, SALTED, PART = 8, 200_000, 4096


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Hashes that a set of n shares with any set it links to, at least."""
    return -(-3 * n // 4)


def prefix_lengths(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the extended prefix, and how many of it are shared at least if the set links."""
    spare = n - least_overlap(n)
    length = np.minimum(n, spare + np.maximum(1, -(-15 * n // 100)))
    return length, length - spare


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def distinct_sets(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The chunk's sets, their keys, and the rows that show a non-empty set first."""
    sets = shingle_sets(as_array(rows["text"]))
    keys = np.fromiter(map(set_key, sets), np.int64, len(sets))
    _, first = np.unique(keys, return_index=True)
    return sets, keys, np.array([i for i in np.sort(first) if len(sets[i])], np.int64)


PROBES = {"bucket": pa.int32(), "chunk": pa.int32(), "keys": pa.binary()}


def prefixes(sets: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed hashes of the extended prefixes, each one's place in ``own``, and what each set needs shared."""
    length, need = prefix_lengths(np.array([len(sets[i]) for i in own], np.int64))
    flat = np.concatenate([np.empty(0, np.uint64), *(sets[i][:k] for i, k in zip(own, length))])
    return mix(flat), np.repeat(np.arange(len(own)), length), need


def probe(rows: pa.Table, bits: int) -> pa.Table:
    """The chunk's distinct prefix hashes by bucket: 31 bits, then whether several of its sets have it."""
    sets, _, own = distinct_sets(rows)
    keys, _, _ = prefixes(sets, own)
    short, times = np.unique(keys >> np.uint64(33 - bits), return_counts=True)
    packed = (((short << np.uint64(1)) | (times > 1)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    out = {name: [] for name in PROBES}
    for bucket, lo, hi in runs(short << np.uint64(33 - bits), bits):
        for name, value in zip(PROBES, (bucket, first_value(rows["chunk"]), packed[lo:hi].tobytes())):
            out[name].append(value)
    return table(out, PROBES)


def shared(rows: pa.Table) -> pa.Table:
    """The bucket's hashes that two chunks, or several sets of one, have; back to each chunk."""
    each = arrays(rows["keys"], "<u4")
    keys = np.concatenate(each)
    _, at, times = np.unique(keys >> np.uint32(1), return_inverse=True, return_counts=True)
    several = np.zeros(len(times), bool)
    several[at[(keys & np.uint32(1)) > 0]] = True
    hit = (several | (times > 1))[at]
    out = {name: [] for name in PROBES}
    for chunk, own, mark in zip(rows["chunk"].to_pylist(), each, np.split(hit, np.cumsum([len(x) for x in each])[:-1])):
        if mark.any():
            for name, value in zip(PROBES, (first_value(rows["bucket"]), chunk, (own[mark] >> np.uint32(1)).tobytes())):
                out[name].append(value)
    return table(out, PROBES)


def survive(rows: pa.Table, hits: pa.Table, bits: int) -> pa.Table:
    """Every document's set key and size; a set that may link, with its hashes, once in the chunk."""
    sets, keys, own = distinct_sets(rows)
    hashes, place, need = prefixes(sets, own)
    short = [
        (np.uint64(bucket) << np.uint64(31)) | found.astype(np.uint64)
        for bucket, found in zip(hits["bucket"].to_pylist(), arrays(hits["keys"], "<u4"))
    ]
    blobs: list[bytes | None] = [None] * len(sets)
    if short:
        hit = np.isin(hashes >> np.uint64(33 - bits), np.concatenate(short))
        enough = np.bincount(place, weights=hit, minlength=len(own)) >= np.maximum(1, need)
        for i in own[enough]:
            blobs[i] = sets[i].tobytes()
    return pa.table(
        {
            "doc_id": rows["doc_id"],
            "row_key": rows["row_key"],
            "chunk": rows["chunk"],
            "set_key": pa.array(keys),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "hashes": pa.array(blobs, pa.binary()),
        }
    )


def point(own: np.ndarray) -> np.ndarray:
    """A set's group counts, up to 65,535."""
    counts = np.bincount((mix(own + np.uint64(1)) >> np.uint64(58)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 0xFFFF).astype(np.uint16)


def group_counts(column: pa.ChunkedArray) -> np.ndarray:
    """The points of a binary column; a count that may be over 65,535 bounds nothing."""
    points = np.concatenate(arrays(column, "<u2")).reshape(-1, GROUPS).astype(np.uint32)
    points[points == 0xFFFF] = 0xFFFFFFFF
    return points


def fine_point(own: np.ndarray, each: int) -> bytes:
    """Group counts, up to 255, with each group split in two until about ``each`` hashes are left to one."""
    bits = min(20, max(6, int(np.ceil(np.log2(max(1, len(own) / each))))))
    counts = np.bincount((mix(own + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def fine_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """``bound`` on fine points, at the coarser one's groups; a count that may be over 255 lets all through."""
    one, two = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if max(one.max(), two.max()) == 255:
        return True
    if len(one) != len(two):
        least = min(len(one), len(two))
        one, two = (x.reshape(least, -1).sum(1) for x in (one, two))
    return 7 * int(np.minimum(one, two).sum(dtype=np.int64)) >= 3 * (size_a + size_b)


def bound(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the summed lesser counts allow an overlap of 3/7 of both sizes together (Jaccard 3/4)."""
    return 7 * np.minimum(a, b).sum(-1, dtype=np.int64) >= 3 * (size_a + size_b)


class CountTree:
    """An R-tree over count vectors: each node has its points' greatest counts and their least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self.tiled(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        tops, least, step = self.points, self.sizes, LEAF
        while True:
            cuts = np.arange(0, len(tops), step)
            tops, least = np.maximum.reduceat(tops, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((tops, least))
            if len(tops) == 1:
                return
            step = FAN

    @staticmethod
    def tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: slabs of size, and in each by the coordinates of the greatest spread."""
        order = np.argsort(sizes, kind="stable")
        wide = np.argsort(-points.astype(np.float32).var(0))[:3]
        slab = np.arange(len(order)) // max(LEAF, int(len(order) ** 0.75))
        keys = [points[order, c] for c in wide[::-1]]
        return order[np.lexsort((*keys, slab))]

    def search(self, query: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points that the bound lets the query link to."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[depth]
            nodes = nodes[nodes < len(tops)]
            nodes = nodes[bound(tops[nodes], query, least[nodes], size)]
            fan = FAN if depth else LEAF
            nodes = (nodes[:, None] * fan + np.arange(fan)).reshape(-1)
        nodes = nodes[nodes < len(self.points)]
        return self.order[nodes[bound(self.points[nodes], query, self.sizes[nodes], size)]]


def close(x: int, near: np.ndarray, fine: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Those of the ``near`` points whose fine points let x link to them."""
    if len(fine[x]) == GROUPS:
        return near
    return near[np.fromiter((fine_bound(fine[x], fine[y], sizes[x], sizes[y]) for y in near), bool, len(near))]


def stars(points: np.ndarray, sizes: np.ndarray, fine: list[bytes]) -> list[tuple[int, int]]:
    """Candidates that gather a large block around central sets: (centre, member)."""
    tree, open_, out = CountTree(points, sizes), np.ones(len(points), bool), []
    centre = np.minimum(points, points.mean(0)).sum(1) / np.maximum(sizes, 1)
    for c in np.argsort(-centre, kind="stable"):
        if open_[c]:
            open_[c] = False
            near = tree.search(points[c], sizes[c])
            near = close(c, near[open_[near]], fine, sizes)
            out += [(c, x) for x in near]
            open_[near] = False
    return out


def block_rows(survivors: DataFrame, bits: int, salts: int) -> DataFrame:
    """Per bucket and salt: sets with their points, and which of them show which prefix hash."""
    schema = {"bucket": pa.int32(), "salt": pa.int32()} | dict.fromkeys(("keys", "sizes", "points", "hashes", "owners"), pa.binary())
    schema["fine"] = pa.list_(pa.binary())

    def emit(batches):
        for batch in batches:
            keys, sizes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("set_key", "n_shingles"))
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
            points = np.array([point(s) for s in sets]).reshape(-1, GROUPS)
            fine = [fine_point(s, 8) for s in sets]
            length = sizes - least_overlap(sizes) + 1
            hashes = mix(np.concatenate([np.empty(0, np.uint64), *(s[:k] for s, k in zip(sets, length))]) ^ np.uint64(0x5BD1E995))
            owner, salt = np.repeat(np.arange(len(sets)), length), (keys % salts)
            order = np.lexsort((hashes, salt[owner]))
            hashes, owner = hashes[order], owner[order]
            out = {name: [] for name in schema}
            for s in np.unique(salt):
                mine = salt[owner] == s
                for bucket, lo, hi in runs(hashes[mine], bits):
                    there, places = np.unique(owner[mine][lo:hi], return_inverse=True)
                    values = (bucket, int(s), keys[there], sizes[there], points[there], hashes[mine][lo:hi], places.astype(np.int32))
                    for name, value in zip(schema, values):
                        out[name].append(value if isinstance(value, int) else value.tobytes())
                    out["fine"].append([fine[i] for i in there])
            yield from table(out, schema).to_batches()

    text = "bucket int, salt int, keys binary, sizes binary, points binary, hashes binary, owners binary, fine array<binary>"
    return survivors.select("set_key", "n_shingles", "hashes").mapInArrow(emit, text)


FOUND = {"a": pa.int64(), "b": pa.int64(), "block": pa.int64(), "members": pa.binary(), "centre": pa.int64(), "same": pa.binary()}


def gather(rows: pa.Table, salted: bool) -> pa.Table:
    """A bucket's candidates (a, b), and its large blocks with their members and first centre.

    If salted, small blocks too, and the hashes of all blocks with the same members here: in another salt their members may differ.
    """
    keys = np.concatenate(arrays(rows["keys"], "<i8"))
    sizes, points = np.concatenate(arrays(rows["sizes"], "<i8")), group_counts(rows["points"])
    starts = np.cumsum([0, *(len(x) // 8 for x in rows["keys"].to_pylist())])
    owners = np.concatenate([x + s for x, s in zip(arrays(rows["owners"], "<i4"), starts)])
    hashes = np.concatenate(arrays(rows["hashes"], "<u8"))
    keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
    sizes, points, owners = sizes[first], points[first], back[owners]
    every = [x for row in rows["fine"].to_pylist() for x in row]
    fine = [every[i] for i in first]
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
    hashes, owners = hashes[new], owners[new]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    count = np.diff(np.concatenate([begin, [len(hashes)]]))
    same = np.add.reduceat(mix(owners.astype(np.uint64) + np.uint64(1)), begin) ^ count.astype(np.uint64)
    _, pick, fold, times = np.unique(same, return_index=True, return_inverse=True, return_counts=True)  # blocks of the same sets are one
    folded, ends = hashes[begin[np.argsort(fold, kind="stable")]], np.cumsum(times)
    begin, count = begin[pick], count[pick]

    def alike(i: int) -> bytes:
        return (folded[ends[i] - times[i] : ends[i]] if salted else hashes[begin[i] : begin[i] + 1]).tobytes()

    pairs: list[np.ndarray] = []
    blocks: list[tuple[int, bytes, int, bytes]] = []
    for size in range(2, SMALL + 1):
        at = begin[count == size][:, None] + np.arange(size)
        left, right = np.triu_indices(size, 1)
        pairs.append(np.stack([owners[at[:, left]].reshape(-1), owners[at[:, right]].reshape(-1)], 1))
    for i in np.flatnonzero(count > SMALL):
        lo, n = begin[i], count[i]
        own = owners[lo : lo + n]
        found = np.array(stars(points[own], sizes[own], [fine[i] for i in own]), np.int64).reshape(-1, 2)
        pairs.append(own[found])
        centre = own[found[0, 0]] if len(found) else own[0]
        blocks.append((int(hashes[lo].view(np.int64)), keys[own].tobytes(), int(keys[centre]), alike(i)))
    if salted:  # parts of small blocks may go on in other salts
        for i in np.flatnonzero(count <= SMALL):
            lo, n = begin[i], count[i]
            blocks.append((int(hashes[lo].view(np.int64)), keys[owners[lo : lo + n]].tobytes(), int(keys[owners[lo]]), alike(i)))
    both = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
    both = both[bound(points[both[:, 0]], points[both[:, 1]], sizes[both[:, 0]], sizes[both[:, 1]])]
    both = both[np.fromiter((fine_bound(fine[x], fine[y], sizes[x], sizes[y]) for x, y in both), bool, len(both))]
    empty = dict.fromkeys(FOUND, [None] * len(both)) | {"a": keys[both[:, 0]], "b": keys[both[:, 1]]}
    none = dict.fromkeys(FOUND, [None] * len(blocks))
    parts = {name: [x[i] for x in blocks] for i, name in enumerate(("block", "members", "centre", "same"))}
    return pa.concat_tables([table(empty, FOUND), table(none | parts, FOUND)])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of 3/4 or more."""
    left = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("right"))

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([one, two]))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * same >= 75 * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


CELL = {"a": pa.int64(), "b": pa.int64()}


def cross_pairs(rows: pa.Table) -> pa.Table:
    """Pairs of a grid cell that the bound lets through and that lie in different components."""
    keys, comp, sizes, part = (rows[c].to_numpy() for c in ("set_key", "component", "n_shingles", "part"))
    points = group_counts(rows["point"])
    fine = rows["fine"].to_pylist()
    tree, out = CountTree(points, sizes), []
    kinds, counts = np.unique(comp, return_counts=True)
    rest = np.flatnonzero(comp != kinds[counts.argmax()])  # each pair has one of these
    alone = part.min() == part.max()
    for x in rest:
        near = tree.search(points[x], sizes[x])
        near = close(x, near[(comp[near] != comp[x]) & (alone | (part[near] != part[x]))], fine, sizes)
        out.append(np.stack([np.full(len(near), keys[x]), keys[near]], 1))
    found = np.unique(np.sort(np.concatenate([np.empty((0, 2), np.int64), *out]), 1), axis=0)
    return table({"a": found[:, 0], "b": found[:, 1]}, CELL)


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, n_shingles, root, component_id`` per row of ``docs(doc_id, text)``; a root names a component.

    Two documents link at a Jaccard similarity of 0.75 or more of their sets; component_id is the least doc_id
    that links reach, one's own included. A text with under five words is one shingle; one without words, or
    null, has none and is its own component. Rows of one doc_id count each; a null doc_id is never the least
    unless a component has no other. No rows give no rows.
    """
    total = text_bytes(docs)
    bits = bucket_bits(total)
    chunks = chunked(docs, total, row_key().alias("row_key")).groupBy("chunk")
    probes = chunks.applyInArrow(lambda rows: then_free(probe, rows, bits), "bucket int, chunk int, keys binary")
    hits = probes.groupBy("bucket").applyInArrow(lambda rows: then_free(shared, rows), "bucket int, chunk int, keys binary")
    documents = kept(
        chunks.cogroup(hits.groupBy("chunk")).applyInArrow(
            lambda rows, found: then_free(survive, rows, found, bits), "doc_id long, row_key long, chunk int, set_key long, n_shingles long, hashes binary"
        ),
        "shingle_sets",
    )
    shown = documents.where("hashes is not null")
    once = shown.groupBy("set_key").agg(F.min("chunk").alias("chunk"))
    survivors = shown.join(once, ["set_key", "chunk"], "left_semi")

    sizing = shown.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).first()
    salts = max(1, -(-sizing["n"] // SALTED))
    wide = max(4, int(np.ceil(np.log2(max(1, (sizing["s"] or 0) / 4 * 16 / salts / (16 << 20))))))
    blocks = block_rows(shown, wide, salts)
    found = kept(
        blocks.groupBy("bucket", "salt").applyInArrow(
            lambda rows: then_free(gather, rows, salts > 1), "a long, b long, block long, members binary, centre long, same binary"
        ),
        "candidates",
    )
    pairs = found.where("a is not null").select("a", "b")
    large = found.where("block is not null").select("block", "members", "centre", "same")
    unpack = F.pandas_udf(lambda s: s.map(lambda x: np.frombuffer(x, np.int64)), "array<long>")
    if salts > 1:  # centres of a block's salts are candidates of the least of them
        spread = large.select(F.explode(unpack("same")).alias("block"), "members", "centre")
        meet = spread.groupBy("block").agg(F.min("centre").alias("a"), F.count("*").alias("n")).where("n > 1")
        spread = kept(spread.join(meet, "block"), "salted_blocks")
        pairs = pairs.unionByName(spread.where("centre <> a").select("a", F.col("centre").alias("b")))
        large = large.where(F.octet_length("members") > 8 * SMALL).select("block", "members").unionByName(spread.select("block", "members"))
    links = kept(verify(pairs.distinct(), survivors), "links")
    roots = connected_components(links)

    # Large blocks that lie in several components.
    members = large.select("block", F.explode(unpack("members")).alias("set_key"))
    members = members.join(roots.select(F.col("a").alias("set_key"), F.col("b").alias("root")), "set_key", "left")
    members = members.select("block", "set_key", F.coalesce("root", "set_key").alias("component"))
    split = members.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    united = members.join(split.where("low <> high").select("block", "low"), "block").select("low", "set_key", "component").distinct()
    united = kept(united, "open_blocks")
    parts = united.groupBy("low").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    points = F.pandas_udf(lambda s: s.map(lambda x: point(np.frombuffer(x, np.uint64)).tobytes()), "binary")
    finer = F.pandas_udf(lambda s: s.map(lambda x: fine_point(np.frombuffer(x, np.uint64), 2)), "binary")
    open_ = united.join(parts, "low").withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    open_ = open_.join(survivors.select("set_key", "n_shingles", points("hashes").alias("point"), finer("hashes").alias("fine")), "set_key")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = open_.withColumn("other", other).select(
        "low", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "set_key", "component", "n_shingles", "point", "fine"
    )
    more = cells.groupBy("low", "x", "y").applyInArrow(lambda rows: then_free(cross_pairs, rows), "a long, b long").distinct()
    extra = verify(more.join(pairs, ["a", "b"], "left_anti"), survivors)
    roots = connected_components(links.unionByName(extra))

    placed = documents.select("doc_id", "row_key", "set_key", "n_shingles").join(
        roots.select(F.col("a").alias("set_key"), F.col("b").alias("root")), "set_key", "left"
    )
    placed = placed.withColumn("root", F.coalesce("root", "set_key"))
    least = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", "row_key", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; see ``grouped``."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns under any names, without near copies: one row of each component stays.

    It is that of the least doc_id (null last), of several the one of the least row key, and of rows that share doc_id and
    text the one whose other columns have the least hash. Rows without words, null texts among them, all stay. Repeats of
    one row are reduced before they are shuffled.
    """
    found = grouped(only(docs, "doc_id", "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    stays = found.where("n_shingles > 0").groupBy("root").agg(F.min_by("row_key", order).alias("key")).select("key")
    rows, doc_id, text = numbered(docs), F.col(f"c{place(docs, 'doc_id')}"), F.col(f"c{place(docs, 'text')}")
    worded = F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hashed = [f"c{i}" for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()]
    keyed = rows.where(worded).select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(*hashed).alias("tie"), F.struct(*rows.columns).alias("whole"))
    keyed = keyed.select(row_key().alias("key"), "tie", "whole")
    once = keyed.groupBy("key").agg(F.min_by("whole", "tie").alias("whole")).join(stays, "key", "left_semi")
    return once.select("whole.*").unionByName(rows.where(~worded)).toDF(*docs.columns)


def op6_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs)
