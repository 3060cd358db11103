"""Near duplicates by SimHash, with exact neighbours from a forest of vantage-point trees.

Fingerprints link at ``radius`` or fewer differing bits. Equal fingerprints become one row first. Then:

* Views. Fingerprints lie 32 +- 4 bits from any vantage point, so that over all 64 bits a bound of 3 bits prunes little. Two
  fingerprints within 3 bits differ in at most one bit of one of their halves. Each half is a view: its trees compare halves
  at distance 1, where the triangle bound prunes a third of what is left at each level. A hit is verified over all 64 bits.
* Shards. The upper part of each view's tree is grown from a bounded sample of the fingerprints (vantage points and cuts only:
  what is found doesn't depend on it). Its leaves are shards: partitions by Hamming distance. A fingerprint is indexed in its
  own shard of each view, and asks those others that its radius reaches into.
* In a shard, a vantage-point tree answers the fingerprints asked about, many at once. Fingerprints that agree on a half can't be
  told apart by it; nodes of such compare all 64 bits at the whole radius. Links leave a shard as stars (each fingerprint and
  the smallest id it is connected with), never as all pairs.

Stars are joined into components by alternating large-star and small-star steps, each a few joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from calltide.llm.common import Stored

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
#: Fingerprints that a shard should hold, how many of the sample stand for a shard, and how many shards there are at most: the
#: sample holds ``SHARDS * SHARD_SAMPLE`` fingerprints at most. Beyond that shards grow, and their trees get deeper.
SHARD, SHARD_SAMPLE, SHARDS = 20_000, 32, 8_192
#: Fingerprints of a leaf, which are compared directly.
LEAF = 64
#: Comparisons that are made at a time, and links that are gathered before they're reduced to stars.
CELLS, LINKS = 1 << 18, 1 << 20
HALVES = [np.uint64((1 << 32) - 1), np.uint64(((1 << 32) - 1) << 32)]
WHOLE = np.uint64((1 << 64) - 1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles by XXH64 with seed 42; bit i is set if it is in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: A-Z alone are lowered, and the six ASCII blanks alone cut
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n, sums = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of each row; null, empty and blank texts have 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), f"id {rows.dtypes[0][1]}, fp bigint")


class VantageTree:
    """A vantage-point tree over fingerprints, of which a node compares the bits of a mask.

    Linked fingerprints are at most ``near`` apart in ``mask``, and at most ``radius`` over all bits. A node splits its points at
    the median distance from a vantage point; where all lie at one distance it compares all bits instead. ``leaf`` is the size
    from which a node is split. ``asked`` and ``pruned`` count the (fingerprint, branch) steps that were possible at the nodes
    reached, and those that the triangle bound saved.
    """

    def __init__(self, points: np.ndarray, mask: np.uint64 = WHOLE, near: int = RADIUS, radius: int = RADIUS, leaf: int = LEAF):
        self.points, self.leaf, self.radius = points, leaf, radius
        self.nodes: list[tuple] = []  # (vantage, mask, near, cut, inner, outer), or (None, rows)
        self.asked = self.pruned = 0
        todo = [(np.arange(len(points)), mask, near, None, 0)]
        while todo:
            rows, m, r, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][4 + side] = at
            cut = self._cut(rows, m) if len(rows) > leaf else None
            if cut is None and len(rows) > leaf and m != WHOLE:
                m, r = WHOLE, radius
                cut = self._cut(rows, m)
            if cut is None:
                self.nodes.append([None, rows])
                continue
            vantage, mid, inner = cut
            self.nodes.append([vantage, m, r, mid, -1, -1])
            todo += [(rows[inner], m, r, at, 0), (rows[~inner], m, r, at, 1)]

    def _cut(self, rows: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int, np.ndarray] | None:
        """Of a few vantage points the one from which distances spread most: it, the cut, and who is inside."""
        some = self.points[rows[:: max(1, len(rows) // 256)]]
        tried = some[:: max(1, len(some) // 8)][:8]
        vantage = tried[np.argmax(np.bitwise_count((tried[:, None] ^ some[None, :]) & mask).var(axis=1))]
        d = np.bitwise_count((self.points[rows] ^ vantage) & mask)
        low, high = int(d.min()), int(d.max())
        if low == high:
            return None
        mid = min(int(np.median(d)), high - 1)
        return vantage, mid, d <= mid

    def leaves(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each leaf that some of ``points`` reach: its number, which of the points, and which of these lie in it themselves."""
        todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            at, who, home = todo.pop()
            node = self.nodes[at]
            if node[0] is None:
                yield at, who, home
                continue
            vantage, mask, near, cut, inner, outer = node
            d = np.bitwise_count((points[who] ^ vantage) & mask).astype(np.int16)
            is_in = d <= cut
            go_in, go_out = d - near <= cut, d + near > cut
            self.asked += 2 * len(who)
            self.pruned += 2 * len(who) - int(go_in.sum()) - int(go_out.sum())
            for child, go, own in ((inner, go_in, is_in), (outer, go_out, ~is_in)):
                if go.any():
                    todo.append((child, who[go], home[go] & own[go]))

    def links(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``points``, rows of the tree) of all within ``radius``, some at a time."""
        for at, who, _ in self.leaves(points):
            rows = self.nodes[at][1]
            step = max(1, CELLS // max(len(rows), 1))
            for i in range(0, len(who), step):
                some = who[i : i + step]
                a, b = np.nonzero(np.bitwise_count(points[some][:, None] ^ self.points[rows][None, :]) <= self.radius)
                if len(a):
                    yield some[a], rows[b]

    def near(self, point: np.uint64) -> np.ndarray:
        """Rows within ``radius`` of one point."""
        found = [b for _, b in self.links(np.asarray([point], np.uint64))]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def lowest(label: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Labels of nodes after links (rows, cols) have joined them: the smallest that is reachable."""
    label = label.copy()
    while True:
        a, b = label[rows], label[cols]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def linked(tree: VantageTree) -> np.ndarray:
    """For each of a tree's points the smallest row that is connected with it through links; few links are held at a time."""
    label, held, n = np.arange(len(tree.points)), [], 0
    for rows, cols in tree.links(tree.points):
        use = rows > cols
        held.append((rows[use], cols[use]))
        n += int(use.sum())
        if n > LINKS:
            label, held, n = lowest(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
    return lowest(label, *map(np.concatenate, zip(*held, strict=True))) if n else label


def shard_rows(batches: Iterator[pa.RecordBatch], trees: list[VantageTree]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and view: the shard in which it is indexed, and (``asks``) those others that it asks."""
    for batch in batches:
        fp, views, shards, homes, whos = batch.column("fp").to_numpy().view(np.uint64), [], [], [], []
        for view, tree in enumerate(trees):
            for at, who, home in tree.leaves(fp):
                views.append(np.full(len(who), view, np.int32)), shards.append(np.full(len(who), at, np.int32))
                homes.append(home), whos.append(who)
        if whos:
            view, shard, home, who = map(np.concatenate, (views, shards, homes, whos))
            rep = batch.column("rep").take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(shard), pa.array(~home), pa.array(fp[who].view(np.int64)), rep], names=["view", "shard", "asks", "fp", "rep"])


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int, pruned=None) -> Iterator[pa.RecordBatch]:
    """Stars of each shard. Rows come sorted by shard with those indexed first, so that only these are held: askers pass by."""
    key, indexed, tree, root = None, [], None, None

    def emit(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def grow() -> Iterator[pa.RecordBatch]:
        """The tree of the points held, the smallest id of each one's component, and the components as stars."""
        nonlocal tree, root
        fp, rep = (np.concatenate([p[i] for p in indexed]) for i in range(2))
        order = np.argsort(rep, kind="stable")
        fp, rep = fp[order].view(np.uint64), rep[order]
        tree = VantageTree(fp, HALVES[key[0]], radius // 2, radius)
        root = rep[linked(tree)]  # rows are in the order of ids
        use = root != rep
        if use.any():
            yield emit(rep[use], root[use])

    def count() -> None:
        if tree is not None and pruned is not None:
            pruned.add(tree.pruned), pruned.add(tree.asked * 1j)

    for batch in batches:
        view, shard, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("view", "shard", "asks"))
        fp, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
        cuts = np.flatnonzero((np.diff(view) != 0) | (np.diff(shard) != 0) | (np.diff(asks.view(np.int8)) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            if (view[a], shard[a]) != key:
                if indexed and tree is None:
                    yield from grow()
                count()
                key, indexed, tree, root = (view[a], shard[a]), [], None, None
            if not asks[a]:
                indexed.append((fp[a:b], rep[a:b]))
            elif indexed:
                if tree is None:
                    yield from grow()
                for i, j in tree.links(fp[a:b].view(np.uint64)):
                    pairs = np.unique(np.stack([rep[a:b][i], root[j]]), axis=1)
                    pairs = pairs[:, pairs[0] != pairs[1]]
                    if pairs.size:
                        yield emit(*pairs)
    if indexed and tree is None:
        yield from grow()
    count()


def upper_trees(sample: np.ndarray, shards: int, radius: int = RADIUS) -> list[VantageTree]:
    """A tree for each half, grown from a sample until a leaf stands for one of about ``shards`` shards. The points are left out."""
    out = []
    for half in HALVES:
        tree = VantageTree(sample, half, radius // 2, radius, max(1, len(sample) // max(shards, 1)))
        tree.nodes = [node if node[0] is not None else [None, None] for node in tree.nodes]
        tree.points = sample[:0]
        out.append(tree)
    return out


def links(nodes: DataFrame, kept: Stored, radius: int = RADIUS, shard: int = SHARD, pruned=None) -> DataFrame:
    """Stars (u > v) that connect all ``nodes`` (fp, rep: its smallest id) within ``radius``; fp is unique.

    ``pruned``: an accumulator of complex numbers: steps that triangle bounds saved, and (imaginary) all steps.
    """
    n = nodes.count()
    shards = min(SHARDS, -(-n // shard))
    few = min(1.0, shards * SHARD_SAMPLE / max(n, 1))
    picked = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(few * (1 << 30))) if few < 1 else nodes  # vantage points only
    sample = np.sort(picked.select("fp").toArrow().column("fp").to_numpy()).view(np.uint64)
    trees = upper_trees(sample, shards, radius)
    dealt = nodes.mapInArrow(partial(shard_rows, trees=trees), "view int, shard int, asks boolean, fp bigint, rep bigint")
    spread = dealt.repartition("view", "shard").sortWithinPartitions("view", "shard", "asks")
    stars = spread.mapInArrow(partial(_shard_links, radius=radius, pruned=pruned), "u bigint, v bigint")
    return kept.write(stars.distinct(), "links")


def components(edges: DataFrame, kept: Stored) -> DataFrame:
    """(u, v): each node of ``edges`` (u > v) and the smallest of its component, which itself has no row."""
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = kept.write(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        kept.drop(edges)
        if now == state:
            return new
        edges, state = new, now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD, pruned=None) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id (the smallest id linked with it, directly or not) of each row.

    Ids must be whole numbers (a TypeError else). Null, empty and blank texts have fingerprint zero, which links like any other. Repeated rows give
    repeated rows. A row with a null id takes its fingerprint's component, or null if only such rows have it. An empty table
    gives no rows; other columns aren't read.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is no column of whole numbers")
    kept = Stored(docs.sparkSession, "simhash")
    prints = kept.write(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = kept.write(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "nodes")
    stars = components(links(nodes, kept, radius, shard, pruned), kept)
    roots = nodes.join(stars, nodes.rep == stars.u, "left").select("fp", F.coalesce("v", "rep").alias("component_id"))
    out = prints.join(roots, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that are the smallest of their component; all columns."""
    near = near_duplicates(docs, id_col, text_col, **how)
    return docs.join(near.where(F.col(id_col) != F.col("component_id")).select(id_col), id_col, "left_anti")
