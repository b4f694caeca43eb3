"""Codes of vectors by parts, fitted with metric trees of the anchors hierarchy.

Components become integers, vectors are cut into equal parts, and every part
position has a small codebook that starts from given vectors and is moved by
rounds of assignment and means. Rounds do not look at vectors one by one: blocks
of vectors carry a tree of balls per part position. A tree is built middle-out:
about sqrt(n) anchors, each taking from the others the points that are nearer to
it, are merged pair by pair into ever larger balls, and each anchor's own points
are treated the same way. A ball caches the sum and the number of its points. In
a round a ball gets the list of entries that may own points of the ball above,
strikes those that cannot own any of its own, and is settled by its sum and
count when one is left; only in leaves with several entries points are compared.

All results are exact integers. Bounds are rounded so that an entry is struck
only when it is certainly further away, and ties go to the lower index.

Trees are a written table, one row per block, read once a round; a task adds up
its blocks before anything is shuffled, so the driver gets one number per
codebook component.

Defined results: rows whose vector is NULL or holds a NULL or a component that
is not finite are left out; a vector shorter than the longest, or than a
multiple of the number of parts, counts as filled up with zeros; rows that
repeat an id are each a vector, and NULL ids come last, when the first vectors
are chosen, equal ids by their components; with fewer vectors than entries there
are only as many entries; equal entries stay apart, but only the first ever owns
a part; an error beyond a long is NULL, and so is the sum over its label; an
empty table gives no rows; further input columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows, written
from areaindex.session import BROADCAST_BYTES, join_null_safe

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of a block of vectors, and points of a leaf; the first bounds a task's memory.
BLOCK_VALUES = 1 << 18
LEAF = 32
_EXACT = 2.0**53
_LIMB = 32


def integers(vectors: list[list[float]], width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), filled up to ``width``: whole float64 numbers, or Python integers where those would not be exact."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    if not x.size or np.abs(x).max() * scale < 2.0**50:
        return np.floor(x * scale)
    whole = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        whole[at] = math.floor(float(v) * scale) if abs(v) < 2.0**40 else int(v) * scale
    return whole


@dataclass
class Tree:
    """Balls over points; ``order`` lists the points so that each ball is a range of it. Children come before parents."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def anchors(points: np.ndarray, number: int) -> np.ndarray:
    """The anchor that owns each point; a new anchor is the point furthest from its own."""
    owner = np.zeros(len(points), np.int64)
    places = [points[0]]
    distance = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    for j in range(1, number):
        far = int(distance.argmax())
        if distance[far] == 0:
            break
        apart = np.sqrt(((np.array(places) - points[far]) ** 2).sum(axis=1))
        near = np.flatnonzero(2 * distance > apart[owner])  # others are nearer to their anchor than half the way
        there = np.sqrt(((points[near] - points[far]) ** 2).sum(axis=1))
        take = there < distance[near]
        owner[near[take]], distance[near[take]] = j, there[take]
        places.append(points[far])
    return owner


class _Planter:
    """Builds one tree; nodes are numbered as they are made."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.nodes: list[tuple] = []

    def add(self, index: np.ndarray, left: int, right: int) -> int:
        own = self.points[index]
        total = own.sum(axis=0)
        centre = total / len(index)
        radius = math.sqrt(((own - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9)
        self.nodes.append((index, left, right, centre, radius, total))
        return len(self.nodes) - 1

    def merged(self, at: list[int], i: int) -> np.ndarray:
        """Radius of a ball around node ``at[i]`` and each node of ``at``."""
        size = np.array([len(self.nodes[k][0]) for k in at], float)
        centre, radius = np.array([self.nodes[k][3] for k in at]), np.array([self.nodes[k][4] for k in at])
        gap = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        share = size / (size + size[i])  # how far the joint centre lies from the first towards the other
        out = np.maximum(gap * share + radius[i], gap * (1 - share) + radius)
        out[i] = np.inf
        return out

    def plant(self, index: np.ndarray) -> int:
        if len(index) <= self.leaf:
            return self.add(index, -1, -1)
        owner = anchors(self.points[index], math.isqrt(len(index) - 1) + 1)
        groups = [index[owner == j] for j in range(owner.max() + 1)]
        if len(groups) == 1:  # all points are equal
            return self.add(index, -1, -1)
        open_nodes = [self.plant(g) for g in groups]
        reach = np.array([self.merged(open_nodes, i) for i in range(len(open_nodes))])
        while True:
            a, b = sorted(divmod(int(reach.argmin()), len(open_nodes)))
            one, other = open_nodes[a], open_nodes[b]
            node = self.add(np.concatenate([self.nodes[one][0], self.nodes[other][0]]), one, other)
            if len(open_nodes) == 2:
                return node
            open_nodes[a] = node
            del open_nodes[b]
            reach = np.delete(np.delete(reach, b, 0), b, 1)
            reach[a] = reach[:, a] = self.merged(open_nodes, a)


def plant(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of one part position; points too large for exact float64 arithmetic make a single leaf."""
    if points.dtype == object:
        n = len(points)
        bounds = np.array([0]), np.array([n]), np.array([-1]), np.array([-1])
        return Tree(np.arange(n), *bounds, np.zeros((1, points.shape[1])), np.array([np.inf]), points.sum(axis=0)[None])
    planter = _Planter(points, leaf)
    root = planter.plant(np.arange(len(points)))
    nodes = planter.nodes
    start, stop = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    stop[root] = len(points)
    for at in range(root, -1, -1):
        index, left, right = nodes[at][:3]
        if left >= 0:
            start[left], stop[left] = start[at], start[at] + len(nodes[left][0])
            start[right], stop[right] = stop[left], stop[at]
    return Tree(
        nodes[root][0], start, stop, *(np.array([n[i] for n in nodes]) for i in (1, 2, 3, 4, 5))
    )


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - book[None]) ** 2).sum(axis=2)


def settle(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Balls owned whole as (node, entry), and the entries of the points (index, entry) that were compared."""
    none = np.zeros(0, np.int64)
    width = max(points.shape[1], 1)
    largest = max((abs(v) for v in (points.max(initial=0), points.min(initial=0), book.max(), book.min())), default=0)
    if points.dtype == object or book.dtype == object or 8.0 * width * float(min(largest, 2**500)) ** 2 >= _EXACT:
        return [], tree.order, _squares(points.astype(object), book.astype(object))[tree.order].argmin(axis=1)
    norms = (book**2).sum(axis=1)
    apart = np.sqrt(_squares(book, book))
    slack = 1e-12 * 16 * width * (float(largest) + 1) ** 2
    distinct = np.array([not (book[:i] == book[i]).all(axis=1).any() for i in range(len(book))])
    frontier, listed = np.array([len(tree.start) - 1]), distinct[None]
    owned, leaves, lists = [], [none], [np.zeros((0, len(book)), bool)]
    while len(frontier):
        far = np.where(listed, norms - 2 * tree.centre[frontier] @ book.T, np.inf)
        best = far.argmin(axis=1)
        lead = far - far[np.arange(len(far)), best][:, None] - 2 * tree.radius[frontier][:, None] * apart[best]
        listed = listed & ~(lead > slack)
        whole = listed.sum(axis=1) == 1
        owned += zip(frontier[whole].tolist(), best[whole].tolist())
        leaf = ~whole & (tree.left[frontier] < 0)
        leaves.append(frontier[leaf])
        lists.append(listed[leaf])
        inner = ~whole & ~leaf
        listed = np.repeat(listed[inner], 2, axis=0)
        frontier = np.column_stack([tree.left[frontier[inner]], tree.right[frontier[inner]]]).ravel()
    at, lists = np.concatenate(leaves), np.concatenate(lists)
    if not len(at):
        return owned, none, none
    index = np.concatenate([tree.order[tree.start[i] : tree.stop[i]] for i in at.tolist()])
    may = np.repeat(lists, tree.stop[at] - tree.start[at], axis=0)
    return owned, index, np.where(may, norms - 2 * points[index] @ book.T, np.inf).argmin(axis=1)


def block_sums(tree: Tree, points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(entries, width + 1) Python integers: sums of the points that each entry owns, then their number."""
    owned, index, entry = settle(tree, points, book)
    out = np.zeros((len(book), points.shape[1] + 1), object)
    if owned:
        node, by = np.array(owned).T
        for e in np.unique(by).tolist():
            mine = node[by == e]
            out[e, :-1] += _whole(tree.sums[mine])
            out[e, -1] += int((tree.stop[mine] - tree.start[mine]).sum())
    for e in np.unique(entry).tolist():
        out[e, :-1] += _whole(points[index[entry == e]])
        out[e, -1] += int((entry == e).sum())
    return out


def _whole(rows: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    return (rows if rows.dtype == object else rows.astype(np.int64)).sum(axis=0).astype(object)


def block_codes(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, both exact."""
    owned, index, entry = settle(tree, points, book)
    code = np.zeros(len(points), np.int64)
    for node, e in owned:
        code[tree.order[tree.start[node] : tree.stop[node]]] = e
    code[index] = entry
    exact = points.dtype != object and book.dtype != object and np.abs(points).max(initial=0) + np.abs(book).max(initial=0) < 2.0**24
    kind = np.int64 if exact else object
    whole, against = (a.astype(np.int64).astype(kind) if a.dtype != object else a for a in (points, book))
    return code, ((whole - against[code]) ** 2).sum(axis=1)


def packed(trees: list[tuple[Tree, np.ndarray]]) -> bytes:
    """Trees with their points as bytes; arrays only, as classes that travel by value have no lasting name."""
    return pickle.dumps([(tuple(vars(tree).values()), points) for tree, points in trees])


def unpacked(blob: bytes) -> list[tuple[Tree, np.ndarray]]:
    return [(Tree(*arrays), points) for arrays, points in pickle.loads(blob)]


class Codebooks:
    """Entries of every part position, as Python integers: [part][entry][position]."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries

    def arrays(self) -> list[np.ndarray]:
        out = []
        for part in self.entries:
            large = max((abs(v) for e in part for v in e), default=0) >= 2**50
            out.append(np.array(part, object if large else np.float64))
        return out

    def digest(self) -> str:
        flat = ",".join(str(v) for part in self.entries for entry in part for v in entry)
        return hashlib.sha256(flat.encode()).hexdigest()

    def moved(self, totals: dict[tuple[int, int, int], int]) -> Codebooks:
        """Entries at the floor of sum over count; ``totals`` by (part, entry, position), the count last."""
        out = []
        for p, part in enumerate(self.entries):
            out.append([])
            for e, entry in enumerate(part):
                n = totals.get((p, e, len(entry)), 0)
                out[p].append([totals.get((p, e, i), 0) // n for i in range(len(entry))] if n else entry)
        return Codebooks(out)

    def decode(self, code: bytes, scale: int = SCALE) -> list[float]:
        """The vector that a code stands for."""
        return [(v + 0.5) / scale for part, e in zip(self.entries, code) for v in part[e]]


@dataclass
class Forest:
    """A written table of blocks, and the codebooks' first entries."""

    blocks: DataFrame
    key_type: str
    label_type: str
    first: Codebooks


def forest(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, scale: int = SCALE,
) -> Forest | None:
    """Blocks of the vectors with their trees; None where no vector is left."""
    key_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (key, label))
    values = vectors.select(col(key).alias("key"), col(label).alias("label"), col(vector).cast("array<double>").alias("vector"))
    limit = F.lit(float("inf"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    kept = values.where(F.col("vector").isNotNull() & sound)
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = parts * max(1, -(-longest // parts))
    share = width // parts
    start = kept.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    first = integers([r["vector"] for r in start], width, scale)
    books = Codebooks([[[int(v) for v in row[p * share : (p + 1) * share]] for row in first] for p in range(parts)])
    size = max(256, BLOCK_VALUES // width)

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []

        def block():
            keys, labels, given = zip(*held)
            whole = integers(given, width, scale)
            cut = [np.ascontiguousarray(whole[:, p * share : (p + 1) * share]) for p in range(parts)]
            return list(keys), list(labels), packed([(plant(x), x) for x in cut])

        for item in items:
            held.append(item)
            if len(held) == size:
                yield block()
                held = []
        if held:
            yield block()

    table = map_rows(kept, f"keys array<{key_type}>, labels array<{label_type}>, trees binary", rows, per_batch=1)
    return Forest(written(table, "forest"), key_type, label_type, books)


def moved(trees: Forest, books: Codebooks) -> Codebooks:
    """One round: every part is assigned, every entry goes to the floored mean of its parts."""
    arrays = books.arrays()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for (blob,) in items:
            sums = [block_sums(tree, points, book) for (tree, points), book in zip(unpacked(blob), arrays)]
            total = sums if total is None else [a + b for a, b in zip(total, sums)]
        for part, table in enumerate(total or ()):
            for (entry, position), value in np.ndenumerate(table):
                limb = 0
                while value:  # sums of any size travel as limbs, the last one signed
                    last = abs(value) < 1 << _LIMB
                    yield part, entry, position, limb, int(value if last else value & ((1 << _LIMB) - 1))
                    value, limb = 0 if last else value >> _LIMB, limb + 1

    sums = map_rows(trees.blocks.select("trees"), "part int, entry int, position int, limb int, value long", rows, at_once=1)
    totals: dict[tuple[int, int, int], int] = {}
    for r in sums.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():
        at = (r["part"], r["entry"], r["position"])
        totals[at] = totals.get(at, 0) + (r["value"] << (_LIMB * r["limb"]))
    return books.moved(totals)


def encode(trees: Forest, books: Codebooks) -> DataFrame:
    """(key, label, code, error) for every vector: one byte per part, and the summed squared distance."""
    arrays = books.arrays()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        for keys, labels, blob in items:
            codes, error = [], 0
            for (tree, points), book in zip(unpacked(blob), arrays):
                code, far = block_codes(tree, points, book)
                codes.append(code.astype(np.uint8))
                error = error + far.astype(object)
            code = np.column_stack(codes)
            for k, lab, c, e in zip(keys, labels, code, error):
                yield k, lab, c.tobytes(), int(e) if e < 1 << 63 else None

    return map_rows(trees.blocks, f"key {trees.key_type}, label {trees.label_type}, code binary, error long", rows, at_once=1)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, **shape: int
) -> tuple[DataFrame, Codebooks]:
    """((key, label, code, error, label_error), codebooks) after ``rounds`` rounds over all vectors."""
    trees = forest(vectors, key, vector, label, **shape)
    if trees is None:
        key_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (key, label))
        schema = f"key {key_type}, label {label_type}, code binary, error long, label_error long"
        return vectors.sparkSession.createDataFrame([], schema), Codebooks([])
    books = trees.first
    for _ in range(rounds):
        books = moved(trees, books)
    codes = written(encode(trees, books), "codes")
    complete = F.count("error") == F.count(F.lit(1))
    totals = written(codes.groupBy("label").agg(F.when(complete, F.try_sum("error")).alias("label_error")), "labels")
    small = 64 * totals.count() <= BROADCAST_BYTES
    return join_null_safe(codes, F.broadcast(totals) if small else totals, ["label"]), books
