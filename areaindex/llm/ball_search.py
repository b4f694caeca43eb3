"""Ranked lexical search: exact inner products over sparse ball trees.

A document is a sparse vector with one integer per term it shares with any of
the queries, a query one with an integer per term. The score is their inner
product. Blocks of documents are arranged in ball trees: a ball keeps the
centroid of its documents, the radius around it, its largest norm and, through
the centroid, the terms that occur in it. No document of a ball can score more
than the centroid's product plus the radius times the norm of the query on the
ball's terms, nor more than that norm times the largest norm; both are rounded
up. A query opens the balls of a block in the order of this bound and stops at
the first that cannot reach its k-th best score so far. In leaves scores are
computed exactly, in 64-bit integers.

Texts are read once, for counts of the terms that queries use; the counts give
the corpus figures, the vectors and the trees, which are written. A bounded
number of blocks is searched first, to give every query a score that k documents
reach; then all blocks are, and a task hands on only what is among its own best
k and reaches that score.

Queries are taken in blocks of a bounded number of bytes, whose terms are sent
to the tasks; documents and blocks have no bound.

Defined results: a NULL or empty text, or one without terms, is not counted and
never returned; a query without terms, or whose terms no document holds, gives
no rows; documents of equal score follow the id, NULL ids last; rows that repeat
an id are documents or queries of their own; fewer than k documents above score
0 are all returned; a term that each document holds may weigh 0; an empty table
gives no rows; further input columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaindex.llm.common import col, map_rows, written

BEST = 10
#: Text of one block of queries, term counts of one block of documents, blocks searched first, documents of a leaf.
QUERY_BYTES = 4 << 20
BLOCK_TERMS = 1 << 16
SEED_BLOCKS = 16
LEAF = 64
#: Bytes of trees that a task reads, and texts or counts that it turns into Python values at once.
TASK_BYTES = 16 << 20
AT_ONCE = 256
# ASCII letters and digits and everything beyond ASCII form terms, A-Z as small letters.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


@dataclass(frozen=True)
class Query:
    """``terms`` are numbers in the vocabulary of its block, ``weights`` those of the terms times their repeats."""

    number: int
    key: object
    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Rows:
    """Sparse rows, none of them empty: ``values`` and ``columns`` of row i from ``starts[i]`` to ``starts[i + 1]``."""

    values: np.ndarray
    columns: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, order: np.ndarray) -> Rows:
        size = np.diff(self.starts)[order]
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[order] - starts[:-1], size)
        return Rows(self.values[at], self.columns[at], starts)

    def times(self, vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * vector[self.columns], self.starts[:-1])


@dataclass
class BallTree:
    """Documents in the order of the leaves, and balls over ranges of them; the first ball is the root."""

    keys: list
    documents: Rows
    terms: np.ndarray  # the number in the vocabulary of each column
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    centroids: Rows

    def dump(self) -> tuple[list, bytes]:
        """Keys, and all else as bytes; arrays only, as classes that travel by value have no lasting name."""
        rest = {k: v for k, v in vars(self).items() if k != "keys"}
        return self.keys, pickle.dumps({k: tuple(vars(v).values()) if isinstance(v, Rows) else v for k, v in rest.items()})

    @staticmethod
    def load(keys: list, blob: bytes) -> BallTree:
        rest = pickle.loads(blob)
        return BallTree(keys, **{k: Rows(*v) if isinstance(v, tuple) else v for k, v in rest.items()})


def _halves(rows: Rows, squares: np.ndarray, centre: np.ndarray, distance: np.ndarray) -> np.ndarray | None:
    """Which documents go to the right: those nearer to the far end of the widest stretch. None where all are equal."""
    def far_from(i: int) -> np.ndarray:
        span = slice(rows.starts[i], rows.starts[i + 1])
        point = np.zeros(len(centre))
        point[rows.columns[span]] = rows.values[span]
        return squares + squares[i] - 2 * rows.times(point)

    one = far_from(int(distance.argmax()))
    other = int(one.argmax())
    if one[other] <= 1e-9 * squares.max():
        return None
    lead = one - far_from(other)
    right = lead > 0
    if not len(lead) / 16 <= right.sum() <= len(lead) * 15 / 16:  # a few far ones: halve, so that trees stay flat
        right = np.zeros(len(lead), bool)
        right[np.argsort(lead, kind="stable")[len(lead) // 2 :]] = True
    return right


def plant(keys: list, rows: Rows, leaf: int = LEAF) -> BallTree:
    """The ball tree of documents given by sparse rows over the vocabulary."""
    terms, columns = np.unique(rows.columns, return_inverse=True)
    rows = Rows(rows.values, columns.reshape(-1), rows.starts)
    order = np.arange(len(rows))
    squares = np.add.reduceat(rows.values.astype(float) ** 2, rows.starts[:-1])
    nodes: list[list] = []
    balls: list[tuple[np.ndarray, np.ndarray]] = []
    work = [(0, len(rows), -1, False)]
    while work:
        first, last, parent, on_right = work.pop()
        here = order[first:last]
        own, square = rows.take(here), squares[here]
        centre = np.bincount(own.columns, weights=own.values, minlength=len(terms)) / len(own)
        held = np.bincount(own.columns, minlength=len(terms)) > 0
        around = square + (centre**2).sum() - 2 * own.times(centre)
        slack = 1e-9 * (square.max() + (centre**2).sum())
        node = len(nodes)
        nodes.append([first, last, -1, -1, math.sqrt(max(around.max(), 0) + slack), math.sqrt(square.max()) * (1 + 1e-9)])
        balls.append((np.flatnonzero(held), centre[held]))
        if parent >= 0:
            nodes[parent][3 if on_right else 2] = node
        if last - first > leaf:
            right = _halves(own, square, centre, around)
            if right is not None:
                order[first:last] = np.concatenate([here[~right], here[right]])
                middle = last - int(right.sum())
                work += [(middle, last, node, True), (first, middle, node, False)]
    table = list(zip(*nodes))
    centroids = Rows(
        np.concatenate([b[1] for b in balls]), np.concatenate([b[0] for b in balls]).astype(np.int32),
        np.concatenate([[0], np.cumsum([len(b[0]) for b in balls])]),
    )
    documents = rows.take(order)
    return BallTree(
        [keys[i] for i in order.tolist()], Rows(documents.values, documents.columns.astype(np.int32), documents.starts), terms,
        *(np.array(c, np.int64) for c in table[:4]), *(np.array(c, float) for c in table[4:]), centroids,
    )


class Best:
    """The k best (score, key) of a query."""

    def __init__(self, k: int, reached: int = 1):
        self.k, self.least = k, max(reached, 1)
        self.rows: list[tuple] = []

    def add(self, scores: np.ndarray, keys: list, offset: int = 0) -> None:
        good = np.flatnonzero(scores >= self.least).tolist()
        if good:
            found = ((-int(scores[i]), keys[offset + i] is None, keys[offset + i]) for i in good)
            self.rows = heapq.nsmallest(self.k, [*self.rows, *found], key=_place)
            if len(self.rows) == self.k:
                self.least = max(self.least, -self.rows[-1][0])


def _place(row: tuple) -> tuple:
    return row if row[2] is not None else row[:2]


def bounds(tree: BallTree, weights: np.ndarray) -> np.ndarray:
    """At least the best score within each ball, for a query as weights over the tree's columns; 0 where none is positive."""
    share = weights.astype(float)
    norm = np.sqrt(np.add.reduceat((share**2)[tree.centroids.columns], tree.centroids.starts[:-1]))
    most = np.minimum(tree.centroids.times(share) + norm * tree.radius, norm * tree.norm)
    return np.where(norm > 0, most * (1 + 1e-9) + 1, 0)


def search(tree: BallTree, query: Query, scratch: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with one block; the number of leaves that were scored."""
    scratch[query.terms] = query.weights
    weights = scratch[tree.terms]
    scratch[query.terms] = 0
    if not weights.any():
        return 0
    most = bounds(tree, weights)
    open_balls, scored = [(-most[0], 0)], 0
    while open_balls:
        bound, node = heapq.heappop(open_balls)
        if -bound < best.least:
            break
        if tree.left[node] < 0:
            a, b = int(tree.first[node]), int(tree.last[node])
            starts = tree.documents.starts
            span = slice(starts[a], starts[b])
            products = tree.documents.values[span] * weights[tree.documents.columns[span]]
            best.add(np.add.reduceat(products, starts[a:b] - starts[a]), tree.keys, a)
            scored += 1
        else:
            for child in (int(tree.left[node]), int(tree.right[node])):
                if most[child] >= best.least:
                    heapq.heappush(open_balls, (-most[child], child))
    return scored


def counted(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, terms, counts) of every document with a term; only terms of the vocabulary are listed."""
    kind = docs.select(col(key)).schema[0].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in items:
            words = terms_of(t)
            if words:
                held = Counter(words)
                mine = sorted((vocabulary[w], held[w]) for w in held.keys() & vocabulary.keys())
                yield k, len(words), [m[0] for m in mine], [m[1] for m in mine]

    return map_rows(
        docs.select(col(key), col(text).cast("string")), f"key {kind}, n long, terms array<int>, counts array<long>", rows, per_batch=AT_ONCE, at_once=AT_ONCE
    )


def index(counts: DataFrame, n_documents: int, n_terms: int, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(block, keys, tree): blocks of documents that hold a term of the vocabulary."""
    kind = counts.schema["key"].dataType.simpleString()

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0

        def block():
            keys, sizes, terms, counts = zip(*held)
            tf = np.fromiter((c for cs in counts for c in cs), np.int64, size)
            lengths = np.array([len(t) for t in terms])
            spread = [100 - 75 + 75 * n * n_documents // n_terms for n in sizes]
            values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(spread, np.int64), lengths))
            columns = np.fromiter((t for ts in terms for t in ts), np.int64, size)
            return plant(list(keys), Rows(values, columns, np.concatenate([[0], np.cumsum(lengths)]))).dump()

        for item in items:
            held.append(item)
            size += len(item[2])
            if size >= block_terms:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    table = map_rows(
        counts.where(F.size("terms") > 0), f"keys array<{kind}>, tree binary", rows, per_batch=1, at_once=AT_ONCE
    )
    return table.withColumn("block", F.xxhash64("tree"))


def ranked(blocks: DataFrame, queries: list[Query], width: int, k: int, reached: dict[int, int] | None = None) -> DataFrame:
    """(query, rank, key, score): the best documents of the blocks for every query."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    reached = reached or {}

    def rows(items: Iterator[tuple]) -> Iterator[tuple]:
        best = [Best(k, reached.get(q.number, 1)) for q in queries]
        scratch = np.zeros(width, np.int64)
        for keys, blob in items:
            tree = BallTree.load(keys, blob)
            for query, held in zip(queries, best):
                search(tree, query, scratch, held)
        for query, held in zip(queries, best):
            for score, _, key in held.rows:
                yield query.number, key, -score

    found = map_rows(blocks.select("keys", "tree"), f"query int, key {kind}, score long", rows, at_once=1)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", k: int = BEST,
) -> DataFrame:
    """(item_key, rank, key, score): the k best documents of every item."""
    given = items.select(col(item_key).alias("item"), col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    n_bytes = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-n_bytes // QUERY_BYTES)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    out = None
    for part in range(n_blocks):
        chosen = given.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == part).collect()
        one = _rank_block(docs, sorted(chosen, key=lambda r: (str(r["item"]), r["text"])), item_kind, key, text, k)
        if one is not None:
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item {item_kind}, rank int, key {kind}, score long")
    return out.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def _rank_block(docs: DataFrame, items: list, item_kind: str, key: str, text: str, k: int) -> DataFrame | None:
    """(item, rank, key, score) for one block of queries; None where no document shares a term with them."""
    asked = [Counter(terms_of(r["text"])) for r in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*asked)))}
    if not vocabulary:
        return None
    counts = written(counted(docs, vocabulary, key, text), "counts")
    n_documents, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_documents:
        return None
    frequency = {r[0]: r[1] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for t, df in frequency.items()}
    queries = []
    for number, (row, held) in enumerate(zip(items, asked)):
        mine = sorted((vocabulary[w], n * weight[vocabulary[w]]) for w, n in held.items() if vocabulary[w] in weight)
        if mine:
            queries.append(Query(number, row["item"], *(np.array(c, np.int64) for c in zip(*mine))))
    if not queries:
        return None
    blocks = written(index(counts, n_documents, n_terms), "blocks")
    n_blocks, n_bytes = blocks.agg(F.count(F.lit(1)), F.sum(F.length("tree"))).first()
    blocks = blocks.repartition(1 + (n_bytes or 0) // TASK_BYTES, "block")
    reached: dict[int, int] = {}
    if n_blocks > 2 * SEED_BLOCKS:
        some = blocks.where(F.pmod("block", F.lit(n_blocks // SEED_BLOCKS)) == 0)
        full = ranked(some, queries, len(vocabulary), k).where(F.col("rank") == k)
        reached = {r["query"]: r["score"] for r in full.collect()}
    names = docs.sparkSession.createDataFrame([(q.number, q.key) for q in queries], f"query int, item {item_kind}")
    return ranked(blocks, queries, len(vocabulary), k, reached).join(F.broadcast(names), "query")
