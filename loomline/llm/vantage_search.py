"""Nearest neighbours through vantage-point trees, one for each shard, under a coarse tree that deals rows to shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.spark_io import cut, stored

K = 10
#: A part of the tree is left out if the least distance that the triangle inequality allows there, times this, is over the k-th found. 1: exact.
FACTOR = 2.0
#: The coarse tree is fitted on so many sampled rows at most, those with the least hashes; a leaf of it is to hold about so many rows.
SAMPLE_ROWS, SHARD_ROWS, LEAST_SAMPLE = 1 << 14, 8192, 32
#: A task holds a tree over rows of about so many bytes as doubles, and queries of about so many. A larger shard is dealt into parts, each with a tree.
PART_BYTES, QUERY_BYTES = 64 << 20, 8 << 20
LEAF_ROWS = 512
#: Distances that are computed at once.
_CHUNK = 1 << 21
_ROUNDING = 1e-9


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances, from the differences themselves."""
    apart = rows - point
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


@dataclass
class VantageTree:
    """Vantage points with the radius inside which a row goes left; a row lies in one leaf."""

    points: list[np.ndarray]
    radius: list[float]
    below: list[tuple[int, int]]  # inner nodes as 0 and above, leaves as -1 - leaf
    leaves: int

    @classmethod
    def grown(cls, rows: np.ndarray, enough: int, seed: int = 5) -> VantageTree:
        """A tree whose leaves hold ``enough`` of the rows at most, or rows that lie equally far from the vantage point."""
        out, pick = cls([], [], [], 0), np.random.default_rng(seed)

        def grow(at: np.ndarray) -> int:
            if len(at) > enough:
                tried = rows[pick.choice(at, min(4, len(at)), replace=False)]
                some = rows[pick.choice(at, min(256, len(at)), replace=False)]
                point = max(tried, key=lambda p: np.std(distances(some, p)))
                far = distances(rows[at], point)
                radius = float(np.median(far))
                if not (far > radius).any():
                    radius = float(far[far < radius].max(initial=-1.0))
                if radius >= 0:
                    here = len(out.points)
                    out.points.append(point), out.radius.append(radius), out.below.append((0, 0))
                    out.below[here] = grow(at[far <= radius]), grow(at[far > radius])
                    return here
            out.leaves += 1
            return -out.leaves

        grow(np.arange(len(rows)))
        return out

    def dealt(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        leaf, todo = np.zeros(len(rows), np.int32), [(0 if self.points else -1, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                leaf[at] = -1 - node
            elif len(at):
                inside = distances(rows[at], self.points[node]) <= self.radius[node]
                todo += [(self.below[node][0], at[inside]), (self.below[node][1], at[~inside])]
        return leaf

    def least(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf a distance that no row of the leaf is nearer than, by the triangle inequality."""
        out = np.zeros((len(queries), self.leaves))
        todo = [(0 if self.points else -1, np.zeros(len(queries)))]
        while todo:
            node, bound = todo.pop()
            if node < 0:
                out[:, -1 - node] = bound
                continue
            far, radius = distances(queries, self.points[node]), self.radius[node]
            rounding = _ROUNDING * (far + radius)
            todo.append((self.below[node][0], np.maximum(bound, far - radius - rounding)))
            todo.append((self.below[node][1], np.maximum(bound, radius - far - rounding)))
        return out


class Nearest:
    """The k nearest found so far of each query, nearest first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, within: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.size = np.einsum("ij,ij->i", queries, queries)
        self.score = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.within = within  # no more than the k-th distance over all rows, as far as it is known

    def reach(self) -> np.ndarray:
        return np.minimum(self.within, self.score[:, -1])

    def add(self, asking: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes rows in for the queries that ask. A product of matrices tells which come into question, the differences give the distance."""
        size = np.einsum("ij,ij->i", rows, rows)
        step = max(1, _CHUNK // max(1, len(rows)))
        for q in (asking[i : i + step] for i in range(0, len(asking), step)):
            about = self.size[q, None] + size[None] - 2 * (self.queries[q] @ rows.T)
            about[self.ids[q, None] == ids[None]] = np.inf
            slack = _ROUNDING * (self.size[q] + size.max(initial=0.0))
            most = self.reach()[q] ** 2
            if len(rows) > self.k:
                most = np.minimum(most, np.partition(about, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero((about <= (most + slack)[:, None]) & (about < np.inf))
            score = np.concatenate([distances(self.queries[q[i[s : s + 16384]]], rows[j[s : s + 16384]]) for s in range(0, len(i), 16384)] or [np.zeros(0)])
            self._merge(q[i], ids[j], score)

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(q)
        held = np.repeat(touched, self.k)
        q, ids, score = np.concatenate([held, q]), np.concatenate([self.found[touched].ravel(), ids]), np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((ids, score, q))
        first = np.searchsorted(q[order], touched)
        best = order[first[:, None] + np.arange(self.k)]
        self.found[touched], self.score[touched] = ids[best], score[best]


def search_part(rows: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    """The k nearest rows of one part for each query, through a tree over the part: first in the likeliest leaf, then wherever the bounds allow more."""
    if not rows.num_rows or not queries.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    ids, vectors = rows.column("id").to_numpy(), _matrix(rows.column("vector"))
    asked = Nearest(queries.column("id").to_numpy(), _matrix(queries.column("vector")), queries.column("within").to_numpy(), k)
    order = np.argsort(ids, kind="stable")  # the tree follows from the rows, not from the order in which they came
    ids, vectors = ids[order], vectors[order]
    tree = VantageTree.grown(vectors, LEAF_ROWS)
    leaf, least = tree.dealt(vectors), tree.least(asked.queries)
    likeliest = least.argmin(axis=1)
    for turn in ("likeliest", "others"):
        for n in range(tree.leaves):
            wanted = likeliest == n if turn == "likeliest" else likeliest != n
            asking = np.nonzero(wanted & (least[:, n] * factor <= asked.reach()))[0]
            if len(asking):
                asked.add(asking, ids[leaf == n], vectors[leaf == n])
    q, r = np.nonzero(asked.score < np.inf)
    return pa.table({"query_id": asked.ids[q], "vec_id": asked.found[q, r], "score": asked.score[q, r]})


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal lengths as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Whether a vector is not null, empty or zero and holds finite components alone."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _trees(held: DataFrame, shard_rows: int) -> dict[int, VantageTree]:
    """Of each vector size the coarse tree, from a bounded sample."""
    n = held.count()
    sample = held.orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE_ROWS).select("size", "vector").toArrow()
    enough = max(LEAST_SAMPLE, round(shard_rows * sample.num_rows / max(n, 1)))
    sizes = sample.column("size").to_numpy()
    return {int(s): VantageTree.grown(_matrix(sample.filter(pa.array(sizes == s)).column("vector")), enough) for s in np.unique(sizes)}


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for b in batches:
        sizes = b.column("size").to_numpy(zero_copy_only=False)
        for s in np.unique(sizes).tolist():
            part = b.filter(pa.array(sizes == s))
            yield s, part, _matrix(part.column("vector"))


def _met(rows: DataFrame, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score) of the queries (size, leaf, id, vector, within) and the rows of those leaves: blocks of queries meet parts of rows."""
    bytes_each = 8 * F.col("size")
    parts = rows.groupBy("size", "leaf").agg(F.ceil(F.count("*") * F.first(bytes_each) / PART_BYTES).cast("int").alias("parts"))
    blocks = queries.groupBy("size", "leaf").agg(F.ceil(F.count("*") * F.first(bytes_each) / QUERY_BYTES).cast("int").alias("blocks"))
    plan = cut(parts.join(blocks, ["size", "leaf"]))
    number = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    key = ["size", "leaf", "part", "block"]
    a = rows.join(plan, ["size", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "vector"), "parts").cast("int")).withColumn("block", every("blocks")).select(*key, "id", "vector")
    b = queries.join(plan, ["size", "leaf"]).withColumn("block", number("blocks")).withColumn("part", every("parts")).select(*key, "id", "vector", "within")
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(lambda x, y: search_part(x, y, k, factor), "query_id long, vec_id long, score double")


def search(table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each query the k nearest rows of ``table`` by Euclidean distance, ties to the smaller id.

    Ids are longs. Rows and queries whose id is null, or whose vector is null, empty, zero or holds null or non-finite
    components, take no part; a row is compared with queries of its vector's length. A query is not compared with rows
    of its own id. Repeated rows are candidates each; a query id that comes more than once asks with its least vector.
    Fewer candidates than k give fewer ranks, an empty table or no queries no rows. Other columns are ignored.
    Components are below 1e150, so that squares stay finite.

    A coarse tree, fitted on a bounded sample, deals every row to one shard. A query is searched in its own shard
    first, and then in each whose lower bound times ``factor`` is within the k-th distance found; so too with the
    leaves of the tree that is built over each part of a shard. With ``factor`` 1 the result is exact. A task holds
    one part and one block of queries; vectors move once for each block of queries that visits their shard.
    """
    kept = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    held = kept(table)
    trees = table.sparkSession.sparkContext.broadcast(_trees(held, shard_rows))
    fields = [held.schema[c] for c in ("id", "vector", "size")] + [T.StructField("leaf", T.IntegerType())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part, vectors in _by_size(batches):
            tree = trees.value.get(size)
            leaf = tree.dealt(vectors) if tree else np.zeros(len(vectors), np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], [f.name for f in fields])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, part, vectors in _by_size(batches):
            tree = trees.value.get(size)
            if not tree:
                continue
            open_ = tree.least(vectors) * factor <= part.column("within").to_numpy()[:, None]
            open_[np.arange(len(vectors)), part.column("leaf").to_numpy()] = False
            q, leaf = np.nonzero(open_)
            own = part.select(["id", "vector", "size"]).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(leaf.astype(np.int32)), part.column("within").take(pa.array(q))], [f.name for f in fields] + ["within"])

    rows = stored(held.mapInArrow(deal, T.StructType(fields)), "shards")
    asked = kept(queries).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))
    asked = stored(asked.mapInArrow(deal, T.StructType(fields)), "queries")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    home = stored(_met(rows, asked.withColumn("within", F.lit(float("inf"))), k, factor).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "home")
    known = home.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("within"))
    wide = asked.join(known, "id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    beyond = stored(wide.mapInArrow(others, T.StructType([*fields, T.StructField("within", T.DoubleType())])), "visits")
    found = home.drop("rank").unionByName(_met(rows, beyond, k, factor))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = K, factor: float = FACTOR) -> DataFrame:
    """``search`` with the rows as queries whose id is divisible by ``every``."""
    return search(table, table.where(F.col(id_col) % every == 0), id_col, vector_col, k, factor)
