"""Near-duplicate vectors by collision counting on one-dimensional projections, verified by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.spark_io import cut, stored
from loomline.operators.components import connected_components

THRESHOLD = 0.98
PROJECTIONS = 32
#: Half a window, in standard deviations of the difference of a pair at the threshold, where collisions are counted and where blocks are cut.
#: A pair at the threshold collides in a projection with a chance of 0.87; a cut parts it with one of 0.0002, closer pairs with less.
COUNT_SPREAD, CUT_SPREAD = 1.5, 3.5
#: Chance that a pair at the threshold itself collides too seldom; closer pairs have less.
MISS = 1e-6
BLOCK_ROWS = 4096
#: The cuts of the blocks come from so many sampled vectors for each block, and so many in all at most.
SAMPLE_PER_BLOCK, SAMPLE_ROWS = 64, 1 << 16
#: A block is cut no further where it has fewer sampled vectors, or where more of it than this share would go to one side.
LEAST_SAMPLE, LARGEST_SHARE = 32, 0.85
_STRIP = 256
_DEEPEST = 62


def directions(dimensions: int, projections: int = PROJECTIONS, seed: int = 17) -> np.ndarray:
    """Orthonormal random directions as columns, as many as asked for or as there are dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return (q * np.sign(np.diag(r)))[:, :projections]


def calibrated(dimensions: int, threshold: float = THRESHOLD, projections: int = PROJECTIONS, miss: float = MISS) -> tuple[float, float, int]:
    """Half the window in which collisions are counted, half that of the cuts, and the least count of collisions.

    Unit vectors at the threshold are sqrt(2 - 2 threshold) apart; in a random direction they differ by that over
    sqrt(dimensions) standard. In few dimensions a window is the whole distance, where no projection can miss. The
    count is the greatest that a pair at the threshold fails to reach with a chance under ``miss``.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    m = min(projections, dimensions)
    window, apart = (min(k * reach / math.sqrt(dimensions), reach) for k in (COUNT_SPREAD, CUT_SPREAD))
    p = math.erf(window * math.sqrt(dimensions) / reach / math.sqrt(2)) if 0 < window < reach else 1.0
    allowed = 0
    while 1 - sum(math.comb(m, k) * (1 - p) ** k * p ** (m - k) for k in range(allowed + 1)) > miss and allowed < m:
        allowed += 1
    return window + 1e-9, apart + 1e-9, m - allowed


def projected(vectors: np.ndarray) -> np.ndarray:
    """The unit vectors of the rows, on the directions."""
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None] @ directions(vectors.shape[1])


def linked(a: np.ndarray, b: np.ndarray, same: bool, threshold: float = THRESHOLD, copied_a: np.ndarray | None = None, copied_b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of pairs of a row of ``a`` and one of ``b`` with a cosine at the threshold or above, a strip of rows at a time; i < j if ``same``.

    The rows of ``b`` are sorted by each projection. A row of ``a`` is the query: its window is centred on its own
    value, and those whose rank lies in the window collide with it. Pairs with too few collisions are dropped, the
    others verified. Pairs of rows that are copies on a common cut belong to another block.
    """
    window, _, least = calibrated(a.shape[1], threshold)
    on_a, on_b = projected(a), projected(b)
    m = on_a.shape[1]
    rank, low, width = np.empty((m, len(b)), np.uint16), np.empty((m, len(a)), np.uint16), np.empty((m, len(a)), np.uint16)
    for p in range(m):
        order = np.argsort(on_b[:, p], kind="stable")
        rank[p, order] = np.arange(len(b))
        line = on_b[order, p]
        low[p] = np.searchsorted(line, on_a[:, p] - window, side="left")
        width[p] = np.searchsorted(line, on_a[:, p] + window, side="right") - low[p]
    size_a, size_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    for start in range(0, len(a), _STRIP):
        end, first = min(len(a), start + _STRIP), start if same else 0
        count = np.zeros((end - start, len(b) - first), np.uint8)
        for p in range(m):
            count += rank[p, None, first:] - low[p, start:end, None] < width[p, start:end, None]  # without sign: below the window wraps around
        i, j = np.nonzero(count >= least)
        i, j = i + start, j + first
        own = i < j if same else np.ones(len(i), bool)
        if copied_a is not None:
            own &= (copied_a[i] & copied_b[j]) == 0
        i, j = i[own], j[own]
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            close = np.einsum("ij,ij->i", a[x], b[y]) / (size_a[x] * size_b[y]) >= threshold
            if close.any():
                yield x[close], y[close]


def join_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row of each row's component, after rows x and y have been linked."""
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (deeper := root[root])).any():
            root = deeper


def tile(rows: pa.Table, threshold: float) -> pa.Table:
    """Of one block, or of two parts of one: for each vector the weight of those linked to it, and the least vector that links lead to."""
    side = rows.column("side").to_numpy()
    vectors = _matrix(rows.column("vector"))
    node, weight, copied = (rows.column(c).to_numpy() for c in ("node", "n", "copied"))
    order = np.lexsort((node, side))
    side, vectors, node, weight, copied = side[order], vectors[order], node[order], weight[order], copied[order]
    cutoff = int((side == 0).sum())
    same = rows.column("one")[0] == rows.column("two")[0]  # else two parts meet, and either may be empty
    shift = 0 if same else cutoff
    total, root = np.zeros(len(node), np.int64), np.arange(len(node))
    a, b = slice(0, cutoff), slice(shift, None)
    for x, y in linked(vectors[a], vectors[b], same, threshold, copied[a], copied[b]) if cutoff and shift < len(side) else ():
        np.add.at(total, x, weight[y + shift])
        np.add.at(total, y + shift, weight[x])
        root = join_roots(root, x, y + shift)
    hit = total > 0
    return pa.table({"node": node[hit], "links": total[hit], "root": node[root[hit]]})


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal lengths as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


@dataclass
class Cuts:
    """A tree of cuts along projections. Values up to a cut go left; those above it, and copies of those less than the window below it, go right.

    So two vectors that differ by less than the window in each projection share a leaf. They may share several, but on
    the way to one alone no cut has both of them as copies.
    """

    window: float
    axis: list[int]  # -1: a leaf
    at: list[float]
    right: list[int]  # the left child follows its parent

    @classmethod
    def grown(cls, sample: np.ndarray, window: float, enough: int) -> Cuts:
        """Cuts at medians of the sample, each along the projection that copies least, until a leaf holds ``enough`` of it."""
        out = cls(window, [], [], [])

        def grow(rows: np.ndarray, depth: int) -> None:
            here = len(out.axis)
            out.axis.append(-1), out.at.append(0.0), out.right.append(-1)
            if len(rows) <= enough or len(rows) < LEAST_SAMPLE or depth == _DEEPEST:
                return
            v = sample[rows]
            at = np.median(v, axis=0)
            left, right = (v <= at).mean(axis=0), (v > at - window).mean(axis=0)
            axis = int(np.argmin(np.maximum(left, right)))
            if max(left[axis], right[axis]) > LARGEST_SHARE:
                return
            out.axis[here], out.at[here] = axis, float(at[axis])
            grow(rows[v[:, axis] <= at[axis]], depth + 1)
            out.right[here] = len(out.axis)
            grow(rows[v[:, axis] > at[axis] - window], depth + 1)

        grow(np.arange(len(sample)), 0)
        return out

    def leaves(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows, cuts on whose way a row is a copy, as bits)."""
        todo = [(0, 0, np.arange(len(values)), np.zeros(len(values), np.int64))]
        while todo:
            here, depth, rows, copied = todo.pop()
            if not len(rows):
                continue
            axis = self.axis[here]
            if axis < 0:
                yield here, rows, copied
                continue
            v = values[rows, axis]
            left, right = v <= self.at[here], v > self.at[here] - self.window
            todo.append((self.right[here], depth + 1, rows[right], copied[right] | (left[right].astype(np.int64) << depth)))
            todo.append((here + 1, depth + 1, rows[left], copied[left]))


def _cuts(held: DataFrame, threshold: float, block_rows: int) -> dict[tuple, Cuts]:
    """Cuts of each label and vector size, from a sample whose size is bounded: those with the least hashes."""
    n = held.count()
    sample = min(SAMPLE_ROWS, -(-n * min(SAMPLE_PER_BLOCK, block_rows) // block_rows))
    schema = T.StructType([held.schema["label"], T.StructField("size", T.IntegerType()), T.StructField("values", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == size))
                found = projected(_matrix(part.column("vector"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("size"), pa.array(list(found), pa.list_(pa.float32()))], [f.name for f in schema.fields])

    chosen = held.orderBy("k1", "k2").limit(sample).select("label", "size", "vector").mapInArrow(run, schema).toArrow()
    groups: dict[tuple, list] = {}
    for label, size, values in zip(chosen.column("label").to_pylist(), chosen.column("size").to_pylist(), chosen.column("values")):
        groups.setdefault((label, size), []).append(values.values.to_numpy())
    enough = max(1, round(block_rows * sample / max(n, 1)))
    return {k: Cuts.grown(np.array(v, np.float64), calibrated(k[1], threshold)[1], enough) for k, v in groups.items()}


def _dealt(held: DataFrame, cuts: dict[tuple, Cuts], with_vectors: bool) -> DataFrame:
    """The vectors, once for each leaf that they are in: label, size, leaf and, if wanted, node, n, copied and vector."""
    fields = [held.schema[c] for c in ("label", "size")] + [T.StructField("leaf", T.IntegerType())]
    more = [held.schema["node"], held.schema["n"], held.schema["vector"]] if with_vectors else []
    schema = T.StructType(fields + more + [T.StructField("copied", T.LongType())] * with_vectors)
    shared = held.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(b.column("label").to_pylist(), b.column("size").to_pylist())):
                groups.setdefault(key, []).append(row)
            for key, rows in groups.items():
                part = b.take(pa.array(rows))
                tree = shared.value.get(key)
                found = tree.leaves(projected(_matrix(part.column("vector")))) if tree else [(0, np.arange(len(rows)), np.zeros(len(rows), np.int64))]
                for leaf, at, copied in found:
                    own = part.take(pa.array(at))
                    columns = [own.column("label"), own.column("size"), pa.array(np.full(len(at), leaf, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns + [own.column(f.name) for f in more] + [pa.array(copied)] * with_vectors, [f.name for f in schema.fields])

    return held.select("label", "size", *[f.name for f in more], *(() if with_vectors else ("vector",))).mapInArrow(run, schema)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one per row of ``table``.

    Two vectors are linked if their labels are equal and not null and their cosine is ``threshold`` or more. Vectors
    that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, are not
    linked. Equal vectors are compared once, with their number; repeated rows count each. component_id is the smallest
    id reachable, that of an unlinked vector its own; a null id is no smallest unless all are null. Other columns are
    ignored; an empty table gives no rows.

    The vectors of a label are dealt into blocks by cuts along projections, with copies where a linked vector may lie
    beyond the cut; in a block, collisions are counted over all projections (``linked``). A block with more than
    ``block_rows`` vectors, as where very many are alike, is dealt into parts by a hash, and each two parts meet in a
    task. A task holds two parts at most and gives back sums and a spanning forest, never pairs. Vectors move twice,
    as they are stored: when equal ones are brought together, and into their blocks.
    """
    if not 0 < block_rows < 1 << 16:
        raise ValueError("block_rows must be from 1 to 65,535: places in a block are 16-bit numbers")
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").select("id", "label", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2"))
    distinct = good.groupBy("label", "k1", "k2", "vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    held = stored(distinct.withColumn("size", F.size("vector")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    cuts = _cuts(held, threshold, block_rows)
    block = ["label", "size", "leaf"]
    large = cut(_dealt(held, cuts, False).groupBy(*block).count().where(F.col("count") > block_rows).select(*block, F.ceil(F.col("count") / block_rows).cast("int").alias("parts")))
    dealt = _dealt(held, cuts, True).join(large, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sided = met.select(*block, F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "n", "copied", "vector")
    found = cut(sided.groupBy(*block, "one", "two").applyInArrow(lambda t: tile(t, threshold), "node long, links long, root long"))
    roots = cut(connected_components(found.where("node <> root"), "node", "root"))
    thin = held.select("node", "label", "k1", "k2", "n", "first")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = roots.join(thin.select("node", "first"), "node")
    firsts = members.groupBy("root").agg(F.min("first").alias("component"))
    named = thin.join(links, "node", "left").join(members.join(firsts, "root").select("node", F.lit(True).alias("in"), "component"), "node", "left")
    component = F.when(F.col("in"), F.col("component")).otherwise(F.col("first"))
    told = named.select("label", "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component"))
    out = good.select("id", "label", "k1", "k2").join(told, ["label", "k1", "k2"]).select("id", "n_links", "component")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
