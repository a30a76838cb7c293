"""Vectors as short codes: integer codebooks of each part, nearest entries found by VA-file filtering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.spark_io import stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Cells that a coordinate of the entries is quantised into.
CELL_BITS = 4
#: Integer components are below this in magnitude, so that the squared distances of 1,024 of them fit into 64 bits.
MOST = 1 << 25
_ROWS = 4096


class Cells:
    """The entries of one part's codebook, each coordinate quantised into cells of equal width with the least and greatest value in each."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        n, width = entries.shape
        self.entries = entries
        low, high = entries.min(axis=0), entries.max(axis=0)
        self.cell = ((entries - low) << bits) // (high - low + 1)
        self.low, self.high = np.zeros((width, 1 << bits), np.int64), np.zeros((width, 1 << bits), np.int64)
        for j in range(width):
            for c in np.unique(self.cell[:, j]):
                held = entries[self.cell[:, j] == c, j]
                self.low[j, c], self.high[j, c] = held.min(), held.max()

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the nearest entry, ties to the lower index, and its squared distance.

        A table for each query and coordinate holds how near and how far a cell can be. An entry's bounds are the sums
        over its cells; entries whose lower bound is above the least upper bound are out, the others are compared
        exactly.
        """
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(queries.shape[1]):
            q = queries[:, j, None]
            below, above = self.low[j] - q, q - self.high[j]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += np.take(near * near, self.cell[:, j], axis=1)
            upper += np.take(far * far, self.cell[:, j], axis=1)
        q, e = np.nonzero(lower <= upper.min(axis=1)[:, None])
        apart = queries[q] - self.entries[e]
        exact = np.einsum("ij,ij->i", apart, apart)
        start = np.searchsorted(q, np.arange(len(queries)))
        least = np.minimum.reduceat(exact, start)
        first = np.nonzero(exact == least[q])[0]
        best = first[np.searchsorted(q[first], np.arange(len(queries)))]
        return e[best], least


def assigned(integers: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (rows, parts) of the nearest entries and the squared distances summed over the parts, given each part's book."""
    width = books[0].entries.shape[1]
    code, error = np.zeros((len(integers), len(books)), np.uint8), np.zeros(len(integers), np.int64)
    for p, book in enumerate(books):
        code[:, p], off = book.nearest(integers[:, p * width : (p + 1) * width])
        error += off
    return code, error


def _integers(vector: pa.Array) -> np.ndarray:
    """floor(256 x) of vectors of equal lengths."""
    return np.floor(np.asarray(vector.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vector), -1) * SCALE).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, _ROWS):
            yield b.slice(start, _ROWS)


def sums(fit: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(slot, sum, count): over the vectors' parts assigned to an entry, of each of its components; slots are numbered by part, entry, component.

    Each task adds up its rows first and hands on one row per slot.
    """
    parts, entries, width = codebooks.shape
    held = fit.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        books = [Cells(c) for c in held.value]
        for b in _pieces(batches):
            integers = _integers(b.column(0))
            code, _ = assigned(integers, books)
            for p in range(parts):
                np.add.at(total[p], code[:, p], integers[:, p * width : (p + 1) * width])
                count[p] += np.bincount(code[:, p], minlength=entries)
        if count.any():
            each = np.repeat(count.ravel(), width)
            used = np.nonzero(each)[0]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used]), pa.array(each[used])], ["slot", "sum", "count"])

    found = fit.select("vector").mapInArrow(run, "slot long, sum long, count long")
    return found.groupBy("slot").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def fitted(fit: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, width) after ``rounds`` of assigning every row and replacing each used entry by the floor of its mean.

    They start as the parts of the rows with the smallest ids, ties by vector. The driver holds the codebooks and one
    sum per component of them, whatever the number of rows. ``fit`` (id, vector) has vectors of one length.
    """
    chosen = fit.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = _integers(chosen.column("vector").combine_chunks())
    codebooks = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        flat = codebooks.reshape(-1).copy()
        for slot, total, count in sums(fit, codebooks).collect():  # one row per component of the codebooks
            flat[slot] = total // count
        codebooks = flat.reshape(codebooks.shape)
    return codebooks


def _fits(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: (x.cast("double") * SCALE < MOST) & (x.cast("double") * SCALE > -MOST)), F.lit(False))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id_col, code, error, label_error, codebooks_sha256), one per vector that is not null and holds finite components alone.

    code has two hex digits per part: the index of the nearest entry in that part's codebook (``fitted``); error is
    the squared distance over all parts, in integers of 1/256. label_error sums it over rows of equal labels, null
    labels together; codebooks_sha256 names the codebooks. Repeated rows count each, zero vectors as any other, and a
    null id comes last in order. The parts are of equal length, so the length coded is that of the vector with the
    smallest id that the number of parts divides. Vectors of another length, and those with a component of 131,072 or
    more in magnitude, whose squares would not fit into 64 bits, stay as rows with null code and errors and shape no
    codebook. Other columns are ignored; an empty table gives no rows.
    """
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")).where(finite)
    divided = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0) & _fits(F.col("vector")))
    first = divided.orderBy(F.col("id").asc_nulls_last(), F.size("vector"), "vector").select(F.size("vector").alias("n")).first()
    length = first["n"] if first else -1
    fit = divided.where(F.size("vector") == length)
    rest = rows.where(~((F.size("vector") == length) & _fits(F.col("vector")))).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if first:
        codebooks = fitted(fit, parts, entries, rounds)
        held, name = table.sparkSession.sparkContext.broadcast(codebooks), hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = [Cells(c) for c in held.value]
            for b in _pieces(batches):
                code, error = assigned(_integers(b.column("vector")), books)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["id", "label", "code", "error"])

        kinds = dict(rows.dtypes)
        coded = fit.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long").unionByName(rest)
    else:
        coded, name = rest, hashlib.sha256(b"").hexdigest()
    coded = stored(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    shown = F.when(F.col("code").isNotNull(), F.col("label_error"))
    return out.select(F.col("id").alias(id_col), "code", "error", shown.alias("label_error"), F.lit(name).alias("codebooks_sha256"))
